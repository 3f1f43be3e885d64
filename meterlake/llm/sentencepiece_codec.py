"""SentencePiece encoding with byte offsets into the original text, and decoding.

The normaliser is read from the model file: at each position the longest key of the
compiled character map (a double-array trie) is replaced, every byte of the normalised
text remembers the original byte span it came from, whitespace is escaped, and a dummy
prefix is added as the model asks. Pieces are then projected to original byte spans.

No piece of a model may hold a whitespace mark behind another character (checked when the
model is read), so merges never cross a word start and each word is segmented on its own.
A bounded per-task memo keeps the pieces of seen words; unseen words of a batch are
segmented by the sentencepiece library with the normaliser switched off, since ours has
run. Models that break the rule, or that hold user-defined pieces, are segmented text by text.

The digests are columns over what the operator returns: ids, spans and the text that the ids
decode to. Texts are taken in batches of about ``BATCH`` bytes, each as flat arrays, and leave
the worker batch by batch, so the arrays in memory do not grow with the rows of an Arrow batch.

The tables of the model file are read from ``model_path`` in every task: give a path that
every executor has, as for the public tokenizer files.

Defined results: NULL and empty texts have no pieces and decode to ''; any other character
is covered by byte pieces, so encoding never fails; only the text column is read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import unused

SPACE = "▁"
#: Words, and characters of words, a per-task memo may hold before it is emptied.
MEMO_LIMIT, MEMO_CHARS = 200_000, 20_000_000
#: Bytes of text (or ids) that are taken at once; one longer text is a batch of its own.
BATCH = 1_000_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = s = 0
    while True:
        x = b[i]
        i += 1
        v |= (x & 127) << s
        s += 7
        if x < 128:
            return v, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Protobuf wire format: (field number, integer or bytes)."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i:i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i:i + n], i + n
        yield key >> 3, v


def _bytes_field(number: int, body: bytes) -> bytes:
    out, n = bytearray([number << 3 | 2]), len(body)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out) + body


def read_charsmap(blob: bytes) -> dict[bytes, bytes]:
    """All (key, replacement) pairs of a compiled character map: trie size, trie units, replacements."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size:]
    child = lambda unit: (unit >> 10) << ((unit & 512) >> 6)  # noqa: E731  offset to the children of a unit
    out, todo = {}, [(0, b"")]
    while todo:
        node, key = todo.pop()
        base = node ^ child(units[node])
        if units[node] >> 8 & 1:
            at = units[base] & 0x7FFFFFFF
            out[key] = texts[at:texts.index(0, at)]
        for c in range(1, 256):
            to = base ^ c
            if to < len(units) and units[to] & 0x800000FF == c:
                todo.append((to, key + bytes([c])))
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for every i, one after another."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _offsets(sizes) -> np.ndarray:
    """Where each of the parts laid one after another starts, and the end of the last."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


def _lossy(run: bytes) -> str:
    """Bytes as text; like the library, one replacement character for each byte that starts no character."""
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as e:
            out.append(run[:e.start].decode() + "\ufffd" * (e.end - e.start))
            run = run[e.end:]
    return "".join(out)


class Codec:
    """Normaliser, segmentation and decoder of one model file."""

    def __init__(self, model: bytes):
        spec, pieces = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}, []
        for number, v in _fields(model):
            if number == 1:
                f = dict(_fields(v))
                pieces.append((f.get(1, b"").decode(), f.get(3, 1)))
            elif number == 3:
                spec |= dict(_fields(v))
        self.charsmap = read_charsmap(spec[2])
        self.first = {k[0] for k in self.charsmap}
        self.longest = max(map(len, self.charsmap), default=0)
        self.prefix, self.squeeze, self.escape = bool(spec[3]), bool(spec[4]), bool(spec[5])
        self.lib = sentencepiece.SentencePieceProcessor()
        # the same vocabulary with an identity normaliser that adds, removes and escapes nothing
        self.lib.LoadFromSerializedProto(b"".join(_bytes_field(n, v) for n, v in _fields(model) if n == 1)
                                         + b"".join(_bytes_field(n, v) for n, v in _fields(model) if n == 2)
                                         + _bytes_field(3, _bytes_field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"))
        mark = SPACE if self.escape else " "
        self.word = re.compile(f"{mark}*[^{mark}]+|{mark}+")
        self.by_word = not any(mark in p.lstrip(mark) or kind == 4 for p, kind in pieces)
        self.surface = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else
                        b" \xe2\x81\x87 " if kind == 2 else p.replace(SPACE, " ").encode() for p, kind in pieces]
        self.is_byte = [kind == 6 for _, kind in pieces]
        self.special = [kind in (2, 3) for _, kind in pieces]
        self.unknown = next((i for i, (_, kind) in enumerate(pieces) if kind == 2), -1)
        #: normalised bytes under each id (an unknown piece has no fixed number)
        self.width = np.array([1 if kind == 6 else len(p.encode()) for p, kind in pieces], np.int32)
        self.letters = np.frombuffer(b"".join(self.surface), np.uint8)
        self.letter_at = _offsets(list(map(len, self.surface)))
        self.plain = ~np.array(self.special, bool)
        self.blank = np.array([s[:1] == b" " for s in self.surface], bool) & self.plain
        self.forget()

    def forget(self) -> None:
        """Empty the memo: words by number, and the pieces of all numbered words one after another."""
        self.memo: dict[str, int] = {}
        self.held = 0
        self.ids, self.widths, self.starts = np.empty(0, np.int32), np.empty(0, np.int32), _offsets([])

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text and, for each of its bytes and its end, the original byte offset
        (None: the offsets follow from the text alone, as nothing was mapped or removed)."""
        if not self.charsmap and not self.squeeze:
            text = text if not text or not self.prefix else " " + text
            return (text.replace(" ", SPACE) if self.escape else text), None
        raw, out, at, i = text.encode(), bytearray(), [], 0
        while i < len(raw):
            n = next((n for n in range(min(self.longest, len(raw) - i), 0, -1) if raw[i:i + n] in self.charsmap), 0) \
                if raw[i] in self.first else 0
            if n:
                new = self.charsmap[raw[i:i + n]]
            else:
                n = 1 if raw[i] < 128 else 2 if raw[i] < 224 else 3 if raw[i] < 240 else 4
                new = raw[i:i + n]
            if self.squeeze:
                while new[:1] == b" " and (not out or out[-1:] == b" "):
                    new = new[1:]
            out += new
            at += [i] * len(new)
            i += n
        if self.squeeze:
            while out[-1:] == b" ":
                del out[-1:]
                end = at.pop()
                i = end
        at.append(i if out else 0)
        if self.prefix and out:
            out, at = b" " + out, [at[0], *at]
        if not self.escape:
            return out.decode("utf-8", "replace"), at
        wide = []
        for b, a in zip(out, at, strict=False):
            wide += [a] * (3 if b == 32 else 1)
        return out.decode("utf-8", "replace").replace(" ", SPACE), [*wide, at[-1]]

    def words(self, norm: str) -> list[str]:
        """The normalised text cut before every run of whitespace marks."""
        return self.word.findall(norm)

    def aligned(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Normalised texts; the original byte offset of every normalised byte and of each text's
        end, one text after another; where each text's offsets start."""
        found = [self.normalise(t) for t in texts]
        norms = [t for t, _ in found]
        if self.charsmap or self.squeeze:
            at = np.fromiter(chain.from_iterable(a for _, a in found), np.int32)
            return norms, at, _offsets([len(a) for _, a in found])
        # nothing was mapped or removed: a blank became a mark of three bytes, and one may have been put in front
        lead = b" " if self.prefix else b""
        parts = [lead + t.encode() + b"\0" if t else b"\0" for t in texts]  # the last byte stands for the end
        first = _offsets(list(map(len, parts)))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(first[:-1], np.diff(first)).astype(np.int32)
        wide = np.where((raw == 32) & self.escape, len(SPACE.encode()), 1)
        return norms, np.repeat(np.maximum(place - len(lead), 0), wide), _offsets(wide)[first]

    def learn(self, words: list[str]) -> None:
        """Segment words and add their pieces to the memo."""
        ids, widths, sizes = [self.ids], [self.widths], []
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            found = self.lib.encode(some, num_threads=1)
            flat = np.fromiter(chain.from_iterable(found), np.int32)
            wide = self.width[flat]
            if (flat == self.unknown).any():  # one unknown piece may stand for several characters
                wide = np.fromiter((len(p.surface.encode()) if p.id == self.unknown else self.width[p.id] for w in some
                                    for p in self.lib.encode(w, return_type="proto").pieces), np.int32)
            self.memo.update(zip(some, range(len(self.memo), len(self.memo) + len(some)), strict=True))
            ids.append(flat)
            widths.append(wide)
            sizes += map(len, found)
        self.ids, self.widths = np.concatenate(ids), np.concatenate(widths)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.array(sizes, np.int64))])

    def segment(self, norms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces of the normalised texts, the normalised bytes under each, and where each text's pieces start."""
        cut = [self.words(t) if self.by_word else [t] * bool(t) for t in norms]
        words = list(chain.from_iterable(cut))
        unseen = set(words).difference(self.memo)
        self.held += sum(map(len, unseen))
        if len(self.memo) + len(unseen) > MEMO_LIMIT or self.held > MEMO_CHARS:
            self.forget()
            unseen = set(words)
            self.held = sum(map(len, unseen))
        if unseen:
            self.learn(list(unseen))
        number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        first, count = self.starts[number], self.starts[number + 1] - self.starts[number]
        at = _ranges(first, count)
        return self.ids[at], self.widths[at], _offsets(count)[_offsets(list(map(len, cut)))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, their begins and ends in bytes of their original text, and where each text's pieces start."""
        norms, at, at_off = self.aligned(texts)
        ids, wide, off = self.segment(norms)
        total = _offsets(wide)
        own = np.arange(len(texts) + 1)  # one offset for the end of each text
        if not np.array_equal(total[off], at_off - own):
            raise ValueError("the pieces of a text do not cover it")
        own = np.repeat(own[:-1], np.diff(off))
        begins, ends = at[total[:-1] + own], at[total[1:] + own]
        return ids, begins, np.maximum(begins, ends), off

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece, in bytes of the original text."""
        ids, begins, ends, _ = self.encode([text])
        return list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): byte pieces join to characters, the text loses its dummy blank."""
        out, run = [], bytearray()
        surface, is_byte = self.surface, self.is_byte
        start = self.prefix or self.squeeze
        for i in ids:
            if is_byte[i]:
                run += surface[i]
                continue
            if run:
                out.append(_lossy(bytes(run)))
                run = bytearray()
                start = False
            s = surface[i].decode()
            if start and not self.special[i] and s[:1] == " ":
                s = s[1:]
                start = self.squeeze
            start = start and not s
            out.append(s)
        if run:
            out.append(_lossy(bytes(run)))
        return "".join(out)

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """``decode`` of lists of ids laid one after another."""
        if not self.squeeze and self.plain[ids].all():
            first, count = self.letter_at[ids], self.letter_at[ids + 1] - self.letter_at[ids]
            if self.prefix:
                heads = off[:-1][np.diff(off) > 0]
                first[heads] += self.blank[ids[heads]]
                count[heads] -= self.blank[ids[heads]]
            data = self.letters[_ranges(first, count)]
            ends = pa.array(_offsets(count)[off], pa.int64())
            out = pa.LargeStringArray.from_buffers(len(off) - 1, ends.buffers()[1], pa.py_buffer(data))
            try:
                out.validate(full=True)
                return out
            except pa.ArrowInvalid:  # byte pieces that are no characters
                pass
        return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)], pa.large_string())


def _codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows that hold about ``most`` together."""
    total = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def encode_udf(path: str, decoded: bool = False):
    """text -> ids and original byte spans of every piece (``decoded``: and the text that these ids
    decode to, so that they need not travel to a second Python worker for it)."""
    @F.arrow_udf("ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes, BATCH):
                ids, begins, ends, off = codec.encode([t or "" for t in batch[a:b].to_pylist()])
                cols = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins, ends)]
                if decoded:
                    cols.append(codec.decode_all(ids, off).cast(pa.string()))
                yield pa.StructArray.from_arrays(cols, names=["ids", "begins", "ends", "decoded"][:len(cols)])
    return encode


def decode_udf(path: str):
    """ids -> text."""
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes, BATCH):
                ids = batch[a:b].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield codec.decode_all(ids, _offsets(sizes[a:b])).cast(pa.string())
    return decode


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", result: str = "pieces", decoded: bool = False) -> DataFrame:
    """``docs`` with a struct column ``result``: ids, begins, ends (bytes of the original text) and, if asked, decoded."""
    return docs.withColumn(result, encode_udf(path, decoded)(F.col(text_col)))


def digest_columns(pieces: str) -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of a column of ``encode_documents(..., decoded=True)``."""
    return [F.size(f"{pieces}.ids").cast("long").alias("n_tokens"), F.sha2(_joined(f"{pieces}.ids"), 256).alias("ids_sha256"),
            F.sha2(f"{pieces}.decoded", 256).alias("decoded_sha256")]


def _joined(numbers: str) -> Column:
    return F.array_join(F.col(numbers).cast("array<string>"), ",")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, and spans_sha256: the decimal begins
    of all pieces joined by commas, a bar, and their ends likewise."""
    pieces = unused(docs, "pieces")
    spans = F.concat(_joined(f"{pieces}.begins"), F.lit("|"), _joined(f"{pieces}.ends"))
    return encode_documents(docs, path, text_col, pieces, decoded=True).select(
        F.col(id_col).alias("doc_id"), *digest_columns(pieces), F.sha2(spans, 256).alias("spans_sha256"))
