"""The digests of the piece codec come from ids, byte spans and decode(ids), checked against the sentencepiece library."""
import hashlib

import numpy as np
import pytest
import sentencepiece

from meterlake.llm import registry
from meterlake.llm import sentencepiece_codec as sc

TEXTS = ["hé  wörld 😀x", " lead", "▁ mark", "<s> a\u0000b", "tab\there", "", "漢字 ☃ 한국어 \U00020000", "é ", "   ", "word " * 900, "x" * 3000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_spans(lib, text):
    """(id, begin, end) from the library's own spans; a character of byte pieces is dealt out byte by byte."""
    out, at = [], 0
    for p in lib.encode(text, return_type="proto").pieces:
        out.append((p.id, at, at + 1) if lib.is_byte(p.id) else (p.id, p.begin, p.end))
        at = out[-1][2]
    return out


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=registry.piece_model())


def test_query_reports_the_spans_of_its_pieces(spark, lib):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in sc.token_digests(docs, registry.piece_model()).collect()}
    pieces = sc.encode_documents(docs, registry.piece_model(), decoded=True)
    for r in pieces.withColumn("back", sc.decode_udf(registry.piece_model())("pieces.ids")).collect():
        want = brute_spans(lib, r.text or "")
        ids, begins, ends = ([w[k] for w in want] for k in range(3))
        assert (r.pieces.ids, r.pieces.begins, r.pieces.ends) == (ids, begins, ends) and ids == lib.encode(r.text or "")
        assert r.back == r.pieces.decoded == lib.decode(ids)
        join = lambda x: ",".join(map(str, x))
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), sha(join(ids)), sha(lib.decode(ids)), sha(f"{join(begins)}|{join(ends)}"))


def test_small_batches_and_an_emptied_memo(spark, lib, monkeypatch):
    monkeypatch.setattr(sc, "MEMO_LIMIT", 3)
    codec = sc._codec(registry.piece_model())
    sizes = np.array(list(map(len, TEXTS)))
    cuts = list(sc._slices(sizes, 20))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(TEXTS))) and len(cuts) > 4
    found = [[]]
    for a, b in cuts:
        ids, begins, ends, off = codec.encode(TEXTS[a:b])
        rows = list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))
        found += [rows[i:j] for i, j in zip(off, off[1:])]
    assert found[1:] == [brute_spans(lib, t) for t in TEXTS]


def test_any_ids_decode_as_the_library_decodes_them(lib):
    codec, rng = sc._codec(registry.piece_model()), np.random.default_rng(5)
    blank, the = lib.piece_to_id("▁"), lib.piece_to_id("▁the")
    lists = [[], [0, the], [1, the], [1, blank, 1, the], [blank, the], [229, 153], [229, 153, the], [258, 229, 43], [the, 0, 0], [68, the], [258] * 3000]
    lists += [rng.integers(0, 400, 12).tolist() for _ in range(300)] + [rng.integers(3, 32000, 12).tolist() for _ in range(300)]
    assert [codec.decode(x) for x in lists] == [lib.decode(x) for x in lists]
    plain = [x for x in lists if x and min(x) > 258]
    for some in (lists, plain):
        flat, off = np.array([i for x in some for i in x], np.int64), sc._offsets(list(map(len, some)))
        assert codec.decode_all(flat, off).to_pylist() == [lib.decode(x) for x in some]


def test_unknown_pieces_cover_all_their_characters():
    """A model without byte pieces joins neighbouring unknown characters into one piece."""
    with open(registry.piece_model(), "rb") as f:
        fields = list(sc._fields(f.read()))
    kept = [v for n, v in fields if n == 1 and dict(sc._fields(v)).get(3, 1) != 6]
    norm = [v for n, v in fields if n == 3]
    trainer = b"\x18\x02"  # model type: byte pair merges
    model = b"".join([sc._bytes_field(1, v) for v in kept] + [sc._bytes_field(2, trainer)] + [sc._bytes_field(3, v) for v in norm])
    own, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sc.Codec(model)
    for text in ("a \U00020000\U00020001b \U00020002", "\U00020000", "plain"):
        assert codec.spans(text) == brute_spans(own, text)
        assert codec.decode([i for i, *_ in codec.spans(text)]) == own.decode(own.encode(text))
