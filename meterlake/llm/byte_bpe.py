"""Byte-level BPE ids as the ``tokenizers`` library gives them, at the speed of ``tiktoken``.

The vocabulary file is read once per task; its path is a parameter. Ids of its merged bytes
are merge ranks, so ``tiktoken`` gives the same ids from the same file. Texts that hold the
string of a special token and very long ones go through the library itself.
"""

from __future__ import annotations

import json

import numpy as np

#: The split of the byte-level pre-tokeniser.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text goes through the library itself.
LONG = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """character -> byte of the byte-level notation: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``plain``: the strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = [] if plain else sorted(special)
        of, vocab = byte_alphabet(), spec["model"]["vocab"]
        ranks = {bytes(of[c] for c in w): i for w, i in vocab.items() if w not in special}
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes: list[bytes] = [b""] * self.size
        for w, i in ranks.items():
            self.bytes[i] = w
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text (uint32), no special tokens added."""
        if len(text) >= LONG or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)
