"""Helpers shared by the corpus operators: table access, lineage cuts, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.session import ensure_checkpoint_dir

#: Entries a per-task word memo may hold before it is emptied (memory bound).
MEMO_LIMIT = 250_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; executors may be lost afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder of the shared checkpoint folder, and read from there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def sample_ids(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows with the smallest hashes of ``id``; small, so it may be broadcast."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(size)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class WordHash(dict):
    """Memo of 64-bit word hashes, emptied when it reaches its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` touches ASCII only and ``bytes.split`` splits on exactly those six bytes."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_keys(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of the k-word shingles; a shorter text is one shingle of all its words."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    key = np.full(n - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        odd = _GOLDEN
        for t in range(k):
            key += hashes[t:n - k + 1 + t] * odd
            odd = odd * _U(0xD1342543DE82EF95) | _U(1)
    return np.unique(mix64(key))
