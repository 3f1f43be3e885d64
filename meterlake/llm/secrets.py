"""Secret scans with multipart credential linking, on built-in functions only.

Strong spans (password assignments, access identifiers, long hex strings) are always
reported. Weak candidates (other identifiers, mixed-case key strings, endpoints) are
reported only when a complementary part lies within ``scope`` code points in the same
text. The parts meet in an interval join: each text is cut into blocks of ``scope`` code
points, the parts of a block are reduced to their extent per part before the shuffle, and
a weak candidate is joined with its own and the two neighbouring blocks, so no pair list
of a text is ever built.

Defined results: NULL and empty texts have no spans; repeated rows each get the full
result; a NULL id is kept; spans count code points, end exclusive; only the id and the
text column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut
from meterlake.llm.native import SPAN, match_spans

#: Kinds in the order of listing.
KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
#: Part of a credential that each kind is: 0 identifier, 1 secret, 2 endpoint.
PARTS = (1, 0, 1, 0, 1, 2)

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: Everything of an assignment before its value.
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENT = r"(?:ASIA|AIDA|AROA|AGPA|ANPA|ABIA|ACCA)[A-Z0-9]{12,}"
TOKEN = r"[A-Za-z0-9+/=_-]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"

SCOPE = 200


def strong_spans(text: Column) -> list[Column]:
    """Spans of the three strong kinds. Runs that are too short are dropped after the match,
    so that what they consumed cannot match again; maximal hex runs allow the shorter form."""
    return [
        match_spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= 12),
        match_spans(text, ACCESS, 1, lambda m: F.length(m) >= 18),
        match_spans(text, HEX.replace("+", "{16,}"), 2),
    ]


def weak_spans(text: Column) -> list[Column]:
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    return [match_spans(text, IDENT, 3), match_spans(text, TOKEN, 4, mixed), match_spans(text, ENDPOINT, 5)]


def _part(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PARTS]), rank + 1)


def link_parts(found: DataFrame, scope: int) -> DataFrame:
    """key, linked: the weak spans of each text that have a complementary part in scope."""
    every = found.where(F.size("weak") > 0).select("key", F.explode(F.concat("strong", "weak")).alias("s")).select("key", "s.*") \
        .withColumn("part", _part(F.col("rank")))
    # a part reaches the blocks of its start and of its end
    extent = every.select("key", "part", "start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("block")) \
        .groupBy("key", "block", "part").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = every.where(F.col("rank") >= 3)
    asked = weak.withColumn("block", F.explode(F.sequence(
        F.floor((F.col("start") - scope - 1) / scope), F.floor((F.col("end") + scope) / scope))))
    met = asked.join(extent.withColumnRenamed("part", "other"), ["key", "block"]).where(F.col("part") != F.col("other"))
    own = (F.col("block") >= F.floor(F.col("start") / scope)) & (F.col("block") <= F.floor((F.col("end") - 1) / scope))
    after = (F.col("block") > F.floor((F.col("end") - 1) / scope)) & (F.col("first") - F.col("end") <= scope)
    before = (F.col("block") < F.floor(F.col("start") / scope)) & (F.col("start") - F.col("last") <= scope)
    return met.where(own | after | before).groupBy("key").agg(
        F.collect_set(F.struct("start", "rank", "end")).alias("linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, strong, linked: arrays of (start, rank, end); rank indexes ``KINDS``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", F.concat(F.xxhash64("t").cast("string"), F.lit(":"), F.crc32(F.col("t").cast("binary")).cast("string"),
                           F.lit(":"), F.length("t").cast("string"), F.lit(":"),
                           F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        F.array_sort(F.concat(*strong_spans(F.col("t")))).alias("strong"), F.concat(*weak_spans(F.col("t"))).alias("weak"))
    found = cut(found)
    linked = link_parts(found, scope)
    return found.join(linked, "key", "left").select(
        "doc_id", "strong", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda rank: F.size(F.filter("strong", lambda s: s["rank"] == rank)).cast("long")
    return scan_secrets(docs, **kw).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("strong", "linked"))).alias("spans"))


def _sql_kind(kind: str, pattern: str, keep: str, rank: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT row_id, {rank} AS rank, e - length(m) AS s, e FROM (
      SELECT row_id, m, sum(length(g) + length(m)) OVER (PARTITION BY row_id ORDER BY i) AS e FROM (
        SELECT row_id, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g, unnest(range(len(ms))) AS i FROM (
          SELECT row_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d))) WHERE {keep}"""


def oracle(scope: int = SCOPE) -> str:
    """The same report in DuckDB SQL: plain interval comparison of all parts of a text."""
    head = ASSIGN_HEAD.replace("'", "''")
    mixed = "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
    kinds = [(ASSIGN, f"length(regexp_replace(m, '{head}', '')) >= 12"), (ACCESS, "length(m) >= 18"),
             (HEX.replace("+", "{16,}"), "true"), (IDENT, "true"), (TOKEN, mixed), (ENDPOINT, "true")]
    every = " UNION ALL ".join(_sql_kind(KINDS[i], p, k, i) for i, (p, k) in enumerate(kinds))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    part = "[" + ", ".join(map(str, PARTS)) + "]"
    text = f"string_agg(({names})[rank + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank, e)"
    return f"""WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({every}),
    linked AS (SELECT w.row_id, w.rank, w.s, w.e FROM spans w WHERE w.rank >= 3 AND EXISTS (
      SELECT 1 FROM spans o WHERE o.row_id = w.row_id AND ({part})[o.rank + 1] <> ({part})[w.rank + 1]
        AND o.s - w.e <= {scope} AND w.s - o.e <= {scope})),
    base AS (SELECT * FROM spans WHERE rank < 3),
    b AS (SELECT row_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
      {text} AS txt FROM base GROUP BY row_id),
    a AS (SELECT row_id, {text} AS txt FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY row_id)
    SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
      sha256(coalesce(b.txt, '')) AS base_sha256, coalesce(a.txt, '') AS spans
    FROM d LEFT JOIN b USING (row_id) LEFT JOIN a USING (row_id)"""
