"""Meter file scans (A1-A4, A7) and normalisation into ``meter_readings``.

Files are read by column *name*: CSV paths are grouped by header line and every group is
scanned with its own schema, so files may order or omit columns as they like. Values are cast with ``try_cast`` so
a bad cell becomes NULL instead of failing the job, and time strings are parsed
by a list of formats, then by Spark's ISO cast. Lines with too many or too few cells and rows
without a meter or a readable time go to a rejects frame, with the reason, the file and the line.
Many files / a directory / a glob form one fleet: ``meter_id`` comes from a
column or from the file name.
"""

from __future__ import annotations

import csv
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.derive import interval_energy
from meterlake.functions.numeric import nan_to_null
from meterlake.operators.profile import data_range, null_counts, profile_stats
from meterlake.plans.ordered import sequential
from meterlake.schema import MEASURES, TIME_FORMATS

#: Column with the text of a line whose cells do not match its file's header.
CORRUPT = "_corrupt"
#: Bits of a row's place in its file within ``seq``.
_PLACE_BITS = 43
#: Why a row is a reject; the first that applies.
REASONS = ("malformed", "no_meter", "no_time", "bad_time")
FORMATS = ("csv", "parquet", "json", "orc")
_SUFFIX_FORMAT = {".csv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json",
                  ".orc": "orc"}


def infer_format(path: str, default: str = "csv") -> str:
    """A2: table format from the file suffix (directories and unknown suffixes: ``default``)."""
    low = path.lower().rstrip("/")
    for suffix, fmt in _SUFFIX_FORMAT.items():
        if low.endswith(suffix):
            return fmt
    return default


def read_meter_raw(spark: SparkSession, path, fmt: str | None = "csv") -> DataFrame:
    """Scan meter files without touching the values (A1, A2); ``fmt=None``
    picks the format from the suffix, which all paths must share. ``_file`` is
    the source file's name, ``_order`` the row's place; ``_has_energy`` tells CSV files with that column."""
    paths = [path] if isinstance(path, str) else list(path)
    if fmt is None:
        found = {infer_format(p) for p in paths}
        if len(found) != 1:
            raise ValueError(f"one format per scan, got {sorted(found)}")
        fmt = found.pop()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FORMATS}")
    if fmt == "csv":
        return _read_csv(spark, paths)
    return spark.read.format(fmt).load(paths).withColumns({"_file": F.col("_metadata.file_name"), "_order": _file_order(fmt)})


def _file_order(fmt: str):
    """A long that sorts rows by file (in the order of the paths' hashes) and by place in the file, the
    same however the files are cut into splits: the row's number (parquet), or the first byte of its
    split and its number in the task. A line has at least a byte, so a split's numbers end before the
    next split begins; only a file's last split can share its task with other files."""
    place = F.col("_metadata.row_index") if fmt == "parquet" else \
        F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    file = F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << (63 - _PLACE_BITS)) - 1))
    return F.shiftleft(file, _PLACE_BITS) + place


def csv_headers(spark: SparkSession, paths) -> dict[tuple, list]:
    """{header: files}: the first line of every file, read through the input's own
    file system (a few bytes per file; the rows stay with the executors)."""
    files = [r.path for r in spark.read.format("binaryFile").load(list(paths)).select("path").collect()]
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    groups: dict[tuple, list] = {}
    for file in sorted(files):
        p = jvm.org.apache.hadoop.fs.Path(file)
        stream = p.getFileSystem(conf).open(p)
        codec = codecs.getCodec(p)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line:  # an empty file has neither header nor rows
            names = next(csv.reader([line.lstrip("\ufeff")]))
            groups.setdefault(tuple(n.strip() for n in names), []).append(file)
    return groups


def _read_csv(spark: SparkSession, paths) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    groups = csv_headers(spark, paths)
    if any(len(set(names)) < len(names) or "" in names for names in groups):
        raise ValueError("a CSV header has empty or repeated names")
    if not groups:
        return reader.csv(paths).withColumns({"_file": F.col("_metadata.file_name"), "_order": _file_order("csv")})
    # every cell is parsed, or lines with too many or too few of them would go unnoticed
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    frames = [reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])).csv(files)
              .withColumns({"_file": F.col("_metadata.file_name"), "_order": _file_order("csv"), "_has_energy": F.lit("energy" in names)})
              for names, files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalise(raw: DataFrame, meter_id: str | None = None, time_col: str = "timestamp",
              time_format=TIME_FORMATS, energy: str = "interval",
              interval_minutes: float = 1.0, chunk: str | None = "auto", reasons: bool = False) -> DataFrame:
    """Raw scan -> ``meter_readings`` (meter_id, seq, ts, measures...).

    * ``meter_id``: name of an id column; default is the source file name.
    * ``time_format``: one format or several, tried in order, then the ISO cast.
    * measures are cast by name, NaN/Inf become NULL (A7); rows of files without an
      ``energy`` column get it from power (C4), ``energy='register'`` converts a
      cumulative register into per-interval values (C6). Rows without a time take no
      part in that: they keep the register value, for the rejects.
    * ``seq`` keeps file order (used only to break timestamp ties), whatever the splits.
    * a malformed line has no time (its cells may belong to other columns), so it is a reject;
      ``reasons`` adds ``file``, ``reason`` (NULL for a good row) and ``record``, the malformed line.
    """
    cols = set(raw.columns)
    mid = F.col(meter_id or ("_file" if "_file" in cols else "_metadata.file_name"))
    formats = [time_format] if isinstance(time_format, str) else list(time_format)
    ts_raw = F.col(time_col)
    ts = ts_raw if dict(raw.dtypes).get(time_col, "").startswith("timestamp") \
        else parse_time(ts_raw, formats)
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in cols else F.lit(False)
    ts = F.when(~broken, ts)
    order = F.col("_order") if "_order" in cols else F.monotonically_increasing_id()
    sel = [mid.alias("meter_id"), order.alias("seq"),
           ts.cast("timestamp_ntz").alias("ts")]
    if "_has_energy" in cols:
        sel.append(F.col("_has_energy"))
    if reasons:
        blank = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
        tests = (broken, blank(mid), blank(ts_raw), ts.isNull())
        reason = F.coalesce(*[F.when(t, F.lit(name)) for t, name in zip(tests, REASONS, strict=True)])
        sel += [F.col("_file").alias("file") if "_file" in cols else F.lit(None).cast("string").alias("file"), reason.alias("reason"),
                F.when(broken, F.col(CORRUPT) if CORRUPT in cols else F.lit(None)).cast("string").alias("record")]
    for m in MEASURES:
        if m in cols:
            sel.append(nan_to_null(F.col(m).try_cast("double")).alias(m))
        else:
            sel.append(F.lit(None).cast("double").alias(m))
    df = raw.select(*sel)
    if "energy" not in cols:
        df = df.withColumn("energy", interval_energy("active_power", interval_minutes))
    elif "_has_energy" in cols:
        df = df.withColumn("energy", F.when(F.col("_has_energy"), F.col("energy"))
                           .otherwise(interval_energy("active_power", interval_minutes))).drop("_has_energy")
    if energy == "register":
        timeless = F.col("ts").isNull()
        df = register_to_interval(df.withColumn("_no_ts", timeless).withColumn("_raw", F.col("energy")),
                                  chunk=chunk, key=("meter_id", "_no_ts"))
        df = df.withColumn("energy", F.when(F.col("_no_ts"), F.col("_raw")).otherwise(F.col("energy"))).drop("_no_ts", "_raw")
    return df


def parse_time(c, formats):
    """TIMESTAMP_NTZ of a time string: the first format that fits, then ISO forms."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats],
                      text.try_cast("timestamp_ntz"))


def split_rejects(df: DataFrame):
    """(good, rejects): rows whose time did not parse are quarantined (A4); with ``reasons``, every
    row that has one, and the good ones come without the columns about it."""
    if "reason" in df.columns:
        return df.where(F.col("reason").isNull()).drop("file", "reason", "record"), df.where(F.col("reason").isNotNull())
    return df.where(F.col("ts").isNotNull()), df.where(F.col("ts").isNull())


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Quarantined rows per file and reason."""
    return rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("rows"))


def read_meter(spark: SparkSession, path, fmt: str | None = "csv", **kw) -> DataFrame:
    """Scan + normalise; malformed lines and rows without a meter or a readable time are dropped (see ``split_rejects``)."""
    good, _ = split_rejects(normalise(read_meter_raw(spark, path, fmt), reasons=True, **kw))
    return good


def load_meter_data(spark: SparkSession, path, fmt: str | None = "csv", verify: bool = False, **kw) -> dict:
    """Status record instead of an exception for a missing path or unreadable files (A3):
    the readings with their range and statistics, the rejected rows and their counts by file
    and reason, and the missing values of all rows, each a DataFrame that nothing computes
    before it is used.

    If the files cannot be opened together, each is tried alone (only then): ``files`` tells
    which ones failed and why, and the others are loaded; a load without a readable file is no
    success. ``verify`` reads all rows once first, so that damage inside a file is found, too."""
    try:
        raw = _opened(spark, path, fmt, verify)
        files = None
    except (PySparkException, Py4JJavaError) as e:
        try:
            files = file_status(spark, path, fmt, verify)
        except (PySparkException, Py4JJavaError):
            files = []
        readable = [f["file"] for f in files if f["success"]]
        if not readable:
            return {"success": False, "error": _reason(e), "data": None, "files": files}
        raw = read_meter_raw(spark, readable, fmt)
    rows = normalise(raw, reasons=True, **kw)
    good, rejects = split_rejects(rows)
    return {"success": True, "error": None, "data": good, "rejects": rejects, "reject_counts": reject_counts(rejects),
            "data_range": data_range(good), "stats": profile_stats(good),
            "missing_data": null_counts(rows.drop("file", "reason", "record")), "files": files}


def file_status(spark: SparkSession, path, fmt: str | None = "csv", verify: bool = True) -> list[dict]:
    """One record (file, success, error) per file of the paths, each opened alone."""
    paths = [path] if isinstance(path, str) else list(path)
    out = []
    for row in spark.read.format("binaryFile").load(paths).select("path").orderBy("path").toLocalIterator():
        try:
            _opened(spark, row.path, fmt, verify)
            out.append({"file": row.path, "success": True, "error": None})
        except (PySparkException, Py4JJavaError) as e:
            out.append({"file": row.path, "success": False, "error": _reason(e)})
    return out


def _opened(spark: SparkSession, path, fmt: str | None, verify: bool) -> DataFrame:
    """The raw scan, analysed (a missing path, a bad footer or header fails now); ``verify`` reads every row."""
    raw = read_meter_raw(spark, path, fmt)
    if verify:
        raw.write.format("noop").mode("overwrite").save()
    return raw


def _reason(e: Exception) -> str:
    cause = e.java_exception.getCause() or e.java_exception if isinstance(e, Py4JJavaError) else e
    return str(cause).strip().splitlines()[0]


def register_to_interval(df: DataFrame, col: str = "energy", chunk: str | None = "auto",
                         key="meter_id") -> DataFrame:
    """Cumulative register -> per-interval energy. The first row keeps the
    register value; a negative step (meter reset) restarts from the new value."""
    x = sequential(df, lag=[col], chunk=chunk, key=key)
    step = F.col(col) - F.col("prev_" + col)
    out = F.when(F.col("prev_" + col).isNull(), F.col(col)).when(step < 0, F.col(col)).otherwise(step)
    return x.withColumn(col, out).drop("prev_" + col)


def interval_to_register(df: DataFrame, col: str = "energy", out: str = "energy_register",
                         chunk: str | None = "auto") -> DataFrame:
    """Running register (cumulative sum per meter in time order)."""
    return sequential(df, cumsum={out: col}, chunk=chunk)
