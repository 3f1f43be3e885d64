"""Fleet analysis as a batch job: the cluster counterpart of "upload a file,
get its analysis".

1. raw meter files -> ``normalise`` -> a written readings table (parquet,
   partitioned by date, sorted by meter and time) in the output folder. The
   written table cuts the lineage: every report below reads it, not the raw
   files, and a lost executor only recomputes from it;
2. each report is one DataFrame job over that table, written to its own
   folder with overwrite (a re-run after a failure replaces partial output).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from meterlake.operators import anomalies as H
from meterlake.operators import consumption as C
from meterlake.operators import efficiency as E
from meterlake.plans import reports as J
from meterlake.sources.meter import normalise, read_meter_raw, split_rejects
from meterlake.sources.sinks import write_json_reports, write_readings, write_table

REPORTS = {
    "daily_stats": C.daily_stats,
    "daily_summary": C.daily_summary,
    "consumption_report": J.consumption_report,
    "overall_efficiency": E.overall_efficiency,
    "anomalies": H.anomaly_union,
    "alert_level": H.alert_level,
}


def run_fleet_report(spark: SparkSession, input_path, output_path: str, fmt: str | None = "csv",
                     meter_id: str | None = None, reports=None, **normalise_kw) -> dict:
    """Run the batch job; returns {report name: output folder}."""
    out = output_path.rstrip("/")
    good, bad = split_rejects(normalise(read_meter_raw(spark, input_path, fmt), meter_id=meter_id, reasons=True, **normalise_kw))
    write_readings(good, f"{out}/readings")
    write_table(bad, f"{out}/rejects")
    m = spark.read.parquet(f"{out}/readings").drop("date")
    written = {"readings": f"{out}/readings", "rejects": f"{out}/rejects"}
    for name in reports or REPORTS:
        write_table(REPORTS[name](m), f"{out}/{name}")
        written[name] = f"{out}/{name}"
    write_json_reports(J.analysis_json(m), f"{out}/analysis_json")
    written["analysis_json"] = f"{out}/analysis_json"
    return written
