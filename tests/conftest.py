import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from meterlake.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="meterlake-tests")
    yield s


COLS = "meter_id long, seq long, ts timestamp_ntz, voltage double, current double, active_power double, " \
       "reactive_power double, power_factor double, energy double"


def readings(spark, rows, meter_id=1, start="2024-03-15 00:00:00", step_minutes=1):
    """Hand-made meter frame. ``rows``: list of dicts (any subset of measures) or
    of active_power floats; one reading per minute from ``start``."""
    from datetime import timedelta
    t0 = datetime.fromisoformat(start)
    out = []
    for i, r in enumerate(rows):
        if not isinstance(r, dict):
            r = {"active_power": r}
        p = r.get("active_power", 100.0)
        out.append((r.get("meter_id", meter_id), r.get("seq", i),
                    r.get("ts", t0 + timedelta(minutes=i * step_minutes)),
                    r.get("voltage", 220.0), r.get("current", None if p is None else p / 220.0), p,
                    r.get("reactive_power", None if p is None else p * 0.3), r.get("power_factor", 0.95),
                    r.get("energy", None if p is None else p / 60.0 / 1000.0)))
    return spark.createDataFrame(out, COLS)
