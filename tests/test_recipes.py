import datetime
import math

from lakeops.plans import load_all


def test_return_and_range_from_zero(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, 0.0), (2, 1, 5.0), (3, 2, 0.0), (4, 3, -2.0), (5, 3, 0.0), (6, 4, None), (7, 5, 4.0), (8, 5, 5.0)]
    events = [(i, at + datetime.timedelta(hours=i), u, v) for i, u, v in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["user_id"]: (r["return_pct"], r["range_pct"]) for r in load_all()["recipe_return_and_range"](spark, str(tmp_path)).collect()}
    assert got[1] == (math.inf, math.inf) and all(map(math.isnan, got[2]))
    assert got[3] == (-100.0, -100.0) and got[4] == (None, None) and got[5] == (25.0, 25.0)
