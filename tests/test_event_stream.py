"""Counts from a stream equal those of the table, whatever the order of its files."""

import datetime as dt

from topoweave.queries.flow_queries import QUERIES

T = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def test_files_out_of_time_order_lose_nothing(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string"
    rows = [(T(k), "a" if k % 3 else "b") for k in range(300)] + [(None, "a")]
    for part in (rows[200:], rows[:100], rows[100:200]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, QUERIES["t11_event_stream"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(map(tuple, QUERIES["t11_event_windows"](spark, str(tmp_path)).collect()), key=str)
    assert got == want and sum(r[2] for r in got) == 300
