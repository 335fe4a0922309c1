"""The publishing hold and the sink that replaces pulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.operators import safety
from larkspur.streaming.windows import replacing_sink, stream_of
from larkspur.thresholds import GateFailure

RELEASE = "project string, trigger string, at date, released_by string, evidence string, cause string, remediation string, metric string, urls array<string>, check_on date"


def test_a_hold_needs_a_whole_later_release(spark):
    day = lambda n: dt.date(2025, 1, n)
    raised = spark.createDataFrame([("a", "K1", day(2)), ("a", "K1", day(5)), ("b", "K2", day(2)), ("c", "K3", day(2)), ("d", "K6", day(2)), ("e", "K9", day(2))], "project string, trigger string, at date")
    said = ("owner", "e", "unknown", "r", "m", ["/x"], day(9))
    releases = spark.createDataFrame([
        ("a", "K1", day(3), *said),  # before the last trigger
        ("b", "K2", day(3), *said),
        ("c", "K3", day(3), " ", *said[1:]),  # by nobody
        ("d", "K6", day(2), *said),  # not later
        ("e", "K9", day(3), *said[:5], None, day(9)),  # no pages
        ("f", "K1", day(3), *said),  # never raised
    ], RELEASE)
    state = safety.holds(raised, releases)
    assert {r["project"]: (r["raised_at"], r["released_at"], r["held"]) for r in state.collect()} == {
        "a": (day(5), None, True), "b": (day(2), day(3), False), "c": (day(2), None, True), "d": (day(2), None, True), "e": (day(2), None, True),
    }
    assert [r["project"] for r in safety.unknown_triggers(raised).collect()] == ["e"]
    safety.require_release(state.filter("project = 'b'"))
    with pytest.raises(GateFailure, match="c K3"):
        safety.require_release(state.filter("project = 'c'"))
    assert safety.holds(raised.limit(0), releases).collect() == []


@pytest.mark.parametrize("files", [1, 8])
def test_pulls_replace_their_range(spark, tmp_path, files):
    day = lambda n: dt.date(2025, 1, n)
    schema = "date date, query string, clicks long, pull_start date, pull_end date, version long"
    first = [(day(n), f"q{n}", n, day(1), day(3), 1) for n in (1, 2, 3)]
    second = [(day(3), "q3", 30, day(2), day(3), 2)]  # the second day has vanished
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    types = spark.read.parquet(f"{tmp_path}/in").schema
    for _ in range(2):  # nothing new: nothing changes
        replacing_sink(stream_of(spark, f"{tmp_path}/in", types, files), f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(F.col("date"), "query", "clicks", "version").orderBy("date")
    assert [tuple(r) for r in got.collect()] == [(day(1), "q1", 1, 1), (day(3), "q3", 30, 2)]
