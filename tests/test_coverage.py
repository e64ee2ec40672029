"""Coverage by stage, raw presence and quarantined artifacts on small frames."""

import datetime as dt

from tidemark.operators import coverage


def test_stages(spark):
    day = lambda n: dt.date(2024, 1, n)
    expected = spark.createDataFrame([("A", day(1)), ("A", day(2)), ("B", day(1)), ("B", day(2)), ("B", day(2))], "market string, day date")
    starts = spark.createDataFrame([("B", day(2))], "market string, first date")
    raw = spark.createDataFrame([("A", day(1)), ("A", day(1)), ("B", day(1)), ("C", day(1)), (None, day(1))], "market string, day date")
    got = {(r["stage"], r["market"], r["day"].day): r["status"] for r in coverage.stages(expected, starts, {"raw": raw, "none": raw.limit(0)}, "day").collect()}
    assert got == {
        ("raw", "A", 1): "present", ("raw", "A", 2): "missing", ("raw", "B", 1): "unavailable", ("raw", "B", 2): "missing", ("raw", "C", 1): "extra", ("raw", None, 1): "extra",
        ("none", "A", 1): "missing", ("none", "A", 2): "missing", ("none", "B", 1): "unavailable", ("none", "B", 2): "missing",
    }


BARS = "market string, ts timestamp_ntz, is_synthetic boolean, inside_session boolean, minute_of_day int, minutes_since_session_open bigint, minutes_until_session_close bigint, session_date date, synthetic_gap_id bigint, synthetic_gap_size_minutes bigint"


def bar(market, minute, synth=True, inside=True, since=500, until=500, gap=1, size=3):
    return (market, dt.datetime(2024, 1, 2) + dt.timedelta(minutes=minute), synth, inside, minute, since, until, dt.date(2024, 1, 2) if inside else None, gap if synth else None, size if synth else None)


def test_raw_gaps(spark):
    rows = [bar("A", m) for m in (300, 301, 302)] + [bar("A", 600, gap=2, size=1), bar("A", 700, synth=False), bar("B", 61, since=59, gap=3, size=2), bar("B", 62, since=60, until=60, gap=3, size=2), bar("B", 1080, inside=None, gap=None)]
    bars = spark.createDataFrame(rows, BARS)
    raw = spark.createDataFrame([("A", rows[0][1]), ("A", rows[0][1]), ("A", rows[4][1]), ("C", rows[0][1]), ("A", None)], "market string, ts timestamp_ntz")
    got = {(r["market"], r["year"]): r for r in coverage.raw_presence(bars, raw).collect()}
    a, b, c = got["A", 2024], got["B", 2024], got["C", 2024]
    assert (a["synthetic_rows"], a["present_in_raw"], a["missing_from_raw"], a["raw_gap_call"]) == (4, 1, 3, "mixed_presence_in_raw_parquet")
    assert (b["edge_share"], b["raw_gap_call"], b["session_template_call"]) == (2 / 3, "confirmed_absent_from_raw_parquet", "primarily_session_edge_under_local_config")
    assert (c["raw_gap_call"], c["edge_share"], c["raw_rows"]) == ("no_synthetic_rows", 0.0, 1)
    counts = {(r["market"], r["kind"], r["value"]): r["n"] for r in coverage.gap_counts(bars).collect()}
    assert counts["A", "gap_size_minutes", "3"] == counts["A", "gap_size_minutes", "1"] == counts["B", "gap_size_minutes", "2"] == 1
    assert counts["A", "ct_hour", "5"] == 3 and counts["B", "session_bucket", coverage.FIRST] == counts["B", "session_bucket", coverage.LAST] == 1
    assert counts["B", "session_bucket", "outside_configured_session"] == 1 and counts["B", "session_date", "2024-01-02"] == 2
    assert [(r["market"], r["size"], r["synthetic_rows"]) for r in coverage.largest(bars, 1).orderBy("market").collect()] == [("A", 3, 3), ("B", 2, 2)]
    assert coverage.raw_presence(bars.limit(0), raw.limit(0)).count() == coverage.gap_counts(bars.limit(0)).count() == 0


def test_strays(spark):
    shape = "market string, file string, path string, sha256 string"
    canonical = spark.createDataFrame([("A", "1", "base/A/1", "x"), ("A", "2", "base/A/2", "x")], shape)
    found = spark.createDataFrame([("A", "1", "old/A/1", "h"), ("A", "2", "old/A/2", "h"), ("A", "3", "old/A/3", "h"), ("A", "1", "base/A/1", "x"), ("A", None, "old/A/n", "h")], shape)
    entries = spark.createDataFrame([("old/A/1", "base/A/1", "h"), ("old/A/1", "base/A/1", "h"), ("old/A/2", "base/A/2", "other")], "artifact_path string, canonical_path string, artifact_sha256 string")
    assert {(r["path"], r["quarantined"]) for r in coverage.strays(found, canonical, entries).collect()} == {("old/A/1", True), ("old/A/2", False)}
