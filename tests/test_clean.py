import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memberlens.operators import audit, clean

DATES = [("2025-01-15 10:30:00",), ("15/01/2025 10:30:00",), ("2025-01-15",), ("15/01/2025",), (None,), ("5/1/2025 7:03:09",)]


def test_all_layouts_parse(frame):
    out = clean.parse_timestamps(frame(DATES, "d string"), ["d"]).collect()
    at = dt.datetime(2025, 1, 15, 10, 30)
    assert [r.d for r in out] == [at, at, dt.datetime(2025, 1, 15), dt.datetime(2025, 1, 15), None, dt.datetime(2025, 1, 5, 7, 3, 9)]


def test_day_first_is_not_month_first(frame):
    assert clean.parse_timestamps(frame([("03/12/2025",)], "d string"), ["d"]).first().d == dt.datetime(2025, 12, 3)


@pytest.mark.parametrize("bad", ["garbage", "2025/01/15", "01-15-2025", "31/02/2025", "2025-13-01"])
def test_unreadable_date_fails_the_job(frame, bad):
    with pytest.raises(PySparkException):
        clean.parse_timestamps(frame([(bad,), ("2025-01-15",)], "d string"), ["d"]).collect()
    assert clean.unparsed_dates(frame([(bad,), ("2025-01-15",)], "d string"), "d").count() == 1


def test_timestamps_pass_through(frame):
    at = dt.datetime(2025, 1, 1, 5)
    assert clean.parse_timestamps(frame([(at,)], "d timestamp"), ["d"]).first().d == at


def test_normalise_keeps_nulls(frame):
    out = clean.normalise_text(frame([(" Web ",), (None,)], "channel string"), ["channel", "absent"]).collect()
    assert [r.channel for r in out] == ["web", None]


def test_first_copy_by_declared_order(frame):
    rows = [("a", dt.datetime(2025, 1, 1), "x", 9.0, 2), ("a", dt.datetime(2025, 1, 1), "x", None, 1), ("a", dt.datetime(2025, 1, 1), "y", 5.0, 3)]
    events = frame(rows, "member_id string, event_date timestamp, event_type string, session_duration_sec double, n int")
    out = {r.event_type: r for r in clean.dedup_events(events, ["n"]).collect()}
    assert len(out) == 2 and out["x"].n == 1 and out["x"].session_duration_sec is None


def test_cap_leaves_null(frame):
    out = clean.cap_sessions(frame([(20000.0,), (10.0,), (None,)], "session_duration_sec double")).collect()
    assert [r.session_duration_sec for r in out] == [14400.0, 10.0, None]


def test_clip_bounds_sides(frame):
    out = clean.clip_to_bounds(frame([(-5.0, 12.0), (None, 3.0)], "a double, b double"), {"a": (0.0, None), "b": (None, 10.0), "c": (0.0, 1.0)}).collect()
    assert [tuple(r) for r in out] == [(0.0, 10.0), (None, 3.0)]


@pytest.fixture
def world(frame):
    members = frame([("A",), ("B",), ("MBR_GHOST_1",)], "member_id string").withColumn("account_open_date", F.lit("2024-01-01").cast("timestamp"))
    transactions = frame([("A",), ("X",), ("Y",)], "member_id string")
    events = frame([("A",), ("Y",), ("Z",), (None,)], "member_id string")
    return members, transactions, events


def test_ghosts_of_both_kinds(world):
    got = {(r.member_id, r.kind) for r in clean.ghost_ids(*world).collect()}
    assert got == {("MBR_GHOST_1", "tagged"), ("X", "orphan"), ("Y", "orphan"), ("Z", "orphan")}


def test_orphan_places(world):
    assert {r.found_in: r.n_ids for r in clean.orphan_breakdown(*world).collect()} == {"transactions_only": 1, "both": 1, "events_only": 1}


def test_spine_summary_and_assertions(world):
    members, transactions, events = world
    spine = clean.build_spine(members)
    assert {r.member_id for r in spine.collect()} == {"A", "B"}
    row = clean.activity_summary(spine, transactions, events).first()
    assert (row.total_members, row.members_with_any_activity, row.zero_activity_members) == (2, 1, 1)
    clean.assert_unique(members, ["member_id"])
    with pytest.raises(AssertionError):
        clean.assert_unique(members.union(members), ["member_id"])
    clean.assert_disjoint(spine, clean.ghost_ids(*world))
    with pytest.raises(AssertionError):
        clean.assert_disjoint(spine, members)


def test_json_null_is_not_a_failure(frame):
    rows = [("[]",), ('[{"tier": "gold", "date": "2024-01-01"}]',), (None,), ("[{broken",)]
    row = audit.json_parseability(frame(rows, "tier_history string")).first()
    assert (row.n_null, row.n_valid, row.n_failure) == (1, 2, 1)


def test_profile_counts(frame):
    rows = {r["column"]: r for r in audit.table_profile(frame([("a", 1), (None, 2)], "s string, n int")).collect()}
    assert rows["s"].n_null == 1 and rows["n"].n_rows == 2 and rows["n"].type == "int"


def test_merged_months_equal_the_whole_profile(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("month"), F.concat(F.lit("v"), F.col("id") % 977).alias("s"), F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("n"), F.lit(None).cast("string").alias("none"))
    monthly = audit.column_sketches(df, by=["month"])
    merged = {r["column"]: r for r in audit.merged_profile(monthly).collect()}
    whole = {r["column"]: r for r in audit.table_profile(df.drop("month")).collect()}
    assert merged == whole and set(whole) == {"s", "n", "none"}
    least = sorted({r.s: r.h for r in df.select("s", F.xxhash64("s").alias("h")).collect()}.items(), key=lambda x: x[1])[:audit.EXAMPLES]
    assert whole["s"].samples == [v for v, _ in least] and whole["none"].samples == [] and whole["n"].n_null == 1000
    assert abs(whole["s"].approx_distinct - 977) < 50


def test_profile_samples_of_few_values(frame):
    rows = {r["column"]: r for r in audit.table_profile(frame([("a", 1), ("b", 2), (None, 2)], "s string, n int")).collect()}
    assert sorted(rows["s"].samples) == ["a", "b"] and sorted(rows["n"].samples) == ["1", "2"]
    assert all(r.n_rows == 0 and r.samples == [] for r in audit.table_profile(frame([], "s string, n int")).collect())
