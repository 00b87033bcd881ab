"""Two streams over several micro-batches: rows in time meet, late ones are dropped and counted, restarts lose nothing."""

from datetime import datetime, timedelta

from caseloom.streaming import joins
from caseloom.streaming.joins import followed, run_slices

DAY0 = datetime(2024, 1, 1)


def slow(rows, waits, hours):
    """The join of the rows that are not late, slice by slice, and how many are late."""
    latest, live, late = {}, [], 0
    for s in sorted({r[-1] for r in rows}):
        mark = min(latest[k] - timedelta(days=waits[k]) for k in waits) if len(latest) == len(waits) else None
        for r in (r for r in rows if r[-1] == s and r[2] in waits):
            if mark is not None and r[3] <= mark:
                late += 1
            else:
                live.append(r)
        for r in (r for r in rows if r[-1] == s and r[2] in waits):
            latest[r[2]] = max(latest.get(r[2], r[3]), r[3])
    met = {(v[0], p[0]) for v in live for p in live if v[2] == "view" and p[2] == "purchase" and v[1] == p[1] and timedelta(0) <= p[3] - v[3] <= timedelta(hours=hours)}
    return met, late


def test_late_rows_are_dropped_and_counted(spark):
    at = lambda d, h=0: DAY0 + timedelta(days=d, hours=h)
    rows = [
        (1, 7, "view", at(0), 0), (2, 7, "purchase", at(0, 5), 0), (3, 8, "view", at(9), 0), (4, 8, "purchase", at(9, 1), 0),
        (5, 8, "purchase", at(9, 2), 1), (6, 7, "purchase", at(0, 6), 1), (7, 9, "view", at(8), 1), (8, 9, "purchase", at(8, 3), 1), (9, 7, "view", at(4), 1),
        (10, 8, "view", at(20), 2), (11, 8, "purchase", at(20, 3), 2), (12, 8, "view", at(19, 23), 3), (13, 8, "view", at(10), 3), (14, 8, "purchase", at(21), 3),
        (15, 8, "click", at(1), 3),
    ]
    df = spark.createDataFrame([(*r[:4], 0, r[4]) for r in rows], "event_id bigint, user_id bigint, event_type string, ts timestamp, k int, slice int")
    waits = {"view": 1, "purchase": 2}
    got, dropped = run_slices(df, lambda s: followed(s, waits, 24), "literal")
    want, late = slow(rows, waits, 24)
    assert {tuple(r) for r in got.collect()} == want and dropped == late and late >= 3 and len(want) >= 5


def test_streams_without_rows(spark):
    df = spark.createDataFrame([(1, 1, "click", DAY0, 0, 0)], "event_id bigint, user_id bigint, event_type string, ts timestamp, k int, slice int")
    got, dropped = run_slices(df, followed, "nothing")
    assert got.count() == 0 and dropped == 0
    assert run_slices.__doc__


def test_parts_of_the_state_follow_the_rows(spark):
    rows = [(i, 1, ("view", "purchase")[i % 2], DAY0 + timedelta(hours=i), 0, i // 3) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp, k int, slice int")
    own, queries = spark.conf.get("spark.sql.shuffle.partitions"), []
    plain = joins.started
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        joins.started = lambda *a: queries.append(plain(*a)) or queries[-1]
        got, _ = run_slices(df, followed, "parts")
        assert got.count() == 9 - 3 and spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        joins.started = plain
        spark.conf.set("spark.sql.shuffle.partitions", own)
    held = {op["numShufflePartitions"] for q in queries for p in q.recentProgress for op in p["stateOperators"]}
    assert held == {spark.sparkContext.defaultParallelism}
    assert joins.state_parts(spark, 36_000_001) == 37
