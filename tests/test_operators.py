"""Literal fixtures for operators whose edge cases the tables lack."""

from datetime import date

from pyspark.sql import functions as F

from caseloom.operators.linkage import unique_links
from caseloom.operators.merge import merge_classes, versions
from caseloom.operators.retrieval import cosine, hybrid
from caseloom.operators.sequence import bounded_fill, islands
from caseloom.plans.calendar import business_deadlines, day_status, spine
from caseloom.plans.evidence import fact_states


def test_runs_and_fill(spark):
    rows = [(1, i, v) for i, v in enumerate(["A", "A", None, "A", "B", None, None, "C"])]
    df = spark.createDataFrame(rows, "k int, seq int, v string")
    got = df.select("seq", bounded_fill(df, ["k"], ["seq"], F.col("v")).alias("v")).orderBy("seq")
    assert [r["v"] for r in got.collect()] == ["A", "A", "A", "A", "B", None, None, "C"]
    runs = islands(df, ["k"], ["seq"], F.col("v")).groupBy("run_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("a")
    assert [(r["a"], r["b"]) for r in runs.collect()] == [(0, 1), (3, 3), (4, 4), (7, 7)]


def test_links_need_one_match_on_both_sides(spark):
    left = spark.createDataFrame([(1, "p", "x"), (2, None, "y"), (3, None, "y"), (4, None, "z")], "a int, k1 string, k2 string")
    right = spark.createDataFrame([(10, "p", "y"), (11, None, "y"), (12, None, "z")], "b int, k1 string, k2 string")
    got = {tuple(r) for r in unique_links(left, right, "a", "b", [("ONE", "k1"), ("TWO", "k2")]).collect()}
    assert got == {(1, 10, "ONE"), (4, 12, "TWO")}


def test_merge_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, g string")
    got = {tuple(r) for r in merge_classes(old, new, "k", "h", "g").collect()}
    assert got == {(1, "UNCHANGED"), (2, "UPDATED"), (3, "STALE"), (4, "INSERTED")}
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "k int, t int, v string")
    got = [tuple(r) for r in versions(rows, ["k"], ["t"], "v").orderBy("valid_from").collect()]
    assert got == [(1, "a", 1, 3, 1, False), (1, "b", 3, 4, 2, False), (1, "a", 4, None, 3, True)]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_fusion_ranks_every_leg(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else (i * 37 % 101) / 101) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, lexical double, semantic double")
    lex = sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0]))
    sem = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[0]))
    score = {}
    for leg in (lex, sem):
        for n, r in enumerate(leg, 1):
            score[r[0]] = score.get(r[0], 0) + 1 / (60 + n)
    want = sorted(((round(v, 6), k) for k, v in score.items()), key=lambda x: (-x[0], x[1]))[:10]
    assert [(r["score"], r["doc_id"]) for r in hybrid(df, 10).collect()] == want


def test_deadline_skips_weekends_holidays_and_recess(spark):
    acts = spark.createDataFrame([(1, date(2026, 9, 4), 3), (2, date(2026, 12, 17), 2)], "id int, day date, term int")
    due = {r["id"]: r["due"] for r in business_deadlines(acts, day_status(spine(acts, "day", 90)), "day", "term").collect()}
    assert due == {1: date(2026, 9, 10), 2: date(2027, 1, 21)}


def test_fact_states(spark):
    rows = [("a", "SUPPORTS"), ("a", "CONTRADICTS"), ("b", "SUPPORTS"), ("c", None), ("d", "INCONCLUSIVE")]
    got = {r["f"]: r["state"] for r in fact_states(spark.createDataFrame(rows, "f string, relation string"), ["f"]).collect()}
    assert got == {"a": "MIXED", "b": "SUPPORT_PRESENT", "c": "NO_EVIDENCE_IN_CONTEXT", "d": "INCONCLUSIVE"}
