"""Passages and contracts on small tables: nulls, empty texts, ties and repeated rows."""

import random

from pyspark.sql import functions as F

from caseloom.functions import passages
from caseloom.plans import contracts


def brute_chunks(text, size):
    rest, out = " ".join((text or "").split()), []
    while rest:
        at = len(rest)
        if at > size:
            spaces = [i for i, c in enumerate(rest[: size + 1]) if c == " "]
            at = spaces[-1] if spaces and spaces[-1] >= size // 3 else size
        out.append(rest[:at])
        rest = rest[at:].strip()
    return out


def test_chunks(spark):
    r = random.Random(5)
    texts = [None, "", "   ", "x" * 95, "a " * 50, "😀" * 41 + " b\n\tc"] + ["".join(r.choice("ab é \n") * r.choice((1, 1, 1, 9, 25)) for _ in range(r.randrange(60))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, got in rows.select("i", passages.chunks(F.col("t"), 30)).collect():
        assert got == brute_chunks(texts[i], 30)


def test_folds_and_signatures(spark):
    rows = spark.createDataFrame([("Ação, Ünïcode ß Łódź",), (None,)], "t string")
    assert [x[0] for x in rows.select(passages.folded(F.col("t"))).collect()] == ["acao, unicode ss łodz", None]
    lines = spark.createDataFrame([("Página 3 — Seite 12 de 2024",), ("fl. 7",), ("p 9 total",)], "t string")
    assert [x[0] for x in lines.select(passages.furniture_signature(F.col("t"))).collect()] == ["pagina # de #", "fl #", "total"]


def test_windows_and_clips(spark):
    rows = spark.createDataFrame([("ab  cd 12345 ef gh",), ("none",), (None,), ("99999",)], "t string")
    assert [x[0] for x in rows.select(passages.window_around(F.col("t"), "[0-9]{4,}", 4)).collect()] == ["cd 1234", None, None, "9999"]
    assert [x[0] for x in rows.select(passages.clipped(F.col("t"), 4)).collect()] == ["ab…", "none", None, "9999…"]


def test_id_sets(spark):
    expected = spark.createDataFrame([(1,), (2,), (2,), (None,), (5,)], "k int")
    returned = spark.createDataFrame([(2,), (3,), (5,), (5,)], "k int")
    got = {(r.k, r.state) for r in contracts.id_set_states(expected, returned, "k").collect()}
    assert got == {(1, "MISSING"), (2, "OK"), (3, "UNEXPECTED"), (5, "DUPLICATE"), (None, "MISSING")}
    assert contracts.id_set_states(expected.limit(0), returned.limit(0), "k").count() == 0


def test_codes_and_single_values(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, v int")
    got = {r.k: (r.v, r.state) for r in contracts.single_value(rows, ["k"], "v").collect()}
    assert got == {"a": (1, "SINGLE"), "b": (None, "CONFLICT"), "c": (None, "NO_CONTEXT")}
    code = contracts.first_code((F.col("v") > 1, "BIG"), (F.col("v") > 0, "POSITIVE"))
    assert sorted(str(r[0]) for r in rows.select(code).collect()) == ["BIG", "None", "POSITIVE", "POSITIVE", "POSITIVE"]


def test_versions_periods_and_scores(spark):
    stored = spark.createDataFrame([("a", 3), ("a", 1)], "k string, version int")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 7)], "k string, at int")
    assert {(r.k, r["at"], r.version) for r in contracts.appended_versions(stored, new, "k", ["at"]).collect()} == {("a", 1, 4), ("a", 2, 5), ("b", 7, 1)}
    days = spark.createDataFrame([("2024-12-20",), ("2025-01-20",), ("2025-01-21",), ("2024-12-19",)], "d string").select(F.to_date("d").alias("d"))
    assert [x[0] for x in days.select(contracts.wraps(F.col("d"), "12-20", "01-20")).collect()] == [True, True, False, False]
    pairs = spark.createDataFrame([("x", True, True), ("x", True, False), ("y", False, False)], "k string, expected boolean, actual boolean")
    assert {tuple(r) for r in contracts.set_scores(pairs, ["k"]).collect()} == {("x", 1, 0, 1, 1.0, 0.5), ("y", 0, 0, 0, None, None)}


def test_terms(spark):
    texts = ["within 15 Business Days, or 3 months", "10 jours", "7 Tagen.", "2 Stunden", "x12 days", "5 daysies", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    value, unit = passages.terms(F.col("t"))
    none = (None, "UNSPECIFIED")
    assert [tuple(r) for r in rows.orderBy("i").select(value, unit).collect()] == [(15, "BUSINESS_DAYS"), (10, "DAYS"), (7, "DAYS"), (2, "HOURS"), none, none, none, none]


def test_citations(spark):
    texts = spark.createDataFrame([(1, "see [1], [1] and [9]"), (2, "[2]"), (3, "none"), (4, None)], "k int, text string")
    got = {tuple(r) for r in passages.verified_citations(texts, spark.createDataFrame([(1,), (2,), (None,)], "n int"), "k", "n").collect()}
    assert got == {(1, 1, "9", False), (2, 1, "", True)}
