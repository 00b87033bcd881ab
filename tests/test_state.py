"""Stored tables against a dict: repeated, aborted and clashing runs; pulls, marks and staleness over several runs."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import state
from caseloom.sources.versioned import Conflict, StoredTable

SCHEMA = "k bigint, scope string, digest string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in rows.items()], SCHEMA)


def slow_merge(held, wanted, version, prune, scope=None):
    out = {}
    for k, (row, made, at) in held.items():
        if k not in wanted and not (prune and (scope is None or row[0] in scope)):
            out[k] = (row, made, at)
    for k, row in wanted.items():
        old = held.get(k)
        out[k] = old if old and old[0][1] == row[1] else (row, old[1] if old else version, version)
    return out


def stored(table):
    return {r["k"]: ((r["scope"], r["digest"], r["v"]), r["created_version"], r["updated_version"]) for r in table.read().collect()}


def test_merges_against_a_dict(spark, tmp_path):
    rnd, table, want = random.Random(6), StoredTable(spark, f"file://{tmp_path}/t", "k", buckets=5), {}
    for run in range(7):
        wanted = {}
        for k in rnd.sample(range(60), rnd.choice([0, 5, 30])):
            digest = rnd.choice("ab")
            wanted[k] = (rnd.choice(["x", "y", None]) if k not in want else want[k][0][0], digest, f"{digest} of {k}")
        prune, scope = run % 3 != 1, {"x"} if run % 3 == 2 else None
        version = table.manifest()["version"] + 1
        after = slow_merge(want, wanted, version, prune, scope)
        told = table.merge(frame(spark, wanted).repartition(3), prune, scope and ("scope", spark.createDataFrame([("x",), ("x",)], "s string")))
        counts = told["counts"]
        assert counts["INSERT"] == len(after.keys() - want.keys()) and counts["PRUNE"] == len(want.keys() - after.keys())
        want = after
        assert stored(table) == want
        again = table.merge(frame(spark, wanted), False)  # the same once more changes nothing
        assert again["version"] == told["version"] and stored(table) == want
    assert table.vacuum() > 0 and stored(table) == want and table.vacuum() == 0


def test_runs_that_are_cut_short_or_clash(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, f"file://{tmp_path}/t", "k", buckets=3)
    assert table.marks() == {} and table.manifest()["version"] == 0
    rows = {k: ("x", "a", "v") for k in range(10)}
    table.merge(frame(spark, rows), marks={"day": "1"})
    before = stored(table)
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(frame(spark, {1: ("x", "b", "w")}), marks={"day": "2"})
    assert stored(table) == before and table.marks() == {"day": "1"}
    (tmp_path / "t/manifests/000000000002").write_text('{"version": 2, "sch')  # a manifest that was being written
    assert stored(table) == before
    told = table.merge(frame(spark, {1: ("x", "b", "w")}), prune=False, marks={"day": "2"})
    assert told["version"] == 3 and table.marks() == {"day": "2"} and stored(table)[1] == (("x", "b", "w"), 1, 3)
    assert {tuple(r) for r in table.changes().collect()} == {(1, "UPDATE")}
    other = StoredTable(spark, f"file://{tmp_path}/t", "k", buckets=3)
    monkeypatch.setattr(other, "_numbers", lambda: [1, 2])  # as one that looked before the third version was there
    with pytest.raises(Conflict):
        other.merge(frame(spark, {5: ("y", "c", "z")}))
    assert table.manifest()["version"] == 3
    assert table.merge(frame(spark, {}), prune=True)["counts"]["PRUNE"] == 10 and stored(table) == {}
    assert table.read(1).count() == 10


def test_odd_rows(spark, tmp_path):
    table = StoredTable(spark, f"file://{tmp_path}/t", "k")
    table.merge(spark.createDataFrame([(None, "s", "a", "v"), (1, None, None, None), (2, "s", "b", "second"), (2, "s", "a", "first")], SCHEMA))
    assert stored(table) == {1: ((None, None, None), 1, 1), 2: (("s", "a", "first"), 1, 1)}


def test_pulls_over_growing_input(spark, tmp_path):
    stored_, marks = (StoredTable(spark, f"file://{tmp_path}/{n}", k) for n, k in (("e", "event_id"), ("m", "case_id")))
    rows = [(i, i % 3, "2024-01-%02d" % (1 + i // 3), "a", i % 3 == 2 and i > 20) for i in range(60)]
    fails = F.max("bad")

    def run(n, until):
        state.pull(spark.createDataFrame(rows[:n], "event_id bigint, case_id bigint, day string, digest string, bad boolean"), stored_, marks, until, fails)
        return {r["case_id"]: (r["mark"], r["n_ok"], r["n_failed"]) for r in marks.read().collect()}

    assert run(12, "2024-01-05") == {c: ("2024-01-05", 1, 0) for c in range(3)}
    after = {0: ("2024-01-12", 2, 0), 1: ("2024-01-12", 2, 0), 2: ("2024-01-05", 1, 1)}
    assert run(36, "2024-01-12") == after
    assert stored_.read().groupBy("case_id").count().orderBy("case_id").collect() == [(0, 12), (1, 12), (2, 4)]
    rows[:] = [(*r[:4], False) for r in rows]  # what was bad is mended, and a row of a day that was pulled comes late
    rows.append((99, 2, "2024-01-05", "a", False))
    assert run(61, "2024-01-20") == {0: ("2024-01-20", 3, 0), 1: ("2024-01-20", 3, 0), 2: ("2024-01-20", 2, 1)}
    assert stored_.read().groupBy("case_id").count().orderBy("case_id").collect() == [(0, 20), (1, 20), (2, 21)]


def test_staleness_runs_along_dependants(spark):
    built = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("gone", "1"), ("x", None), ("y", "1"), ("z", "1")], "artifact string, source_hash string")
    now = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1"), ("new", "1"), ("x", None), ("y", "1"), ("z", "1")], "artifact string, source_hash string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("a", "c"), ("y", "gone"), ("z", "x"), ("x", "z")], "artifact string, needed string")
    got = {r["artifact"]: r["reason"] for r in state.stale_artifacts(built, now, needs).collect()}
    assert got == {"a": "CHANGED", "b": "DEPENDENCY", "c": "DEPENDENCY", "gone": "GONE", "new": "NEW", "y": "DEPENDENCY"}
    assert state.stale_artifacts(built.limit(0), now.limit(0), needs).count() == 0


def test_a_merge_deals_rows_by_their_case_and_writes_them_once(spark, tmp_path):
    table, want = StoredTable(spark, f"file://{tmp_path}/t", "k", buckets=4, by="scope"), {}
    first = {k: (f"s{k % 7}", "a", "v") for k in range(60)}
    second = {k: (f"s{k % 7}", "b" if k % 2 else "a", "w") for k in range(80) if k % 7 < 3 and k % 5}
    for version, (wanted, scope) in enumerate(((first, None), (second, {"s0", "s1", "s2"})), 1):
        n = table.parts()
        told = table.merge(frame(spark, wanted).repartition(n, "scope"), True, scope and ("scope", spark.createDataFrame([(s,) for s in scope], "s string")), parts=n)
        want = slow_merge(want, wanted, version, True, scope)
        assert stored(table) == want and told["rows"] == len(want)
        # one file for each bucket and part, and nothing beside them
        files = [f for f in tmp_path.glob(f"t/{told['changes']}/**/*") if f.suffix == ".parquet"]
        assert len(files) <= n and {f.parent.parent for f in files} == {tmp_path / "t" / told["changes"]}
        assert len(list((tmp_path / "t" / told["changes"]).parent.iterdir())) == 1
    of = table.read().withColumn("place", F.input_file_name()).select("scope", F.regexp_extract("place", r"bucket=(\d+)", 1).alias("b")).distinct()
    assert of.groupBy("scope").count().filter("count > 1").isEmpty()
    assert {(r["k"], r["action"]) for r in table.changes().collect()} == {(k, "INSERT") for k in second.keys() - first.keys()} | {(k, "UPDATE") for k in second.keys() & first.keys() if k % 2} | {(k, "PRUNE") for k in first if k % 7 < 3 and k not in second}
    before = sorted(tmp_path.glob("t/data/*"))
    table.merge(frame(spark, {k: row for k, (row, _, _) in want.items()}))
    assert sorted(tmp_path.glob("t/data/*")) == before  # a run that changes nothing leaves nothing
