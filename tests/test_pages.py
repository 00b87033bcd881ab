"""Regions, folios, nested values and readings of pages against slow versions and on literal cases."""

import itertools
import json
import random
from collections import Counter

import pytest

from caseloom.operators import folios, nested, readings, regions
from caseloom.operators.regions import Line


def slow_regions(lines):
    """By the rules alone: grow until nothing changes, join all that is near, then all boxes that nothing parts."""
    lines = sorted(lines, key=lambda x: (-x.y1, x.x0, -x.y0, x.x1, x.score))
    near = lambda a, b: max(a.y0 - b.y1, b.y0 - a.y1) <= 20 and min(a.x1, b.x1) > max(a.x0, b.x0)
    inside = {i for i, x in enumerate(lines) if x.score >= 0.7}
    while more := {j for j, y in enumerate(lines) if j not in inside and y.score >= 0.35 and any(near(lines[i], y) for i in inside)}:
        inside |= more

    def joined(items, test):
        groups = [{x} for x in items]
        for a, b in itertools.combinations(items, 2):
            if test(a, b):
                ga, gb = (next(g for g in groups if x in g) for x in (a, b))
                if ga is not gb:
                    groups.remove(gb)
                    ga |= gb
        return groups

    boxes = joined(sorted(inside), lambda a, b: near(lines[a], lines[b]))
    hulls = [(min(lines[i].x0 for i in g), min(lines[i].y0 for i in g), max(lines[i].x1 for i in g), max(lines[i].y1 for i in g)) for g in boxes]

    def fits(a, b):
        (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = hulls[a], hulls[b]
        gap = max(ay0 - by1, by0 - ay1)
        if gap > 160 or min(ax1, bx1) <= max(ax0, bx0):
            return False
        low, high = (by1, ay0) if ay0 >= by0 else (ay1, by0)
        between = [x for x in lines if x.y0 >= low - 2 and x.y1 <= high + 2]
        return gap <= 0 or not any(x.score < (0.4 if gap > 60 else 0.2) for x in between)

    return {frozenset(i for b in g for i in boxes[b]) for g in joined(range(len(boxes)), fits)}


def test_regions_against_the_rules():
    rnd, several = random.Random(9), 0
    for _ in range(1500):
        lines, y = [], 800.0
        for _ in range(rnd.randint(1, 14)):
            x = rnd.choice([0.0, 0.0, 200.0])
            lines.append(Line(x, y - 10, x + rnd.choice([100.0, 300.0]), y, rnd.choice([0.0, 0.1, 0.3, 0.5, 0.5, 0.9, 0.9])))
            y -= rnd.choice([0, 12, 12, 25, 45, 90])
        got = {}
        for i, head in regions.regions(lines).items():
            got.setdefault(head, set()).add(i)
        assert {frozenset(g) for g in got.values()} == slow_regions(lines)
        several += len(got) > 1
    assert several > 200


def test_prose_parts_boxes(spark):
    row = lambda y, score: (0.0, y - 10.0, 300.0, float(y), score)
    pages = {
        "joined": [row(800, 0.9), row(788, 0.5), row(740, 0.9)],
        "parted": [row(800, 0.9), row(788, 0.5), row(764, 0.1), row(740, 0.9)],
        "doubt": [row(800, 0.9), row(760, 0.3), row(740, 0.9)],  # close: not surely prose
        "far": [row(800, 0.9), row(760, 0.3), row(700, 0.9)],  # apart: rather prose
        "none": [row(800, 0.5)],
    }
    rows = [(p, *x) for p, xs in pages.items() for x in xs] + [("joined", None, 1.0, 2.0, 3.0, 0.9)]
    df = spark.createDataFrame(rows, "page string, x0 double, y0 double, x1 double, y1 double, score double")
    got = Counter()
    for r in regions.assembled(df, ["page"]).collect():
        got[r["page"]] += 1
        if r["page"] == "joined":
            assert (r["n_lines"], r["n_taken_in"], r["y0"], r["y1"]) == (3, 1, 730.0, 800.0)
    assert got == {"joined": 1, "parted": 2, "doubt": 1, "far": 2}
    assert regions.assembled(df.limit(0), ["page"]).count() == 0


def test_folio_candidates(spark):
    cnj, other = "1000045-12.2024.8.26.0100", "2222222-12.2024.8.26.0100"
    pages = [
        (1, f"Body cites fls. 332 and folhas 12. Liberado nos autos em 01/02/2024, processo {cnj}, fls. 11"),
        (2, "x" * 400 + " foot fls. 12"),
        (3, "conforme fls. 5 " + "y" * 400),
        (4, f"protocolado em 02/02, processo {other}, fls. 99 " + "z" * 400),
        (5, None), (6, "  "), (7, "Protocolado em 3/3\nàs 10:00 FLS.\n13"),
    ]
    df = spark.createDataFrame([("d", *p) for p in pages], "doc string, page int, text string")
    got = {(r["page"], r["folio"], r["source"], r["weight"]) for r in folios.candidates(df, cnj).collect()}
    assert got == {
        (1, 332, "body_citation", 20), (1, 12, "body_citation", 20), (1, 11, "court_stamp", 100), (2, 12, "page_tail", 90),
        (3, 5, "body_citation", 20), (4, 99, "body_citation", 20), (7, 13, "court_stamp", 80),
    }
    told = {r["page"]: (r["folio"], r["resolution"]) for r in folios.resolved(df.select("doc", "page"), folios.candidates(df, cnj)).collect()}
    # page 1: 11, page 2: 12, page 7: 13 outweigh all else
    assert told == {1: (11, "EXPLICIT"), 2: (12, "EXPLICIT"), 7: (13, "EXPLICIT"), 3: (9, "INFERRED"), 4: (10, "INFERRED"), 5: (11, "INFERRED"), 6: (12, "INFERRED")}
    none = folios.candidates(df.limit(0))
    assert {r["resolution"] for r in folios.resolved(df.select("doc", "page"), none).collect()} == {"UNKNOWN"}


def slow_chain(rows):
    best = (0, [], [])
    for n in range(len(rows) + 1):
        for pick in itertools.combinations(sorted(set(rows)), n):
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pick, pick[1:])):
                key = (-sum(w for _, _, w in pick), [f for _, f, _ in pick][::-1])
                if (key[0], key[1]) < (best[0], best[1]) or not best[2]:
                    best = (*key, list(pick)) if pick else best
    return best


def test_chains_are_the_heaviest():
    rnd = random.Random(10)
    for _ in range(400):
        rows = list({(rnd.randint(1, 6), rnd.randint(1, 7)): rnd.choice([20, 80, 90, 100]) for _ in range(rnd.randint(1, 9))}.items())
        rows = [(p, f, w) for (p, f), w in rows]
        got = folios.heaviest_chain(rows)
        weight = {(p, f): w for p, f, w in rows}
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
        want = slow_chain(rows)
        assert sum(weight[x] for x in got) == -want[0] and [f for _, f in got][::-1] == want[1], rows
    assert folios.heaviest_chain([]) == []


def test_folios_of_events_against_the_chain(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "props").collect()
    want = {}
    for user in {r["user_id"] for r in ev}:
        own = sorted((r for r in ev if r["user_id"] == user), key=lambda r: (r["ts"], r["event_id"]))
        weight = {"purchase": 100, "click": 90, "view": 20}
        rows = [(i, json.loads(r["props"])["k"], weight[r["event_type"]]) for i, r in enumerate(own, 1) if r["event_type"] in weight]
        chain = dict(folios.heaviest_chain(rows))
        for i in range(1, len(own) + 1):
            at = min((p for p in chain if p >= i), default=max(chain, default=None))
            folio = None if at is None else i + chain[at] - at
            several = sum(p == i for p, _, _ in rows) > 1
            want[user, i] = (folio, "EXPLICIT" if i in chain else "INFERRED" if at else "AMBIGUOUS" if several else "UNKNOWN")
    got = {(r["user_id"], r["page"]): (r["folio"], r["resolution"]) for r in folios.folio_chains(spark, sf_dir).collect()}
    assert got == want


def slow_leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in slow_leaves(v, f"{path}.{k}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in slow_leaves(v, f"{path}[{i}]")]
    return [(path, value)]


def test_nested_values_of_any_depth(spark):
    rnd = random.Random(11)

    def value(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice([1, 2.5, "text", "", None, True, [], {}])
        return {rnd.choice("abcdef") + rnd.choice(["", "key"]): value(depth - 1) for _ in range(3)} if rnd.random() < 0.6 else [value(depth - 1) for _ in range(rnd.randint(0, 3))]

    rows = [(i, json.dumps(value(6))) for i in range(60)] + [(100, None), (101, "{not json"), (102, "7"), (103, '{"key": {"key": [[[{"key": 1}]]]}}')]
    df = spark.createDataFrame(rows, "key bigint, text string").repartition(3)
    got = sorted((r["key"], r["path"], json.dumps(json.loads(r["leaf"]))) for r in nested.leaves(df, "key", "text").collect())
    assert got == sorted((i, p, json.dumps(v)) for i, t in rows if t and t != "{not json" for p, v in slow_leaves(json.loads(t)))
    assert nested.leaves(df.limit(0), "key", "text").count() == 0


def test_nested_values_are_written_once(spark, monkeypatch):
    deep = lambda n: json.loads("[" * n + '{"a": "]]}", "b\\"[[": [1]}' + "]" * n)
    rows, calls, plain = [(i, json.dumps(deep(n))) for i, n in enumerate((0, 1, 5, 40))] + [(9, "[" * 500)], [], nested.kept
    monkeypatch.setattr(nested, "kept", lambda df, name: calls.append(name) or plain(df, name))
    df = spark.createDataFrame(rows, "key bigint, text string")
    got = sorted((r["key"], r["path"], json.loads(r["leaf"])) for r in nested.leaves(df, "key", "text").collect())
    assert got == sorted((i, p, v) for i, t in rows[:-1] for p, v in slow_leaves(json.loads(t)))
    assert len(calls) == 1 + 41 // nested.LEVELS  # 42 levels, opened 16 at a time
    calls.clear()
    assert nested.leaves(df.filter("key < 3"), "key", "text").count() == 6 and len(calls) == 1


def test_analyses_are_dealt_once(spark, sf_dir):
    plan = nested.prior_known(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # lines and orders, both by order


def test_known_objects(spark):
    analysis = {"facts": [{"key": "f1", "text": "A"}, {"key": "f1", "text": "A"}, {"text": "no key"}, 5], "claims": {}, "other": [{"key": "x", "text": "y"}], "relations": [{"key": "r", "subject": "s", "predicate": "p", "object": "o", "more": [1]}]}
    rows = [(1, 2, "h", json.dumps(analysis)), (1, 3, "h", None), (1, 4, "h", "[1]"), (1, 5, "h", "oops"), (1, 6, "h2", json.dumps(analysis))]
    got = nested.known_objects(spark.createDataFrame(rows, "process_id int, movement_id int, source_hash string, analysis string")).collect()
    told = sorted((r["movement_id"], r["collection"], r["text"]) for r in got)
    assert told == [(m, *x) for m in (2, 6) for x in (("facts", "A"), ("relations", '{"object":"o","predicate":"p","subject":"s"}'))]
    assert len({r["id"] for r in got}) == 4


def slow_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_readings_against_the_table_of_lengths(spark):
    rnd = random.Random(12)
    for _ in range(1500):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        pairs = readings.common(a, b)
        assert len(pairs) == slow_length(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        one, two = readings.states(a, b)
        assert one.count("MOVED") == two.count("MOVED") == (Counter(a) & Counter(b)).total() - len(pairs)
    assert readings.states(["a", "b", "c"], ["c", "a", "b", "d"]) == (["KEPT", "KEPT", "MOVED"], ["MOVED", "KEPT", "KEPT", "RECOVERED"])
    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (2, 0, None), (2, 1, "a"), (2, 2, "x")], "reading int, place int, block string")
    pairs = spark.createDataFrame([("p", 1, 2), ("p", 1, 9), ("p", 9, 1)], "page string, first int, second int")
    got = {tuple(r)[1:] for r in readings.compared(pairs, blocks).collect()}
    assert got == {(1, 2, 1, 1, 1, 1), (1, 9, 0, 0, 3, 0), (9, 1, 0, 0, 0, 3)}


@pytest.mark.parametrize("query, least", [(regions.barrier_regions, 1), (readings.reading_changes, 1)])
def test_queries_have_rows(spark, sf_dir, query, least):
    assert query(spark, sf_dir).count() >= least
