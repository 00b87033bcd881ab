"""Table folds against the rules as they are stated, on literal tables; chains against a walk."""

import random

from caseloom.operators import tables
from caseloom.operators.tables import Run


def slow_separators(bands):
    most = max(len(b) for b in bands)
    rows = [b for b in bands if len(b) == most]
    out = []
    for j in range(most - 1):
        end, start = max(b[j].x1 for b in rows), min(b[j + 1].x0 for b in rows)
        out.append(round((end + start) / 2 if start > end else (min(b[j].x0 for b in rows) + start) / 2, 2))
    return out


def slow_incompatible(top, bottom):
    if len(top) <= 1 or len(bottom) <= 1:
        if abs(min(r.x0 for b in top for r in b) - min(r.x0 for b in bottom for r in b)) < 20:
            return False
    a, b = slow_separators(top), slow_separators(bottom)
    if len(a) != len(b):
        return len(top) >= 2 and len(bottom) >= 2
    return bool(a) and sum(abs(x - y) for x, y in zip(a, b)) / len(a) > 40


def slow_sections(bands):
    cuts = [0]
    for i in range(len(bands) - 1):
        last, nxt = bands[i], bands[i + 1]
        wide = min(r.y0 for r in last) - max(r.y1 for r in nxt) > 25
        header = len(nxt) >= 4 and min(r.x0 for r in nxt) < 35 and min(r.x0 for r in last) > 60 and len(last) <= 2
        if (wide or header) and slow_incompatible(bands[cuts[-1] : i + 1], bands[i + 1 :]):
            cuts.append(i + 1)
    return [bands[a:b] for a, b in zip(cuts, [*cuts[1:], len(bands)])]


def band(y, *cells):
    return [Run(x, y - 10, x + 6 * len(t), y, t) for x, t in cells]


def test_sections_against_the_rule():
    rnd, cuts = random.Random(7), 0
    for _ in range(3000):
        y, bands = 800.0, []
        for _ in range(rnd.randint(1, 9)):
            xs = sorted(rnd.sample(range(0, 500, 20), rnd.choice([1, 2, 2, 3, 4, 5])))
            bands.append(band(y, *((float(x) + rnd.choice([0, 50]), "t" * rnd.randint(1, 4)) for x in xs)))
            bands[-1].sort()
            y -= rnd.choice([12, 14, 40])
        got = tables.sections(bands)
        assert got == slow_sections(bands)
        cuts += len(got) - 1
    assert cuts > 200


def test_payslip_is_two_tables(spark):
    rows = [
        band(800, (20, "Name"), (200, "Ana")), band(788, (20, "Role"), (200, "Clerk")),
        band(740, (20, "Code"), (90, "Item"), (200, "Ref"), (300, "Pay"), (400, "Cut")),
        band(728, (20, "001"), (90, "Wages of"), (300, "100")), band(717, (90, "March")), band(705, (20, "002"), (90, "Tax"), (400, "10")),
        band(660, (90, "apart")),
    ]
    assert [len(s) for s in tables.sections(rows)] == [2, 5]
    runs = [("t", i, *map(float, r[:4]), r.text) for i, b in enumerate(rows) for r in b] + [("t", 3, 0.0, 0.0, 1.0, 1.0, " "), ("none", 1, 0.0, 0.0, 1.0, 1.0, None)]
    random.Random(1).shuffle(runs)
    df = spark.createDataFrame(runs, "id string, band int, x0 double, y0 double, x1 double, y1 double, text string").repartition(3)
    got = {tuple(r)[1:] for r in tables.rebuilt(df, "id").collect()}
    assert {(0, 0, 0, 1, "Name"), (0, 0, 1, 1, "Ana"), (0, 1, 0, 1, "Role"), (0, 1, 1, 1, "Clerk")} <= got
    assert {(1, 1, 0, 1, "001"), (1, 1, 1, 1, "Wages of\nMarch"), (1, 1, 3, 1, "100"), (1, 2, 4, 1, "10"), (1, 3, 1, 1, "apart")} <= got and len(got) == 16
    assert tables.rebuilt(df.limit(0), "id").count() == 0


def test_cells_span_what_they_reach_into():
    rows = tables.grid([band(100, (0, "a"), (100, "b"), (200, "c")), band(88, (0, "x" * 30)), band(76, (0, "x" * 10), (200, "c"))])
    assert [[(c.column, c.span) for c in cells] for cells, _, _ in rows] == [[(0, 1), (1, 1), (2, 1)], [(0, 3)], [(0, 2), (2, 1)]]


def test_rows_merge_upwards_only_where_they_may():
    def told(*bands):
        g = tables.grid(list(bands))
        return [[c.text for c in cells] for cells in tables.merged(g, max(map(len, bands)))]

    two = band(100, (0, "key"), (100, "one"))
    assert told(two, band(88, (100, "two"))) == [["key", "one\ntwo"]]
    assert told(two, band(60, (100, "two"))) == [["key", "one"], ["two"]]  # too far below
    assert told(two, band(88, (0, "k2"))) == [["key", "one"], ["k2"]]  # a key of its own
    assert told(band(100, (0, "a")), band(88, (0, "b"))) == [["a\nb"]]  # one column only
    assert told(band(112, (0, "k"), (100, "x"), (200, "z")), band(100, (0, "key"), (100, "one")), band(88, (200, "new"))) == [["k", "x", "z"], ["key", "one"], ["new"]]


def test_chains_against_a_walk(spark):
    rnd, links, want = random.Random(8), [], {}
    for c in range(40):
        n = rnd.choice([1, 2, 3, 7, 60])
        names = [c * 1000 + i for i in rnd.sample(range(1000), n + 1)]
        links += list(zip(names[1:], names))
        want |= {x: (names[0], i) for i, x in enumerate(names)}
    circle = [(900_001, 900_000), (900_002, 900_001), (900_000, 900_002)]
    df = spark.createDataFrame(links + circle, "node bigint, prior bigint").repartition(3)
    assert {r["node"]: (r["head"], r["place"]) for r in tables.chained(df).collect()} == want
    assert tables.chained(df.limit(0)).count() == 0


def test_tables_go_on_over_pages(spark):
    rows = [("d", 1, 1, 2, ["A", None]), ("d", 1, 2, 3, ["x", "y", "z"]), ("d", 2, 1, 3, [" X ", "Y", "z"]), ("d", 3, 1, 3, ["", " ", None]), ("d", 3, 2, 2, ["q", "r"]), ("d", 4, 1, 2, ["q", "s"]), ("d", 6, 1, 2, ["q", "s"]), ("e", 5, 1, 2, ["q", "s"])]
    df = spark.createDataFrame(rows, "doc string, page int, no int, columns int, header array<string>")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in tables.continued_tables(df).collect()}
    assert got == {("d", 1, 1): (1, 1, 0), ("d", 1, 2): (1, 2, 0), ("d", 2, 1): (1, 2, 1), ("d", 3, 1): (1, 2, 2), ("d", 3, 2): (3, 2, 0), ("d", 4, 1): (4, 1, 0), ("d", 6, 1): (6, 1, 0), ("e", 5, 1): (5, 1, 0)}


def test_long_chains_of_tables_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(tables, "kept", lambda *_: 1 / 0)  # nothing is written between
    rows = [("d", p, 1, 2, ["A"]) for p in range(1, 400)] + [(None, 1, 1, 2, ["A"]), (None, 2, 1, 2, ["A"]), ("e", None, 1, 2, ["A"]), ("e", 1, 1, 2, None), ("e", 2, 1, 2, ["A"])]
    df = spark.createDataFrame(rows, "doc string, page int, no int, columns int, header array<string>").repartition(3)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in tables.continued_tables(df).collect()}
    assert got == {(d, p, n): (1, 1, p - 1) if d == "d" else (p, n, 0) for d, p, n, *_ in rows}


def test_paragraphs_go_on_over_pages(spark):
    pages = [("d", 1, "Head.\nA paragraph that"), ("d", 2, "goes on and"), ("d", 3, "ends here.\nAnother ends."), ("d", 4, "New one with hy-"), ("d", 5, "phen.\n- item"), ("d", 6, "lower but after an item."), ("d", 7, None), ("d", 8, "x"), ("d", 9, "# heading"), ("d", 10, "# Two"), ("d", 11, "# Three")]
    df = spark.createDataFrame(pages, "doc string, page int, text string")
    got = {r["page"]: (r["logical_page"], r["part"]) for r in tables.continued_paragraphs(df).collect()}
    assert got == {2: (1, 1), 3: (1, 2), 5: (4, 1)}
