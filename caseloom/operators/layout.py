"""Boxes on pages: overlaps, bands, columns, cells, components, suppression, reading order and furniture.

A page is an order and its boxes are its lines, placed by their part, supplier and quantity on a sheet of 600 by 800.
A page's boxes are few, so what depends on their order is one fold over the page's own sorted array; everything else is
a window or a join within the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import dealt, table

WIDTH, HEIGHT = 600, 800


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page, box, x0, y0, x1, y1, score, kind``: whole numbers all."""
    l = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").distinct()
    x0, y0 = (F.col("l_partkey") * 7 % 400).cast("int"), (F.col("l_suppkey") * 53 % 700).cast("int")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return l.select(
        F.col("l_orderkey").alias("page"), rank.alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 4).cast("int").alias("x1"), (y0 + 12 + F.col("l_linenumber") * 6).cast("int").alias("y1"),
        F.floor(F.col("l_discount") * 1000 + 0.5).cast("int").alias("score"), F.col("l_returnflag").alias("kind"),
    )


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes (structs of x0, y0, x1, y1) share."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    return w * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def folded_pages(rows: DataFrame, order: list[str], step: Callable[[Column, Column], Column], start: str) -> DataFrame:
    """``page, state``: the boxes of each page in their order, folded with ``step`` from an empty state of type ``start``."""
    own = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in ("page", *order)])))
    return rows.groupBy("page").agg(own.alias("own")).select("page", F.aggregate("own", F.array().cast(start), step).alias("state"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of each page: how many overlap, the largest shared area, and the smallest gap of those that don't."""
    b = boxes(spark, sf_dir).select("page", "box", F.struct("x0", "y0", "x1", "y1").alias("a"))
    both = b.join(b.select("page", F.col("box").alias("other"), F.col("a").alias("b")), "page").filter("box < other")
    shared = intersection(F.col("a"), F.col("b"))
    gap = F.greatest(F.col("a.x0") - F.col("b.x1"), F.col("b.x0") - F.col("a.x1"), F.col("a.y0") - F.col("b.y1"), F.col("b.y0") - F.col("a.y1"), F.lit(0))
    return both.groupBy("page").agg(F.count("*").alias("n_pairs"), F.count_if(shared > 0).alias("n_overlaps"), F.max(shared).alias("largest"), F.min(F.when(shared == 0, gap)).alias("least_gap"))


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stay when those of lesser score go that cover a kept one by half of the union or six tenths of the
    smaller; boxes under a score of 20 don't count."""
    rows = boxes(spark, sf_dir).filter("score >= 20").select("page", (-F.col("score")).alias("s"), "box", "x0", "y0", "x1", "y1")

    def step(kept: Column, b: Column) -> Column:
        def covers(k: Column) -> Column:
            both = intersection(k, b)
            return (2 * both > area(k) + area(b) - both) | (10 * both > 6 * F.least(area(k), area(b)))

        return F.when(F.exists(kept, covers), kept).otherwise(F.array_append(kept, b))

    out = folded_pages(rows, ["s", "box"], step, "array<struct<s:int,box:int,x0:int,y0:int,x1:int,y1:int>>")
    return out.select("page", F.size("state").cast("bigint").alias("n_kept"), F.array_join(F.transform("state", lambda k: k["box"]), ",").alias("kept"))


def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in bands from the top: one joins the last band if its middle is within three points, or 45 in a hundred of its
    height, of the mean middle of that band."""
    rows = boxes(spark, sf_dir).select("page", (F.col("y0") + F.col("y1")).alias("twice"), "box", (F.col("y1") - F.col("y0")).alias("h"))

    def step(bands: Column, b: Column) -> Column:
        last = F.try_element_at(bands, F.lit(-1))
        near = F.abs(b["twice"] * last["n"] - last["total"]) * 100 <= F.greatest(F.lit(600), b["h"] * 90) * last["n"]
        grown = F.struct((last["n"] + 1).alias("n"), (last["total"] + b["twice"]).alias("total"))
        fresh = F.struct(F.lit(1).alias("n"), b["twice"].alias("total"))
        return F.when((F.size(bands) > 0) & near, F.array_append(F.slice(bands, F.lit(1), F.greatest(F.size(bands) - 1, F.lit(0))), grown)).otherwise(F.array_append(bands, fresh))

    out = folded_pages(rows, ["twice", "box"], step, "array<struct<n:int,total:int>>")
    return out.select("page", F.size("state").cast("bigint").alias("n_bands"), F.array_join(F.transform("state", lambda k: k["n"]), ",").alias("sizes"))


def column_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each page: boxes whose left edges follow one another by 16 points at most."""
    b = boxes(spark, sf_dir)
    w = Window.partitionBy("page").orderBy("x0", "box")
    cut = F.when(F.col("x0") - F.lag("x0").over(w) <= 16, 0).otherwise(1)
    slots = b.withColumn("c", cut).withColumn("slot", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return slots.groupBy("page", "slot").agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.count("*").alias("n"))


def cell_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as rows of 50 points by its columns, empty cells too, with what stands in a cell from left to right."""
    b = boxes(spark, sf_dir)
    w = Window.partitionBy("page").orderBy("x0", "box")
    held = b.withColumn("c", F.when(F.col("x0") - F.lag("x0").over(w) <= 16, 0).otherwise(1)).withColumn("slot", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("band", F.floor(F.col("y0") / 50))
    grid = held.select("page", "band").distinct().join(held.select("page", "slot").distinct(), "page")
    cells = held.groupBy("page", "band", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "box", "kind"))), lambda x: x["kind"]), " ").alias("cell"))
    return grid.join(cells, ["page", "band", "slot"], "left").select("page", "band", "slot", F.coalesce("cell", F.lit("")).alias("cell"))


def horizontal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbours in a row of 50 points, and how many are as wide as a column's."""
    b = boxes(spark, sf_dir).withColumn("band", F.floor(F.col("y0") / 50))
    gap = F.lead("x0").over(Window.partitionBy("page", "band").orderBy("x0", "box")) - F.col("x1")
    rows = b.withColumn("gap", gap).filter("gap is not null")
    return rows.groupBy("page").agg(F.count("*").alias("n_gaps"), F.count_if(F.col("gap") >= 20).alias("n_wide"), F.max("gap").alias("widest"))


def recurring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every box how many others of its page, in other rows, begin within twelve points of its left edge."""
    b = boxes(spark, sf_dir).select("page", "box", "x0", F.floor(F.col("y0") / 50).alias("band"))
    o = b.select("page", F.col("box").alias("b2"), F.col("x0").alias("x2"), F.col("band").alias("band2"))
    hits = b.join(o, "page").filter("b2 <> box and band2 <> band and abs(x2 - x0) <= 12").groupBy("page", "box").agg(F.count("*").alias("n"))
    return b.join(hits, ["page", "box"], "left").groupBy("page").agg(F.count("n").alias("n_recurring"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def box_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of boxes that hang together: joined where they overlap or one stands within 18 points under the other. Labels
    go from box to box of a page by its own array of pairs, as often as the page has boxes."""
    b = boxes(spark, sf_dir)
    o = b.select("page", *(F.col(c).alias(f"{c}2") for c in ("box", "x0", "y0", "x1", "y1")))
    near = (F.least("x1", "x12") >= F.greatest("x0", "x02")) & (F.greatest("y0", "y02") - F.least("y1", "y12") <= 18)
    pairs = b.join(o, "page").filter((F.col("box") < F.col("box2")) & near).groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("box").alias("a"), F.col("box2").alias("b")))).alias("pairs"))
    pages = b.groupBy("page").agg(F.array_sort(F.collect_list("box")).alias("names")).join(pairs, "page", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<a:int,b:int>>")))

    def joined(labels: Column, p: Column) -> Column:
        x, y = F.element_at(labels, p["a"]), F.element_at(labels, p["b"])
        return F.transform(labels, lambda v: F.when((v == x) | (v == y), F.least(x, y)).otherwise(v))

    labels = F.aggregate("pairs", F.col("names"), joined)
    return pages.select("page", F.size(F.array_distinct(labels)).cast("bigint").alias("n_regions"), F.array_join(labels, ",").alias("labels"))


def reading_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of the reading order from the top: boxes that overlap in height share one, whose order is not resolved if they
    overlap in width as well."""
    w = Window.partitionBy("page").orderBy("y0", "box")
    b = boxes(spark, sf_dir).withColumn("reach", F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("slot", F.sum(F.when(F.col("y0") < F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy("page", "slot").orderBy("x0", "box").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("clash", F.col("x0") < F.max("x1").over(v))
    return b.groupBy("page", "slot").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("clash"), F.lit(False)).alias("unresolved"))


def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page from the top as paragraphs: a new one begins after a gap of more than 40 points, at an indent of more
    than 60, or where the kind changes."""
    w = Window.partitionBy("page").orderBy("y0", "box")
    b = boxes(spark, sf_dir)
    new = F.coalesce((F.col("y0") - F.lag("y1").over(w) > 40) | (F.abs(F.col("x0") - F.lag("x0").over(w)) > 60) | (F.col("kind") != F.lag("kind").over(w)), F.lit(True))
    rows = b.withColumn("p", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page").agg(F.max("p").alias("n_paragraphs"), F.count("*").alias("n_lines"))


def line_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of a page with the differences that decide on a break, scaled to the page and cut to one."""
    w = Window.partitionBy("page").orderBy("y0", "box")
    b = boxes(spark, sf_dir).withColumn("n", F.lead(F.struct("x0", "y0", "x1", "y1", "kind")).over(w)).filter("n is not null")
    unit = lambda c, by: F.round(F.least(F.greatest(c / by, F.lit(-1.0)), F.lit(1.0)), 6)
    return b.select("page", "box", unit(F.col("n.y0") - F.col("y1"), HEIGHT).alias("gap"), unit(F.col("n.x0") - F.col("x0"), WIDTH).alias("indent"), unit((F.col("n.x1") - F.col("n.x0")) - (F.col("x1") - F.col("x0")), WIDTH).alias("width"), (F.col("n.kind") == F.col("kind")).alias("same_kind"))


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page has two columns: pairs of a left and a right box that share some height, more than one of them; and how
    far the engine can trust the page."""
    b = boxes(spark, sf_dir)
    left, right = b.filter(F.col("x1") <= WIDTH / 2).select("page", F.col("y0").alias("a0"), F.col("y1").alias("a1")), b.filter(F.col("x0") >= WIDTH / 2).select("page", F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    pairs = left.join(right, "page").filter("a0 < b1 and b0 < a1").groupBy("page").agg(F.count("*").alias("n_pairs"))
    shape = b.groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("x1") - F.col("x0") < 60).alias("n_short"))
    both = shape.join(pairs, "page", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    codes = F.array_compact(F.array(F.when(F.col("n_pairs") > 1, "PARALLEL"), F.when((F.col("n_short") >= 0.8 * F.col("n")) & (F.col("n") >= 3), "SHORT_LINES"), F.when(F.col("n") >= 7, "MANY_LINES")))
    return both.select("page", "n_pairs", F.array_join(codes, ",").alias("triggers"), (F.size(codes) == 0).alias("confident"))


def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers: boxes at the top or foot that come again, in their region and with their kind, on a page of the
    case no more than two pages away."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("no"))
    region = F.when(F.col("y1") >= 0.78 * HEIGHT, "HEADER").when(F.col("y0") <= 0.18 * HEIGHT, "FOOTER")
    rows = boxes(spark, sf_dir).withColumn("region", region).filter("region is not null").join(o, "page").select("o_custkey", "region", "kind", "no").distinct()
    w = Window.partitionBy("o_custkey", "region", "kind").orderBy("no")
    runs = rows.withColumn("run", F.sum(F.when(F.col("no") - F.lag("no").over(w) <= 2, 0).otherwise(1)).over(w))
    return runs.groupBy("o_custkey", "region", "kind", "run").agg(F.count("*").alias("n_pages"), F.min("no").alias("first_page"), F.max("no").alias("last_page")).filter("n_pages >= 2")


def moved_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes after a turn by a right angle and a shift, as an affine map of their corners."""
    a, b, c, d, e, f = 0, 1, -1, 0, HEIGHT, 0
    at = lambda x, y: (a * F.col(x) + c * F.col(y) + e, b * F.col(x) + d * F.col(y) + f)
    (x0, y0), (x1, y1) = at("x0", "y0"), at("x1", "y1")
    return boxes(spark, sf_dir).select("page", "box", F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each page by where they stand and how large they are, without those at the edge."""
    kind = F.when(F.col("y1") >= 0.78 * HEIGHT, "HEADER").when(F.col("y0") <= 0.18 * HEIGHT, "FOOTER").when(F.col("x1") - F.col("x0") < 60, "STAMP").when((F.col("x1") - F.col("x0")) >= 150, "BODY").otherwise("BLOCK")
    rows = boxes(spark, sf_dir).withColumn("region", kind).filter("region not in ('HEADER', 'FOOTER')")
    return rows.groupBy("page", "region").agg(F.count("*").alias("n"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("bigint").alias("area"))


def turn_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns in a row as a record: two authors that take turns, the second answer longer than the first."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    for i in (1, 2, 3):
        c = c.withColumn(f"r{i}", F.lead("role", i).over(w)).withColumn(f"n{i}", F.lead("n", i).over(w))
    hit = c.filter("role = r2 and r1 = r3 and role <> r1 and n3 > n1")
    return hit.select("conv_id", "turn", (F.col("n3") - F.col("n1")).cast("bigint").alias("grown"))


QUERIES = {
    f.__name__: f
    for f in (
        box_overlaps, suppressed, row_bands, column_slots, cell_matrix, horizontal_gaps, recurring_edges, box_components, reading_slots, paragraph_breaks, line_pair_features, two_columns,
        page_furniture, moved_boxes, region_kinds, turn_pattern,
    )
}

_B = """b AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS box, CAST(l_partkey * 7 % 400 AS INT) AS x0, CAST(l_suppkey * 53 % 700 AS INT) AS y0,
  CAST(l_partkey * 7 % 400 + l_quantity * 4 AS INT) AS x1, CAST(l_suppkey * 53 % 700 + 12 + l_linenumber * 6 AS INT) AS y1, CAST(floor(l_discount * 1000 + 0.5) AS INT) AS score, l_returnflag AS kind FROM (SELECT DISTINCT * FROM lineitem))"""
_SLOT = """s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY page ORDER BY x0, box ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, box) <= 16 THEN 0 ELSE 1 END AS c FROM b))"""
_SHARED = "greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0)"
_AREA = "({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0)"
ORACLE = {
    "box_overlaps": f"""WITH {_B}, p AS (SELECT a.page, {_SHARED.format(a='a', b='o')} AS s, greatest(a.x0 - o.x1, o.x0 - a.x1, a.y0 - o.y1, o.y0 - a.y1, 0) AS g FROM b a JOIN b o ON a.page = o.page AND a.box < o.box)
SELECT page, count(*) AS n_pairs, count(*) FILTER (s > 0) AS n_overlaps, max(s) AS largest, min(CASE WHEN s = 0 THEN g END) AS least_gap FROM p GROUP BY 1""",
    "suppressed": f"""WITH RECURSIVE {_B}, k AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY score DESC, box) AS r, struct_pack(box := box, x0 := x0, y0 := y0, x1 := x1, y1 := y1) AS v FROM b WHERE score >= 20),
f AS (SELECT page, 1 AS r, [v] AS kept FROM k WHERE r = 1 UNION ALL
  SELECT f.page, f.r + 1, CASE WHEN len(list_filter(kept, lambda q: 2 * ({_SHARED.format(a='q', b='v')}) > {_AREA.format(a='q')} + {_AREA.format(a='v')} - ({_SHARED.format(a='q', b='v')}) OR 10 * ({_SHARED.format(a='q', b='v')}) > 6 * least({_AREA.format(a='q')}, {_AREA.format(a='v')}))) > 0 THEN kept ELSE list_append(kept, v) END
  FROM f JOIN k ON k.page = f.page AND k.r = f.r + 1)
SELECT page, len(kept) AS n_kept, array_to_string(list_transform(kept, lambda q: q.box), ',') AS kept FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY r DESC) = 1""",
    "row_bands": f"""WITH RECURSIVE {_B}, k AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY y0 + y1, box) AS r, y0 + y1 AS t, y1 - y0 AS h FROM b),
f AS (SELECT page, 1 AS r, 1 AS n, t AS total, [] :: INT[] AS done FROM k WHERE r = 1 UNION ALL
  SELECT f.page, f.r + 1, CASE WHEN abs(k.t * n - total) * 100 <= greatest(600, k.h * 90) * n THEN n + 1 ELSE 1 END, CASE WHEN abs(k.t * n - total) * 100 <= greatest(600, k.h * 90) * n THEN total + k.t ELSE k.t END,
    CASE WHEN abs(k.t * n - total) * 100 <= greatest(600, k.h * 90) * n THEN done ELSE list_append(done, n) END FROM f JOIN k ON k.page = f.page AND k.r = f.r + 1)
SELECT page, len(done) + 1 AS n_bands, array_to_string(list_append(done, n), ',') AS sizes FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY r DESC) = 1""",
    "column_slots": f"WITH {_B}, {_SLOT} SELECT page, slot, min(x0) AS left, max(x1) AS right, count(*) AS n FROM s GROUP BY ALL",
    "cell_matrix": f"""WITH {_B}, {_SLOT}, h AS (SELECT *, CAST(floor(y0 / 50) AS BIGINT) AS band FROM s), g AS (SELECT DISTINCT h.page, h.band, j.slot FROM h JOIN (SELECT DISTINCT page, slot FROM h) j ON h.page = j.page),
c AS (SELECT page, band, slot, string_agg(kind, ' ' ORDER BY x0, box) AS cell FROM h GROUP BY ALL) SELECT page, band, slot, coalesce(cell, '') AS cell FROM g LEFT JOIN c USING (page, band, slot)""",
    "horizontal_gaps": f"""WITH {_B}, g AS (SELECT page, lead(x0) OVER (PARTITION BY page, floor(y0 / 50) ORDER BY x0, box) - x1 AS gap FROM b) SELECT page, count(*) AS n_gaps, count(*) FILTER (gap >= 20) AS n_wide, max(gap) AS widest FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "recurring_edges": f"""WITH {_B}, n AS (SELECT a.page, a.box, count(o.box) AS n FROM b a LEFT JOIN b o ON a.page = o.page AND a.box <> o.box AND floor(a.y0 / 50) <> floor(o.y0 / 50) AND abs(a.x0 - o.x0) <= 12 GROUP BY ALL)
SELECT page, count(*) FILTER (n > 0) AS n_recurring, max(n) AS most FROM n GROUP BY 1""",
    "box_components": f"""WITH RECURSIVE {_B}, e AS (SELECT a.page, a.box AS u, o.box AS v FROM b a JOIN b o ON a.page = o.page AND a.box <> o.box AND least(a.x1, o.x1) >= greatest(a.x0, o.x0) AND greatest(a.y0, o.y0) - least(a.y1, o.y1) <= 18),
r AS (SELECT page, box, box AS seen FROM b UNION SELECT r.page, r.box, e.v FROM r JOIN e ON e.page = r.page AND e.u = r.seen), l AS (SELECT page, box, min(seen) AS label FROM r GROUP BY ALL)
SELECT page, count(DISTINCT label) AS n_regions, string_agg(label, ',' ORDER BY box) AS labels FROM l GROUP BY 1""",
    "reading_slots": f"""WITH {_B}, a AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
s AS (SELECT *, CAST(sum(CASE WHEN y0 < reach THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y0, box ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot FROM a),
c AS (SELECT *, x0 < max(x1) OVER (PARTITION BY page, slot ORDER BY x0, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clash FROM s) SELECT page, slot, count(*) AS n, coalesce(bool_or(clash), false) AS unresolved FROM c GROUP BY ALL""",
    "paragraph_breaks": f"""WITH {_B}, a AS (SELECT *, coalesce(y0 - lag(y1) OVER w > 40 OR abs(x0 - lag(x0) OVER w) > 60 OR kind <> lag(kind) OVER w, true) AS c FROM b WINDOW w AS (PARTITION BY page ORDER BY y0, box)) SELECT page, count(*) FILTER (c) AS n_paragraphs, count(*) AS n_lines FROM a GROUP BY 1""",
    "line_pair_features": f"""WITH {_B}, a AS (SELECT *, lead(x0) OVER w AS a0, lead(y0) OVER w AS b0, lead(x1) OVER w AS a1, lead(kind) OVER w AS nk FROM b WINDOW w AS (PARTITION BY page ORDER BY y0, box))
SELECT page, box, round(least(greatest((b0 - y1) / 800.0::DOUBLE, -1), 1), 6) AS gap, round(least(greatest((a0 - x0) / 600.0::DOUBLE, -1), 1), 6) AS indent, round(least(greatest(((a1 - a0) - (x1 - x0)) / 600.0::DOUBLE, -1), 1), 6) AS width, nk = kind AS same_kind FROM a WHERE a0 IS NOT NULL""",
    "two_columns": f"""WITH {_B}, p AS (SELECT a.page, count(*) AS k FROM b a JOIN b o ON a.page = o.page AND a.x1 <= 300 AND o.x0 >= 300 AND a.y0 < o.y1 AND o.y0 < a.y1 GROUP BY 1), g AS (SELECT page, count(*) AS n, count(*) FILTER (x1 - x0 < 60) AS s FROM b GROUP BY 1),
c AS (SELECT page, coalesce(k, 0) AS n_pairs, concat_ws(',', CASE WHEN k > 1 THEN 'PARALLEL' END, CASE WHEN s >= 0.8::DOUBLE * n AND n >= 3 THEN 'SHORT_LINES' END, CASE WHEN n >= 7 THEN 'MANY_LINES' END) AS triggers FROM g LEFT JOIN p USING (page)) SELECT *, triggers = '' AS confident FROM c""",
    "page_furniture": f"""WITH {_B}, o AS (SELECT o_orderkey AS page, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS no FROM orders),
r AS (SELECT DISTINCT o_custkey, CASE WHEN y1 >= 0.78::DOUBLE * 800 THEN 'HEADER' ELSE 'FOOTER' END AS region, kind, no FROM b JOIN o USING (page) WHERE y1 >= 0.78::DOUBLE * 800 OR y0 <= 0.18::DOUBLE * 800),
q AS (SELECT *, CASE WHEN no - lag(no) OVER (PARTITION BY o_custkey, region, kind ORDER BY no) <= 2 THEN 0 ELSE 1 END AS c FROM r), s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY o_custkey, region, kind ORDER BY no) AS BIGINT) AS run FROM q)
SELECT o_custkey, region, kind, run, count(*) AS n_pages, min(no) AS first_page, max(no) AS last_page FROM s GROUP BY ALL HAVING count(*) >= 2""",
    "moved_boxes": f"WITH {_B} SELECT page, box, 800 - y1 AS x0, x0 AS y0, 800 - y0 AS x1, x1 AS y1 FROM b",
    "region_kinds": f"""WITH {_B}, k AS (SELECT *, CASE WHEN x1 - x0 < 60 THEN 'STAMP' WHEN x1 - x0 >= 150 THEN 'BODY' ELSE 'BLOCK' END AS region FROM b WHERE NOT (y1 >= 0.78::DOUBLE * 800) AND NOT (y0 <= 0.18::DOUBLE * 800))
SELECT page, region, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM k GROUP BY ALL""",
    "turn_pattern": """
WITH a AS (SELECT conv_id, turn, role, lead(role, 1) OVER w AS r1, lead(role, 2) OVER w AS r2, lead(role, 3) OVER w AS r3, length(lead(text, 1) OVER w) AS n1, length(lead(text, 3) OVER w) AS n3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, n3 - n1 AS grown FROM a WHERE role = r2 AND r1 = r3 AND role <> r1 AND n3 > n1""",
}
