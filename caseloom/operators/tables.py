"""Tables on pages: sections, cells and wrapped rows by one fold over a table's bands, and chains over page breaks.

A table is its runs of text with their boxes, points upwards, in bands from the top. What a section says of its columns
is small (the most runs of any band, and how far each of these columns reaches), can be told of a section with one more
band from that of the section before, and so is carried down from the last cut and up from the last band; a cut needs
only the two where they meet.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import dealt, kept, table

#: Points: gaps that may part sections and rows, shifts of columns and of left edges, margins of a header line, and how far
#: a cell must reach into a column to span it.
SECTION_GAP, ROW_GAP, SHIFT, LEFT_SHIFT, MARGIN, INNER, REACH = 25.0, 12.0, 40.0, 20.0, 35.0, 60.0, 5.0
HEADER_RUNS, FEW_RUNS = 4, 2


class Run(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    text: str


class Schema(NamedTuple):
    """Columns of some bands: how many bands and the left edge, and of the bands with most runs the least and greatest
    edges of each run."""

    bands: int
    left: float
    low: tuple[float, ...]
    high: tuple[float, ...]

    def with_band(self, band: list[Run]) -> "Schema":
        low, high = tuple(r.x0 for r in band), tuple(r.x1 for r in band)
        if len(low) < len(self.low):
            low, high = self.low, self.high
        elif len(low) == len(self.low):
            low, high = tuple(map(min, low, self.low)), tuple(map(max, high, self.high))
        return Schema(self.bands + 1, min(self.left, band[0].x0), low, high)

    def separators(self) -> list[float]:
        """Where one column ends and the next begins."""
        pairs = zip(self.high, self.low[1:], self.low)
        return [round((end + start) / 2 if start > end else (own + start) / 2, 2) for end, start, own in pairs]


NOTHING = Schema(0, float("inf"), (), ())


def incompatible(top: Schema, bottom: Schema) -> bool:
    """Whether the columns of two blocks cannot be those of one table."""
    if not top.bands or not bottom.bands:
        return False
    single = top.bands == 1 or bottom.bands == 1
    if single and abs(top.left - bottom.left) < LEFT_SHIFT:
        return False
    a, b = top.separators(), bottom.separators()
    if len(a) != len(b):
        return not single
    return bool(a) and sum(abs(x - y) for x, y in zip(a, b)) / len(a) > SHIFT


def sections(bands: list[list[Run]]) -> list[list[list[Run]]]:
    """Bands from the top, cut where a wide gap or a header line parts columns that don't fit."""
    below = [NOTHING]
    for band in reversed(bands):
        below.append(below[-1].with_band(band))
    below.reverse()  # below[i]: the columns of band i and all under it
    out, above = [], NOTHING
    for i, band in enumerate(bands):
        if above.bands:
            last = bands[i - 1]
            wide = min(r.y0 for r in last) - max(r.y1 for r in band) > SECTION_GAP
            header = len(band) >= HEADER_RUNS and band[0].x0 < MARGIN and last[0].x0 > INNER and len(last) <= FEW_RUNS
            if (wide or header) and incompatible(above, below[i]):
                above = NOTHING
        if not above.bands:
            out.append([])
        out[-1].append(band)
        above = above.with_band(band)
    return out


class Cell(NamedTuple):
    column: int
    span: int
    text: str


def grid(bands: list[list[Run]]) -> list[tuple[list[Cell], float, float]]:
    """Rows of cells with their lowest and highest points: a run stands in the last column that begins before it, runs of
    one column are one cell, and a cell spans the empty columns that it reaches into."""
    schema = NOTHING
    for band in bands:
        schema = schema.with_band(band)
    starts = [min(schema.left, min(r.x0 for r in bands[0])), *schema.separators()]
    out = []
    for band in bands:
        at: dict[int, list[Run]] = {}
        for r in band:
            at.setdefault(max((j for j, x in enumerate(starts) if r.x0 >= x), default=0), []).append(r)
        cells = []
        for j in sorted(at):
            reach, end = max(r.x1 for r in at[j]), j
            while end + 1 < len(starts) and end + 1 not in at and reach > starts[end + 1] + REACH:
                end += 1
            cells.append(Cell(j, end - j + 1, " ".join(r.text for r in at[j])))
        out.append((cells, min(r.y0 for r in band), max(r.y1 for r in band)))
    return out


def merged(rows: list[tuple[list[Cell], float, float]], columns: int) -> list[list[Cell]]:
    """Rows that go on the one above are taken into it: close under it, without a cell in the first of several columns, and
    with cells only where it has some. Lines of a cell keep their order."""
    out: list[list[Cell]] = []
    low = 0.0
    for cells, y0, y1 in rows:
        if out and low - y1 <= ROW_GAP and not (columns > 1 and cells[0].column == 0):
            held = {c.column: c for c in out[-1]}
            if all(c.column in held for c in cells):
                for c in cells:
                    held[c.column] = held[c.column]._replace(text=f"{held[c.column].text}\n{c.text}")
                out[-1], low = list(held.values()), min(low, y0)
                continue
        out.append(cells)
        low = y0
    return out


def rebuilt(runs: DataFrame, key: str) -> DataFrame:
    """``key, section, row, column, span, text``: the cells of each table of ``runs (key, band, x0, y0, x1, y1, text)``.

    Bands count from the top. Runs that are null or blank are none, and so is a table without any; runs that begin
    together go by their right edge and text. A table is one task's, as it is one page's; tables spread by their key.
    """
    kind = runs.schema[key].dataType.simpleString()

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["band", "x0", "x1", "text"])
        bands = [[Run(*r) for r in zip(g.x0, g.y0, g.x1, g.y1, g.text)] for _, g in frame.groupby("band", sort=True)]
        out = []
        for s, section in enumerate(sections(bands)):
            columns = max(len(b) for b in section)
            for i, cells in enumerate(merged(grid(section), columns)):
                out += [(frame[key].iloc[0], s, i, c.column, c.span, c.text) for c in cells]
        return pd.DataFrame(out, columns=[key, "section", "row", "column", "span", "text"])

    held = runs.filter((F.trim("text") != "") & F.col(key).isNotNull()).select(key, F.col("band").cast("long").alias("band"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")
    return held.groupBy(key).applyInPandas(folded, f"{key} {kind}, section bigint, row bigint, column bigint, span bigint, text string")


#: Points of a character and of a line, characters of a printed line, and of the indent of its second and later ones.
CHAR, LINE, GAP, WIDTH, INDENT = 6.0, 11.0, 3.0, 72, 12


def printed(docs: DataFrame) -> DataFrame:
    """The lines of texts with bars as they would be printed: wrapped at ``WIDTH`` characters with an indent, cells parted
    by bars or by a run of blanks, and room after a line that ends a sentence. ``doc_id, band, x0, y0, x1, y1, text``."""
    lines = docs.filter(F.contains("text", F.lit("|"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    pieces = F.filter(F.regexp_extract_all("said", F.lit(rf"(.{{1,{WIDTH}}})"), F.lit(1)), lambda x: F.trim(x) != "")
    wrapped = lines.select("doc_id", "line", F.posexplode(pieces).alias("piece", "shown"))
    bands = wrapped.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "piece", "shown"))).alias("b"))
    start = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<struct<y:double,piece:int,shown:string>>").alias("out"))
    step = lambda a, x: F.struct(
        (a["y"] - LINE - F.when(F.rtrim(x["shown"]).endswith("."), 10 * GAP).otherwise(GAP)).alias("y"),
        F.array_append(a["out"], F.struct(a["y"].alias("y"), x["piece"].alias("piece"), x["shown"].alias("shown"))).alias("out"),
    )
    placed = bands.select("doc_id", F.posexplode(F.aggregate("b", start, step)["out"]).alias("band", "p")).select("doc_id", "band", "p.*")
    cells = placed.withColumn("parts", F.split("shown", r"\|")).withColumn("ends", F.aggregate("parts", F.array().cast("array<int>"), lambda a, p: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + F.length(p))))
    runs = cells.select("doc_id", "band", "y", "piece", F.explode(F.arrays_zip("parts", "ends")).alias("c"))
    left = F.when(F.col("piece") > 0, INDENT).otherwise(0) + F.col("c.ends") - F.length("c.parts") + F.length("c.parts") - F.length(F.ltrim("c.parts"))
    right = F.when(F.col("piece") > 0, INDENT).otherwise(0) + F.col("c.ends") - (F.length("c.parts") - F.length(F.rtrim("c.parts")))
    return runs.select("doc_id", "band", (left * CHAR).alias("x0"), (F.col("y") - LINE).alias("y0"), (right * CHAR).alias("x1"), F.col("y").alias("y1"), F.trim("c.parts").alias("text")).filter("text <> ''")


def compound_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, rows and cells of the tables that documents with bars hold."""
    found = rebuilt(printed(table(spark, sf_dir, "documents")), "doc_id")
    return found.select("doc_id", "section", "row", "column", "span", F.sha2("text", 256).alias("text"))


def chained(links: DataFrame) -> DataFrame:
    """``node, head, place`` for every node of ``links (node, prior)``, in which each node has one prior and is the prior of
    one at the most: the first of its chain, and how many stand before it.

    Pointers jump: after each round a node points twice as far, so a chain of n needs log2(n) rounds, each of them a join
    in which every node has one row. Circles are not chains: their nodes are left out once no chain is that long.
    """
    ptr = links.select("node", "prior", F.lit(1).cast("long").alias("steps"))
    first = links.select(F.col("prior").alias("node")).join(links.select("node"), "node", "left_anti").distinct()
    done = kept(first.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("place")), "chains")
    ptr, n, span = kept(ptr, "pointers"), links.count() + 1, 1
    while span <= 2 * n and not ptr.isEmpty():
        # a pointer at a node whose head is known is known itself
        known = done.select(F.col("node").alias("prior"), "head", "place")
        fresh = kept(ptr.join(known, "prior").select("node", "head", (F.col("place") + F.col("steps")).alias("place")), "chains")
        done = kept(done.unionByName(fresh), "chains")
        rest = ptr.join(fresh.select("node"), "node", "left_anti")
        ahead = rest.select(F.col("node").alias("prior"), F.col("prior").alias("further"), F.col("steps").alias("more"))
        # where the prior has just become known there is no pointer to follow, and the next round reads it
        jumped = rest.join(ahead, "prior", "left").select("node", F.coalesce("further", "prior").alias("prior"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        ptr = kept(jumped, "pointers")
        span *= 2
    return done


def continued_tables(tables: DataFrame) -> DataFrame:
    """``doc, page, no, logical_page, logical_no, part``: each table of ``tables (doc, page, no, columns, header)`` with the
    first of those that it goes on from page to page, and its part from 0.

    The last table of a page goes on in the first of the next page if both have as many columns and their headers do not
    differ; a header without words fits any. A page whose only table goes both ways carries a chain on.
    """
    plain = F.transform("header", lambda h: F.lower(F.trim(F.regexp_replace(F.coalesce(h, F.lit("")), r"\s+", " "))))
    w = Window.partitionBy("doc").orderBy("page", "no")
    rows = tables.select("doc", "page", "no", F.struct("page", "columns", plain.alias("header"), F.exists(plain, lambda h: h != "").alias("worded")).alias("t"))
    a, b = F.col("a"), F.col("t")
    # where the table before is on the page before, it is the last there and this one the first here
    fits = (a["page"] + 1 == b["page"]) & (a["columns"] == b["columns"]) & (~a["worded"] | ~b["worded"] | (a["header"] == b["header"]))
    goes = F.coalesce(fits & F.col("doc").isNotNull(), F.lit(False))
    rows = rows.withColumn("a", F.lag("t").over(w)).select("doc", "page", "no", goes.alias("goes"))
    head = F.last(F.when(~F.col("goes"), F.struct("page", "no")), ignorenulls=True).over(w)
    return rows.withColumn("head", head).select("doc", "page", "no", F.col("head.page").alias("logical_page"), F.col("head.no").alias("logical_no"), F.coalesce(F.col("page") - F.col("head.page"), F.lit(0)).cast("bigint").alias("part"))


def tables_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a customer's bundle: a page is an order by date, its tables are its lines by status, with the return flags
    in them as columns."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").distinct()
    pages = o.select("o_custkey", "o_orderkey", F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)").alias("page"))
    cells = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag"), "l_orderkey").groupBy("l_orderkey", "l_linestatus").agg(F.sort_array(F.collect_set("l_returnflag")).alias("header"))
    held = cells.join(pages, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc"), "page", F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("no"), F.size("header").alias("columns"), "header")
    # an order has a table or two
    return continued_tables(dealt(held, "doc", 2 * table(spark, sf_dir, "orders").count()))


#: Characters of a page in ``paragraphs_over_pages``.
PAGE_CHARS = 600


def continued_paragraphs(pages: DataFrame) -> DataFrame:
    """``doc, page, logical_page, part``: pages of ``pages (doc, page, text)`` whose first paragraph goes on from the page before.

    The last line of a page and the first of the next are one paragraph if the last ends no sentence, is cut by a hyphen, or
    the first begins in lower case, and neither begins a heading, a quote or an item. A page of several lines ends a chain;
    blank and null pages have no lines and link nothing.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    own = pages.select("doc", "page", lines.alias("lines")).filter(F.size("lines") > 0)
    own = own.select("doc", "page", F.trim(F.element_at("lines", 1)).alias("head"), F.trim(F.element_at("lines", -1)).alias("tail"), (F.size("lines") == 1).alias("single"))
    apart = lambda c: F.col(c).rlike(r"^([#>]|[-*] |[0-9]+[.)] |[a-z]\) )")
    a, b = own.select("doc", F.col("page").alias("before"), "tail", "single"), own.select("doc", "page", "head")
    open_ = ~F.col("tail").rlike(r"[.!?:;]['\")\]]*$") | F.col("tail").rlike(r"[\p{L}_]-$") | F.col("head").rlike(r"^\p{Ll}")
    met = b.join(a, (b["doc"] == a["doc"]) & (b["page"] == a["before"] + 1) & open_ & ~apart("head") & ~apart("tail")).select(b["doc"], b["page"], "before", "single")
    # a page whose only line goes on both ways is in the middle of a chain, any other begins one with its last line
    name = lambda page, part: F.struct(F.col("doc"), F.col(page).alias("page"), F.lit(part).alias("line"))
    singles = own.filter("single").select("doc", F.col("page").alias("p"))
    links = met.join(singles, (met["doc"] == singles["doc"]) & (met["page"] == singles["p"]), "left").select(met["doc"], met["page"], "before", "single", F.col("p").isNotNull().alias("whole"))
    node = F.when(F.col("whole"), name("page", "only")).otherwise(name("page", "head"))
    prior = F.when(F.col("single"), name("before", "only")).otherwise(name("before", "tail"))
    chains = chained(kept(links.select(node.alias("node"), prior.alias("prior")), "continued"))
    return chains.filter("place > 0").select("node.doc", "node.page", F.col("head.page").alias("logical_page"), F.col("place").alias("part"))


def paragraphs_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document that run over its pages of ``PAGE_CHARS`` characters."""
    cut = F.regexp_extract_all("text", F.lit(rf"(?s)(.{{1,{PAGE_CHARS}}})"), F.lit(1))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(cut).alias("page", "text"))
    return continued_paragraphs(pages).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (compound_tables, tables_over_pages, paragraphs_over_pages)}
ORACLE = {
    "tables_over_pages": """
WITH pages AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page FROM (SELECT DISTINCT o_custkey, o_orderkey, o_orderdate FROM orders)),
t AS (SELECT o_custkey AS doc, page, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS no, list_sort(list(DISTINCT l_returnflag)) AS h FROM lineitem JOIN pages ON l_orderkey = o_orderkey GROUP BY ALL),
x AS (SELECT *, lag(page) OVER w AS pp, lag(h) OVER w AS ph FROM t WINDOW w AS (PARTITION BY doc ORDER BY page, no)),
c AS (SELECT *, sum(CASE WHEN pp = page - 1 AND ph = h THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, no ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT doc, page, no, first(page) OVER w AS logical_page, first(no) OVER w AS logical_no, row_number() OVER w - 1 AS part FROM c WINDOW w AS (PARTITION BY doc, g ORDER BY page, no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "paragraphs_over_pages": rf"""
WITH p AS (SELECT doc_id, i AS page, substr(text, CAST(i * {PAGE_CHARS} + 1 AS BIGINT), {PAGE_CHARS}) AS t FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {PAGE_CHARS}.0) AS BIGINT))) AS i FROM documents)),
l AS (SELECT doc_id, page, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM p),
o AS (SELECT doc_id, page, trim(ls[1], ' ') AS head, trim(ls[-1], ' ') AS tail, len(ls) = 1 AS single FROM l WHERE len(ls) > 0),
x AS (SELECT *, lag(page) OVER w AS pp, lag(tail) OVER w AS pt, lag(single) OVER w AS ps FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
m AS (SELECT *, pp = page - 1 AND (NOT regexp_matches(pt, '[.!?:;][''")\]]*$') OR regexp_matches(pt, '[\p{{L}}_]-$') OR regexp_matches(head, '^\p{{Ll}}'))
  AND NOT regexp_matches(head, '^([#>]|[-*] |[0-9]+[.)] |[a-z]\) )') AND NOT regexp_matches(pt, '^([#>]|[-*] |[0-9]+[.)] |[a-z]\) )') AS goes FROM x),
c AS (SELECT *, sum(CASE WHEN goes AND ps AND lag_goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(goes) OVER (PARTITION BY doc_id ORDER BY page) AS lag_goes FROM m))
SELECT doc_id, page, first(pp) OVER w AS logical_page, row_number() OVER w AS part FROM c WHERE goes WINDOW w AS (PARTITION BY doc_id, g ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
}
