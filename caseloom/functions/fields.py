"""Fields read off texts: folds, numbers, names, roles, dates, ids, lines, lists, tables and headings, as expressions."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from caseloom.functions.passages import _folds, one_spaced
from caseloom.functions.text import count_of
from caseloom.sources.tables import dealt, table, texts


def ladder(text: Column, *rules: tuple[str, str]) -> Column:
    """The name of the first pattern that is found; null without one."""
    return F.coalesce(*(F.when(text.rlike(pattern), name) for pattern, name in rules))


def upper_fold(text: Column) -> Column:
    """Plain capitals and digits: marks away, other letters dropped, everything else one space."""
    plain = F.regexp_replace(F.translate(text, *_folds()), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.upper(plain), "[^A-Z0-9]+", " "))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of ``name`` in a namespace, given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab89ab89ab89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def parsed_date(text: Column) -> tuple[Column, Column]:
    """Day (null if there is none) and precision of a date in one of five spellings, at the start of a text; a date that
    the calendar does not have is none."""
    at = lambda p, f: F.try_to_date(F.regexp_extract(text, p, 0), f)
    day = F.coalesce(at("^[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"), at("^[0-9]{2}-[0-9]{2}-[0-9]{4}", "dd-MM-yyyy"), at(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "dd.MM.yyyy"), at("^[0-9]{8}$", "yyyyMMdd"), at("^[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"))
    month = F.try_to_date(F.concat(F.regexp_extract(text, "^[0-9]{4}-[0-9]{2}$", 0), F.lit("-01")), "yyyy-MM-dd")
    precision = F.when(day.isNotNull() & text.rlike("[ T][0-9]{2}:[0-9]{2}"), "DATETIME").when(day.isNotNull(), "DATE").when(month.isNotNull(), "MONTH").otherwise("UNKNOWN")
    return F.coalesce(day, month), precision


def heading_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, block_no, heading_path, content``: the blocks of a Markdown text between blank lines, each under the open
    headings; neighbouring list items of one heading are one block."""
    parts = rows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n")).alias("no", "raw")).select(key, "no", F.trim("raw").alias("b")).filter("b <> ''")
    mark = F.regexp_extract("b", r"^ {0,3}(#{1,6})[ \t]+", 1)
    name = F.regexp_extract("b", r"^ {0,3}#{1,6}[ \t]+([^\n]+?)[ \t]*#*[ \t]*(?:\n|$)", 1)
    parts = parts.withColumn("level", F.length(mark)).withColumn("name", name)
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, 7):  # the last heading of this level, unless a higher one came after it
        own = F.last(F.when(F.col("level") == level, F.struct("no", "name")), ignorenulls=True).over(w)
        over = F.max(F.when((F.col("level") > 0) & (F.col("level") < level), F.col("no"))).over(w)
        parts = parts.withColumn(f"h{level}", F.when(own["no"] > F.coalesce(over, F.lit(-1)), own["name"]))
    path = F.array_join(F.array_compact(F.array(*[f"h{i}" for i in range(1, 7)])), " > ")
    body = F.when(F.col("level") > 0, F.trim(F.regexp_replace("b", r"^[^\n]*\n?", ""))).otherwise(F.col("b"))
    blocks = parts.select(key, "no", path.alias("heading_path"), body.alias("content")).filter("content <> ''")
    item = F.col("content").rlike(r"^\s*(?:[-*+] |[0-9]+[.)] )")
    v = Window.partitionBy(key).orderBy("no")
    joins = item & F.coalesce(F.lag(item).over(v), F.lit(False)) & (F.lag("heading_path").over(v) == F.col("heading_path"))
    groups = blocks.withColumn("g", F.sum(F.when(joins, 0).otherwise(1)).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_sort(F.collect_list(F.struct("no", "content")))
    return groups.groupBy(key, F.col("g").alias("block_no"), "heading_path").agg(F.array_join(F.transform(held, lambda x: x["content"]), "\n\n").alias("content"))


class _Tables(HTMLParser):
    """The cells of the tables of a page: table, row, column, rows and columns that they span, text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.table, self.row, self.open = -1, -1, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            told = dict(attrs)
            span = lambda n: max(1, int(told.get(n) or 1)) if str(told.get(n) or 1).isdigit() else 1
            self.cells.append([self.table, self.row, span("rowspan"), span("colspan"), ""])
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag not in ("td", "th", "tr", "table")

    def handle_data(self, data):
        if self.open:
            self.cells[-1][4] += data


#: As HTML has it, no cell spans more columns than that.
MOST_COLUMNS = 1000


def grid_cells(page: str | None) -> list[tuple[int, int, int, str]]:
    """``table, row, column, text`` of every place of a page's tables; a cell fills all places that it spans.

    A cell spans no more rows than its table has below it, and no more columns than ``MOST_COLUMNS``. What a cell takes of
    the rows below is kept as one interval; only the places of the open row are a set. Of cells that meet, the earlier has
    the place.
    """
    out, told = [], plain_cells(page)
    if told is None:
        parser = _Tables()
        parser.feed(page or "")
        told = parser.cells
    rows: dict[int, dict[int, list]] = {}
    for number, row, down, across, text in told:
        rows.setdefault(number, {}).setdefault(row, []).append((down, min(across, MOST_COLUMNS), " ".join(text.split())))
    for number, cells in rows.items():
        height, held = max(cells) + 1, []  # first and last column, row behind the last, text
        for row in range(height):
            taken: set[int] = set()

            def fill(first: int, last: int, text: str) -> None:
                for c in range(first, last):
                    if c not in taken:
                        taken.add(c)
                        out.append((number, row, c, text))

            held = [h for h in held if h[2] > row]
            for first, last, _, text in held:
                fill(first, last, text)
            column = 0
            for down, across, text in cells.get(row, ()):
                while column in taken:
                    column += 1
                fill(column, column + across, text)
                if down > 1:
                    held.append((column, column + across, row + down, text))
    return sorted(out)


#: What ``plain_cells`` reads: tags of tables and paragraphs, at most with a bare span, and text without a bracket. An ampersand
#: begins a named reference of those whose end is told, or there is none.
_PLAIN = re.compile(r"(?:[^<&]|&(?:amp|lt|gt|quot|#[0-9]{2,4});|</?(?:table|tr|td|th|p)>|<t[dh] (?:row|col)span=[0-9]{1,5}>)*+")
_TAG = re.compile(r"<(/?)(table|tr|t[dh]|p)(?: (row|col)span=([0-9]+))?>([^<]*)")


def plain_cells(page: str | None) -> list[list] | None:
    """What ``_Tables`` finds in a page of nothing but plain tags, without a parser of HTML; None for any other page."""
    if not page or _PLAIN.fullmatch(page) is None:
        return None
    cells, table, row, open_ = [], -1, -1, False
    for close, tag, way, span, text in _TAG.findall(page):
        if close:
            open_ = open_ and tag == "p"
        elif tag == "table":
            table, row = table + 1, -1
        elif tag == "tr":
            row += 1
        elif tag != "p":
            n = max(1, int(span or 1))
            cells.append([table, row, n if way == "row" else 1, n if way == "col" else 1, ""])
            open_ = True
        if open_ and text:
            cells[-1][4] += unescape(text) if "&" in text else text
    return cells


_CELL = StructType([StructField(n, IntegerType()) for n in ("table", "row", "column")] + [StructField("text", StringType())])
_ARROW_CELL = pa.struct([(n, pa.int32()) for n in ("table", "row", "column")] + [("text", pa.string())])


@F.arrow_udf(ArrayType(_CELL))
def html_grids(pages: pa.Array) -> pa.Array:
    ends, found = [0], []
    for page in pages:
        found += grid_cells(page.as_py())
        ends.append(len(found))
    columns = zip(*found) if found else ((),) * 4
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_CELL)], fields=list(_ARROW_CELL))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def name_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of every document in plain capitals."""
    return texts(spark, sf_dir).select("doc_id", upper_fold(F.left("text", F.lit(200))).alias("fold"))


def process_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of cases in their written form, found in a sentence, and what their digits say of court and route."""
    segment = F.element_at(F.array(*map(F.lit, "34568")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    written = F.format_string("%07d-%02d.%04d.%s.%02d.%04d", F.col("o_orderkey"), F.col("o_custkey") % 97, F.year("o_orderdate"), segment, F.col("o_custkey") % 30, F.col("o_orderkey") % 9999)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Autos n. "), written, F.lit(", fls. 3")).alias("sentence"))
    found = F.regexp_extract("sentence", r"[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}", 0)
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.substring(digits, 15, 2).cast("int")
    s = F.substring(digits, 14, 1)
    route = F.when((s == "4") & n.between(1, 6), F.concat(F.lit("trf"), n.cast("string"))).when((s == "5") & (n == 0), "tst").when((s == "5") & n.between(1, 24), F.concat(F.lit("trt"), n.cast("string"))).when((s == "3") & (n == 0), "stj").when((s == "8") & n.between(1, 27), F.concat(F.lit("tj"), n.cast("string")))
    return o.select("o_orderkey", digits.alias("digits"), route.alias("route"))


def type_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each kind of part by the first pattern that fits."""
    kind = ladder(F.upper("p_type"), ("^ECONOMY.*(STEEL|TIN)$", "CHEAP_METAL"), ("(STEEL|TIN|COPPER|NICKEL|BRASS)", "METAL"), ("^(LARGE|STANDARD)", "BIG"))
    return table(spark, sf_dir, "part").groupBy(F.coalesce(kind, F.lit("OTHER")).alias("kind"), "p_type").agg(F.count("*").alias("n"))


def turn_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn's author is in the case, and what the turn is: an order, a question, a list or a statement."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    who = F.when(role.isin("user", "human"), "CLAIMANT").when(role.isin("assistant", "model"), "RESPONDENT").when(role.contains("system"), "COURT").when(role.contains("tool"), "EXPERT").otherwise("OTHER")
    low = F.lower(F.coalesce("text", F.lit("")))
    act = F.coalesce(ladder(low, (r"\?\s*$", "QUESTION"), (r"^\s*(?:[-*+] |[0-9]+[.)] )", "LIST"), (r"[0-9]{3,}", "FIGURES")), F.when(F.trim(low) == "", "EMPTY"), F.lit("STATEMENT"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", who.alias("party"), act.alias("act"))


def excerpt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 180 characters before the first long number of a text to 260 after its start, blanks as one space."""
    at = F.regexp_instr("text", F.lit("[0-9]{4,}"))
    first = F.greatest(F.lit(1), at - 180)
    cut = one_spaced(F.substring(F.col("text"), first, at - first + 260))
    return texts(spark, sf_dir).filter(at > 0).select("doc_id", F.sha2(cut, 256).alias("excerpt_hash"), F.length(cut).cast("bigint").alias("n_chars"))


def instruction_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of four families in their order; what one family has taken the next ones no longer see."""
    text = F.coalesce("text", F.lit(""))
    families = {"mail": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "address": r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}", "number": r"[0-9]{4,}", "figure": r"[0-9]+"}
    out, rest = [], text
    for name, pattern in families.items():
        out.append(count_of(rest, pattern).alias(f"n_{name}"))
        rest = F.regexp_replace(rest, pattern, " ")
    return texts(spark, sf_dir).select("doc_id", *out)


def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every text, cut after a stop that a blank follows, numbered."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])[ \t\r\n]+", "$1\x01")
    s = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split(marked, "\x01")).alias("no", "s")).select("doc_id", "no", F.trim("s").alias("s")).filter("s <> ''")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("bigint").alias("longest"), F.min(F.length("s")).cast("bigint").alias("shortest"))


def trailing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of capitalised words in the first line of a text: what is left of a name after header prose."""
    line = F.element_at(F.split("text", "\n"), 1)
    name = F.regexp_extract(line, r"(?:^|[^A-Za-z])([A-Z][a-z']+(?: [A-Z][a-z']+)*)[^A-Z]*$", 1)
    return texts(spark, sf_dir).filter("text is not null").select("doc_id", F.when(name != "", name).alias("name"))


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without control characters and with even blanks, and how much went."""
    t = F.coalesce("text", F.lit(""))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]+", ""), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    return texts(spark, sf_dir).select("doc_id", F.sha2(clean, 256).alias("clean_hash"), (F.length(t) - F.length(clean)).cast("bigint").alias("n_removed"))


def tabular_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which at least seven in ten lines have several cells, cut at bars, tabs or wide gaps."""
    lines = texts(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    cells = lines.select("doc_id", F.size(F.filter(F.split("line", r"\||\t| {2,}"), lambda c: F.trim(c) != "")).alias("n"))
    g = cells.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("n") >= 2).alias("n_rows"), F.max("n").cast("bigint").alias("n_columns"))
    return g.withColumn("is_grid", 10 * F.col("n_rows") >= 7 * F.col("n_lines"))


def gfm_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a Markdown table; bars in a cell are escaped."""
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("| "), cell(F.col("n_nationkey")), F.lit(" | "), cell(F.col("n_name")), F.lit(" |"))
    g = n.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("body"), F.count("*").alias("n_rows"))
    return g.select("r_name", "n_rows", F.concat(F.lit("| key | name |\n| --- | --- |\n"), F.col("body")).alias("gfm"))


def span_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables whose first cell spans all rows and whose foot spans two columns, read back place by place."""
    l = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey"), "l_orderkey")
    g = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x"))
    rows = F.array_join(F.transform("x", lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<th rowspan="), F.size("x").cast("string"), F.lit(">"), F.col("l_orderkey").cast("string"), F.lit("</th>"))).otherwise(""), F.lit("<td>"), r["l_linenumber"].cast("string"), F.lit("</td><td>"), r["l_returnflag"], F.lit(" &amp; </td>"))), "</tr>")
    page = F.concat(F.lit("<p>x</p><table>"), rows, F.lit("</tr><tr><td colspan=2>sum</td><td>"), F.size("x").cast("string"), F.lit("</td></tr></table>"))
    # a row is one order's whole page, so its columns are read off its own cells
    columns = F.transform(F.array_distinct(F.transform("cells", lambda c: c["column"])), lambda k: F.struct(k.alias("column"), F.array_sort(F.transform(F.filter("cells", lambda c: c["column"] == k), lambda c: F.struct(c["row"], c["text"]))).alias("x")))
    held = g.select("l_orderkey", html_grids(page).alias("cells")).select("l_orderkey", F.inline(columns))
    return held.select("l_orderkey", "column", F.size("x").cast("bigint").alias("n_rows"), F.sha2(F.array_join(F.transform("x", lambda c: c["text"]), "|"), 256).alias("column_hash"))


def reflowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with words joined that a line's end had cut, and single line ends as spaces; blank lines stay."""
    joined = F.regexp_replace(F.coalesce("text", F.lit("")), r"([a-z])-\n([a-z])", "$1$2")
    flow = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"\n\n+", "\x01"), r"\n", " "), "\x01", "\n\n")
    return texts(spark, sf_dir).select("doc_id", F.sha2(flow, 256).alias("flow_hash"), (F.length(F.coalesce("text", F.lit(""))) - F.length(flow)).cast("bigint").alias("n_joined"))


_BLOCKS = ((r"^\s*(?:[-*+] |[0-9]+[.)] )", "LIST"), (r"\|.*\|", "TABLE"), (r"^\s*[\"'«“>]", "QUOTE"), (r"^[^a-z]{4,80}$", "TITLE"), (r"^.{1,60}[^.!?;:,\s]\s*$", "SECTION"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).filter("trim(line) <> ''")
    return lines.withColumn("role", F.coalesce(ladder(F.col("line"), *_BLOCKS), F.lit("PARAGRAPH")))


def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text by what they look like."""
    return _lines(spark, sf_dir).groupBy("doc_id", "role").agg(F.count("*").alias("n"), F.min("no").cast("bigint").alias("first_line"))


def flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of one look as one node of the text, in order."""
    w = Window.partitionBy("doc_id").orderBy("no")
    rows = _lines(spark, sf_dir).withColumn("c", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    rows = rows.withColumn("node", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "node").agg(F.min("role").alias("role"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring lines of which the second goes on with the first's sentence, by text."""
    w = Window.partitionBy("doc_id").orderBy("no")
    rows = _lines(spark, sf_dir).select("doc_id", "no", "line", F.lead("line").over(w).alias("next")).filter("next is not null")
    goes_on = ~F.col("line").rlike(r"[.!?:;]\s*$") & F.col("next").rlike(r"^\s*[a-z(]")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.count_if(goes_on).alias("n_continued"), F.count_if(F.col("line").rlike("-$") & goes_on).alias("n_hyphenated"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the lists in each page, without their markup: how many, in how many lists, and the longest."""
    html = F.coalesce("html", F.lit(""))
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    return table(spark, sf_dir, "pages").select("page_id", F.size(items).cast("bigint").alias("n_items"), count_of(html, "(?i)<[uo]l[ >]").alias("n_lists"), F.array_max(F.transform(items, lambda x: F.length(x))).cast("bigint").alias("longest"))


def heading_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each page by its first heading, whose text must be there."""
    head = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), "<[^>]*>", ""))
    kind = F.coalesce(ladder(head, (r"\|", "TABLE"), (r"[0-9]{4,}", "NUMBERED"), (r"[%#$*&]{3,}", "JUNK"), (r"^\S+$", "WORD")), F.when(head == "", "UNCONFIRMED"), F.lit("TEXT"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("type"), F.length(head).cast("bigint").alias("n_chars"))


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as Markdown, and its blocks under their headings: two levels, a list that is one block, and an end."""
    l = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("- piece "), n.cast("string"))), "\n\n").alias("items"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat(F.lit("# "), F.col("o_orderpriority"), F.lit(" #\n\nIntro of "), F.col("o_orderkey").cast("string"), F.lit("\n\n## Pieces\n\n"), F.col("items"), F.lit("\n\n# End\nLast line"))
    blocks = heading_blocks(o.select("o_orderkey", text.alias("md")), "o_orderkey", "md")
    return blocks.select("o_orderkey", F.col("block_no").cast("bigint"), "heading_path", F.sha2("content", 256).alias("content_hash"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in seven spellings, one of which no calendar has, read back with their precision."""
    kind = F.col("o_orderkey") % 7
    as_ = lambda f: F.date_format("o_orderdate", f)
    raw = F.when(kind == 0, as_("dd/MM/yyyy HH:mm")).when(kind == 1, as_("dd-MM-yyyy")).when(kind == 2, as_("dd.MM.yyyy")).when(kind == 3, as_("yyyyMMdd")).when(kind == 4, as_("yyyy-MM-dd'T'HH:mm")).when(kind == 5, as_("yyyy-MM")).otherwise(F.concat(F.lit("30/02/"), as_("yyyy")))
    day, precision = parsed_date(F.col("raw"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", F.date_format(day, "yyyy-MM-dd").alias("day"), precision.alias("precision"))


def duty_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of duties: what, for whom, by when, in words that fit the number of days."""
    days = F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 5).when(F.col("o_orderpriority").startswith("3"), 15)
    label = F.when(days.isNull(), "no term").when(days == 1, "1 day").otherwise(F.concat(days.cast("string"), F.lit(" days")))
    status = F.element_at(F.create_map(*map(F.lit, ("F", "done", "O", "open", "P", "in part"))), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("Order %d (%s): %s", F.col("o_orderkey"), status, label).alias("title"))


def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs of customers, as the URL namespace makes them."""
    name = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", uuid5("6ba7b8119dad11d180b400c04fd430c8", name).alias("uuid"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a movement is known by: its number where it has one, else its date, class and sum if all are there; and a hash
    of its source without what is only shown."""
    o = table(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("W"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")))
    literal = F.when(F.col("o_totalprice") > 1000, F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", F.col("o_custkey").cast("string")))
    kind = F.when(number.isNotNull(), "NUMBER").when(literal.isNotNull(), "LITERAL").otherwise("NONE")
    return o.select("o_orderkey", kind.alias("kind"), F.sha2(F.coalesce(number, literal), 256).alias("fingerprint"), F.sha2(F.to_json(F.struct("o_custkey", "o_orderkey", "o_orderstatus")), 256).alias("source_hash"))


def payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in nested JSON, flattened and each once: a movement's payload lists its pieces, each with its source."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("n"))).alias("pieces"))).alias("payload"))
    pieces = F.from_json("payload", "pieces array<struct<source bigint, n int>>")["pieces"]
    ids = F.array_distinct(F.transform(pieces, lambda p: p["source"]))
    return l.select("l_orderkey", F.size(ids).cast("bigint").alias("n_sources"), F.array_join(F.array_sort(ids), ",").alias("sources"), F.array_min(F.transform(pieces, lambda p: p["n"])).alias("first"), F.array_max(F.transform(pieces, lambda p: p["n"])).alias("last"))


def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's address says in its query: the parameters, whether they agree with the path, and the address without
    secrets."""
    url = F.coalesce("url", F.lit(""))
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    value = lambda n: F.regexp_extract(q, f"(?:^|&){n}=([^&]*)", 1)
    path_no = F.regexp_extract(url, r"/([0-9]+)(?:[?#]|$)", 1)
    code = F.when(path_no == "", "NO_NUMBER").when(q == "", "NO_QUERY").when(value("page") != "", "PAGED").otherwise("TRACKED")
    bare = F.regexp_replace(url, r"([?&](?:utm_source|ref|token)=)[^&#]*", "$1REMOVED")
    return table(spark, sf_dir, "pages").select("page_id", value("page").alias("page"), value("ref").alias("ref"), code.alias("code"), bare.alias("safe_url"))


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to wait, read from a message, else doubled for each attempt; never over a minute."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")
    message = F.when(F.col("event_type") == "view", F.concat(F.lit("retry after "), F.col("k").cast("string"), F.lit(" s"))).otherwise("failed")
    told = F.regexp_extract(message, "retry after ([0-9]+)", 1)
    wait = F.when(told != "", told.cast("bigint")).otherwise(F.pow(F.lit(2.0), F.col("k") % 8).cast("bigint"))
    return e.select("event_id", F.least(wait, F.lit(60)).alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        name_folds, process_numbers, type_ladder, turn_roles, excerpt_windows, instruction_families, sentence_windows, trailing_names, sanitised, tabular_grids, gfm_tables, span_tables,
        reflowed, block_roles, flow_nodes, continuations, list_items, heading_types, heading_paths, date_forms, duty_titles, uuid5_ids, fingerprints, payload_ids, query_strings, retry_waits,
    )
}

_SQL_LINES = r"""n AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
b AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*(?:[-*+] |[0-9]+[.)] )') THEN 'LIST' WHEN regexp_matches(line, '\|.*\|') THEN 'TABLE' WHEN regexp_matches(line, '^\s*["''«“>]') THEN 'QUOTE' WHEN regexp_matches(line, '^[^a-z]{4,80}$') THEN 'TITLE'
  WHEN regexp_matches(line, '^.{1,60}[^.!?;:,\s]\s*$') THEN 'SECTION' ELSE 'PARAGRAPH' END AS role FROM n WHERE trim(line, ' ') <> '')"""
ORACLE = {
    "name_folds": r"SELECT doc_id, trim(regexp_replace(upper(regexp_replace(strip_accents(left(text, 200)), '[^\x00-\x7F]', '', 'g')), '[^A-Z0-9]+', ' ', 'g'), ' ') AS fold FROM documents",
    "process_numbers": """
WITH p AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0') || year(o_orderdate) || substr('34568', CAST(o_orderkey % 5 + 1 AS BIGINT), 1) || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 9999 AS VARCHAR), 4, '0') AS digits, o_custkey % 30 AS n FROM orders)
SELECT o_orderkey, digits, CASE substr(digits, 14, 1) WHEN '4' THEN CASE WHEN n BETWEEN 1 AND 6 THEN 'trf' || n END WHEN '5' THEN CASE WHEN n = 0 THEN 'tst' WHEN n BETWEEN 1 AND 24 THEN 'trt' || n END WHEN '3' THEN CASE WHEN n = 0 THEN 'stj' END WHEN '8' THEN CASE WHEN n BETWEEN 1 AND 27 THEN 'tj' || n END END AS route FROM p""",
    "type_ladder": """
SELECT p_type, CASE WHEN regexp_matches(upper(p_type), '^ECONOMY.*(STEEL|TIN)$') THEN 'CHEAP_METAL' WHEN regexp_matches(upper(p_type), '(STEEL|TIN|COPPER|NICKEL|BRASS)') THEN 'METAL' WHEN regexp_matches(upper(p_type), '^(LARGE|STANDARD)') THEN 'BIG' ELSE 'OTHER' END AS kind, count(*) AS n FROM part GROUP BY ALL""",
    "turn_roles": r"""
WITH a AS (SELECT conv_id, turn, lower(trim(coalesce(role, ''), ' ')) AS r, lower(coalesce(text, '')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN r IN ('user', 'human') THEN 'CLAIMANT' WHEN r IN ('assistant', 'model') THEN 'RESPONDENT' WHEN contains(r, 'system') THEN 'COURT' WHEN contains(r, 'tool') THEN 'EXPERT' ELSE 'OTHER' END AS party,
  CASE WHEN regexp_matches(t, '\?\s*$') THEN 'QUESTION' WHEN regexp_matches(t, '^\s*(?:[-*+] |[0-9]+[.)] )') THEN 'LIST' WHEN regexp_matches(t, '[0-9]{3,}') THEN 'FIGURES' WHEN trim(t, ' ') = '' THEN 'EMPTY' ELSE 'STATEMENT' END AS act FROM a""",
    "excerpt_windows": r"""
WITH a AS (SELECT doc_id, text, strpos(text, regexp_extract(text, '[0-9]{4,}')) AS p FROM documents WHERE regexp_matches(text, '[0-9]{4,}')),
c AS (SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, p - 180), p - greatest(1, p - 180) + 260), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ') AS x FROM a) SELECT doc_id, sha256(x) AS excerpt_hash, length(x) AS n_chars FROM c""",
    "instruction_families": r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT *, regexp_replace(t, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+', ' ', 'g') AS u FROM a),
c AS (SELECT *, regexp_replace(u, '[0-9]{1,3}(?:[.][0-9]{1,3}){3}', ' ', 'g') AS v FROM b), d AS (SELECT *, regexp_replace(v, '[0-9]{4,}', ' ', 'g') AS w FROM c)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+')) AS n_mail, len(regexp_extract_all(u, '[0-9]{1,3}(?:[.][0-9]{1,3}){3}')) AS n_address, len(regexp_extract_all(v, '[0-9]{4,}')) AS n_number, len(regexp_extract_all(w, '[0-9]+')) AS n_figure FROM d""",
    "sentence_windows": r"""
WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))), ' ') AS s FROM documents)
SELECT doc_id, count(*) AS n, max(length(s)) AS longest, min(length(s)) AS shortest FROM s WHERE s <> '' GROUP BY 1""",
    "trailing_names": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, nullif(regexp_extract(line, '(?:^|[^A-Za-z])([A-Z][a-z'']+(?: [A-Z][a-z'']+)*)[^A-Z]*$', 1), '') AS name FROM l""",
    "sanitised": r"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]+', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS x FROM documents)
SELECT doc_id, sha256(x) AS clean_hash, length(t) - length(x) AS n_removed FROM c""",
    "tabular_grids": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, len(list_filter(regexp_split_to_array(line, '\||\t| {2,}'), lambda c: trim(c, ' ') <> '')) AS n FROM l WHERE trim(line, ' ') <> '')
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n >= 2) AS n_rows, max(n) AS n_columns, 10 * count(*) FILTER (n >= 2) >= 7 * count(*) AS is_grid FROM c GROUP BY 1""",
    "gfm_tables": r"""
SELECT r_name, count(*) AS n_rows, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\|') || ' |', chr(10) ORDER BY n_nationkey) AS gfm FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "span_tables": """
WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS r FROM lineitem), g AS (SELECT l_orderkey, count(*) AS c FROM l GROUP BY 1),
x AS (SELECT l_orderkey, 0 AS c, r, CAST(l_orderkey AS VARCHAR) AS t FROM l UNION ALL SELECT l_orderkey, 1, r, CAST(n AS VARCHAR) FROM l UNION ALL SELECT l_orderkey, 2, r, f || ' &' FROM l
  UNION ALL SELECT l_orderkey, 0, c + 1, 'sum' FROM g UNION ALL SELECT l_orderkey, 1, c + 1, 'sum' FROM g UNION ALL SELECT l_orderkey, 2, c + 1, CAST(c AS VARCHAR) FROM g)
SELECT l_orderkey, c AS "column", count(*) AS n_rows, sha256(string_agg(t, '|' ORDER BY r)) AS column_hash FROM x GROUP BY ALL""",
    "reflowed": r"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([a-z])-\n([a-z])', '\1\2', 'g'), '\n\n+', chr(1), 'g'), '\n', ' ', 'g'), chr(1), chr(10) || chr(10), 'g') AS x FROM documents)
SELECT doc_id, sha256(x) AS flow_hash, length(t) - length(x) AS n_joined FROM f""",
    "block_roles": f"WITH {_SQL_LINES} SELECT doc_id, role, count(*) AS n, min(no) AS first_line FROM b GROUP BY ALL",
    "flow_nodes": f"""WITH {_SQL_LINES}, c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY doc_id ORDER BY no) THEN 0 ELSE 1 END AS c FROM b), d AS (SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS node FROM c)
SELECT doc_id, node, min(role) AS role, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM d GROUP BY ALL""",
    "continuations": rf"""WITH {_SQL_LINES}, p AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS nx FROM b), q AS (SELECT *, NOT regexp_matches(line, '[.!?:;]\s*$') AND regexp_matches(nx, '^\s*[a-z(]') AS g FROM p WHERE nx IS NOT NULL)
SELECT doc_id, count(*) AS n_pairs, count(*) FILTER (g) AS n_continued, count(*) FILTER (g AND line LIKE '%-') AS n_hyphenated FROM q GROUP BY 1""",
    "list_items": r"""
WITH i AS (SELECT page_id, coalesce(html, '') AS h, list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ')) AS x FROM pages)
SELECT page_id, len(x) AS n_items, len(regexp_extract_all(h, '(?i)<[uo]l[ >]')) AS n_lists, list_max(list_transform(x, lambda y: length(y))) AS longest FROM i""",
    "heading_types": r"""
WITH h AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]*>', '', 'g'), ' ') AS h FROM pages)
SELECT page_id, CASE WHEN regexp_matches(h, '\|') THEN 'TABLE' WHEN regexp_matches(h, '[0-9]{4,}') THEN 'NUMBERED' WHEN regexp_matches(h, '[%#$*&]{3,}') THEN 'JUNK' WHEN regexp_matches(h, '^\S+$') THEN 'WORD' WHEN h = '' THEN 'UNCONFIRMED' ELSE 'TEXT' END AS type, length(h) AS n_chars FROM h""",
    "heading_paths": """
WITH l AS (SELECT l_orderkey, string_agg('- piece ' || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber) AS items FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderpriority AS p, items FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, 1 AS block_no, p AS heading_path, sha256('Intro of ' || o_orderkey) AS content_hash FROM o UNION ALL SELECT o_orderkey, 2, p || ' > Pieces', sha256(items) FROM o UNION ALL SELECT o_orderkey, 3, 'End', sha256('Last line') FROM o""",
    "date_forms": """
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%d/%m/%Y %H:%M') WHEN 1 THEN strftime(d, '%d-%m-%Y') WHEN 2 THEN strftime(d, '%d.%m.%Y') WHEN 3 THEN strftime(d, '%Y%m%d') WHEN 4 THEN strftime(d, '%Y-%m-%dT%H:%M') WHEN 5 THEN strftime(d, '%Y-%m') ELSE '30/02/' || strftime(d, '%Y') END AS raw,
  CASE WHEN k <= 4 THEN strftime(d, '%Y-%m-%d') WHEN k = 5 THEN strftime(d, '%Y-%m-01') END AS day, CASE WHEN k IN (0, 4) THEN 'DATETIME' WHEN k <= 3 THEN 'DATE' WHEN k = 5 THEN 'MONTH' ELSE 'UNKNOWN' END AS precision FROM (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 7 AS k FROM orders)""",
    "duty_titles": """
SELECT o_orderkey, 'Order ' || o_orderkey || ' (' || CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'in part' END || '): ' || CASE left(o_orderpriority, 1) WHEN '1' THEN '1 day' WHEN '2' THEN '5 days' WHEN '3' THEN '15 days' ELSE 'no term' END AS title FROM orders""",
    "uuid5_ids": """
WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_custkey || '|' || c_name)) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""",
    "fingerprints": """
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'W' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS n, CASE WHEN o_totalprice > 1000 THEN strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|' || o_custkey END AS l, CAST(json_object('o_custkey', o_custkey, 'o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus) AS VARCHAR) AS j FROM orders)
SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN 'NUMBER' WHEN l IS NOT NULL THEN 'LITERAL' ELSE 'NONE' END AS kind, sha256(coalesce(n, l)) AS fingerprint, sha256(j) AS source_hash FROM p""",
    "payload_ids": """
SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_sources, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS sources, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY 1""",
    "query_strings": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '\?([^#]*)', 1) AS q, regexp_extract(coalesce(url, ''), '/([0-9]+)(?:[?#]|$)', 1) AS n FROM pages)
SELECT page_id, regexp_extract(q, '(?:^|&)page=([^&]*)', 1) AS page, regexp_extract(q, '(?:^|&)ref=([^&]*)', 1) AS ref, CASE WHEN n = '' THEN 'NO_NUMBER' WHEN q = '' THEN 'NO_QUERY' WHEN regexp_extract(q, '(?:^|&)page=([^&]*)', 1) <> '' THEN 'PAGED' ELSE 'TRACKED' END AS code,
  regexp_replace(u, '([?&](?:utm_source|ref|token)=)[^&#]*', '\1REMOVED', 'g') AS safe_url FROM u""",
    "retry_waits": """
WITH e AS (SELECT event_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events) SELECT event_id, least(CASE WHEN event_type = 'view' AND k >= 0 THEN k ELSE CAST(pow(2, k % 8) AS BIGINT) END, 60) AS seconds FROM e""",
}
