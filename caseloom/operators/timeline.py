"""Timelines of cases: movements with their parts, antecedents, supports, parents, roles and pending duties.

An order stands for a movement of its customer's case, its lines for the pieces of the movement, an event for a
notice. Where a rule asks for exactly one match, several are as good as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.retrieval import _query, best_of, for_each_query
from caseloom.sources.tables import dealt, table


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two ranges touch; an open end (null) reaches as far as it can."""
    return F.coalesce(a_start <= b_end, F.lit(True)) & F.coalesce(b_start <= a_end, F.lit(True))


def only_match(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` of the keys that have exactly one different ``value``."""
    g = pairs.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    return g.filter(F.col("_a") == F.col("_b")).select(key, F.col("_a").alias(value))


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """The rows of the first of ``tiers`` that has any for a key; all have the same columns."""
    every = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers, 1)])
    least = every.groupBy(key).agg(F.min("tier").alias("_t"))
    return every.join(least, key).filter(F.col("tier") == F.col("_t")).drop("_t")


def best_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return best_of(df, [key], list(order), 1)


def provider_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every movement with its pieces as one list in their order, its first piece that is still open, and its number
    counted from the end of the case."""
    pieces = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    code = F.concat_ws(":", F.col("l_linenumber").cast("string"), "l_returnflag")
    own = pieces.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", code.alias("code")))), lambda x: x["code"]), ",").alias("pieces"),
        F.count("*").alias("n_pieces"),
        F.min(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("first_open"),
    )
    moves = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    back = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return moves.select("o_custkey", "o_orderkey", back.alias("from_end"), "pieces", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), "first_open")


def source_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movements of every source, each once, by the first place where it cites the source."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_linenumber").alias("place"))
    rank = F.row_number().over(Window.partitionBy("l_partkey").orderBy("place", "l_orderkey"))
    return first.select("l_partkey", "l_orderkey", "place", rank.alias("rank"))


def artifact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with their movement, and with their supplier only where that is of the party's own nation: the condition
    is part of the outer join, so no piece goes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    party = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(party, F.col("o_custkey") == F.col("c_custkey"))
    both = both.join(suppliers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "left")
    return both.select("l_orderkey", "l_linenumber", "o_custkey", F.col("s_name").alias("own_supplier"))


def bilateral_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who acts for whom: one row for each supplier and customer with pieces in common, both by name."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n_pieces"))
    named = pairs.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select(F.col("s_name").alias("representative"), F.col("c_name").alias("represented"), "n_pieces")


def origin_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of every movement's origin: its first piece that was returned, else the party's first notice, else its own."""
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("returned"))
    notice = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("noticed"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = o.join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(notice, F.col("o_custkey") == F.col("user_id"), "left")
    source = F.when(F.col("returned").isNotNull(), "PIECE").when(F.col("noticed").isNotNull(), "NOTICE").otherwise("MOVEMENT")
    return both.select("o_orderkey", F.date_format(F.coalesce("returned", "noticed", "o_orderdate"), "yyyy-MM-dd").alias("origin_day"), source.alias("origin"))


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a user's events on one day whose spans touch, each pair once."""
    spans = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    other = spans.select("user_id", "day", F.col("event_type").alias("other_type"), F.col("a").alias("c"), F.col("b").alias("d"))
    both = spans.join(other, ["user_id", "day"]).filter((F.col("event_type") < F.col("other_type")) & overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    return both.groupBy("user_id", "event_type", "other_type").agg(F.count("*").alias("n_days"))


def support_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later piece supports the one earlier piece of its movement with the same term; with several it supports none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 10).alias("term"), "l_returnflag")
    origin = lines.select("l_orderkey", "term", F.col("l_linenumber").alias("origin"), F.col("l_returnflag").alias("origin_flag"))
    both = lines.join(origin, ["l_orderkey", "term"]).filter("l_linenumber > origin and (l_returnflag = origin_flag or origin_flag = 'N')")
    one = both.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("origin").alias("origin")).filter("n = 1")
    return one.select("l_orderkey", "l_linenumber", "origin")


def antecedent_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purchase goes back to: the latest view of the hour before, else the latest of any time before, else the
    user's only view; else nothing. One window and one aggregate, no inequality join."""
    ev = table(spark, sf_dir, "events").filter("event_type in ('view', 'purchase')").select("event_id", "user_id", "event_type", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.struct("event_id", "ts")), ignorenulls=True).over(w)
    alone = ev.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("alone"), F.count("*").alias("n_views")).filter("n_views = 1")
    rows = ev.withColumn("seen", seen).filter("event_type = 'purchase'").join(alone, "user_id", "left")
    near = F.col("seen").isNotNull() & (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("seen.ts").cast("timestamp")) <= 3_600_000_000)
    tier = F.when(near, "SAME_HOUR").when(F.col("seen").isNotNull(), "NEAREST_PRIOR").when(F.col("alone").isNotNull(), "UNIQUE_OF_KIND").otherwise("NONE")
    return rows.select("event_id", "user_id", F.coalesce("seen.event_id", "alone").alias("antecedent"), tier.alias("tier"))


def notice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and movements of one party, month and day: an equality join on three columns."""
    day = lambda c: (F.month(c).alias("month"), F.day(c).alias("day"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("party"), *day("ts")).groupBy("party", "month", "day").agg(F.count("*").alias("n_notices"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("party"), *day("o_orderdate"))
    return o.join(e, ["party", "month", "day"]).select("o_orderkey", "party", "n_notices")


def best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a publication speaks of: its clauses of 35 characters or more are looked for by their first 140, 80
    and 55 characters, for 3, 2 and 1 points; the page with most points wins if it has 3."""
    asked = _query(spark, sf_dir).select("query_id", F.filter(F.transform(F.split(F.lower("query"), "[.;\n]"), lambda c: F.trim(c)), lambda c: F.length(c) >= 35).alias("clauses"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    held = lambda c, n: F.contains(F.col("low"), F.left(c, F.lit(n)))
    points = lambda q: F.aggregate(F.transform(q["clauses"], lambda c: F.when(held(c, 140), 3).when(held(c, 80), 2).when(held(c, 55), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    scored = for_each_query(docs, asked, points, "doc_id").filter("score >= 3")
    return best_by(scored, "query_id", F.desc("score"), F.asc("doc_id")).select("query_id", "doc_id", F.col("score").cast("bigint").alias("points"))


def temporal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every movement the party's notice by day of the year: those before it come first, then the nearest."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.dayofyear("ts").alias("at"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.dayofyear("o_orderdate").alias("on"))
    gap = F.col("on") - F.col("at")
    both = o.join(e, F.col("o_custkey") == F.col("user_id")).select("o_orderkey", "event_id", F.when(gap >= 0, 0).otherwise(1).alias("bucket"), F.abs(gap).alias("distance"))
    best = both.groupBy("o_orderkey").agg(F.min(F.struct("bucket", "distance", "event_id")).alias("b"))
    return best.select("o_orderkey", "b.bucket", "b.distance", "b.event_id")


def pending_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open movements with their party and its first notice, without those of which a piece is done already."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    notice = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("n"))
    left = o.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return left.join(notice, F.col("o_custkey") == F.col("user_id"), "left").select("o_orderkey", "c_name", F.col("n.event_id").alias("notice"))


def copies_with_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose document there is: the copy of a table that a semi-join leaves."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", "toxic")


def duplicate_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text from one source at most are merged: the labelled and least one wins, and the labels of the losers
    are its own from then on."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("name"), "source")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n_labels"))
    rows = docs.join(marks, "doc_id", "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))
    best = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("source").alias("low"), F.max("source").alias("high"), F.min(F.struct((-F.least("n_labels", F.lit(1))).alias("r"), "doc_id")).alias("w"))
    map_ = best.filter("n > 1 and low = high").select("name", F.col("w.doc_id").alias("winner"))
    return rows.join(map_, "name").groupBy("winner").agg(F.count_if(F.col("doc_id") != F.col("winner")).alias("n_losers"), F.sum("n_labels").alias("n_labels"))


def parent_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of every movement: the latest earlier one of the same kind, else the latest earlier one of the case."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    of = lambda *keys: F.lag("o_orderkey").over(Window.partitionBy(*keys).orderBy("o_orderdate", "o_orderkey"))
    kind, case = of("o_custkey", "o_orderpriority"), of("o_custkey")
    found = o.select("o_orderkey", kind.alias("by_kind"), case.alias("by_case"))
    method = F.when(F.col("by_kind").isNotNull(), "SAME_KIND").when(F.col("by_case").isNotNull(), "SAME_CASE").otherwise("ROOT")
    return found.select("o_orderkey", F.coalesce("by_kind", "by_case").alias("parent"), method.alias("method"))


def case_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each party: its roles in all movements, merged and sorted, and its latest movement (of several on one
    day the first)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    g = o.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("roles"),
        F.count("*").alias("n_movements"),
        F.max(F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k"), "o_orderpriority")).alias("last"),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    both = c.join(g, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", "c_name", F.coalesce("roles", F.lit("")).alias("roles"), F.coalesce("n_movements", F.lit(0)).alias("n_movements"), (-F.col("last.k")).alias("latest"), F.col("last.o_orderpriority").alias("latest_kind"))


def recipient_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a movement is for: the suppliers of its returned pieces, else those of all pieces, else the party itself."""
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag")
    lines = pieces.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), F.col("o_custkey") == F.col("c_custkey"))
    named = dealt(lines.select("o_orderkey", F.col("s_name").alias("name"), "l_returnflag"), "o_orderkey", pieces.count())
    tiers = [named.filter("l_returnflag = 'R'").select("o_orderkey", "name").distinct(), named.select("o_orderkey", "name").distinct(), own.select("o_orderkey", "name")]
    return first_tier(tiers, "o_orderkey").groupBy("o_orderkey", "tier").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("label"))


def movement_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movement with its party, nation, region and largest piece: four outer joins in place of four look-ups a row."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    top = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("m"))).alias("t"))
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    title = F.concat_ws(" / ", "o_orderpriority", "c_name", "n_name", "r_name")
    return both.select("o_orderkey", title.alias("title"), (-F.col("t.m")).cast("bigint").alias("largest_piece"))


def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a label speaks of is there: its document, with a text, from a source that is known by another document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    known = docs.groupBy("source").agg(F.count("*").alias("n_source"))
    both = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id", "left").join(known, "source", "left")
    code = F.when(F.col("source").isNull(), "DOCUMENT_MISSING").when(F.coalesce(F.trim("text"), F.lit("")) == "", "PAGE_WITHOUT_TEXT").when(F.col("n_source") < 2, "OWNER_UNKNOWN").otherwise("OK")
    return both.select("doc_id", code.alias("code"))


def relations_of_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of each nation with others through pieces, whichever end it is on, with the evidence counted."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a")), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b")), F.col("o_custkey") == F.col("c_custkey"))
    edges = ends.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first")).filter("a <> b")
    both = edges.select(F.col("a").alias("nation"), F.col("b").alias("other"), "n", "first").unionByName(edges.select(F.col("b").alias("nation"), F.col("a").alias("other"), "n", "first"))
    return both.groupBy("nation", "other").agg(F.sum("n").alias("n_evidence"), F.min("first").alias("first_evidence"))


def unattested_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each movement is attested by a returned piece, in pieces and pages, and where the first gap is."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_returnflag") == "R").alias("attested"))
    g = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_pieces"), F.count_if("attested").alias("n_attested"), F.sum(F.when(~F.col("attested"), F.col("l_quantity")).otherwise(0.0)).alias("pages_open"), F.min(F.when(~F.col("attested"), F.col("l_linenumber"))).alias("first_open"))
    return g.withColumn("status", F.when(F.col("n_attested") == F.col("n_pieces"), "COMPLETE").when(F.col("n_attested") > 0, "PARTIAL").otherwise("UNATTESTED"))


def movement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive movements of one kind as one act: numbered, with its first and last movement and their sum."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    change = F.when(F.col("o_orderstatus").eqNullSafe(F.lag("o_orderstatus").over(w)), 0).otherwise(1)
    runs = o.withColumn("c", change).withColumn("act", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.struct("o_orderdate", "o_orderkey")
    return runs.groupBy("o_custkey", "act").agg(F.min("o_orderstatus").alias("kind"), F.min(ends)["o_orderkey"].alias("first"), F.max(ends)["o_orderkey"].alias("last"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def page_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that a new act begins between two neighbouring movements: another kind, a long gap, a higher class."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    nxt = F.lead(F.struct("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")).over(w)
    p = o.withColumn("x", nxt).filter("x is not null")
    gap = F.datediff(F.to_date("x.o_orderdate"), F.to_date("o_orderdate"))
    codes = F.array_compact(F.array(F.when(F.col("x.o_orderstatus") != F.col("o_orderstatus"), "STATUS"), F.when(gap > 90, "GAP"), F.when(F.col("x.o_orderpriority") < F.col("o_orderpriority"), "CLASS")))
    state = F.when(F.size(codes) >= 2, "BOUNDARY").when(F.size(codes) == 1, "POSSIBLE").otherwise("NONE")
    return p.select("o_orderkey", F.col("x.o_orderkey").alias("next"), F.array_join(codes, ",").alias("evidence"), state.alias("state"))


QUERIES = {
    f.__name__: f
    for f in (
        provider_timeline, source_movements, artifact_chain, bilateral_pairs, origin_dates, span_overlaps, support_links, antecedent_tiers, notice_events, best_page, temporal_rank,
        pending_duties, copies_with_owner, duplicate_rewrite, parent_choice, case_overview, recipient_label, movement_details, source_context, relations_of_case, unattested_pieces,
        movement_groups, page_boundaries,
    )
}

ORACLE = {
    "provider_timeline": """
WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS pieces, count(*) AS n, min(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS first_open FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS from_end, pieces, coalesce(n, 0) AS n_pieces, first_open FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "source_movements": """
WITH f AS (SELECT l_partkey, l_orderkey, min(l_linenumber) AS place FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY place, l_orderkey) AS rank FROM f""",
    "artifact_chain": """
SELECT l_orderkey, l_linenumber, o_custkey, s_name AS own_supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey""",
    "bilateral_pairs": """
SELECT s_name AS representative, c_name AS represented, count(*) AS n_pieces FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY s_suppkey, s_name, c_custkey, c_name""",
    "origin_dates": """
WITH b AS (SELECT l_orderkey, min(l_shipdate) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), n AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1)
SELECT o_orderkey, strftime(coalesce(r, t, o_orderdate), '%Y-%m-%d') AS origin_day, CASE WHEN r IS NOT NULL THEN 'PIECE' WHEN t IS NOT NULL THEN 'NOTICE' ELSE 'MOVEMENT' END AS origin
FROM orders LEFT JOIN b ON o_orderkey = l_orderkey LEFT JOIN n ON o_custkey = user_id""",
    "span_overlaps": """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)
SELECT x.user_id, x.event_type, y.event_type AS other_type, count(*) AS n_days FROM s x JOIN s y ON x.user_id = y.user_id AND x.day = y.day AND x.event_type < y.event_type AND NOT (x.b < y.a OR y.b < x.a) GROUP BY ALL""",
    "support_links": """
WITH l AS (SELECT l_orderkey, l_linenumber, floor(l_quantity / 10) AS term, l_returnflag AS f FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, min(b.l_linenumber) AS origin FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.term = b.term AND a.l_linenumber > b.l_linenumber AND (a.f = b.f OR b.f = 'N') GROUP BY ALL HAVING count(*) = 1""",
    "antecedent_tiers": """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS vid, user_id, ts AS vts FROM events WHERE event_type = 'view'),
b AS (SELECT p.event_id, arg_max(vid, (vts, vid)) AS vid, max(vts) AS vts FROM p JOIN v ON p.user_id = v.user_id AND (vts < ts OR (vts = ts AND vid < p.event_id)) GROUP BY 1),
u AS (SELECT user_id, min(vid) AS alone FROM v GROUP BY 1 HAVING count(*) = 1)
SELECT p.event_id, p.user_id, coalesce(vid, alone) AS antecedent, CASE WHEN vid IS NOT NULL AND epoch_us(ts) - epoch_us(vts) <= 3600000000 THEN 'SAME_HOUR' WHEN vid IS NOT NULL THEN 'NEAREST_PRIOR' WHEN alone IS NOT NULL THEN 'UNIQUE_OF_KIND' ELSE 'NONE' END AS tier
FROM p LEFT JOIN b USING (event_id) LEFT JOIN u ON p.user_id = u.user_id""",
    "notice_events": """
SELECT o_orderkey, o_custkey AS party, count(*) AS n_notices FROM orders JOIN events ON o_custkey = user_id AND month(o_orderdate) = month(ts) AND day(o_orderdate) = day(ts) GROUP BY ALL""",
    "best_page": """
WITH q AS (SELECT item_id AS query_id, trim(c, ' ') AS c FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[.;\n]')) AS c FROM benchmark WHERE item_id % 100 = 0) WHERE length(trim(c, ' ')) >= 35),
s AS (SELECT query_id, doc_id, sum(CASE WHEN contains(lower(text), left(c, 140)) THEN 3 WHEN contains(lower(text), left(c, 80)) THEN 2 WHEN contains(lower(text), left(c, 55)) THEN 1 ELSE 0 END) AS points FROM q, documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT query_id, doc_id, CAST(points AS BIGINT) AS points FROM s WHERE points >= 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) = 1""",
    "temporal_rank": """
WITH b AS (SELECT o_orderkey, event_id, CASE WHEN dayofyear(o_orderdate) >= dayofyear(ts) THEN 0 ELSE 1 END AS bucket, abs(dayofyear(o_orderdate) - dayofyear(ts)) AS distance FROM orders JOIN events ON o_custkey = user_id AND event_type = 'purchase')
SELECT o_orderkey, bucket, distance, event_id FROM b QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY bucket, distance, event_id) = 1""",
    "pending_duties": """
WITH n AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS notice FROM events GROUP BY 1)
SELECT o_orderkey, c_name, notice FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON o_custkey = user_id WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "copies_with_owner": "SELECT doc_id, quality, toxic FROM labels WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)",
    "duplicate_rewrite": """
WITH m AS (SELECT doc_id, count(*) AS k FROM labels GROUP BY 1), r AS (SELECT doc_id, text, source, coalesce(k, 0) AS k FROM documents LEFT JOIN m USING (doc_id) WHERE text IS NOT NULL),
g AS (SELECT text, arg_min(doc_id, (CASE WHEN k > 0 THEN 0 ELSE 1 END, doc_id)) AS winner FROM r GROUP BY text HAVING count(*) > 1 AND count(DISTINCT source) = 1)
SELECT winner, count(*) FILTER (doc_id <> winner) AS n_losers, CAST(sum(k) AS BIGINT) AS n_labels FROM r JOIN g USING (text) GROUP BY winner""",
    "parent_choice": """
WITH f AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS c FROM orders)
SELECT o_orderkey, coalesce(k, c) AS parent, CASE WHEN k IS NOT NULL THEN 'SAME_KIND' WHEN c IS NOT NULL THEN 'SAME_CASE' ELSE 'ROOT' END AS method FROM f""",
    "case_overview": """
WITH g AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS roles, count(*) AS n, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS latest, arg_max(o_orderpriority, (o_orderdate, -o_orderkey)) AS latest_kind FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(roles, '') AS roles, coalesce(n, 0) AS n_movements, latest, latest_kind FROM customer LEFT JOIN g ON c_custkey = o_custkey""",
    "recipient_label": """
WITH l AS (SELECT l_orderkey AS o_orderkey, s_name AS name, l_returnflag AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
t AS (SELECT DISTINCT o_orderkey, name, 1 AS tier FROM l WHERE f = 'R' UNION ALL SELECT DISTINCT o_orderkey, name, 2 FROM l UNION ALL SELECT o_orderkey, c_name, 3 FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT o_orderkey, min(tier) AS tier FROM t GROUP BY 1)
SELECT o_orderkey, tier, string_agg(name, '; ' ORDER BY name) AS label FROM t SEMI JOIN m USING (o_orderkey, tier) GROUP BY ALL""",
    "movement_details": """
WITH t AS (SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey, concat_ws(' / ', o_orderpriority, c_name, n_name, r_name) AS title, CAST(p AS BIGINT) AS largest_piece FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN t ON o_orderkey = l_orderkey""",
    "source_context": """
WITH k AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT l.doc_id, CASE WHEN d.source IS NULL THEN 'DOCUMENT_MISSING' WHEN trim(coalesce(text, ''), ' ') = '' THEN 'PAGE_WITHOUT_TEXT' WHEN n < 2 THEN 'OWNER_UNKNOWN' ELSE 'OK' END AS code FROM labels l LEFT JOIN documents d USING (doc_id) LEFT JOIN k ON d.source = k.source""",
    "relations_of_case": """
WITH e AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n, min(l_orderkey) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING a <> b)
SELECT nation, other, CAST(sum(n) AS BIGINT) AS n_evidence, min(f) AS first_evidence FROM (SELECT a AS nation, b AS other, n, f FROM e UNION ALL SELECT b, a, n, f FROM e) GROUP BY ALL""",
    "unattested_pieces": """
WITH g AS (SELECT l_orderkey, count(*) AS n_pieces, count(*) FILTER (l_returnflag = 'R') AS n_attested, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS pages_open, min(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS first_open FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN n_attested = n_pieces THEN 'COMPLETE' WHEN n_attested > 0 THEN 'PARTIAL' ELSE 'UNATTESTED' END AS status FROM g""",
    "movement_groups": """
WITH a AS (SELECT *, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) THEN 0 ELSE 1 END AS c FROM orders),
b AS (SELECT *, CAST(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS act FROM a)
SELECT o_custkey, act, min(o_orderstatus) AS kind, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM b GROUP BY ALL""",
    "page_boundaries": """
WITH a AS (SELECT *, lead(o_orderkey) OVER w AS nx, lead(o_orderdate) OVER w AS nd, lead(o_orderstatus) OVER w AS ns, lead(o_orderpriority) OVER w AS np FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
b AS (SELECT o_orderkey, nx AS next, ns <> o_orderstatus AS s, date_diff('day', CAST(o_orderdate AS DATE), CAST(nd AS DATE)) > 90 AS g, np < o_orderpriority AS c FROM a WHERE nx IS NOT NULL)
SELECT o_orderkey, next, concat_ws(',', CASE WHEN s THEN 'STATUS' END, CASE WHEN g THEN 'GAP' END, CASE WHEN c THEN 'CLASS' END) AS evidence, CASE s::INT + g::INT + c::INT WHEN 0 THEN 'NONE' WHEN 1 THEN 'POSSIBLE' ELSE 'BOUNDARY' END AS state FROM b""",
}
