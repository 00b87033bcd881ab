"""Stored tables that follow their sources: identities, claims, merges with pruning, versions, positions, inventories.

Every function is a join or an aggregate of two tables and says what is to be written; ``materialise`` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import table

_SEP = "\x1f"


def row_hash(*columns: str | Column) -> Column:
    """Hash of a row's values in their order; null differs from empty."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws(_SEP, *parts), 256)


def actions(stored: DataFrame, desired: DataFrame, key: str, digest: str, prune: bool = True) -> DataFrame:
    """``key, action``: INSERT, UPDATE, SKIP or PRUNE (KEEP without ``prune``) for every key of either table."""
    a = stored.select(F.col(key).alias("_k"), F.col(digest).alias("_old"))
    both = desired.select(key, F.col(digest).alias("_new")).join(a, F.col(key) == F.col("_k"), "full")
    action = F.when(F.col("_k").isNull(), "INSERT").when(F.col(key).isNull(), "PRUNE" if prune else "KEEP").when(F.col("_old") == F.col("_new"), "SKIP").otherwise("UPDATE")
    return both.select(F.coalesce(key, "_k").alias(key), action.alias("action"))


def materialise(stored: DataFrame, desired: DataFrame, key: str, digest: str, prune: bool = True) -> DataFrame:
    """The table after the merge: desired rows, and stored ones that nobody desires unless they are pruned."""
    rest = stored.join(desired.select(key), key, "left_anti")
    return desired if prune else desired.unionByName(rest)


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The incoming rows that are new: the first of each key that is not stored."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_f"))
    return first.select(*keys, *(F.col("_f")[c].alias(c) for c in rest)).join(stored.select(*keys), keys, "left_anti")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")


def materialise_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run writes where the stored movements are those of an earlier state of the orders, and how many pieces
    hang on each movement that it touches."""
    o = _orders(spark, sf_dir)
    digest = lambda status: row_hash("o_orderkey", status, "o_orderpriority")
    stored = o.filter("o_orderkey % 7 <> 0").select("o_orderkey", digest(F.when(F.col("o_orderkey") % 5 == 0, F.lit("P")).otherwise(F.col("o_orderstatus"))).alias("h"))
    desired = o.filter("o_orderkey % 11 <> 0").select("o_orderkey", digest(F.col("o_orderstatus")).alias("h"))
    pieces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    both = actions(stored, desired, "o_orderkey", "h").join(pieces, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", "action", F.when(F.col("action") != "SKIP", F.coalesce("n", F.lit(0))).alias("n_dependants"))


def materialise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four projections as one table of events with ids from their content, held against an earlier state of it."""
    o, l, e, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events", "conversations"))
    four = [
        o.select(F.lit("MOVEMENT").alias("kind"), F.col("o_orderkey").cast("string").alias("source"), "o_orderstatus"),
        l.select(F.lit("PIECE"), F.concat_ws("/", "l_orderkey", "l_linenumber"), "l_linestatus"),
        e.select(F.lit("NOTICE"), F.col("event_id").cast("string"), "event_type"),
        c.select(F.lit("HEARING"), F.concat_ws("/", "conv_id", "turn"), "role"),
    ]
    every = four[0].union(four[1]).union(four[2]).union(four[3]).toDF("kind", "source", "state")
    every = every.groupBy("kind", "source").agg(F.max("state").alias("state")).withColumn("id", F.left(F.sha2(F.concat_ws("|", "kind", "source"), 256), F.lit(24)))
    before = F.left("id", F.lit(1)) < "d"  # the earlier state lacks some and has others in another state
    stored = every.filter(before).select("id", F.sha2(F.when(F.substring("id", 2, 1) == "0", F.lit("old")).otherwise(F.col("state")), 256).alias("h"))
    done = actions(stored, every.select("id", F.sha2("state", 256).alias("h")), "id", "h")
    return done.join(every.select("id", "kind"), "id").groupBy("kind", "action").agg(F.count("*").alias("n"))


def refresh_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance after a refresh: entries of the new run win, those that only the resolver wrote stay."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    old = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("k").alias("resolver"), F.max("k").alias("method"))
    new = e.filter("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").cast("string").alias("method"), F.count("*").cast("string").alias("run"))
    both = old.withColumnRenamed("method", "old_method").join(new, "user_id", "full")
    return both.select("user_id", "resolver", F.coalesce("method", "old_method").alias("method"), "run")


def prune_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants that were only a fallback: those without a movement go unless something else refers to them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    moves = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    notices = table(spark, sf_dir, "events").select("user_id").distinct()
    both = c.join(moves, F.col("c_custkey") == F.col("o_custkey"), "left").join(notices, F.col("c_custkey") == F.col("user_id"), "left")
    state = F.when(F.col("o_custkey").isNotNull(), "KEEP").when(F.col("user_id").isNotNull(), "REFERENCED").when(F.col("c_acctbal") < 0, "DELETE").otherwise("KEEP_CONFIRMED")
    return both.select("c_custkey", state.alias("state"))


def candidate_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by fingerprint: the first seen gives the row, later ones only raise its count and last date."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", row_hash("l_partkey", "l_returnflag").alias("fingerprint"))
    g = l.groupBy("fingerprint").agg(F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("f"), F.max("l_shipdate").alias("last"), F.count("*").alias("n_seen"))
    return g.select("fingerprint", "f.l_orderkey", "f.l_linenumber", F.date_format("last", "yyyy-MM-dd").alias("last_seen"), "n_seen")


def snapshot_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New snapshots by content: those that the table has, and repeats among the new ones, are passed over."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("content_sha"))
    return insert_ignore(p.filter("page_id % 3 = 0").select("content_sha"), p.filter("page_id % 3 <> 0"), ["content_sha"], ["page_id"])


def entity_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity for each fingerprint of name digits and nation: one that suppliers have already, else a new one named by
    its fingerprint."""
    mark = lambda name, nation: F.left(F.sha2(F.concat_ws("|", F.regexp_replace(name, "[^0-9]", ""), nation.cast("string")), 256), F.lit(24))
    s = table(spark, sf_dir, "supplier").select(mark(F.col("s_name"), F.col("s_nationkey")).alias("fingerprint"), "s_suppkey").groupBy("fingerprint").agg(F.min("s_suppkey").alias("known"))
    c = table(spark, sf_dir, "customer").select("c_custkey", mark(F.col("c_name"), F.col("c_nationkey")).alias("fingerprint"))
    both = c.join(s, "fingerprint", "left")
    return both.select("c_custkey", F.coalesce(F.concat(F.lit("S"), F.col("known").cast("string")), "fingerprint").alias("entity_id"), F.col("known").isNull().alias("created"))


def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as precise as their document is: a day, a month or a year; an id from owner and source."""
    o = _orders(spark, sf_dir)
    precision = F.when(F.col("o_orderstatus") == "F", "DAY").when(F.col("o_orderstatus") == "O", "MONTH").otherwise("YEAR")
    size = F.when(F.col("o_orderstatus") == "F", 10).when(F.col("o_orderstatus") == "O", 7).otherwise(4)
    return o.select("o_orderkey", precision.alias("precision"), F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), size).alias("value"), F.left(row_hash("o_custkey", "o_orderkey"), F.lit(16)).alias("chronology_id"))


def supersede_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a calendar's day against those stored: a new one follows the greatest and supersedes it, the same
    content adds none."""
    o = _orders(spark, sf_dir).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus", "o_orderkey")
    stored = o.filter("o_orderkey % 2 = 0").groupBy("day").agg(F.count_distinct("o_orderstatus").alias("version"), F.max("o_orderstatus").alias("current"))
    new = o.filter("o_orderkey % 2 = 1").groupBy("day").agg(F.max("o_orderstatus").alias("incoming"))
    both = new.join(stored, "day", "left")
    same = F.col("current").eqNullSafe(F.col("incoming"))
    return both.select("day", F.when(same, F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1).alias("version"), (~same & F.col("version").isNotNull()).alias("supersedes"))


def relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each pair and kind, with its best confidence, its first evidence and how much there is."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_discount")
    g = l.groupBy("l_suppkey", "l_partkey", "l_returnflag").agg(F.max("l_discount").alias("confidence"), F.min("l_orderkey").alias("first_evidence"), F.count("*").alias("n_evidence"))
    return g.withColumn("relation_id", F.left(F.sha2(F.concat_ws("|", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag"), 256), F.lit(24)))


def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would go with each party: its movements, their pieces, and its notices. Each table is counted before it is joined."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    moves = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("n_movements"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"))
    notices = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_notices"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    both = c.join(moves, F.col("c_custkey") == F.col("o_custkey"), "left").join(notices, F.col("c_custkey") == F.col("user_id"), "left")
    return both.select("c_custkey", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_movements", "n_pieces", "n_notices")))


def archived_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that are archived: all movements are finished and none is of the last year there is."""
    o = _orders(spark, sf_dir)
    last = F.broadcast(o.agg(F.max("o_orderdate").alias("last")))
    g = o.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("finished"), F.max("o_orderdate").alias("latest")).join(last)
    return g.select("o_custkey", (F.col("finished") & (F.datediff(F.to_date("last"), F.to_date("latest")) > 365)).alias("archived"))


def page_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each piece with their position; a page that comes again keeps its first."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("page"))
    first = docs.filter("page is not null").groupBy("source", "page").agg(F.min("doc_id").alias("doc_id"))
    return first.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("position"))


def grouped_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with one verification code: sorted, the first as primary, and whether they agree in type."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_returnflag")
    g = l.groupBy("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("code")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda x: x.cast("string")), ",").alias("artifacts"), F.min("l_linenumber").alias("primary"), (F.min("l_returnflag") == F.max("l_returnflag")).alias("one_type"))
    return g


def backfill_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of every conversation, from its first turn that has one; later turns don't change it."""
    c = table(spark, sf_dir, "conversations").filter("role is not null and text is not null and trim(text) <> ''")
    first = c.groupBy("conv_id").agg(F.min(F.struct("turn", "role", F.length("text").alias("n"))).alias("f"))
    return first.select("conv_id", F.concat_ws("_", F.upper("f.role"), F.when(F.col("f.n") > 100, "LONG").otherwise("SHORT")).alias("type"))


def reference_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an artifact may be confirmed by a reference: one of its own case, literally there, not taken by another."""
    o = _orders(spark, sf_dir)
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    digits = F.right(F.col("ref").cast("string"), F.lit(1))
    rows = o.select("o_orderkey", "o_custkey", nxt.alias("ref"))
    code = F.when(F.col("ref").isNull(), "NO_REFERENCE").when(~F.contains(F.col("o_custkey").cast("string"), digits), "LITERAL_NOT_FOUND").otherwise("CONFIRMED")
    return rows.select("o_orderkey", code.alias("code"))


def docket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total order of a case's pieces, and the running page at which each begins: a window within each case."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("pages"))
    both = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pages")
    return both.select("o_custkey", "o_orderkey", "l_linenumber", F.row_number().over(w).alias("canonical_order"), (F.coalesce(F.sum("pages").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias("first_page"))


def projection_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source's projection may be pruned: never with derivatives, only repaired with some, else rebuilt."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    g = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_derived"))
    policy = F.when(F.col("n_derived") == 0, "PRUNE").when(2 * F.col("n_derived") < F.col("n"), "REPAIR").otherwise("KEEP")
    return g.select("source", "n", "n_derived", policy.alias("policy"))


def identity_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old pieces get the new identities by position where both sides have as many, each once and without a hole."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    g = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("d"), F.max("l_linenumber").alias("top"), F.count_distinct("l_partkey").alias("parts"))
    code = F.when(F.col("n") != F.col("d"), "DUPLICATE_POSITION").when(F.col("top") != F.col("n"), "HOLE").when(F.col("parts") != F.col("n"), "DUPLICATE_IDENTITY").otherwise("OK")
    return g.select("l_orderkey", "n", code.alias("code"))


def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a purchase may name the antecedent that it does: it must be there, of the same user, and before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")
    named = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("event_id") - F.get_json_object("props", "$.k").cast("bigint") - 1).alias("antecedent"))
    other = e.select(F.col("event_id").alias("antecedent"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    both = named.join(other, "antecedent", "left")
    code = F.when(F.col("u").isNull(), "ANTECEDENT_MISSING").when(F.col("u") != F.col("user_id"), "OTHER_CASE").when(F.col("t") > F.col("ts"), "NOT_BEFORE").otherwise("OK")
    return both.select("event_id", code.alias("code"))


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each conversation: a hash over its turns in order, whether it has any text, and its turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("whole"), F.count("*").alias("n_turns"))
    return g.select("conv_id", F.sha2("whole", 256).alias("source_hash"), (F.trim(F.regexp_replace("whole", "[\\s]+", " ")) != "").alias("eligible"), "n_turns")


def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came with clashing versions, numbered anew within their owner in order of time."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey")
    old = (F.col("l_suppkey") % 3 + 1).alias("old_version")
    clash = F.count("*").over(Window.partitionBy("l_orderkey", "old_version")) > 1
    rows = l.select("l_orderkey", "l_linenumber", "l_shipdate", old)
    return rows.select("l_orderkey", "l_linenumber", "old_version", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("old_version", "l_shipdate", "l_linenumber")).alias("version"), clash.alias("clashed"))


def representation_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representations by licence: one that names the state takes the place of one that doesn't, for the same number."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace("s_name", "[^0-9]", "").cast("bigint").alias("number"), F.when(F.col("s_acctbal") > 3000, F.col("s_nationkey")).alias("state"))
    rows = s.select((F.col("number") % 40).alias("licence"), "state", "s_suppkey")
    g = rows.groupBy("licence").agg(F.count_distinct("state").alias("n_states"), F.min("state").alias("state"), F.min("s_suppkey").alias("first"), F.count("*").alias("n"))
    kind = F.when(F.col("n_states") == 0, "WITHOUT_STATE").when(F.col("n_states") == 1, "UPGRADED").otherwise("CONFLICT")
    return g.select("licence", F.when(F.col("n_states") == 1, F.col("state")).alias("state"), "first", "n", kind.alias("kind"))


def case_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A readable page for each conversation, front matter and a section a turn, and its hash."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), F.col("text"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("body"), F.count("*").alias("n"))
    page = F.concat(F.lit("---\ncase: "), F.col("conv_id").cast("string"), F.lit("\nturns: "), F.col("n").cast("string"), F.lit("\n---\n\n"), F.col("body"), F.lit("\n"))
    return g.select("conv_id", F.length(page).cast("bigint").alias("n_chars"), F.sha2(page, 256).alias("page_sha"))


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and incoming entries: places of the previous stay, new ones follow, what comes in wins where it is not null."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    old = l.filter("l_linenumber <= 3").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("place"), F.min("l_returnflag").alias("old_flag"))
    new = l.filter("l_linenumber >= 3").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("arrived"), F.min(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag"))).alias("new_flag"))
    both = old.join(new, ["l_orderkey", "l_partkey"], "full")
    order = Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("place"), "arrived", "l_partkey")
    return both.select("l_orderkey", "l_partkey", F.row_number().over(order).alias("position"), F.coalesce("new_flag", "old_flag").alias("flag"))


def reused_and_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of an inventory that are known, new, or rejected because their identity comes twice."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    known = l.filter("l_orderkey % 2 = 0").select("l_partkey", "l_suppkey").distinct().withColumn("known", F.lit(True))
    g = l.filter("l_orderkey % 2 = 1").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n")).join(known, ["l_partkey", "l_suppkey"], "left")
    state = F.when(F.col("n") > 1, "REJECTED").when(F.col("known").isNotNull(), "REUSED").otherwise("NEW")
    return g.groupBy("l_orderkey", state.alias("state")).agg(F.count("*").alias("n"))


def inventory_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an inventory all of whose parts are known, and the others."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    g = l.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("l_orderkey").agg(F.count("*").alias("n_parts"), F.count("s_suppkey").alias("n_known"))
    return g.withColumn("is_known", F.col("n_parts") == F.col("n_known"))


def merged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a turn's author over a conversation, in order and each once, by their text with blanks evened out."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\r\\n]+", " ")).alias("quote")).filter("quote <> ''")
    first = c.groupBy("conv_id", "role", "quote").agg(F.min("turn").alias("turn"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "quote"))
    return first.select("conv_id", "role", "turn", rank.alias("position"), "n")


def rebuild_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a rebuilt table may take the place of the old: every old event is there, or its removal has a reason."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    rebuilt = e.filter("event_id % 13 <> 0").select("event_id", F.when(F.col("event_id") % 17 == 0, F.lit("reclassified")).otherwise(F.col("event_type")).alias("new_type"))
    referenced = e.filter("event_type = 'purchase'").select("user_id").distinct().withColumn("referenced", F.lit(True))
    both = e.join(rebuilt, "event_id", "left").join(referenced, "user_id", "left")
    state = F.when(F.col("new_type") == F.col("event_type"), "PRESERVED").when(F.col("new_type").isNotNull(), "CHANGED").when(F.col("referenced").isNotNull(), "REMOVED_REFERENCED").otherwise("REMOVED")
    return both.groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def selection_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected candidates that belong to their issue, each once, at the place of their first selection; strays are told."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    picks = l.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 25).alias("issue"))
    own = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey")).alias("issue")).agg(F.count("*").alias("n_candidates"))
    first = picks.groupBy("l_orderkey", "issue").agg(F.min("l_linenumber").alias("place")).join(own, "issue", "left")
    return first.select("l_orderkey", "issue", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("place", "issue")).alias("position"), F.col("n_candidates").isNotNull().alias("belongs"))


QUERIES = {
    f.__name__: f
    for f in (
        materialise_movements, materialise_events, refresh_obligations, prune_fallbacks, candidate_upsert, snapshot_insert, entity_create, chronology, supersede_versions, relation_upsert,
        cascade_counts, archived_cases, page_positions, grouped_artifacts, backfill_types, reference_guard, docket_order, projection_policy, identity_backfill, cross_references,
        source_states, renumbered, representation_upgrade, case_markdown, manifest_merge, reused_and_new, inventory_known, merged_references, rebuild_guard, selection_apply,
    )
}

ORACLE = {
    "materialise_movements": """
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 7 <> 0), d AS (SELECT o_orderkey, o_orderstatus AS st FROM orders WHERE o_orderkey % 11 <> 0),
a AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN 'INSERT' WHEN o_orderkey IS NULL THEN 'PRUNE' WHEN s.st = d.st THEN 'SKIP' ELSE 'UPDATE' END AS action FROM d FULL JOIN s ON o_orderkey = k),
l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, action, CASE WHEN action <> 'SKIP' THEN coalesce(n, 0) END AS n_dependants FROM a LEFT JOIN l ON o_orderkey = l_orderkey""",
    "materialise_events": """
WITH e AS (SELECT kind, source, max(state) AS state FROM (SELECT 'MOVEMENT' AS kind, CAST(o_orderkey AS VARCHAR) AS source, o_orderstatus AS state FROM orders UNION ALL SELECT 'PIECE', l_orderkey || '/' || l_linenumber, l_linestatus FROM lineitem
  UNION ALL SELECT 'NOTICE', CAST(event_id AS VARCHAR), event_type FROM events UNION ALL SELECT 'HEARING', conv_id || '/' || turn, role FROM conversations) GROUP BY ALL),
i AS (SELECT *, left(sha256(kind || '|' || source), 24) AS id FROM e)
SELECT kind, CASE WHEN NOT left(id, 1) < 'd' THEN 'INSERT' WHEN substr(id, 2, 1) = '0' THEN 'UPDATE' ELSE 'SKIP' END AS action, count(*) AS n FROM i GROUP BY ALL""",
    "refresh_obligations": """
WITH e AS (SELECT event_id, user_id, event_type, props->>'$.k' AS k FROM events),
o AS (SELECT user_id, min(k) AS resolver, max(k) AS m FROM e WHERE event_type = 'view' GROUP BY 1), n AS (SELECT user_id, CAST(max(event_id) AS VARCHAR) AS m, CAST(count(*) AS VARCHAR) AS run FROM e WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, resolver, coalesce(n.m, o.m) AS method, run FROM o FULL JOIN n USING (user_id)""",
    "prune_fallbacks": """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'KEEP' WHEN c_custkey IN (SELECT user_id FROM events) THEN 'REFERENCED' WHEN c_acctbal < 0 THEN 'DELETE' ELSE 'KEEP_CONFIRMED' END AS state FROM customer""",
    "candidate_upsert": """
WITH l AS (SELECT *, sha256('=' || l_partkey || chr(31) || '=' || l_returnflag) AS fingerprint FROM lineitem)
SELECT fingerprint, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS l_linenumber, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen, count(*) AS n_seen FROM l GROUP BY 1""",
    "snapshot_insert": """
WITH p AS (SELECT page_id, sha256(html) AS content_sha FROM pages) SELECT content_sha, min(page_id) AS page_id FROM p WHERE page_id % 3 <> 0 AND content_sha NOT IN (SELECT content_sha FROM p WHERE page_id % 3 = 0) GROUP BY 1""",
    "entity_create": """
WITH s AS (SELECT left(sha256(regexp_replace(s_name, '[^0-9]', '', 'g') || '|' || s_nationkey), 24) AS f, min(s_suppkey) AS known FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce('S' || known, left(sha256(regexp_replace(c_name, '[^0-9]', '', 'g') || '|' || c_nationkey), 24)) AS entity_id, known IS NULL AS created FROM customer LEFT JOIN s ON f = left(sha256(regexp_replace(c_name, '[^0-9]', '', 'g') || '|' || c_nationkey), 24)""",
    "chronology": """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DAY' WHEN 'O' THEN 'MONTH' ELSE 'YEAR' END AS precision, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS value,
  left(sha256('=' || o_custkey || chr(31) || '=' || o_orderkey), 16) AS chronology_id FROM orders""",
    "supersede_versions": """
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(DISTINCT o_orderstatus) AS v, max(o_orderstatus) AS c FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderstatus) AS i FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT day, CASE WHEN c = i THEN v ELSE coalesce(v, 0) + 1 END AS version, v IS NOT NULL AND c <> i AS supersedes FROM n LEFT JOIN s USING (day)""",
    "relation_upsert": """
SELECT l_suppkey, l_partkey, l_returnflag, max(l_discount) AS confidence, min(l_orderkey) AS first_evidence, count(*) AS n_evidence, left(sha256(l_suppkey || '|' || l_partkey || '|' || l_returnflag), 24) AS relation_id FROM lineitem GROUP BY ALL""",
    "cascade_counts": """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_movements, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_pieces, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_notices FROM customer""",
    "archived_cases": """
SELECT o_custkey, bool_and(o_orderstatus = 'F') AND date_diff('day', CAST(max(o_orderdate) AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) > 365 AS archived FROM orders GROUP BY 1""",
    "page_positions": """
WITH f AS (SELECT source, text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY ALL) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM f""",
    "grouped_artifacts": """
SELECT l_orderkey, strftime(l_shipdate, '%Y-%m') AS code, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS artifacts, min(l_linenumber) AS primary, min(l_returnflag) = max(l_returnflag) AS one_type FROM lineitem GROUP BY ALL""",
    "backfill_types": """
SELECT conv_id, arg_min(upper(role) || '_' || CASE WHEN length(text) > 100 THEN 'LONG' ELSE 'SHORT' END, (turn, role, length(text))) AS type FROM conversations WHERE role IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1""",
    "reference_guard": """
WITH n AS (SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ref FROM orders)
SELECT o_orderkey, CASE WHEN ref IS NULL THEN 'NO_REFERENCE' WHEN NOT contains(CAST(o_custkey AS VARCHAR), right(CAST(ref AS VARCHAR), 1)) THEN 'LITERAL_NOT_FOUND' ELSE 'CONFIRMED' END AS code FROM n""",
    "docket_order": """
SELECT o_custkey, o_orderkey, l_linenumber, row_number() OVER w AS canonical_order, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_page
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT))""",
    "projection_policy": """
SELECT source, count(*) AS n, count(quality) AS n_derived, CASE WHEN count(quality) = 0 THEN 'PRUNE' WHEN 2 * count(quality) < count(*) THEN 'REPAIR' ELSE 'KEEP' END AS policy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "identity_backfill": """
SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) <> count(DISTINCT l_linenumber) THEN 'DUPLICATE_POSITION' WHEN max(l_linenumber) <> count(*) THEN 'HOLE' WHEN count(DISTINCT l_partkey) <> count(*) THEN 'DUPLICATE_IDENTITY' ELSE 'OK' END AS code FROM lineitem GROUP BY 1""",
    "cross_references": """
WITH p AS (SELECT event_id, user_id, ts, event_id - CAST(props->>'$.k' AS BIGINT) - 1 AS a FROM events WHERE event_type = 'purchase')
SELECT p.event_id, CASE WHEN x.user_id IS NULL THEN 'ANTECEDENT_MISSING' WHEN x.user_id <> p.user_id THEN 'OTHER_CASE' WHEN x.ts > p.ts THEN 'NOT_BEFORE' ELSE 'OK' END AS code FROM p LEFT JOIN events x ON x.event_id = a""",
    "source_states": r"""
WITH g AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, '')) AS whole, count(*) AS n_turns FROM conversations GROUP BY 1)
SELECT conv_id, sha256(whole) AS source_hash, trim(regexp_replace(whole, '[\s]+', ' ', 'g'), ' ') <> '' AS eligible, n_turns FROM g""",
    "renumbered": """
WITH r AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey % 3 + 1 AS old_version FROM lineitem)
SELECT l_orderkey, l_linenumber, old_version, row_number() OVER (PARTITION BY l_orderkey ORDER BY old_version, l_shipdate, l_linenumber) AS version, count(*) OVER (PARTITION BY l_orderkey, old_version) > 1 AS clashed FROM r""",
    "representation_upgrade": """
WITH r AS (SELECT CAST(regexp_replace(s_name, '[^0-9]', '', 'g') AS BIGINT) % 40 AS licence, CASE WHEN s_acctbal > 3000 THEN s_nationkey END AS state, s_suppkey FROM supplier)
SELECT licence, CASE WHEN count(DISTINCT state) = 1 THEN min(state) END AS state, min(s_suppkey) AS first, count(*) AS n, CASE count(DISTINCT state) WHEN 0 THEN 'WITHOUT_STATE' WHEN 1 THEN 'UPGRADED' ELSE 'CONFLICT' END AS kind FROM r GROUP BY 1""",
    "case_markdown": """
WITH p AS (SELECT conv_id, turn, '## ' || turn || ' ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '') AS part FROM conversations),
g AS (SELECT conv_id, '---' || chr(10) || 'case: ' || conv_id || chr(10) || 'turns: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY turn, part) || chr(10) AS page FROM p GROUP BY conv_id)
SELECT conv_id, length(page) AS n_chars, sha256(page) AS page_sha FROM g""",
    "manifest_merge": """
WITH o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS place, min(l_returnflag) AS f FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
n AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS arrived, min(CASE WHEN l_linestatus = 'O' THEN l_returnflag END) AS g FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place NULLS LAST, arrived NULLS FIRST, l_partkey) AS position, coalesce(g, f) AS flag FROM o FULL JOIN n USING (l_orderkey, l_partkey)""",
    "reused_and_new": """
WITH k AS (SELECT DISTINCT l_partkey, l_suppkey, true AS known FROM lineitem WHERE l_orderkey % 2 = 0), g AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS c FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL)
SELECT l_orderkey, CASE WHEN c > 1 THEN 'REJECTED' WHEN known THEN 'REUSED' ELSE 'NEW' END AS state, count(*) AS n FROM g LEFT JOIN k USING (l_partkey, l_suppkey) GROUP BY ALL""",
    "inventory_known": """
SELECT l_orderkey, count(*) AS n_parts, count(s_suppkey) AS n_known, count(*) = count(s_suppkey) AS is_known FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY 1""",
    "merged_references": r"""
WITH f AS (SELECT conv_id, role, quote, min(turn) AS turn, count(*) AS n FROM (SELECT conv_id, role, turn, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), ' ') AS quote FROM conversations) WHERE quote <> '' GROUP BY ALL)
SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, quote) AS position, n FROM f""",
    "rebuild_guard": """
SELECT event_type, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN 'PRESERVED' WHEN event_id % 13 <> 0 THEN 'CHANGED' WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 'REMOVED_REFERENCED' ELSE 'REMOVED' END AS state, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL""",
    "selection_apply": """
WITH f AS (SELECT l_orderkey, l_suppkey % 25 AS issue, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT l_orderkey, issue, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, issue) AS position, issue IN (SELECT s_nationkey FROM supplier) AS belongs FROM f""",
}
