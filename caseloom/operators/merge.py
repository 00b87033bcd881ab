"""Versions, merges, change detection and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import table


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, not a window: rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, *(F.col("_top")[c].alias(c) for c in [*order, *rest]))


def merge_classes(old: DataFrame, new: DataFrame, key: str, old_hash: str, new_hash: str) -> DataFrame:
    """INSERTED, UPDATED, UNCHANGED or STALE for every key of either side."""
    a = old.select(F.col(key).alias("_k"), F.col(old_hash).alias("_a"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.col(new_hash).alias("_b"), F.lit(True).alias("_in_new"))
    both = b.join(a, F.col(key) == F.col("_k"), "full")
    state = F.when(F.col("_in_old").isNull(), "INSERTED").when(F.col("_in_new").isNull(), "STALE").when(F.col("_a").eqNullSafe(F.col("_b")), "UNCHANGED").otherwise("UPDATED")
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), state.alias("state"))


def versions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Slowly changing history: a row for each change of ``value``, valid until the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = df.withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).filter("_new")
    until = F.lead(order[0]).over(w)
    return moved.select(*keys, value, F.col(order[0]).alias("valid_from"), until.alias("valid_to"), F.row_number().over(w).cast("bigint").alias("version"), until.isNull().alias("is_current"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "labels").withColumn("state_hash", F.sha2(F.col("quality").cast("string"), 256))
    incoming = table(spark, sf_dir, "documents").withColumn("new_hash", F.sha2(F.when(F.col("n_chars") >= 1000, "1").otherwise("0"), 256))
    return merge_classes(stored, incoming, "doc_id", "state_hash", "new_hash")


def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority")


def stale_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("n_ready"))


def reconcile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text: one source is a duplicate, several are variants of a version."""
    by = table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("content_id"))
    found = by.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
    return found.withColumn("status", F.when(F.col("n_sources") > 1, "VERSION_VARIANT").when(F.col("n_docs") > 1, "DUPLICATE").otherwise("EXACT"))


def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of the set of nation names that have customers, for each region and segment."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name", "c_mktsegment").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("n_name")), "|"), 256).alias("digest"), F.countDistinct("n_name").alias("n"))


def union_event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeline of three kinds of facts, counted by day."""
    o = table(spark, sf_dir, "orders").select(F.lit("ORDER").alias("kind"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))
    l = table(spark, sf_dir, "lineitem").select(F.lit("SHIPMENT").alias("kind"), F.to_date("l_shipdate").alias("day"), F.col("l_linestatus").alias("status"))
    e = table(spark, sf_dir, "events").select(F.lit("EVENT").alias("kind"), F.to_date("ts").alias("day"), F.col("event_type").alias("status"))
    return o.unionByName(l).unionByName(e).groupBy("kind", "day", "status").agg(F.count("*").alias("n")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (latest_version, upsert_merge, scd2_versions, stale_anti, status_counts, reconcile_versions, set_digest, union_event_feed)}
ORACLE = {
    "latest_version": """
SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "upsert_merge": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'INSERTED' WHEN d.doc_id IS NULL THEN 'STALE' WHEN sha256(CAST(l.quality AS VARCHAR)) = sha256(CASE WHEN d.n_chars >= 1000 THEN '1' ELSE '0' END) THEN 'UNCHANGED' ELSE 'UPDATED' END AS state
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
    "scd2_versions": """
WITH a AS (SELECT *, o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w OR row_number() OVER w = 1 AS moved FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderpriority, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, row_number() OVER w AS version, lead(o_orderdate) OVER w IS NULL AS is_current
FROM a WHERE moved WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "stale_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "status_counts": """
SELECT lang, count(*) AS n_docs, count(quality) AS n_labelled, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 1 AND toxic = 0) AS n_ready FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "reconcile_versions": """
SELECT sha256(text) AS content_id, min(doc_id) AS doc_id, count(*) AS n_docs, count(DISTINCT source) AS n_sources, CASE WHEN count(DISTINCT source) > 1 THEN 'VERSION_VARIANT' WHEN count(*) > 1 THEN 'DUPLICATE' ELSE 'EXACT' END AS status FROM documents WHERE text IS NOT NULL GROUP BY text""",
    "set_digest": """
SELECT r_name, c_mktsegment, sha256(string_agg(n_name, '|' ORDER BY n_name)) AS digest, count(*) AS n
FROM (SELECT DISTINCT r_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name, c_mktsegment""",
    "union_event_feed": """
SELECT kind, strftime(day, '%Y-%m-%d') AS day, status, count(*) AS n FROM (
  SELECT 'ORDER' AS kind, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status FROM orders
  UNION ALL SELECT 'SHIPMENT', CAST(l_shipdate AS DATE), l_linestatus FROM lineitem
  UNION ALL SELECT 'EVENT', CAST(ts AS DATE), event_type FROM events) GROUP BY ALL""",
}
