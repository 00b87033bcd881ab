"""Runs, fills, segments and offsets over ordered rows, as windows partitioned by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import table


def islands(df: DataFrame, keys: list[str], order: list[str], identity: Column, name: str = "run_id") -> DataFrame:
    """Number maximal runs of equal ``identity`` within ``keys``; a null identity ends a run and is in none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_identity", identity)
    change = F.when(F.col("_identity").eqNullSafe(F.lag("_identity").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    counted = marked.withColumn("_change", change)
    return counted.withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_identity is not null").drop("_identity", "_change")


def bounded_fill(df: DataFrame, keys: list[str], order: list[str], value: Column) -> Column:
    """Fill a null only where the nearest values before and after it are equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(value, F.when(before == after, before))


def running_offset(keys: list[str], order: list[str], size: Column) -> Column:
    """Sum of the sizes of the rows before this one."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def islands_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return runs.groupBy("user_id", "run_id").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min(F.struct("ts", "event_id"))["event_id"].alias("first_id"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_id"))


def bounded_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    known = F.when(F.col("event_type") != "view", F.col("event_type"))
    return ev.select("event_id", known.alias("known"), bounded_fill(ev, ["user_id"], ["ts", "event_id"], known).alias("filled"))


def offset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with a constant difference of label and position, and the gap to the next segment."""
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn").distinct()
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    seg = said.withColumn("offset", F.col("turn") - rn).groupBy("conv_id", "offset").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))
    after = F.lead("first_turn").over(Window.partitionBy("conv_id").orderBy("first_turn"))
    return seg.withColumn("gap", after - F.col("last_turn") - 1)


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("bigint")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("n_chars"), running_offset(["conv_id"], ["turn"], size).cast("bigint").alias("start_offset"))


def anchor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns on either side of the longest turn of each conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    ranked = c.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    best = ranked.groupBy("conv_id").agg(F.max(F.struct("n", (-F.col("rn")).alias("m")))["m"].alias("m"))
    near = ranked.join(best, "conv_id").withColumn("distance", F.col("rn") + F.col("m")).filter("distance between -2 and 2")
    return near.select("conv_id", "turn", "role", "distance")


def batch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous batches of a conversation's turns, cut where the running size passes a share of the total."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    whole = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("size"), running_offset(["conv_id"], ["turn"], size).alias("before"), F.sum(size).over(whole).alias("total"))
    n = F.greatest(F.ceil(F.col("total") / 2000), F.lit(1))
    batch = F.least(F.floor((F.col("before") + F.col("size") / 2) * n / F.greatest(F.col("total"), F.lit(1))), n - 1)
    return c.select("conv_id", "turn", batch.cast("bigint").alias("batch"), F.ceil(F.col("size") / 2.6).cast("bigint").alias("tokens"))


def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in two documents or more of a source: page furniture."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("source", "doc_id", F.trim("line").alias("line")).filter(F.length("line") >= 4)
    found = lines.groupBy("source", F.sha2("line", 256).alias("line_hash"), F.length("line").cast("bigint").alias("n_chars")).agg(F.countDistinct("doc_id").alias("n_docs"))
    return found.filter("n_docs >= 2")


def folio_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, overlap and gaps of the hours in which a user has events, by event type."""
    ev = table(spark, sf_dir, "events")
    hour = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 24 + F.hour("ts")).cast("bigint")
    hours = ev.groupBy("user_id", hour.alias("h")).agg(F.countDistinct("event_type").alias("kinds"))
    step = F.col("h") - F.lag("h").over(Window.partitionBy("user_id").orderBy("h"))
    hours = hours.withColumn("missing", F.coalesce(step - 1, F.lit(0)))
    return hours.groupBy("user_id").agg(F.count("*").alias("n_union"), F.count_if(F.col("kinds") > 1).alias("n_overlap"), F.sum("missing").alias("n_gap"), F.count_if(F.col("missing") > 0).alias("n_gap_ranges"))


QUERIES = {f.__name__: f for f in (islands_event_type, bounded_gap_fill, offset_segments, running_offsets, anchor_window, batch_budget, recurring_lines, folio_set_algebra)}
ORACLE = {
    "islands_event_type": """
WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM a)
SELECT user_id, run_id, min(event_type) AS event_type, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id
FROM b WHERE event_type IS NOT NULL GROUP BY user_id, run_id""",
    "bounded_gap_fill": """
WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'view' THEN event_type END AS known FROM events),
b AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM a)
SELECT event_id, known, coalesce(known, CASE WHEN p = q THEN p END) AS filled FROM b""",
    "offset_segments": """
WITH a AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "offset" FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')),
b AS (SELECT conv_id, "offset", min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM a GROUP BY ALL)
SELECT *, lead(first_turn) OVER (PARTITION BY conv_id ORDER BY first_turn) - last_turn - 1 AS gap FROM b""",
    "running_offsets": """
SELECT conv_id, turn, length(text) AS n_chars, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM conversations""",
    "anchor_window": """
WITH a AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
b AS (SELECT conv_id, arg_max(rn, (n, -rn)) AS m FROM a GROUP BY conv_id)
SELECT conv_id, turn, role, rn - m AS distance FROM a JOIN b USING (conv_id) WHERE rn - m BETWEEN -2 AND 2""",
    "batch_budget": """
WITH a AS (SELECT conv_id, turn, coalesce(length(text), 0) AS size, coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id) AS total FROM conversations),
b AS (SELECT *, greatest(ceil(total / 2000.0::DOUBLE), 1) AS n FROM a)
SELECT conv_id, turn, CAST(least(floor((before + size / 2.0::DOUBLE) * n / greatest(total, 1)), n - 1) AS BIGINT) AS batch, CAST(ceil(size / 2.6::DOUBLE) AS BIGINT) AS tokens FROM b""",
    "recurring_lines": """
WITH a AS (SELECT source, doc_id, trim(line, ' ') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT source, sha256(line) AS line_hash, length(line) AS n_chars, count(DISTINCT doc_id) AS n_docs FROM a WHERE length(line) >= 4 GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2""",
    "folio_set_algebra": """
WITH a AS (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS h, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL),
b AS (SELECT *, coalesce(h - lag(h) OVER (PARTITION BY user_id ORDER BY h) - 1, 0) AS missing FROM a)
SELECT user_id, count(*) AS n_union, count(*) FILTER (kinds > 1) AS n_overlap, CAST(sum(missing) AS BIGINT) AS n_gap, count(*) FILTER (missing > 0) AS n_gap_ranges FROM b GROUP BY user_id""",
}
