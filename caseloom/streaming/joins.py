"""Streams in event time over several micro-batches: an interval join of two streams, and windows that drop what is late.

Events arrive in slices of a few days; those of the highest tenth of ``k`` arrive days after the others. A slice is put
where the stream reads, the stream runs to its end and stops, and the next slice finds it where its checkpoint left it, so
every slice is a restart. An event is late if it is not after the watermark that the slices before have left: the least,
over both streams, of the latest time seen less what may be waited for. Late events are dropped, and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from caseloom.sources.tables import shared_path, table

#: Days in a slice, days by which some events arrive late, the least ``k`` of those, and the first day.
SLICE_DAYS, LATE_DAYS, LATE_K, FIRST_DAY = 5, 6, 90, "2024-01-01"
#: What each stream waits for, and how long after a view a purchase may follow it.
WAITS = {"view": 2, "purchase": 3}
FOLLOWS_HOURS = 24
#: Rows of a stream, over all its slices, for each part of its state.
STATE_ROWS = 1_000_000


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the slice in which they arrive."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"))
    late = F.when(F.col("k") >= LATE_K, LATE_DAYS).otherwise(0)
    return ev.withColumn("slice", F.floor((F.date_diff(F.to_date("ts"), F.to_date(F.lit(FIRST_DAY))) + late) / SLICE_DAYS).cast("int"))


def state_parts(spark: SparkSession, rows: int) -> int:
    """In how many parts a stream of ``rows`` keeps its state. Every part is loaded and committed again in each micro-batch,
    with or without rows, so there are only as many as there are cores, or as keep a part at ``STATE_ROWS``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))


def started(writer: DataStreamWriter, spark: SparkSession, parts: int) -> StreamingQuery:
    """The stream, begun with its state in ``parts``; it takes the session's settings as it begins."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, parts)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, own)


def run_slices(rows: DataFrame, build, name: str) -> tuple[DataFrame, int]:
    """Feed ``rows`` slice by slice to the stream that ``build`` makes of a reader, and return what it has written and
    how many rows its stateful operators have dropped as late."""
    spark, dropped = rows.sparkSession, 0
    place = shared_path(spark, name)
    schema = rows.drop("slice").schema
    rows.write.partitionBy("slice").parquet(f"{place}/arrived")
    parts = state_parts(spark, spark.read.parquet(f"{place}/arrived").count())
    slices = [r["slice"] for r in spark.read.parquet(f"{place}/arrived").select("slice").distinct().orderBy("slice").collect()]
    for i in slices:
        spark.read.schema(schema).parquet(f"{place}/arrived/slice={i}").write.parquet(f"{place}/in/{i}")
        stream = build(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{place}/in"))
        query = started(stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True), spark, parts)
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{place}/out"), dropped


def followed(events: DataFrame, waits: dict[str, int] = WAITS, hours: int = FOLLOWS_HOURS) -> DataFrame:
    """``view_id, purchase_id``: purchases within ``hours`` after a view of their user, of one stream of events read twice.

    Both sides have a watermark and the condition bounds the times of one by those of the other, so the state of either
    holds no more than what may still be met.
    """
    side = lambda kind, n: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias(f"user_{n}"), F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"ts_{n}")).withWatermark(f"ts_{n}", f"{waits[kind]} days")
    views, purchases = side("view", "v"), side("purchase", "p")
    near = (F.col("user_v") == F.col("user_p")) & (F.col("ts_p") >= F.col("ts_v")) & (F.col("ts_p") <= F.col("ts_v") + F.expr(f"INTERVAL {hours} HOURS"))
    return views.join(purchases, near).select("view_id", "purchase_id")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and the purchases that follow them in time, from two streams with late events; the row without ids counts the
    events that came too late for either."""
    found, dropped = run_slices(arrivals(spark, sf_dir), followed, "join")
    return found.withColumn("n_late", F.lit(None).cast("bigint")).unionByName(spark.createDataFrame([(None, None, dropped)], "view_id bigint, purchase_id bigint, n_late bigint"))


def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day and kind, given out once as the watermark closes the day; what comes for a closed day is dropped."""

    def days(events: DataFrame) -> DataFrame:
        rows = events.withWatermark("ts", f"{WAITS['view']} days")
        return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

    return run_slices(arrivals(spark, sf_dir), days, "days")[0].withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_ARRIVED = f"""
a AS (SELECT event_id, user_id, event_type, ts, CAST(floor((date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE))
  + CASE WHEN coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) >= {LATE_K} THEN {LATE_DAYS} ELSE 0 END) / {SLICE_DAYS}.0) AS INT) AS s FROM events),
seen AS (SELECT s, {{}} FROM a GROUP BY s)"""

QUERIES = {f.__name__: f for f in (stream_join, stream_closed_days)}
ORACLE = {
    "stream_join": f"""
WITH {_ARRIVED.format("max(ts) FILTER (event_type = 'view') AS v, max(ts) FILTER (event_type = 'purchase') AS p")},
mark AS (SELECT s, epoch_ms(max(v) OVER w) - {WAITS['view'] * 86_400_000} AS v, epoch_ms(max(p) OVER w) - {WAITS['purchase'] * 86_400_000} AS p FROM seen WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT a.*, coalesce(epoch_us(ts) <= 1000 * least(v, p), false) AS late FROM a JOIN mark USING (s) WHERE event_type IN ('view', 'purchase'))
SELECT v.event_id AS view_id, p.event_id AS purchase_id, CAST(NULL AS BIGINT) AS n_late FROM e v JOIN e p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL {FOLLOWS_HOURS} HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase' AND NOT v.late AND NOT p.late
UNION ALL SELECT NULL, NULL, count(*) FROM e WHERE late""",
    "stream_closed_days": f"""
WITH {_ARRIVED.format("max(ts) AS t")},
mark AS (SELECT s, max(t) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {WAITS['view']} DAY AS m FROM seen),
last AS (SELECT max(t) - INTERVAL {WAITS['view']} DAY AS m FROM seen)
SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM a JOIN mark USING (s), last
WHERE (mark.m IS NULL OR CAST(ts AS DATE) + 1 > mark.m) AND CAST(ts AS DATE) + 1 <= last.m GROUP BY ALL""",
}
