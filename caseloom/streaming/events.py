"""Structured Streaming over the event table: high-water mark, windows, sessions, de-duplication.

Every query reads the table as a file stream with ``availableNow``, writes Parquet with a checkpoint and
returns what was written, so a restart goes on where the last run ended and late data are handled by the
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import shared_path

#: Long enough for a table that is read in one go: nothing is late.
WATERMARK = "60 days"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern the path may be a file or a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """Run a stream over all that is there, and read the sink: appended rows, or the whole state after the last batch."""
    spark = stream.sparkSession
    place = shared_path(spark, name)
    out = stream.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if complete:
        out = out.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{place}/out"))
    else:
        out = out.format("parquet").option("path", f"{place}/out")
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def incremental_hwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows taken up by the incremental reader, and the high-water mark of each type."""
    return run_to_end(event_stream(spark, sf_dir), "hwm").groupBy("event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("high_water"))


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, from tumbling windows."""
    rows = event_stream(spark, sf_dir).withWatermark("ts", WATERMARK)
    g = rows.groupBy(F.window("ts", "1 day")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return run_to_end(g, "window", complete=True).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: events with gaps under six hours."""
    rows = event_stream(spark, sf_dir).withWatermark("ts", WATERMARK)
    g = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return run_to_end(g, "session", complete=True).select("user_id", "n", "first_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("start"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each user, type and day, de-duplicated in the stream's state."""
    s = event_stream(spark, sf_dir).withWatermark("ts", WATERMARK).select("user_id", "event_type", F.to_date("ts").alias("day"), "ts")
    return run_to_end(s.dropDuplicates(["user_id", "event_type", "day"]), "dedup").select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"))


def changes(stream: DataFrame, name: str) -> DataFrame:
    """``event_id, change`` of a stream of ``user_id, event_type, event_id, ts, payload``: CREATED, CHANGED or UNCHANGED
    against the event before it of its user and kind; an event's place in a micro-batch is its time, then its id.

    What the stream remembers is the last payload of each user and kind. A micro-batch reads it where the one before has
    written it and writes its own rows and what is last now into a folder of its number, over what a run that was cut short
    may have left there: one shuffle a batch, and no group in one piece.
    """
    spark = stream.sparkSession
    place = shared_path(spark, name)
    kinds = stream.select("user_id", "event_type", "payload", F.lit(True).alias("last"), F.lit(True).alias("told"), "event_id", F.lit("").alias("change")).schema
    w = Window.partitionBy("user_id", "event_type").orderBy("told", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("told", F.lit(True))
        if number:
            held = batch.sparkSession.read.schema(kinds).parquet(f"{place}/out/batch={number - 1}").filter("last")
            rows = rows.unionByName(held.select("user_id", "event_type", "payload", F.lit(False).alias("told")), allowMissingColumns=True)
        before = F.lag("payload").over(w)
        change = F.when(before.isNull(), "CREATED").when(before == F.col("payload"), "UNCHANGED").otherwise("CHANGED")
        rows = rows.select("user_id", "event_type", "payload", F.lead(F.lit(True)).over(w).isNull().alias("last"), "told", "event_id", change.alias("change"))
        rows.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    # a stream without files has written no batch
    spark.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{place}/out/batch=none")
    return spark.read.schema(kinds).parquet(f"{place}/out").filter("told").select("event_id", "change")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every event's payload compares with the one before it of its user and kind, over all micro-batches."""
    return changes(event_stream(spark, sf_dir).select("user_id", "event_type", "event_id", "ts", F.coalesce("props", F.lit("")).alias("payload")), "changes")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind in windows of two days that begin every day."""
    rows = event_stream(spark, sf_dir).withWatermark("ts", WATERMARK)
    g = rows.groupBy(F.window("ts", "2 days", "1 day")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    return run_to_end(g, "sliding", complete=True).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of the stream with their party from a stored table, counted by segment once the stream has ended."""
    rows = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "value")
    party = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return run_to_end(rows.join(party, "user_id", "left"), "enriched").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (incremental_hwm, stream_window, stream_session, stream_dedup, stream_changes, stream_sliding, stream_enriched)}
ORACLE = {
    "incremental_hwm": "SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS high_water FROM events GROUP BY event_type",
    "stream_window": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_session": """
WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, count(*) AS n, min(event_id) AS first_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM b GROUP BY user_id, s""",
    "stream_changes": """
SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'CREATED' WHEN coalesce(props, '') = lag(coalesce(props, '')) OVER w THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""",
    "stream_sliding": """
SELECT strftime(d, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([CAST(ts AS DATE), CAST(ts AS DATE) - 1]) AS d FROM events) GROUP BY ALL""",
    "stream_enriched": "SELECT c_mktsegment, count(*) AS n, round(sum(value), 2) AS total FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' GROUP BY 1",
    "stream_dedup": "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events",
}
