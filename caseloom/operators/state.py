"""State that lives between runs: stored movements and pieces, marks of what was pulled, and what has gone stale.

Time stands for runs: a run sees the lines shipped, or the events that came, before its date. Every query makes its runs
one after the other over growing input, each against the table that the run before left, and returns what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.store import row_hash
from caseloom.sources.tables import kept, shared_path, table
from caseloom.sources.versioned import CREATED, UPDATED, StoredTable

#: Dates of the runs over lines, and since when a movement must have moved to be named by the last of them.
SHIPPED, NAMED_SINCE = ("1997-01-01", "1999-01-01", "2002-01-01"), "1998-01-01"
#: Dates up to which the runs over events pull.
PULLED = ("2024-01-10", "2024-01-20", "2024-01-31")


def movements(lines: DataFrame) -> DataFrame:
    g = lines.groupBy(F.col("l_orderkey").alias("movement_id")).agg(F.count("*").alias("n_pieces"), F.sum("l_quantity").cast("bigint").alias("units"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("moved_on"))
    return g.withColumn("digest", F.xxhash64("n_pieces", "units", "moved_on"))


def pieces(lines: DataFrame) -> DataFrame:
    g = lines.groupBy(F.col("l_orderkey").alias("movement_id"), "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("units"))
    return g.select(F.concat_ws("-", "movement_id", "l_linenumber").alias("piece_id"), "movement_id", "n", "units", F.xxhash64("n", "units").alias("digest"))


def movement_runs(spark: SparkSession, sf_dir: str, with_pieces: bool) -> tuple[StoredTable, StoredTable]:
    """Three runs: all that is there; only movements that moved since, where silence deletes nothing; all that is still
    named, where silence deletes. Pieces, if wanted, follow the movements that a run wrote, pruned with them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"))
    before = lambda day: F.col("l_shipdate") < F.to_timestamp_ntz(F.lit(day))
    path = shared_path(spark, "movements")
    moves, parts = StoredTable(spark, f"{path}/movements", "movement_id"), StoredTable(spark, f"{path}/pieces", "piece_id", by="movement_id")
    n = moves.parts(lines.count())
    for i, day in enumerate(SHIPPED):
        # all that follows goes by order, so a run's lines are shuffled once for each table
        seen = lines.filter(before(day)).repartition(n, "l_orderkey")
        wanted = movements(seen)
        if i:
            wanted = wanted.filter(F.col("moved_on") >= (SHIPPED[0], NAMED_SINCE)[i - 1])
        moves.merge(wanted, prune=i != 1, parts=n)
        if not with_pieces:
            continue
        changed = moves.changes()
        own = pieces(seen.join(changed.filter("action <> 'PRUNE'").select(F.col("movement_id").alias("l_orderkey")).repartition(n, "l_orderkey"), "l_orderkey", "left_semi"))
        parts.merge(own, prune=True, scope=("movement_id", changed.select("movement_id")), parts=n)
    return moves, parts


def stored_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored movements after three runs, with the runs that made and last changed each."""
    return movement_runs(spark, sf_dir, False)[0].read().select("movement_id", "n_pieces", "units", "moved_on", CREATED, UPDATED)


def stored_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pieces after three runs: those of pruned movements went with them."""
    return movement_runs(spark, sf_dir, True)[1].read().select("piece_id", "movement_id", "n", "units", CREATED, UPDATED)


def pull(events: DataFrame, stored: StoredTable, marks: StoredTable, until: str, fails) -> None:
    """One run: each case pulls from its mark, that day included, up to ``until``; what it has already is skipped.

    ``events`` has ``event_id, case_id, day, digest`` and what else is stored. A case whose pull ``fails`` (an aggregate
    over its rows) stores nothing, keeps its mark and notes an error, so its next run pulls the same days again. Rows are
    committed before marks: a run cut short between them is pulled again and finds its rows there.
    """
    held = marks.read() if marks.manifest()["schema"] else None
    cases = events.select("case_id").distinct()
    since = cases.withColumn("mark", F.lit(None).cast("string")).withColumn("n_ok", F.lit(0)).withColumn("n_failed", F.lit(0)) if held is None else cases.join(held.select("case_id", "mark", "n_ok", "n_failed"), "case_id", "left").fillna(0, ["n_ok", "n_failed"])
    window = kept(events.join(since.select("case_id", "mark"), "case_id").filter((F.col("day") <= until) & (F.col("mark").isNull() | (F.col("day") >= F.col("mark")))).drop("mark"), "window")
    bad = kept(window.groupBy("case_id").agg(fails.alias("bad")).filter("bad").select("case_id", "bad"), "failed")
    stored.merge(window.join(bad, "case_id", "left_anti"), prune=False)
    told = since.join(bad, "case_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    told = told.select("case_id", F.when(F.col("bad"), F.col("mark")).otherwise(F.lit(until)).alias("mark"), (F.col("n_ok") + (~F.col("bad")).cast("int")).alias("n_ok"), (F.col("n_failed") + F.col("bad").cast("int")).alias("n_failed"))
    marks.merge(told.withColumn("digest", row_hash("mark", "n_ok", "n_failed")), prune=False)


def pull_runs(spark: SparkSession, sf_dir: str) -> tuple[StoredTable, StoredTable]:
    ev = table(spark, sf_dir, "events")
    rows = ev.select("event_id", F.col("user_id").alias("case_id"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), row_hash("event_type", "value", "props").alias("digest"))
    path = shared_path(spark, "pulls")
    stored, marks = StoredTable(spark, f"{path}/events", "event_id"), StoredTable(spark, f"{path}/marks", "case_id")
    for day in PULLED:
        pull(rows, stored, marks, day, F.count_if(F.col("event_type") == "error") * 5 > 2 * F.count("*"))
    return stored, marks


def sync_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's mark after three runs over the events, its good and failed runs, and how many events it has stored."""
    stored, marks = pull_runs(spark, sf_dir)
    counts = stored.read().groupBy("case_id").agg(F.count("*").alias("n_stored"))
    return marks.read().join(counts, "case_id", "left").select("case_id", "mark", F.col("n_ok").cast("bigint").alias("n_ok"), F.col("n_failed").cast("bigint").alias("n_failed"), F.coalesce("n_stored", F.lit(0)).alias("n_stored"))


def stale_artifacts(built: DataFrame, current: DataFrame, needs: DataFrame) -> DataFrame:
    """``artifact, reason``: what must be built again.

    ``built (artifact, source_hash)`` is what stood when an artifact was built, ``current`` what stands now, ``needs
    (artifact, needed)`` what rests on what. CHANGED: the hash differs; NEW: never built; GONE: its source is no more;
    DEPENDENCY: something that it rests on, near or far, is one of these. Each round adds those that rest on the ones
    added last, each once, so there are as many rounds as there are levels; circles end them too.
    """
    both = built.select("artifact", F.col("source_hash").alias("a"), F.lit(True).alias("b")).join(current.select("artifact", F.col("source_hash").alias("c"), F.lit(True).alias("d")), "artifact", "full")
    reason = F.when(F.col("b").isNull(), "NEW").when(F.col("d").isNull(), "GONE").when(~F.col("a").eqNullSafe(F.col("c")), "CHANGED")
    found = kept(both.select("artifact", reason.alias("reason")).filter("reason is not null"), "stale")
    edge = found.select(F.col("artifact").alias("needed"))
    while True:
        more = needs.join(edge, "needed", "left_semi").select("artifact").distinct().join(found, "artifact", "left_anti")
        more = kept(more.withColumn("reason", F.lit("DEPENDENCY")), "stale")
        if more.isEmpty():
            return found
        found, edge = found.unionByName(more), more.select(F.col("artifact").alias("needed"))


#: Until when lines had been shipped as the artifacts were built.
BUILT_UNTIL = "2001-10-01"


def invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a late shipment makes stale: the summary of its order, the dossier of the customer, the reports of nation and
    region. The hashes of the build are read back from the stored table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct()
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").distinct()
    nations = table(spark, sf_dir, "nation")
    name = lambda kind, c: F.concat_ws(":", F.lit(kind), c)

    def hashes(seen: DataFrame) -> DataFrame:
        digest = movements(seen).select(F.col("movement_id").alias("o_orderkey"), F.col("digest").cast("string").alias("digest"))
        own = orders.join(digest, "o_orderkey", "left").select(name("order", "o_orderkey").alias("artifact"), F.coalesce("digest", F.lit("")).alias("source_hash"))
        fixed = [df.select(name(kind, c).alias("artifact"), F.lit("").alias("source_hash")).distinct() for kind, df, c in (("customer", customers, "c_custkey"), ("nation", nations, "n_nationkey"), ("region", nations, "n_regionkey"))]
        return own.unionByName(fixed[0]).unionByName(fixed[1]).unionByName(fixed[2])

    needs = orders.select(name("customer", "o_custkey").alias("artifact"), name("order", "o_orderkey").alias("needed"))
    needs = needs.unionByName(customers.select(name("nation", "c_nationkey").alias("artifact"), name("customer", "c_custkey").alias("needed")))
    needs = needs.unionByName(nations.select(name("region", "n_regionkey").alias("artifact"), name("nation", "n_nationkey").alias("needed")))
    builds = StoredTable(spark, f"{shared_path(spark, 'builds')}/builds", "artifact", "source_hash")
    builds.merge(hashes(lines.filter(F.col("l_shipdate") < F.to_timestamp_ntz(F.lit(BUILT_UNTIL)))))
    return stale_artifacts(builds.read(), hashes(lines), needs)


_A, _B, _C = SHIPPED
_ERR = "count(*) FILTER (event_type = 'error') * 5 > 2 * count(*)"
QUERIES = {f.__name__: f for f in (stored_movements, stored_pieces, sync_marks, invalidated)}
ORACLE = {
    "stored_movements": f"""
SELECT l_orderkey AS movement_id, count(*) AS n_pieces, CAST(sum(l_quantity) AS BIGINT) AS units, strftime(max(l_shipdate), '%Y-%m-%d') AS moved_on,
  CASE WHEN min(l_shipdate) < '{_A}' THEN 1 WHEN min(l_shipdate) < '{_B}' THEN 2 ELSE 3 END AS created_version,
  CASE WHEN max(l_shipdate) >= '{_B}' THEN 3 WHEN max(l_shipdate) >= '{_A}' THEN 2 ELSE 1 END AS updated_version
FROM lineitem WHERE l_shipdate < '{_C}' GROUP BY 1 HAVING max(l_shipdate) >= '{NAMED_SINCE}'""",
    "stored_pieces": f"""
WITH m AS (SELECT l_orderkey FROM lineitem WHERE l_shipdate < '{_C}' GROUP BY 1 HAVING max(l_shipdate) >= '{NAMED_SINCE}'),
s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < '{_A}' THEN 1 WHEN l_shipdate < '{_B}' THEN 2 ELSE 3 END AS r, l_quantity FROM lineitem JOIN m USING (l_orderkey) WHERE l_shipdate < '{_C}')
SELECT l_orderkey || '-' || l_linenumber AS piece_id, l_orderkey AS movement_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS units, min(r) AS created_version, max(r) AS updated_version FROM s GROUP BY ALL""",
    "sync_marks": f"""
WITH e AS (SELECT event_id, user_id AS c, event_type, strftime(ts, '%Y-%m-%d') AS d FROM events), u AS (SELECT DISTINCT c FROM e),
r1 AS (SELECT u.c, NOT coalesce({_ERR}, false) AS ok FROM u LEFT JOIN e ON e.c = u.c AND d <= '{PULLED[0]}' GROUP BY 1),
m1 AS (SELECT c, ok AS ok1, CASE WHEN ok THEN '{PULLED[0]}' END AS m FROM r1),
r2 AS (SELECT m1.c, ok1, m, NOT coalesce({_ERR}, false) AS ok FROM m1 LEFT JOIN e ON e.c = m1.c AND d <= '{PULLED[1]}' AND (m IS NULL OR d >= m) GROUP BY ALL),
m2 AS (SELECT c, ok1, ok AS ok2, CASE WHEN ok THEN '{PULLED[1]}' ELSE m END AS m FROM r2),
r3 AS (SELECT m2.c, ok1, ok2, m, NOT coalesce({_ERR}, false) AS ok FROM m2 LEFT JOIN e ON e.c = m2.c AND d <= '{PULLED[2]}' AND (m IS NULL OR d >= m) GROUP BY ALL),
m3 AS (SELECT c, ok1, ok2, ok AS ok3, CASE WHEN ok THEN '{PULLED[2]}' ELSE m END AS m FROM r3)
SELECT m3.c AS case_id, m AS mark, ok1::INT + ok2::INT + ok3::INT AS n_ok, 3 - (ok1::INT + ok2::INT + ok3::INT) AS n_failed, count(e.event_id) AS n_stored
FROM m3 LEFT JOIN e ON e.c = m3.c AND e.d <= m3.m GROUP BY ALL""",
    "invalidated": f"""
WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= '{BUILT_UNTIL}')),
c AS (SELECT DISTINCT o_custkey AS k FROM o), n AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey IN (FROM c)), r AS (SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_nationkey IN (FROM n))
SELECT 'order:' || o_orderkey AS artifact, 'CHANGED' AS reason FROM o UNION ALL SELECT 'customer:' || k, 'DEPENDENCY' FROM c UNION ALL SELECT 'nation:' || k, 'DEPENDENCY' FROM n UNION ALL SELECT 'region:' || k, 'DEPENDENCY' FROM r""",
}
