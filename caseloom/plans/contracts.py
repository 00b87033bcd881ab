"""Contracts between stages as queries: id sets, first failing rules, single values, claims, versions, scores.

Every check is an aggregate or an equality join. Where a key must have one value, its least and its greatest
are compared instead of gathering all of them, so a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def id_set_states(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """OK, MISSING, DUPLICATE or UNEXPECTED for every id of either side."""
    a = expected.select(F.col(key).alias("_k")).distinct()
    b = returned.groupBy(key).agg(F.count("*").alias("n"))
    both = a.join(b, F.col("_k").eqNullSafe(F.col(key)) & F.col("n").isNotNull(), "full")
    state = F.when(F.col("n").isNull(), "MISSING").when(F.col("_k").isNull() & F.col(key).isNotNull(), "UNEXPECTED").when(F.col("n") > 1, "DUPLICATE").otherwise("OK")
    return both.select(F.coalesce("_k", key).alias(key), state.alias("state"))


def first_code(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that fits; null where none does. A rule on a null does not fit."""
    return F.coalesce(*(F.when(condition, code) for condition, code in rules))


def single_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one value of each key, or NO_CONTEXT without any, or CONFLICT with several."""
    g = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    state = F.when(F.col("_a").isNull(), "NO_CONTEXT").when(F.col("_a") == F.col("_b"), "SINGLE").otherwise("CONFLICT")
    return g.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias(value), state.alias("state"))


def appended_versions(stored: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``incoming`` numbered on from the greatest ``version`` that ``stored`` has for its key."""
    last = stored.groupBy(key).agg(F.max("version").alias("_last"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return incoming.withColumn("_rn", rn).join(last, key, "left").withColumn("version", F.col("_rn") + F.coalesce("_last", F.lit(0))).drop("_rn", "_last")


def wraps(day: Column, start: str, end: str) -> Column:
    """Whether a date falls in a period of month-days, which may run over the new year; both ends are in it."""
    md = F.date_format(day, "MM-dd")
    return (md >= start) | (md <= end) if start > end else (md >= start) & (md <= end)


def set_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall of ``actual`` against ``expected`` (both boolean) for each key; null where undefined."""
    g = pairs.groupBy(*keys).agg(F.count_if(F.col("expected") & F.col("actual")).alias("tp"), F.count_if(~F.col("expected") & F.col("actual")).alias("fp"), F.count_if(F.col("expected") & ~F.col("actual")).alias("fn"))
    ratio = lambda n: F.when(n > 0, F.round(F.col("tp") / n, 6))
    return g.select(*keys, "tp", "fp", "fn", ratio(F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp") + F.col("fn")).alias("recall"))


def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_set_states(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def row_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each line fails; lines that fail none have code null."""
    code = first_code((F.col("l_quantity") <= 1, "QUANTITY_TOO_SMALL"), (F.col("l_discount") > 0.09, "DISCOUNT_TOO_HIGH"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "RETURNED_BUT_OPEN"), (F.col("l_tax") == 0, "NO_TAX"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))


def one_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and years with more orders than the one that is wanted of each."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))
    return g.filter("n <> 1")


def single_or_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return single_value(table(spark, sf_dir, "orders").select("o_custkey", priority.alias("priority")), ["o_custkey"], "priority")


def identity_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one source claims as its own, with the first claimant."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("identity"), "source").agg(F.min("doc_id").alias("first_id"))
    g = docs.groupBy("identity").agg(F.count("source").alias("n_owners"), F.min(F.struct("first_id", "source")).alias("f"))
    return g.filter("n_owners > 1").select("identity", "n_owners", F.col("f.source").alias("owner"))


def version_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases appended behind the versions that a user's views have taken."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    stored = ev.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("version"))
    return appended_versions(stored, ev.filter("event_type = 'purchase'"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("version").cast("bigint").alias("version"))


def coalesce_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, with what the texts give in their place: an incoming value wins, a missing one leaves the stored."""
    incoming = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 2000, 1).when(F.col("n_chars") < 50, 0).alias("new_quality"), "lang")
    both = incoming.join(table(spark, sf_dir, "labels"), "doc_id", "full")
    origin = F.when(F.col("new_quality").isNotNull(), "INCOMING").when(F.col("quality").isNotNull(), "STORED").otherwise("NONE")
    return both.select("doc_id", "lang", F.coalesce("new_quality", "quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"), origin.alias("origin"))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length foretells quality, by language."""
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return set_scores(both.select("lang", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 500).alias("actual")), ["lang"])


def length_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median length and median deviation from it, by flag; the exact median holds a counter for each different value."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    mid = lines.groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"))
    return lines.join(mid, "l_returnflag").groupBy("l_returnflag", "median").agg(F.median(F.abs(F.col("l_quantity") - F.col("median"))).alias("mad"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user, and a flag that, once set, no later event takes back."""
    ev = table(spark, sf_dir, "events")
    g = ev.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count("*").alias("n"))
    return g.select("user_id", F.col("last.event_type").alias("state"), F.coalesce("failed", F.lit(False)).alias("failed"), "n")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that each event type lies behind the newest event of all."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts"))
    now = F.broadcast(g.agg(F.max("last_ts").alias("now")))
    behind = F.datediff(F.to_date("now"), F.to_date("last_ts"))
    return g.join(now).select("event_type", F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), behind.cast("bigint").alias("days_behind"), (behind <= 1).alias("fresh"))


def recess_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inside and outside the recess from 20 December to 20 January, by status."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", wraps(F.col("o_orderdate"), "12-20", "01-20").alias("in_recess")).agg(F.count("*").alias("n"))


# Months as written in long dates.
_MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()


def long_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written out, and what is read back from the writing."""
    names = F.array(*map(F.lit, _MONTHS))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" de ", F.day("o_orderdate").cast("string"), F.element_at(names, F.month("o_orderdate")), F.year("o_orderdate").cast("string")).alias("written"))
    part = lambda i: F.regexp_extract("written", r"^([0-9]{1,2}) de ([a-zç]+) de ([0-9]{4})$", i)
    month = F.array_position(names, part(2))
    iso = F.when(month > 0, F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")))
    return o.select("o_orderkey", "written", iso.alias("iso"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from content: 24 hex digits over the parts of an order, and one for a pair whichever way it is given."""
    a, b = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    sha = lambda *c: F.left(F.sha2(F.concat_ws("\0", *c), 256), F.lit(24))
    return table(spark, sf_dir, "orders").select("o_orderkey", sha(F.lit("order"), a, b).alias("stable_id"), sha(F.lit("pair"), F.least(a, b), F.greatest(a, b)).alias("pair_id"))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON with sorted keys and no blanks, and its hash."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_mktsegment", "c_name", "c_nationkey")).alias("canonical"))
    return c.withColumn("source_hash", F.sha2("canonical", 256))


def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector for each label: the weighted mean of its vectors, brought to length one. Sums combine before the shuffle."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7 + 1).alias("w"), F.posexplode("embedding").alias("dim", "x"))
    mean = e.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, "label").select("label", "dim", F.when(F.col("norm") > 0, F.round(F.col("m") / F.col("norm"), 6)).otherwise(0.0).alias("value"))


def vector_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vectors of a label share one space: a single dimension, no missing vector."""
    g = table(spark, sf_dir, "embeddings").select("label", F.size("embedding").alias("d")).groupBy("label")
    return g.agg(F.count("*").alias("n"), F.min("d").cast("bigint").alias("dim"), (F.min("d") == F.max("d")).alias("one_space"))


def package_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table; counts come from the files' footers."""
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in TABLES]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


QUERIES = {
    f.__name__: f
    for f in (batch_validation, row_rejections, one_per_pair, single_or_conflict, identity_claims, version_append, coalesce_merge, label_scores, length_deviation, job_states, freshness, recess_orders, long_dates, stable_ids, canonical_json, pooled_vectors, vector_spaces, package_inventory)
}

_WRITTEN = "['" + "', '".join(_MONTHS) + "']"
ORACLE = {
    "batch_validation": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'MISSING' WHEN d.doc_id IS NULL THEN 'UNEXPECTED' WHEN n > 1 THEN 'DUPLICATE' ELSE 'OK' END AS state
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "row_rejections": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 1 THEN 'QUANTITY_TOO_SMALL' WHEN l_discount > 0.09::DOUBLE THEN 'DISCOUNT_TOO_HIGH' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'RETURNED_BUT_OPEN' WHEN l_tax = 0 THEN 'NO_TAX' END AS code FROM lineitem""",
    "one_per_pair": "SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY ALL HAVING count(*) <> 1",
    "single_or_conflict": """
WITH g AS (SELECT o_custkey, min(p) AS p, count(DISTINCT p) AS n FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS p FROM orders) GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n = 1 THEN p END AS priority, CASE n WHEN 0 THEN 'NO_CONTEXT' WHEN 1 THEN 'SINGLE' ELSE 'CONFLICT' END AS state FROM g""",
    "identity_claims": "SELECT sha256(text) AS identity, count(DISTINCT source) AS n_owners, arg_min(source, (doc_id, source)) AS owner FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "version_append": """
WITH v AS (SELECT user_id, count(*) AS last FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + coalesce(last, 0) AS version FROM events LEFT JOIN v USING (user_id) WHERE event_type = 'purchase'""",
    "coalesce_merge": """
WITH n AS (SELECT doc_id, lang, CASE WHEN n_chars >= 2000 THEN 1 WHEN n_chars < 50 THEN 0 END AS q FROM documents)
SELECT doc_id, lang, CAST(coalesce(q, quality) AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, CASE WHEN q IS NOT NULL THEN 'INCOMING' WHEN quality IS NOT NULL THEN 'STORED' ELSE 'NONE' END AS origin FROM n FULL JOIN labels USING (doc_id)""",
    "label_scores": """
WITH g AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality <> 1 AND n_chars >= 500) AS fp, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) END AS recall FROM g""",
    "length_deviation": "SELECT l_returnflag, median(l_quantity) AS median, mad(l_quantity) AS mad FROM lineitem GROUP BY l_returnflag",
    "job_states": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, coalesce(bool_or(event_type = 'error'), false) AS failed, count(*) AS n FROM events GROUP BY user_id",
    "freshness": """
WITH g AS (SELECT event_type, max(ts) AS t FROM events GROUP BY event_type), d AS (SELECT event_type, t, date_diff('day', CAST(t AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) AS b FROM g)
SELECT event_type, strftime(t, '%Y-%m-%d') AS last_day, b AS days_behind, b <= 1 AS fresh FROM d""",
    "recess_orders": "SELECT o_orderstatus, strftime(o_orderdate, '%m-%d') >= '12-20' OR strftime(o_orderdate, '%m-%d') <= '01-20' AS in_recess, count(*) AS n FROM orders GROUP BY ALL",
    "long_dates": f"SELECT o_orderkey, day(o_orderdate) || ' de ' || ({_WRITTEN})[month(o_orderdate)] || ' de ' || year(o_orderdate) AS written, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    "stable_ids": """
WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey AS VARCHAR) AS b FROM orders)
SELECT o_orderkey, left(sha256('order' || chr(0) || a || chr(0) || b), 24) AS stable_id, left(sha256('pair' || chr(0) || least(a, b) || chr(0) || greatest(a, b)), 24) AS pair_id FROM o""",
    "canonical_json": """
WITH c AS (SELECT c_custkey, CAST(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_name', c_name, 'c_nationkey', c_nationkey) AS VARCHAR) AS canonical FROM customer)
SELECT *, sha256(canonical) AS source_hash FROM c""",
    "pooled_vectors": """
WITH e AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
m AS (SELECT label, dim, sum(x * w) / sum(w) AS m FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label)
SELECT label, dim, CASE WHEN norm > 0 THEN round(m / norm, 6) ELSE 0.0::DOUBLE END AS value FROM m JOIN n USING (label)""",
    "vector_spaces": "SELECT label, count(*) AS n, min(len(embedding)) AS dim, min(len(embedding)) = max(len(embedding)) AS one_space FROM embeddings GROUP BY label",
    "package_inventory": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
}
