"""Business-day calendars, deadlines and rule choice.

A calendar is a small table of days (one row a day, so bounded by years, not by data). Days are numbered by
business ordinal once; a deadline is then two equality joins, whatever the number of acts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import table

# Holidays by month and day, and the recess, which wraps the year.
HOLIDAYS = ("01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "12-25")
RECESS = ("12-20", "01-20")
#: Status and its rank: of several for one day the highest wins.
RANKS = {"SUSPENDED": 40, "RECESS": 30, "HOLIDAY": 20, "BUSINESS_DAY": 10}


def spine(days: DataFrame, day: str, more: int) -> DataFrame:
    """Every day from the first in ``days`` to ``more`` days after the last."""
    ends = days.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(F.explode(F.expr(f"sequence(a, date_add(b, {more}))")).alias("day"))


def day_status(days: DataFrame) -> DataFrame:
    """``day, status``: the winner among weekend, holiday, recess and plain day."""
    md = F.date_format("day", "MM-dd")
    claims = F.array_compact(
        F.array(
            F.when((md >= RECESS[0]) | (md <= RECESS[1]), F.struct(F.lit(RANKS["RECESS"]).alias("rank"), F.lit("RECESS").alias("status"))),
            F.when(md.isin(*HOLIDAYS) | F.weekday("day").isin(5, 6), F.struct(F.lit(RANKS["HOLIDAY"]).alias("rank"), F.lit("HOLIDAY").alias("status"))),
            F.struct(F.lit(RANKS["BUSINESS_DAY"]).alias("rank"), F.lit("BUSINESS_DAY").alias("status")),
        )
    )
    return days.select("day", F.array_max(claims)["status"].alias("status"))


def business_deadlines(acts: DataFrame, calendar: DataFrame, day: str, term: str) -> DataFrame:
    """``acts`` with ``due``: the ``term``-th business day after ``day``; null where the calendar ends before."""
    w = Window.orderBy("day")  # the calendar alone
    numbered = calendar.withColumn("passed", F.sum(F.when(F.col("status") == "BUSINESS_DAY", 1).otherwise(0)).over(w))
    at = numbered.select(F.col("day").alias("_day"), "passed")
    due = numbered.filter("status = 'BUSINESS_DAY'").select(F.col("day").alias("due"), F.col("passed").alias("_ordinal"))
    started = acts.join(at, F.col(day) == F.col("_day"), "left").withColumn("_target", F.col("passed") + F.col(term))
    return started.join(due, F.col("_target") == F.col("_ordinal"), "left").drop("_day", "passed", "_target", "_ordinal")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))


def business_day_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).withColumn("term", F.when(F.col("o_orderpriority") == "1-URGENT", 5).otherwise(15))
    due = business_deadlines(o, day_status(spine(o, "day", 90)), "day", "term")
    return due.select("o_orderkey", "term", F.date_format("due", "yyyy-MM-dd").alias("due"))


def calendar_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.join(day_status(spine(o, "day", 0)), "day").groupBy(F.date_format("day", "yyyy-MM").alias("month"), "status").agg(F.count("*").alias("n"))


def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicable rule of highest precedence, for every order; none is a result too."""
    o = _orders(spark, sf_dir)
    rules = F.array_compact(
        F.array(
            F.when(F.col("o_orderpriority") == "1-URGENT", F.struct(F.lit(30).alias("rank"), F.lit("URGENT").alias("rule"), F.lit(5).alias("days"))),
            F.when((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "O"), F.struct(F.lit(20).alias("rank"), F.lit("LARGE_OPEN").alias("rule"), F.lit(10).alias("days"))),
            F.when(F.col("o_orderstatus") != "P", F.struct(F.lit(10).alias("rank"), F.lit("DEFAULT").alias("rule"), F.lit(15).alias("days"))),
        )
    )
    best = F.array_max(rules)
    return o.select("o_orderkey", F.coalesce(best["rule"], F.lit("UNRESOLVED")).alias("rule"), best["days"].alias("days"), F.size(rules).alias("n_rules"))


QUERIES = {f.__name__: f for f in (business_day_due, calendar_compose, rule_resolution)}

_STATUS = """c AS (SELECT day, CASE WHEN strftime(day, '%m-%d') >= '12-20' OR strftime(day, '%m-%d') <= '01-20' THEN 'RECESS'
  WHEN strftime(day, '%m-%d') IN ('01-01','04-21','05-01','09-07','10-12','11-02','11-15','12-25') OR isodow(day) >= 6 THEN 'HOLIDAY' ELSE 'BUSINESS_DAY' END AS status
  FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate) + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM orders))"""
ORACLE = {
    "business_day_due": f"""WITH {_STATUS},
n AS (SELECT *, sum(CASE WHEN status = 'BUSINESS_DAY' THEN 1 ELSE 0 END) OVER (ORDER BY day) AS passed FROM c),
o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 15 END AS term, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, term, strftime(d.day, '%Y-%m-%d') AS due FROM o JOIN n ON o.day = n.day LEFT JOIN n d ON d.status = 'BUSINESS_DAY' AND d.passed = n.passed + o.term""",
    "calendar_compose": f"WITH {_STATUS} SELECT strftime(day, '%Y-%m') AS month, status, count(*) AS n FROM orders JOIN c ON CAST(o_orderdate AS DATE) = day GROUP BY ALL",
    "rule_resolution": """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'LARGE_OPEN' WHEN o_orderstatus <> 'P' THEN 'DEFAULT' ELSE 'UNRESOLVED' END AS rule,
CASE WHEN o_orderpriority = '1-URGENT' THEN 5 WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 10 WHEN o_orderstatus <> 'P' THEN 15 END AS days,
(o_orderpriority = '1-URGENT')::INT + (o_totalprice > 300000 AND o_orderstatus = 'O')::INT + (o_orderstatus <> 'P')::INT AS n_rules FROM orders""",
}
