"""Deadlines by policy: calendars composed from registries, rule choice, triggers, counting, adjustment, reasons.

A calendar has one row a day and is numbered once for every way of counting; an act's deadline is then a few equality
joins. Rules and policies are small tables of constants; what they cannot decide is a result with a reason, never a
guess. Orders stand for acts: the priority for the regime, the status for how the act was communicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.plans.calendar import HOLIDAYS, spine
from caseloom.plans.contracts import first_code, wraps
from caseloom.sources.tables import table

# Precedence of a day's status, and of the scope of what says so.
STATUS_RANK = {"SUSPENDED": 40, "RECESS": 30, "HOLIDAY": 20, "BUSINESS_DAY": 10}
SCOPE_RANK = {"SYSTEM": 70, "UNIT": 60, "FORUM": 50, "COMARCA": 40, "COURT": 30, "STATE": 20, "NATIONAL": 10}
# How each regime counts (mode, recess, whether its bounds are told, what happens to a due day off).
POLICIES = {
    "CPC": ("BUSINESS", True, True, "NEXT_BUSINESS_DAY"),
    "CPP": ("CONTINUOUS", True, True, "NEXT_BUSINESS_DAY"),
    "CLT": ("BUSINESS", True, True, "NONE"),
    "LAW_9099": ("BUSINESS", False, False, "NONE"),
}
# Rules as (id, regime, act, precedence, category rank, days, first day in force, last).
RULES = (
    ("R01", "CPC", "DEFENCE", 10, 2, 15, "1992-01-01", None),
    ("R02", "CPC", "APPEAL", 20, 3, 15, "1992-01-01", None),
    ("R03", "CPC", "*", 5, 1, 5, None, None),
    ("R04", "CPP", "APPEAL", 20, 3, 5, "1993-01-01", "1996-12-31"),
    ("R05", "CPP", "*", 5, 1, 10, None, None),
    ("R06", "CLT", "APPEAL", 20, 3, 8, "1992-01-01", "1995-06-30"),
    ("R07", "CLT", "DEFENCE", 20, 2, 5, "1992-01-01", None),
    ("R08", "LAW_9099", "APPEAL", 30, 3, 10, None, None),
)
_RULE = "rule_id string, regime string, act string, precedence int, category int, days int, valid_from string, valid_to string"


def ranked(column: Column, ranks: dict[str, int]) -> Column:
    """The rank of a name; -1 for one that has none."""
    out = F.lit(-1)
    for name, rank in ranks.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def in_effect(day: Column, first: Column, last: Column) -> Column:
    """Whether a day is in a period; an open end (null) has no bound."""
    return F.coalesce(day >= first, F.lit(True)) & F.coalesce(day <= last, F.lit(True))


def applies(applicability: Column, medium: Column) -> Column:
    """True, false or unknown (null): ALL holds for every medium, another only for its own, none for one not told."""
    return F.when(applicability == "ALL", True).when(applicability.isin("ELECTRONIC", "PHYSICAL"), applicability == medium)


def numbered(calendar: DataFrame) -> DataFrame:
    """Calendars (region, day, status) with, for each day, the next business day after it (``after``), the first from it on
    (``from_here``), and how many days count before it in each mode (``business``, ``continuous``, ``plain``)."""
    ahead = Window.partitionBy("region").orderBy("day")  # the days of one calendar
    back = ahead.rowsBetween(Window.unboundedPreceding, -1)
    free, recess = F.col("status") == "BUSINESS_DAY", wraps(F.col("day"), "12-20", "01-20")
    open_day = F.when(free, F.col("day"))
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(back), F.lit(0))
    return calendar.select(
        "region", "day", "status",
        F.min(open_day).over(ahead.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
        F.min(open_day).over(ahead.rowsBetween(0, Window.unboundedFollowing)).alias("from_here"),
        count(free & ~recess).alias("business"), count(~recess).alias("continuous"), count(free).alias("plain"),
        (free & ~recess).alias("is_business"), (~recess).alias("is_continuous"), free.alias("is_plain"),
    )


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("available"), "o_totalprice")
    regime = F.when(F.col("o_orderpriority").startswith("1"), "CPC").when(F.col("o_orderpriority").startswith("2"), "CPP").when(F.col("o_orderpriority").startswith("3"), "CLT").when(F.col("o_orderpriority").startswith("4"), "LAW_9099")
    act = F.when(F.col("o_totalprice") > 250000, "APPEAL").when(F.col("o_totalprice") > 100000, "DEFENCE").otherwise("OTHER")
    return o.select("o_orderkey", "o_custkey", regime.alias("regime"), act.alias("act"), "available", F.when(F.col("o_orderstatus") == "F", F.date_add("available", 3)).alias("published"), "o_orderstatus")


def _placed_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts with the region of their party, whose calendar counts; an act without a known party has none."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    party = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey").drop("c_nationkey").dropDuplicates(["o_custkey"])
    return _acts(spark, sf_dir).join(party, "o_custkey", "left")


def _rules(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(RULES, _RULE))


def registry_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registries say, a row for each day: holidays as written dates, suspensions as written ranges, both from
    JSON; dates that are none and ranges that run backwards give no row, and ranges are clipped to their year."""
    day = F.date_add(F.lit("1995-12-01").cast("date"), F.col("n_nationkey") * 17)
    br = lambda d: F.date_format(d, "dd/MM/yyyy")
    text = F.when(F.col("n_nationkey") % 5 == 0, F.concat(br(day), F.lit(" a "), br(F.date_add(day, F.col("n_nationkey") * 3 - 6)))).when(F.col("n_nationkey") == 7, F.lit("31/02/1996")).otherwise(br(day))
    raw = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_name").alias("Descricao"), text.alias("Data"), F.col("n_regionkey").alias("region"))).alias("json"))
    row = F.from_json("json", "Descricao string, Data string, region int")
    cut = raw.select(row.alias("r")).select("r.Descricao", "r.region", F.regexp_extract("r.Data", "^([0-9]{2}/[0-9]{2}/[0-9]{4})", 1).alias("a"), F.regexp_extract("r.Data", " a ([0-9]{2}/[0-9]{2}/[0-9]{4})$", 1).alias("b"))
    first, last = F.try_to_date("a", "dd/MM/yyyy"), F.try_to_date("b", "dd/MM/yyyy")
    good = cut.select("Descricao", "region", first.alias("first"), F.coalesce(last, first).alias("last"), last.isNotNull().alias("range")).filter("first is not null and first <= last")
    end = F.least(F.col("last"), F.make_date(F.year("first"), F.lit(12), F.lit(31)))
    days = good.select("Descricao", "region", "range", F.explode(F.sequence("first", end)).alias("day"))
    return days.select("Descricao", "region", F.date_format("day", "yyyy-MM-dd").alias("day"), F.when(F.col("range"), "SUSPENDED").otherwise("HOLIDAY").alias("status"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds on each day of the acts, by region: registries, the fixed holidays, and weekends as derived."""
    days = spine(_acts(spark, sf_dir), "available", 120)
    registry = registry_days(spark, sf_dir).select(F.to_date("day").alias("day"), "region", "status", F.when(F.col("status") == "SUSPENDED", "COURT").otherwise("COMARCA").alias("scope"), F.col("Descricao").alias("source"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"))
    every = days.join(F.broadcast(regions))  # one row a day and region
    fixed = every.filter(F.date_format("day", "MM-dd").isin(*HOLIDAYS)).select("day", "region", F.lit("HOLIDAY").alias("status"), F.lit("NATIONAL").alias("scope"), F.lit("act").alias("source"))
    weekend = every.filter(F.weekday("day") >= 5).select("day", "region", F.lit("HOLIDAY").alias("status"), F.lit("NATIONAL").alias("scope"), F.lit("algorithm").alias("source"))
    plain = every.select("day", "region", F.lit("BUSINESS_DAY").alias("status"), F.lit("NATIONAL").alias("scope"), F.lit("base").alias("source"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return registry.join(F.broadcast(ends), F.col("day").between(F.col("a"), F.col("b"))).drop("a", "b").unionByName(fixed).unionByName(weekend).unionByName(plain)


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct(ranked(F.col("status"), STATUS_RANK).alias("r"), ranked(F.col("scope"), SCOPE_RANK).alias("s"), "source", "status", "scope")
    return _claims(spark, sf_dir).groupBy("region", "day").agg(F.max(key).alias("w"), F.count("*").alias("n_claims")).select("region", "day", "w.status", "w.scope", "w.source", "n_claims")


def calendar_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all that is said about a day the winner by status, scope and source; one row for each region and day."""
    return _composed(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def calendar_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which entries of one region differ in status, and years for which they come from several sources."""
    g = _claims(spark, sf_dir).filter("status <> 'BUSINESS_DAY'").groupBy("region", F.year("day").cast("bigint").alias("year"), "day").agg(F.count_distinct("status").alias("n_status"), F.count_distinct("source").alias("n_sources"))
    return g.groupBy("region", "year").agg(F.count_if(F.col("n_status") > 1).alias("n_conflicts"), F.count_if(F.col("n_sources") > 1).alias("n_shared"), F.count("*").alias("n_days"))


def calendar_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many registry entries each party's request matches, by the scope of the entry: its nation, its region or all."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("state"), F.when(F.col("n_nationkey") % 3 == 0, "NATIONAL").when(F.col("n_nationkey") % 3 == 1, "STATE").otherwise("UNIT").alias("scope"))
    home = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("c_region"))
    match = (F.col("scope") == "NATIONAL") | ((F.col("scope") == "STATE") & (F.col("state") == F.col("c_region"))) | ((F.col("scope") == "UNIT") & (F.col("unit") == F.col("c_nationkey")))
    hits = home.join(n).filter(match).groupBy("c_nationkey").agg(F.count("*").alias("n_entries"), F.max(ranked(F.col("scope"), SCOPE_RANK)).alias("narrowest"))  # nations by nations
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(hits), "c_nationkey").select("c_custkey", "n_entries", "narrowest")


def applicability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a notice applies to an act of its medium: yes, no, or not to be told."""
    kind = F.when(F.col("event_type") == "view", "ALL").when(F.col("event_type") == "click", "ELECTRONIC").when(F.col("event_type") == "purchase", "PHYSICAL").otherwise("LOCAL")
    medium = F.when(F.col("user_id") % 3 == 0, "ELECTRONIC").when(F.col("user_id") % 3 == 1, "PHYSICAL")
    state = applies(kind, medium)
    return table(spark, sf_dir, "events").groupBy("event_type", F.when(state, "TRUE").when(~state, "FALSE").otherwise("UNKNOWN").alias("applies")).agg(F.count("*").alias("n"))


def calendar_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of a day in a range: those in force, or with the history all of them."""
    o = _acts(spark, sf_dir).filter("available between '1995-01-01' and '1995-12-31'")
    last = Window.partitionBy("available").orderBy(F.desc("o_orderkey"))
    rows = o.select("available", "o_orderkey", (F.row_number().over(last) == 1).alias("is_current"))
    return rows.groupBy("available").agg(F.count("*").alias("n_history"), F.min(F.when(F.col("is_current"), F.col("o_orderkey"))).alias("current")).withColumn("available", F.date_format("available", "yyyy-MM-dd"))


def _triggered(acts: DataFrame, cal: DataFrame) -> DataFrame:
    """``acts`` with the day derived from the calendar of their region, the trigger, and the day on which counting starts."""
    a = acts.join(cal.select("region", F.col("day").alias("available"), F.col("after").alias("derived")), ["region", "available"], "left").withColumn("trigger", F.coalesce("published", "derived"))
    return a.join(cal.select("region", F.col("day").alias("trigger"), F.col("after").alias("start")), ["region", "trigger"], "left")


def communication_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day that sets an act's term running: the publication if it is told, else the next business day after it was
    available; counting starts on the next business day after that."""
    a = _triggered(_placed_acts(spark, sf_dir), numbered(_composed(spark, sf_dir)))
    method = F.when(F.col("published").isNotNull(), "DECLARED").when(F.col("derived").isNotNull(), "DERIVED").otherwise("UNRESOLVED")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return a.select("o_orderkey", iso("trigger"), iso("start"), method.alias("method"))


def deadline_calculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The due day of every act by its regime's policy, or the reason why there is none.

    Business regimes count business days outside the recess, the continuous one all days outside it; a due day off
    moves on where the policy says so; a policy that doesn't tell its bounds, an act without regime, and a calendar that
    ends too early leave the act open.
    """
    cal = numbered(_composed(spark, sf_dir))
    a = _placed_acts(spark, sf_dir).withColumn("term", F.when(F.col("act") == "APPEAL", 15).when(F.col("act") == "DEFENCE", 10).otherwise(5))
    a = _triggered(a, cal)
    mode = F.when(F.col("regime").isin("CPC", "CLT"), "business").when(F.col("regime") == "CPP", "continuous").when(F.col("regime") == "LAW_9099", "plain")
    counts = cal.select("region", F.col("day").alias("start"), F.explode(F.map_from_arrays(F.array(*map(F.lit, ("business", "continuous", "plain"))), F.array("business", "continuous", "plain"))).alias("mode", "before"))
    a = a.withColumn("mode", mode).join(counts, ["region", "start", "mode"], "left").withColumn("ordinal", F.col("before") + F.col("term") - 1)
    ends = None
    for name in ("business", "continuous", "plain"):
        part = cal.filter(F.col(f"is_{name}")).select("region", F.lit(name).alias("mode"), F.col(name).alias("ordinal"), F.col("day").alias("last_counted"), "from_here")
        ends = part if ends is None else ends.unionByName(part)
    a = a.join(ends, ["region", "mode", "ordinal"], "left")
    due = F.when(F.col("regime").isin("CPC", "CPP"), F.col("from_here")).otherwise(F.col("last_counted"))
    code = first_code((F.col("regime").isNull(), "COUNTING_POLICY_UNRESOLVED"), (F.col("regime") == "LAW_9099", "COUNTING_BOUNDARY_UNSPECIFIED"), (F.col("trigger").isNull(), "COMMUNICATION_TRIGGER_MISSING"), (F.col("start").isNull() | due.isNull(), "CALENDAR_COVERAGE_MISSING"))
    status = F.when(code.isNull(), "CALCULATED").when(code == "COUNTING_BOUNDARY_UNSPECIFIED", "REVIEW_REQUIRED").otherwise("UNRESOLVED")
    return a.select("o_orderkey", "regime", "term", F.when(code.isNull(), F.date_format(due, "yyyy-MM-dd")).alias("due"), status.alias("status"), code.alias("code"))


def counting_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy that counts an act's term, or the code of the conflict between what is told and what its rule says."""
    a = _acts(spark, sf_dir).withColumn("unit", F.when(F.col("o_orderkey") % 4 == 0, "BUSINESS_DAYS").when(F.col("o_orderkey") % 4 == 1, "CALENDAR_DAYS").when(F.col("o_orderkey") % 4 == 2, "DAYS"))
    a = a.withColumn("qualifier", F.when(F.col("o_orderkey") % 6 == 0, "BUSINESS_DAYS").when(F.col("o_orderkey") % 6 == 3, "WEEKS"))
    known = lambda c: c.isin("BUSINESS_DAYS", "CALENDAR_DAYS")
    told = F.coalesce("qualifier", F.when(known(F.col("unit")), F.col("unit")))
    mode = F.when(F.col("regime").isin("CPC", "CLT", "LAW_9099"), "BUSINESS_DAYS").when(F.col("regime") == "CPP", "CALENDAR_DAYS")
    code = first_code(
        (F.col("qualifier").isNotNull() & known(F.col("unit")) & (F.col("qualifier") != F.col("unit")), "COUNTING_QUALIFIERS_CONFLICT"),
        (told.isNotNull() & ~known(told), "UNSUPPORTED_COUNTING_QUALIFIER"),
        (mode.isNull(), "COUNTING_POLICY_UNRESOLVED"),
        (told.isNotNull() & (told != mode), "COUNTING_QUALIFIER_CONFLICTS_WITH_RULE"),
        ((F.col("regime") == "CLT") & (F.col("available") < F.lit("1993-01-01").cast("date")), "COUNTING_POLICY_OUTSIDE_EFFECTIVE_PERIOD"),
    )
    return a.select("o_orderkey", code.alias("code"), F.when(code.isNull(), F.concat_ws("_", "regime", mode)).alias("policy"))


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule against every kind of act and year: how many acts it takes, or why not, by the first check that fails."""
    a = _acts(spark, sf_dir).groupBy("regime", "act", F.year("available").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.min("available").alias("first"))  # kinds are few
    r = _rules(spark).withColumnRenamed("regime", "rule_regime").withColumnRenamed("act", "rule_act")
    both = a.join(r)
    day = F.col("first")
    code = first_code((~F.col("rule_regime").eqNullSafe(F.col("regime")), "BASE_REGIME"), ((F.col("rule_act") != "*") & (F.col("rule_act") != F.col("act")), "PROCEDURAL_ACT_TYPE"), (~in_effect(day, F.col("valid_from").cast("date"), F.col("valid_to").cast("date")), "OUTSIDE_EFFECTIVE_PERIOD"))
    return both.groupBy("rule_id", F.coalesce(code, F.lit("COMPATIBLE")).alias("code")).agg(F.sum("n").alias("n_acts"), F.count("*").alias("n_kinds"))


def rule_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each act: of those that fit the one of highest precedence, category and id; a term told by the court
    (here: of every ninth act) goes before all rules."""
    a = _acts(spark, sf_dir)
    r = _rules(spark).select("rule_id", F.col("regime").alias("rule_regime"), F.col("act").alias("rule_act"), "precedence", "category", "days", F.col("valid_from").cast("date").alias("f"), F.col("valid_to").cast("date").alias("t"))
    fits = (F.col("regime") == F.col("rule_regime")) & ((F.col("rule_act") == "*") | (F.col("rule_act") == F.col("act"))) & in_effect(F.col("available"), F.col("f"), F.col("t"))
    best = a.join(r, fits, "left").groupBy("o_orderkey").agg(F.max(F.struct("precedence", "category", "rule_id", "days")).alias("b"), F.count("rule_id").alias("n_rules"))
    told = F.col("o_orderkey") % 9 == 0
    return best.select("o_orderkey", F.when(told, "JUDICIAL_EXPLICIT_TERM").otherwise(F.coalesce("b.rule_id", F.lit("UNRESOLVED"))).alias("rule"), F.when(told, F.lit(7)).otherwise(F.col("b.days")).alias("days"), "n_rules")


def rule_pack_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rule pack is sound and what it leaves open: each regime of the acts with its rules, doubles and holes."""
    r = _rules(spark).groupBy(F.col("regime").alias("rule_regime")).agg(F.count("*").alias("n_rules"), F.count_distinct("rule_id").alias("n_ids"), F.bool_or(F.col("act") == "*").alias("has_default"), F.count_if(F.col("days") <= 0).alias("n_bad"))
    a = _acts(spark, sf_dir).groupBy("regime").agg(F.count("*").alias("n_acts"))
    both = a.join(F.broadcast(r), F.col("regime") == F.col("rule_regime"), "left")
    code = first_code((F.col("regime").isNull(), "NO_REGIME"), (F.col("n_rules").isNull(), "NO_RULES"), (F.col("n_rules") != F.col("n_ids"), "DUPLICATE_ID"), (F.col("n_bad") > 0, "BAD_TERM"), (~F.col("has_default"), "NO_DEFAULT"))
    return both.select("regime", "n_acts", F.coalesce(code, F.lit("OK")).alias("code"))


def communication_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publication that communicates each act: exactly one notice of its party on its day of the month, else a reason."""
    e = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'view')").select("user_id", F.day("ts").alias("dom"), "event_id")
    g = e.groupBy("user_id", "dom").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
    a = _acts(spark, sf_dir).select("o_orderkey", "o_custkey", F.day("available").alias("dom"))
    both = a.join(g, (F.col("o_custkey") == F.col("user_id")) & (a["dom"] == g["dom"]), "left")
    code = F.when(F.col("n").isNull(), "COMMUNICATION_EVENT_MISSING").when(F.col("n") > 1, "COMMUNICATION_EVENT_AMBIGUOUS")
    return both.select("o_orderkey", F.when(code.isNull(), F.col("event_id")).alias("event_id"), code.alias("code"))


def opposing_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who must answer: the opposite of the one role that the earlier acts of a case had; with two roles nobody is named."""
    role = F.when(F.col("o_orderstatus") == "F", "PLAINTIFF").when(F.col("o_orderstatus") == "O", "DEFENDANT")
    g = _acts(spark, sf_dir).filter("act <> 'OTHER'").groupBy("o_custkey").agg(F.min(role).alias("a"), F.max(role).alias("b"))
    return g.select("o_custkey", F.when(F.col("a") == F.col("b"), F.when(F.col("a") == "PLAINTIFF", "DEFENDANT").otherwise("PLAINTIFF")).alias("opposing"), F.when(F.col("a").isNull(), "NO_ANTECEDENT").when(F.col("a") == F.col("b"), "INVERSE").otherwise("AMBIGUOUS").alias("method"))


def relevant_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years for which calendars are needed: those of all acts and the ones after them, with the acts that need each."""
    y = F.year("available").cast("bigint")
    return _acts(spark, sf_dir).select(F.explode(F.array(y, y + 1)).alias("year")).groupBy("year").agg(F.count("*").alias("n_acts"))


QUERIES = {
    f.__name__: f
    for f in (registry_days, calendar_winner, calendar_conflicts, calendar_scope, applicability_states, calendar_range, communication_trigger, deadline_calculation, counting_policy, rule_candidates, rule_choice, rule_pack_checks, communication_evidence, opposing_role, relevant_years)
}

_SQL_ACTS = """a AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE left(o_orderpriority, 1) WHEN '1' THEN 'CPC' WHEN '2' THEN 'CPP' WHEN '3' THEN 'CLT' WHEN '4' THEN 'LAW_9099' END AS regime,
  CASE WHEN o_totalprice > 250000 THEN 'APPEAL' WHEN o_totalprice > 100000 THEN 'DEFENCE' ELSE 'OTHER' END AS act, CAST(o_orderdate AS DATE) AS available, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 3 END AS published FROM orders)"""
_SQL_REGISTRY = """g0 AS (SELECT n_name, n_regionkey AS region, DATE '1995-12-01' + n_nationkey * 17 AS f, n_nationkey % 5 = 0 AS rng, DATE '1995-12-01' + n_nationkey * 17 + CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey * 3 - 6 ELSE 0 END AS t FROM nation WHERE n_nationkey <> 7),
g AS (SELECT n_name, region, CASE WHEN rng THEN 'SUSPENDED' ELSE 'HOLIDAY' END AS status, CAST(unnest(generate_series(CAST(f AS TIMESTAMP), CAST(least(t, make_date(year(f), 12, 31)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM g0 WHERE f <= t)"""
_SQL_CAL = f"""{_SQL_ACTS}, {_SQL_REGISTRY},
d AS (SELECT CAST(unnest(generate_series(CAST(min(available) AS TIMESTAMP), CAST(max(available) + 120 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM a),
e AS (SELECT day, r_regionkey AS region FROM d, region),
c AS (SELECT day, region, status, CASE WHEN status = 'SUSPENDED' THEN 'COURT' ELSE 'COMARCA' END AS scope, n_name AS source FROM g SEMI JOIN d USING (day)
  UNION ALL SELECT day, region, 'HOLIDAY', 'NATIONAL', 'act' FROM e WHERE strftime(day, '%m-%d') IN ({', '.join(f"'{h}'" for h in HOLIDAYS)})
  UNION ALL SELECT day, region, 'HOLIDAY', 'NATIONAL', 'algorithm' FROM e WHERE isodow(day) >= 6
  UNION ALL SELECT day, region, 'BUSINESS_DAY', 'NATIONAL', 'base' FROM e),
k AS (SELECT *, CASE status WHEN 'SUSPENDED' THEN 40 WHEN 'HOLIDAY' THEN 20 ELSE 10 END AS r, CASE scope WHEN 'COMARCA' THEN 40 WHEN 'COURT' THEN 30 ELSE 10 END AS s FROM c),
w AS (SELECT *, count(*) OVER (PARTITION BY region, day) AS n_claims FROM k QUALIFY row_number() OVER (PARTITION BY region, day ORDER BY r DESC, s DESC, source DESC, status DESC, scope DESC) = 1)"""
_SQL_NUMBERED = f"""{_SQL_CAL},
m0 AS (SELECT region, day, status, status = 'BUSINESS_DAY' AS free, strftime(day, '%m-%d') >= '12-20' OR strftime(day, '%m-%d') <= '01-20' AS recess FROM w),
m AS (SELECT *, min(CASE WHEN free THEN day END) OVER (PARTITION BY region ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after, min(CASE WHEN free THEN day END) OVER (PARTITION BY region ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM m0),
pa AS (SELECT c_custkey, any_value(n_regionkey) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
x AS (SELECT a.*, pa.region, coalesce(published, m.after) AS trigger, m.after AS derived FROM a LEFT JOIN pa ON o_custkey = c_custkey LEFT JOIN m ON m.day = available AND m.region = pa.region),
y AS (SELECT x.*, m.after AS start FROM x LEFT JOIN m ON m.day = trigger AND m.region = x.region)"""
_SQL_RULES = "ru AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RULES) + ") t(rule_id, rr, ra, precedence, category, days, vf, vt))"
ORACLE = {
    "registry_days": f"WITH {_SQL_REGISTRY} SELECT n_name AS Descricao, region, strftime(day, '%Y-%m-%d') AS day, status FROM g",
    "calendar_winner": f"WITH {_SQL_CAL} SELECT region, strftime(day, '%Y-%m-%d') AS day, status, scope, source, n_claims FROM w",
    "calendar_conflicts": f"""WITH {_SQL_CAL}, q AS (SELECT region, year(day) AS year, day, count(DISTINCT status) AS s, count(DISTINCT source) AS o FROM c WHERE status <> 'BUSINESS_DAY' GROUP BY ALL)
SELECT region, year, count(*) FILTER (s > 1) AS n_conflicts, count(*) FILTER (o > 1) AS n_shared, count(*) AS n_days FROM q GROUP BY ALL""",
    "calendar_scope": """
WITH h AS (SELECT x.n_nationkey AS k, count(*) AS n, max(CASE e.n_nationkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 60 END) AS narrowest FROM nation x JOIN nation e ON e.n_nationkey % 3 = 0 OR (e.n_nationkey % 3 = 1 AND e.n_regionkey = x.n_regionkey) OR (e.n_nationkey % 3 = 2 AND e.n_nationkey = x.n_nationkey) GROUP BY 1)
SELECT c_custkey, n AS n_entries, narrowest FROM customer JOIN h ON c_nationkey = k""",
    "applicability_states": """
WITH k AS (SELECT event_type, CASE event_type WHEN 'view' THEN 'ALL' WHEN 'click' THEN 'ELECTRONIC' WHEN 'purchase' THEN 'PHYSICAL' ELSE 'LOCAL' END AS kind, CASE user_id % 3 WHEN 0 THEN 'ELECTRONIC' WHEN 1 THEN 'PHYSICAL' END AS medium FROM events)
SELECT event_type, CASE WHEN kind = 'ALL' OR (kind <> 'LOCAL' AND kind = medium) THEN 'TRUE' WHEN kind <> 'LOCAL' AND kind <> medium THEN 'FALSE' ELSE 'UNKNOWN' END AS applies, count(*) AS n FROM k GROUP BY ALL""",
    "calendar_range": f"WITH {_SQL_ACTS} SELECT strftime(available, '%Y-%m-%d') AS available, count(*) AS n_history, max(o_orderkey) AS current FROM a WHERE available BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' GROUP BY 1",
    "communication_trigger": f"WITH {_SQL_NUMBERED} SELECT o_orderkey, strftime(trigger, '%Y-%m-%d') AS trigger, strftime(start, '%Y-%m-%d') AS start, CASE WHEN published IS NOT NULL THEN 'DECLARED' WHEN derived IS NOT NULL THEN 'DERIVED' ELSE 'UNRESOLVED' END AS method FROM y",
    "deadline_calculation": f"""WITH {_SQL_NUMBERED},
b AS (SELECT region, mode, day, row_number() OVER (PARTITION BY region, mode ORDER BY day) AS o, here FROM (SELECT 'B' AS mode, * FROM m WHERE free AND NOT recess UNION ALL SELECT 'C', * FROM m WHERE NOT recess UNION ALL SELECT 'P', * FROM m WHERE free)),
t AS (SELECT y.*, CASE act WHEN 'APPEAL' THEN 15 WHEN 'DEFENCE' THEN 10 ELSE 5 END AS term, CASE WHEN regime IN ('CPC', 'CLT') THEN 'B' WHEN regime = 'CPP' THEN 'C' WHEN regime = 'LAW_9099' THEN 'P' END AS mode FROM y),
f AS (SELECT t.o_orderkey, min(b.o) AS o FROM t JOIN (SELECT region, day, mode, o FROM b) b ON b.mode = t.mode AND b.region = t.region AND b.day >= t.start AND b.day < t.start + 45 GROUP BY 1),
z AS (SELECT t.*, CASE WHEN regime IN ('CPC', 'CPP') THEN b.here ELSE b.day END AS due FROM t LEFT JOIN f USING (o_orderkey) LEFT JOIN b ON b.mode = t.mode AND b.region = t.region AND b.o = f.o + t.term - 1),
v AS (SELECT *, CASE WHEN regime IS NULL THEN 'COUNTING_POLICY_UNRESOLVED' WHEN regime = 'LAW_9099' THEN 'COUNTING_BOUNDARY_UNSPECIFIED' WHEN trigger IS NULL THEN 'COMMUNICATION_TRIGGER_MISSING' WHEN start IS NULL OR due IS NULL THEN 'CALENDAR_COVERAGE_MISSING' END AS code FROM z)
SELECT o_orderkey, regime, term, CASE WHEN code IS NULL THEN strftime(due, '%Y-%m-%d') END AS due, CASE WHEN code IS NULL THEN 'CALCULATED' WHEN code = 'COUNTING_BOUNDARY_UNSPECIFIED' THEN 'REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS status, code FROM v""",
    "counting_policy": f"""WITH {_SQL_ACTS},
u AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'BUSINESS_DAYS' WHEN 1 THEN 'CALENDAR_DAYS' WHEN 2 THEN 'DAYS' END AS unit, CASE o_orderkey % 6 WHEN 0 THEN 'BUSINESS_DAYS' WHEN 3 THEN 'WEEKS' END AS q, CASE WHEN regime = 'CPP' THEN 'CALENDAR_DAYS' WHEN regime IS NOT NULL THEN 'BUSINESS_DAYS' END AS mode FROM a),
t AS (SELECT *, coalesce(q, CASE WHEN unit IN ('BUSINESS_DAYS', 'CALENDAR_DAYS') THEN unit END) AS told FROM u),
v AS (SELECT *, CASE WHEN q IS NOT NULL AND unit IN ('BUSINESS_DAYS', 'CALENDAR_DAYS') AND q <> unit THEN 'COUNTING_QUALIFIERS_CONFLICT' WHEN told NOT IN ('BUSINESS_DAYS', 'CALENDAR_DAYS') THEN 'UNSUPPORTED_COUNTING_QUALIFIER' WHEN mode IS NULL THEN 'COUNTING_POLICY_UNRESOLVED'
  WHEN told <> mode THEN 'COUNTING_QUALIFIER_CONFLICTS_WITH_RULE' WHEN regime = 'CLT' AND available < DATE '1993-01-01' THEN 'COUNTING_POLICY_OUTSIDE_EFFECTIVE_PERIOD' END AS code FROM t)
SELECT o_orderkey, code, CASE WHEN code IS NULL THEN regime || '_' || mode END AS policy FROM v""",
    "rule_candidates": f"""WITH {_SQL_ACTS}, {_SQL_RULES}, k AS (SELECT regime, act, year(available) AS yr, count(*) AS n, min(available) AS first FROM a GROUP BY ALL),
c AS (SELECT rule_id, n, CASE WHEN rr IS DISTINCT FROM regime THEN 'BASE_REGIME' WHEN ra <> '*' AND ra <> act THEN 'PROCEDURAL_ACT_TYPE' WHEN NOT (coalesce(first >= CAST(vf AS DATE), true) AND coalesce(first <= CAST(vt AS DATE), true)) THEN 'OUTSIDE_EFFECTIVE_PERIOD' ELSE 'COMPATIBLE' END AS code FROM k, ru)
SELECT rule_id, code, CAST(sum(n) AS BIGINT) AS n_acts, count(*) AS n_kinds FROM c GROUP BY ALL""",
    "rule_choice": f"""WITH {_SQL_ACTS}, {_SQL_RULES},
j AS (SELECT o_orderkey, rule_id, days, precedence, category FROM a LEFT JOIN ru ON regime = rr AND (ra = '*' OR ra = act) AND coalesce(available >= CAST(vf AS DATE), true) AND coalesce(available <= CAST(vt AS DATE), true)),
b AS (SELECT o_orderkey, arg_max(rule_id, (precedence, category, rule_id)) AS r, arg_max(days, (precedence, category, rule_id)) AS d, count(rule_id) AS n FROM j GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'JUDICIAL_EXPLICIT_TERM' ELSE coalesce(r, 'UNRESOLVED') END AS rule, CASE WHEN o_orderkey % 9 = 0 THEN 7 ELSE d END AS days, n AS n_rules FROM b""",
    "rule_pack_checks": f"""WITH {_SQL_ACTS}, {_SQL_RULES}, r AS (SELECT rr, count(*) AS n, count(DISTINCT rule_id) AS i, bool_or(ra = '*') AS d, count(*) FILTER (days <= 0) AS b FROM ru GROUP BY 1)
SELECT regime, count(*) AS n_acts, any_value(CASE WHEN regime IS NULL THEN 'NO_REGIME' WHEN n IS NULL THEN 'NO_RULES' WHEN n <> i THEN 'DUPLICATE_ID' WHEN b > 0 THEN 'BAD_TERM' WHEN NOT d THEN 'NO_DEFAULT' ELSE 'OK' END) AS code FROM a LEFT JOIN r ON regime = rr GROUP BY regime""",
    "communication_evidence": f"""WITH {_SQL_ACTS}, g AS (SELECT user_id, day(ts) AS dom, count(*) AS n, min(event_id) AS event_id FROM events WHERE event_type IN ('purchase', 'view') GROUP BY ALL)
SELECT o_orderkey, CASE WHEN n = 1 THEN event_id END AS event_id, CASE WHEN n IS NULL THEN 'COMMUNICATION_EVENT_MISSING' WHEN n > 1 THEN 'COMMUNICATION_EVENT_AMBIGUOUS' END AS code FROM a LEFT JOIN g ON o_custkey = user_id AND day(available) = dom""",
    "opposing_role": f"""WITH {_SQL_ACTS}, g AS (SELECT o_custkey, min(r) AS x, max(r) AS y FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'PLAINTIFF' WHEN 'O' THEN 'DEFENDANT' END AS r FROM a WHERE act <> 'OTHER') GROUP BY 1)
SELECT o_custkey, CASE WHEN x = y THEN CASE x WHEN 'PLAINTIFF' THEN 'DEFENDANT' ELSE 'PLAINTIFF' END END AS opposing, CASE WHEN x IS NULL THEN 'NO_ANTECEDENT' WHEN x = y THEN 'INVERSE' ELSE 'AMBIGUOUS' END AS method FROM g""",
    "relevant_years": f"WITH {_SQL_ACTS} SELECT yr AS year, count(*) AS n_acts FROM (SELECT unnest([year(available), year(available) + 1]) AS yr FROM a) GROUP BY 1",
}
