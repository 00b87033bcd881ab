"""From an obligation to its deadline, or to the one reason why there is none: the checks in their order, first failure told.

Nothing is guessed: an obligation without a context, a communication, a rule, a term, a fitting role or class, a policy or
a date stays open with that reason, and what the calculation itself cannot decide keeps its code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans.contracts import first_code
from caseloom.plans.deadlines import ORACLE as DEADLINES
from caseloom.plans.deadlines import RULES, _placed_acts, communication_evidence, deadline_calculation, rule_choice
from caseloom.sources.tables import table

#: A rule that the act itself states; it is in no catalogue.
EXPLICIT = "JUDICIAL_EXPLICIT_TERM"
#: Words of a trigger that is no communication, and the reason while nobody has confirmed it.
TRIGGERS = (("(?i)audi[eê]ncia", "HEARING_TRIGGER_NOT_CONFIRMED"), ("(?i)efetiva[cç][aã]o da medida", "MEASURE_EFFECTIVENESS_TRIGGER_NOT_CONFIRMED"))
REVIEW = ("COUNTING_BOUNDARY_UNSPECIFIED",)


def whole(value: Column) -> Column:
    return F.coalesce(F.size(value) > 0, F.lit(False))


def reason_of(o: DataFrame) -> Column:
    """The first reason that fits a row of ``o``, null if none does.

    Columns: ``domain, regime, jurisdiction, regimes`` (array) of the context; ``trigger_text``; ``communication_code`` (what
    is wrong with the communication) and ``communicated`` (whether there is one); ``rule_id`` and ``n_rules`` (rules of that
    id in the catalogue); ``term_value, term_unit`` of the act, ``rule_value, rule_unit`` of the rule; ``role, rule_roles``;
    ``procedure_class, rule_classes``; ``policy``; ``available_on, published_on``; ``calculation_code``. Empty lists of roles
    and classes fit all.
    """
    c = F.col
    context = F.coalesce(F.length("domain") > 0, F.lit(False)) & F.coalesce(F.length("regime") > 0, F.lit(False)) & F.coalesce(F.length("jurisdiction") > 0, F.lit(False)) & whole(c("regimes"))
    told = first_code(*((c("trigger_text").rlike(p), code) for p, code in TRIGGERS))
    given = lambda value, unit: F.coalesce((c(value) > 0) & ~c(unit).isin("", "UNSPECIFIED"), F.lit(False))
    fits = lambda value, allowed: ~whole(c(allowed)) | F.coalesce(F.array_contains(c(allowed), c(value)), F.lit(False))
    return F.coalesce(
        F.when(~context, "LEGAL_CONTEXT_MISSING"),
        told,
        c("communication_code"),
        first_code(
            (c("rule_id").isNull() | (c("rule_id") == ""), "RESOLVED_RULE_MISSING"),
            ((c("rule_id") != EXPLICIT) & (F.coalesce("n_rules", F.lit(0)) != 1), "RESOLVED_RULE_NOT_FOUND"),
            (~given("term_value", "term_unit") & ~given("rule_value", "rule_unit"), "TERM_INPUT_MISSING"),
            (~fits("role", "rule_roles"), "RECIPIENT_ROLE_MISSING_OR_INCOMPATIBLE"),
            (~fits("procedure_class", "rule_classes"), "PROCEDURE_CLASS_MISSING_OR_INCOMPATIBLE"),
            (c("policy").isNull() & ~F.coalesce("communicated", F.lit(False)), "COMMUNICATION_POLICY_MISSING"),
            (c("published_on").isNull() & c("available_on").isNull(), "COMMUNICATION_TRIGGER_MISSING"),
        ),
        c("calculation_code"),
    )


def status_of(reason: Column) -> Column:
    return F.when(reason.isNull(), "CALCULATED").when(reason.isin(*REVIEW), "REVIEW_REQUIRED").otherwise("UNRESOLVED")


def obligation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every act as an obligation: its context from regime and region, its communication from the party's events, its rule by
    choice, its role from the status, its class from the party's segment; the due day, or the reason why there is none.

    Appeals and defences go to a party whose role is known; the special regime is for two classes.
    """
    acts = _placed_acts(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment").dropDuplicates(["o_custkey"]), "o_custkey", "left")
    evidence = communication_evidence(spark, sf_dir).select("o_orderkey", F.col("code").alias("communication_code"), F.col("event_id").isNotNull().alias("communicated"))
    rule = rule_choice(spark, sf_dir).select("o_orderkey", "rule", "days")
    counted = deadline_calculation(spark, sf_dir).select("o_orderkey", "due", F.col("code").alias("calculation_code"))
    o = acts.join(evidence, "o_orderkey", "left").join(rule, "o_orderkey", "left").join(counted, "o_orderkey", "left")
    catalogue = [r[0] for r in RULES]
    own = F.col("rule") == EXPLICIT
    o = o.select(
        "o_orderkey", F.lit("CIVIL").alias("domain"), "regime", F.col("region").cast("string").alias("jurisdiction"), F.array("regime").alias("regimes"),
        F.lit(None).cast("string").alias("trigger_text"), "communication_code", "communicated",
        F.when(F.col("rule") != "UNRESOLVED", F.col("rule")).alias("rule_id"), F.when(F.col("rule").isin(*catalogue), 1).otherwise(0).alias("n_rules"),
        F.when(own, F.col("days")).alias("term_value"), F.when(own, "DAYS").alias("term_unit"), F.when(~own, F.col("days")).alias("rule_value"), F.when(~own, "DAYS").alias("rule_unit"),
        F.when(F.col("o_orderstatus") == "F", "PLAINTIFF").when(F.col("o_orderstatus") == "O", "DEFENDANT").alias("role"),
        F.when(F.col("act").isin("APPEAL", "DEFENCE"), F.array(F.lit("PLAINTIFF"), F.lit("DEFENDANT"))).alias("rule_roles"),
        F.col("c_mktsegment").alias("procedure_class"), F.when(F.col("regime") == "LAW_9099", F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("rule_classes"),
        F.lit(None).cast("string").alias("policy"), F.col("available").alias("available_on"), F.col("published").alias("published_on"), "due", "calculation_code",
    )
    told = o.withColumn("reason", reason_of(o))
    return told.select("o_orderkey", F.when(F.col("reason").isNull(), F.col("due")).alias("due"), status_of(F.col("reason")).alias("status"), "reason")


QUERIES = {"obligation_results": obligation_results}
ORACLE = {
    "obligation_results": f"""
WITH ce AS ({DEADLINES["communication_evidence"]}), rc AS ({DEADLINES["rule_choice"]}), dc AS ({DEADLINES["deadline_calculation"]}),
p AS (SELECT c_custkey, any_value(c_mktsegment) AS seg, any_value(n_regionkey) AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
x AS (SELECT o.o_orderkey, regime, region, ce.code AS cc, rule, rc.days, o_orderstatus, o_totalprice > 100000 AS roles, seg, due, dc.code
  FROM orders o JOIN dc USING (o_orderkey) LEFT JOIN p ON o_custkey = c_custkey LEFT JOIN ce USING (o_orderkey) LEFT JOIN rc USING (o_orderkey)),
r AS (SELECT *, CASE WHEN regime IS NULL OR region IS NULL THEN 'LEGAL_CONTEXT_MISSING' WHEN cc IS NOT NULL THEN cc WHEN rule = 'UNRESOLVED' THEN 'RESOLVED_RULE_MISSING' WHEN coalesce(days, 0) <= 0 THEN 'TERM_INPUT_MISSING'
  WHEN roles AND o_orderstatus NOT IN ('F', 'O') THEN 'RECIPIENT_ROLE_MISSING_OR_INCOMPATIBLE' WHEN regime = 'LAW_9099' AND coalesce(seg, '') NOT IN ('BUILDING', 'MACHINERY') THEN 'PROCEDURE_CLASS_MISSING_OR_INCOMPATIBLE' ELSE code END AS reason FROM x)
SELECT o_orderkey, CASE WHEN reason IS NULL THEN due END AS due, CASE WHEN reason IS NULL THEN 'CALCULATED' WHEN reason = 'COUNTING_BOUNDARY_UNSPECIFIED' THEN 'REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS status, reason FROM r"""
}
