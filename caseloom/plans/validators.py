"""What a stage hands to the next, checked: required fields, known ids, whole sets, one answer to a pair, stated reasons.

Every check is a join or an aggregate with the code of its first failure, so that one bad row never stops the others.
Movements stand for claims, parts for facts, pieces for the evidence that links them, parties for actors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.plans.contracts import first_code
from caseloom.sources.tables import table


def unknown_ids(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``known_id``: whether the id is there; a null id is unknown."""
    names = known.select(F.col(key).alias("_k")).distinct().withColumn("_there", F.lit(True))
    return rows.join(names, F.col(column) == F.col("_k"), "left").withColumn("known_id", F.coalesce("_there", F.lit(False))).drop("_k", "_there")


def source_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn can be a source: it has an author, a text, a place, and a hash that no other turn of its case has."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("h"))
    times = c.filter("h is not null").groupBy("conv_id", "h").agg(F.min("turn").alias("first"))
    both = c.join(times, ["conv_id", "h"], "left")
    code = first_code((F.col("role").isNull(), "ROLE_MISSING"), (F.col("text").isNull(), "TEXT_MISSING"), (F.trim("text") == "", "TEXT_BLANK"), (F.col("turn") > F.col("first"), "REPEATED"))
    return both.select("conv_id", "turn", F.coalesce(code, F.lit("OK")).alias("code"))


def sufficiency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stated sufficiency agrees with the points left open: finished movements must have none, open ones some."""
    openly = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n_open"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(openly, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))
    code = F.when((F.col("o_orderstatus") == "F") & (F.col("n_open") > 0), "SUFFICIENT_WITH_OPEN_POINTS").when((F.col("o_orderstatus") == "O") & (F.col("n_open") == 0), "INSUFFICIENT_WITHOUT_POINTS").otherwise("OK")
    return o.groupBy("o_orderstatus", code.alias("code")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def fact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as a validator leaves them: an id from their content, those that say the same under the first one's id, and a
    status that is on the list."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.trim(F.concat_ws(" ", "p_brand", "p_type"))).alias("statement"), "p_size")
    status = F.when(F.col("p_size") % 4 == 0, "ASSERTED").when(F.col("p_size") % 4 == 1, "DOCUMENTED").when(F.col("p_size") % 4 == 2, "JUDICIAL")
    first = p.groupBy("statement").agg(F.min("p_partkey").alias("first"))
    rows = p.join(first, "statement")
    code = first_code((status.isNull(), "EPISTEMIC_STATUS"), (F.col("p_partkey") != F.col("first"), "DUPLICATE_STATEMENT"))
    return rows.select("p_partkey", F.left(F.sha2("statement", 256), F.lit(24)).alias("fact_id"), status.alias("status"), code.alias("code"))


def actor_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of each party over its movements: one that is told alone stands, an open mention makes it ambiguous."""
    role = F.when(F.col("o_orderpriority").startswith("1"), "CLAIMANT").when(F.col("o_orderpriority").startswith("5"), "RESPONDENT").when(F.col("o_orderpriority").startswith("4"), "RELATIVE_OF")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(role)).alias("roles"))
    told = F.array_remove("roles", "RELATIVE_OF")
    state = F.when(F.size("roles") == 0, "UNKNOWN").when((F.size(told) == 1) & ~F.array_contains("roles", "RELATIVE_OF"), "RESOLVED").otherwise("AMBIGUOUS")
    return g.select("o_custkey", state.alias("state"), F.when(state == "RESOLVED", F.get(told, F.lit(0))).alias("role"))


def source_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stands behind a movement: the one supplier of its own party's nation among its pieces; none or several is none."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    hit = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("s_nationkey") == F.col("c_nationkey"))
    g = hit.groupBy("o_orderkey").agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b"))
    return g.select("o_orderkey", F.when(F.col("a") == F.col("b"), F.col("a")).alias("actor"), F.when(F.col("a") == F.col("b"), "DERIVED").otherwise("AMBIGUOUS").alias("method"))


def issue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each issue by what it links: facts and rules, facts alone, or rules alone; and what a research of it must
    find out."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("facts"), F.count_if(F.col("l_returnflag") != "N").alias("rules"))
    kind = F.when((F.col("facts") > 0) & (F.col("rules") > 0), "MIXED").when(F.col("facts") > 0, "FACTUAL").otherwise("LEGAL")
    goals = F.when(kind == "MIXED", F.array(F.lit("FIND_RULE"), F.lit("FIND_PRECEDENT"), F.lit("FIND_PROOF"))).when(kind == "LEGAL", F.array(F.lit("FIND_RULE"), F.lit("FIND_PRECEDENT"))).otherwise(F.array(F.lit("FIND_PROOF")))
    return l.select("l_orderkey", kind.alias("kind"), F.explode(goals).alias("objective"))


def research_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a plan has exactly one query for each pair of issue and objective; what is missing, doubled or not asked for."""
    wanted = issue_kinds(spark, sf_dir).select("l_orderkey", "objective", F.lit(True).alias("w"))
    plan = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, "FIND_RULE").when(F.col("l_linenumber") % 3 == 1, "FIND_PROOF").otherwise("FIND_PRECEDENT").alias("objective"))
    got = plan.groupBy("l_orderkey", "objective").agg(F.count("*").alias("n"))
    both = wanted.join(got, ["l_orderkey", "objective"], "full")
    code = F.when(F.col("n").isNull(), "MISSING").when(F.col("w").isNull(), "NOT_ASKED").when(F.col("n") > 1, "DOUBLED").otherwise("OK")
    return both.groupBy("objective", code.alias("code")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


def precedent_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the opening words of every benchmark item in turn: the first document that has them, of those by number; items
    that open alike are looked for once, and words are compared as they stand."""
    words = lambda c: F.slice(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""), 1, 6)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words(F.col("text")), " ").alias("opening")).filter("opening <> ''")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(words(F.col("text")), " ").alias("opening"))
    first = docs.groupBy("opening").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return items.join(first, "opening", "left").select("item_id", "doc_id", F.coalesce("n", F.lit(0)).alias("n_hits"))


def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the first thing that is wrong with each: no party, no evidence, evidence of an unknown source, no sum."""
    l = unknown_ids(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_suppkey", table(spark, sf_dir, "supplier").filter("s_acctbal > -500"), "s_suppkey")
    g = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_and("known_id").alias("known"))
    o = unknown_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", table(spark, sf_dir, "customer").filter("c_acctbal > -900"), "c_custkey")
    both = o.join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    code = first_code((~F.col("known_id"), "PARTY_UNKNOWN"), (F.col("n").isNull(), "NO_EVIDENCE"), (~F.col("known"), "SOURCE_UNKNOWN"), (F.col("o_totalprice") < 5000, "NO_SUM"))
    return both.groupBy(F.coalesce(code, F.lit("ACCEPTED")).alias("code")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def independent_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each movement judged for itself: accepted, or rejected with the reason; references to others count as far as they are
    accepted too."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("d"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ref"))
    own = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "ref", first_code((F.col("n").isNull(), "EMPTY"), (F.col("d") >= 0.1, "VALUE_OUT_OF_RANGE")).alias("own"))
    other = own.select(F.col("o_orderkey").alias("ref"), F.col("own").alias("ref_code"), F.lit(True).alias("there"))
    both = own.join(other, "ref", "left")
    reason = F.coalesce("own", F.when(F.col("ref").isNotNull() & F.col("ref_code").isNotNull(), "REFERENCE_REJECTED"))
    return both.select("o_orderkey", reason.isNull().alias("accepted"), reason.alias("reason"))


def synthesis_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all that a synthesis rests on belongs to its case: ids of others, by case."""
    e = table(spark, sf_dir, "events").select("user_id", (F.get_json_object("props", "$.k").cast("bigint") * 100 + F.col("event_id") % 7).alias("cited"))
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("cited"), F.lit(True).alias("own")).distinct()
    both = e.groupBy("user_id", "cited").agg(F.count("*").alias("n")).join(own, ["user_id", "cited"], "left")
    g = both.groupBy("user_id").agg(F.count("*").alias("n_cited"), F.count("own").alias("n_own"))
    return g.withColumn("valid", F.col("n_cited") == F.col("n_own"))


def context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack that goes into a draft: a case's frame and its three largest movements, with a fingerprint of all of it."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = o.withColumn("r", rank).filter("r <= 3").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "o_orderkey"))), lambda x: x["o_orderkey"]), ",").alias("sources"))
    both = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("sources", F.coalesce("sources", F.lit("")))
    return both.select("c_custkey", "sources", F.sha2(F.concat_ws("\n", F.col("c_custkey").cast("string"), "c_name", "sources"), 256).alias("fingerprint"))


def assembled_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes into the mapping of issues: movements whose facts are all known, whose party is, and that contradict no
    other; how many of each region are left out, and why first."""
    facts = unknown_ids(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", table(spark, sf_dir, "part").filter("p_size <= 45"), "p_partkey").groupBy("l_orderkey").agg(F.bool_and("known_id").alias("facts_known"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    twice = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("same_day"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(twice, ["o_custkey", "o_orderdate"]).join(facts, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    code = first_code((F.col("n_regionkey").isNull(), "PARTY_UNKNOWN"), (F.col("facts_known").isNull(), "NO_FACTS"), (~F.col("facts_known"), "FACT_UNKNOWN"), (F.col("same_day") > 1, "CONTRADICTION"))
    return o.groupBy("n_regionkey", F.coalesce(code, F.lit("READY")).alias("code")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (source_contract, sufficiency_check, fact_extraction, actor_roles, source_actor, issue_kinds, research_plan, precedent_hits, claim_checks, independent_validation, synthesis_ids, context_packs, assembled_inputs)
}

_KINDS = """k AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag <> 'N') > 0 THEN 'MIXED' WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'FACTUAL' ELSE 'LEGAL' END AS kind FROM lineitem GROUP BY 1),
o AS (SELECT l_orderkey, kind, unnest(CASE kind WHEN 'MIXED' THEN ['FIND_RULE', 'FIND_PRECEDENT', 'FIND_PROOF'] WHEN 'LEGAL' THEN ['FIND_RULE', 'FIND_PRECEDENT'] ELSE ['FIND_PROOF'] END) AS objective FROM k)"""
ORACLE = {
    "source_contract": """
SELECT conv_id, turn, CASE WHEN role IS NULL THEN 'ROLE_MISSING' WHEN text IS NULL THEN 'TEXT_MISSING' WHEN trim(text, ' ') = '' THEN 'TEXT_BLANK' WHEN turn > min(turn) OVER (PARTITION BY conv_id, text) THEN 'REPEATED' ELSE 'OK' END AS code FROM conversations""",
    "sufficiency_check": """
WITH p AS (SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS n FROM orders)
SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' AND n > 0 THEN 'SUFFICIENT_WITH_OPEN_POINTS' WHEN o_orderstatus = 'O' AND n = 0 THEN 'INSUFFICIENT_WITHOUT_POINTS' ELSE 'OK' END AS code, count(*) AS n, min(o_orderkey) AS first FROM p GROUP BY 1, 2""",
    "fact_extraction": """
WITH p AS (SELECT p_partkey, lower(trim(p_brand || ' ' || p_type, ' ')) AS s, CASE p_size % 4 WHEN 0 THEN 'ASSERTED' WHEN 1 THEN 'DOCUMENTED' WHEN 2 THEN 'JUDICIAL' END AS status FROM part)
SELECT p_partkey, left(sha256(s), 24) AS fact_id, status, CASE WHEN status IS NULL THEN 'EPISTEMIC_STATUS' WHEN p_partkey <> min(p_partkey) OVER (PARTITION BY s) THEN 'DUPLICATE_STATEMENT' END AS code FROM p""",
    "actor_roles": """
WITH g AS (SELECT o_custkey, bool_or(left(o_orderpriority, 1) = '1') AS c, bool_or(left(o_orderpriority, 1) = '5') AS r, bool_or(left(o_orderpriority, 1) = '4') AS x FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN NOT (c OR r OR x) THEN 'UNKNOWN' WHEN c <> r AND NOT x THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state, CASE WHEN c <> r AND NOT x THEN CASE WHEN c THEN 'CLAIMANT' ELSE 'RESPONDENT' END END AS role FROM g""",
    "source_actor": """
WITH g AS (SELECT o_orderkey, min(s_suppkey) AS a, max(s_suppkey) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = c_nationkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN a = b THEN a END AS actor, CASE WHEN a = b THEN 'DERIVED' ELSE 'AMBIGUOUS' END AS method FROM g""",
    "issue_kinds": f"WITH {_KINDS} SELECT l_orderkey, kind, objective FROM o",
    "research_plan": f"""WITH {_KINDS}, g AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'FIND_RULE' WHEN 1 THEN 'FIND_PROOF' ELSE 'FIND_PRECEDENT' END AS objective, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT objective, CASE WHEN c IS NULL THEN 'MISSING' WHEN kind IS NULL THEN 'NOT_ASKED' WHEN c > 1 THEN 'DOUBLED' ELSE 'OK' END AS code, count(*) AS n, min(l_orderkey) AS first FROM o FULL JOIN g USING (l_orderkey, objective) GROUP BY 1, 2""",
    "precedent_hits": """
WITH i AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')[1:6], ' ') AS opening FROM benchmark), d AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')[1:6], ' ') AS opening FROM documents WHERE text IS NOT NULL),
f AS (SELECT opening, min(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY 1) SELECT item_id, doc_id, coalesce(n, 0) AS n_hits FROM i LEFT JOIN f USING (opening) WHERE opening <> ''""",
    "claim_checks": """
WITH g AS (SELECT l_orderkey, bool_and(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > -500)) AS known FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900) THEN 'PARTY_UNKNOWN' WHEN known IS NULL THEN 'NO_EVIDENCE' WHEN NOT known THEN 'SOURCE_UNKNOWN' WHEN o_totalprice < 5000 THEN 'NO_SUM' ELSE 'ACCEPTED' END AS code, count(*) AS n, min(o_orderkey) AS first FROM orders LEFT JOIN g ON o_orderkey = l_orderkey GROUP BY 1""",
    "independent_validation": """
WITH l AS (SELECT l_orderkey, max(l_discount) AS d FROM lineitem GROUP BY 1), w AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ref, CASE WHEN d IS NULL THEN 'EMPTY' WHEN d >= 0.1::DOUBLE THEN 'VALUE_OUT_OF_RANGE' END AS own FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
r AS (SELECT w.o_orderkey, coalesce(w.own, CASE WHEN x.own IS NOT NULL THEN 'REFERENCE_REJECTED' END) AS reason FROM w LEFT JOIN w x ON w.ref = x.o_orderkey) SELECT o_orderkey, reason IS NULL AS accepted, reason FROM r""",
    "synthesis_ids": """
WITH e AS (SELECT DISTINCT user_id, CAST(props->>'$.k' AS BIGINT) * 100 + event_id % 7 AS cited FROM events)
SELECT user_id, count(*) AS n_cited, count(o_orderkey) AS n_own, count(*) = count(o_orderkey) AS valid FROM e LEFT JOIN orders ON o_custkey = user_id AND o_orderkey = cited GROUP BY 1""",
    "context_packs": """
WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3), g AS (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY r) AS s FROM t GROUP BY 1)
SELECT c_custkey, coalesce(s, '') AS sources, sha256(c_custkey || chr(10) || c_name || chr(10) || coalesce(s, '')) AS fingerprint FROM customer LEFT JOIN g ON c_custkey = o_custkey""",
    "assembled_inputs": """
WITH f AS (SELECT l_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 45)) AS k FROM lineitem GROUP BY 1), c AS (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS same_day FROM orders)
SELECT n_regionkey, CASE WHEN n_regionkey IS NULL THEN 'PARTY_UNKNOWN' WHEN k IS NULL THEN 'NO_FACTS' WHEN NOT k THEN 'FACT_UNKNOWN' WHEN same_day > 1 THEN 'CONTRADICTION' ELSE 'READY' END AS code, count(*) AS n FROM o LEFT JOIN f ON o_orderkey = l_orderkey LEFT JOIN c ON o_custkey = c_custkey GROUP BY 1, 2""",
}
