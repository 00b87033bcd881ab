"""Evidence states: what the links of a fact support, contradict or leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import table


def fact_states(links: DataFrame, fact: list[str]) -> DataFrame:
    """One state for each fact from its links' ``relation`` (null: no link)."""
    has = lambda r: F.coalesce(F.bool_or(F.col("relation") == r), F.lit(False))
    g = links.groupBy(*fact).agg(F.count("relation").alias("n_links"), has("SUPPORTS").alias("s"), has("CONTRADICTS").alias("c"), has("INCONCLUSIVE").alias("i"))
    state = F.when(F.col("s") & F.col("c"), "MIXED").when(F.col("s"), "SUPPORT_PRESENT").when(F.col("c"), "CONTRADICTION_PRESENT").when(F.col("i"), "INCONCLUSIVE").otherwise("NO_EVIDENCE_IN_CONTEXT")
    return g.select(*fact, "n_links", state.alias("state"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is a fact, its labelled copies are its evidence."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("fact"))
    relation = F.when(F.col("toxic") == 1, "INCONCLUSIVE").when(F.col("quality") == 1, "SUPPORTS").when(F.col("quality") == 0, "CONTRADICTS")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "fact", relation.alias("relation"))


def fact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_states(_links(spark, sf_dir), ["fact"])


def gaps(facts: DataFrame, links: DataFrame) -> DataFrame:
    """``fact_id, coverage, codes, sufficiency`` from facts (fact_id, documented) and their links (fact_id, relation, scope).

    FULL with a full support, PARTIAL with any, SELF_DOCUMENTED without links if the fact's own status documents it;
    codes come in a fixed order, each once; conflicts are AMBIGUOUS, other open codes INSUFFICIENT.
    """
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rel = F.col("relation")
    g = links.groupBy("fact_id").agg(F.count("*").alias("n"), some((rel == "SUPPORTS") & (F.col("scope") == "FULL")).alias("full"), some(rel == "SUPPORTS").alias("s"), some(rel == "CONTRADICTS").alias("c"), some(rel == "INCONCLUSIVE").alias("i"))
    both = facts.join(g, "fact_id", "left")
    has = {k: F.coalesce(k, F.lit(False)) for k in ("full", "s", "c", "i")}
    linked = F.coalesce("n", F.lit(0)) > 0
    coverage = F.when(has["full"], "FULL").when(has["s"], "PARTIAL").when(~linked & F.col("documented"), "SELF_DOCUMENTED").otherwise("NONE")
    codes = F.array_compact(F.array(
        F.when((coverage == "NONE") & ~linked, "NO_EVIDENCE_IN_CONTEXT").when(coverage == "NONE", "NO_SUPPORT_IN_CONTEXT").when(coverage == "PARTIAL", "PARTIAL_SUPPORT"),
        F.when(has["i"], "INCONCLUSIVE_EVIDENCE"), F.when(has["s"] & has["c"], "CONFLICTING_EVIDENCE"),
    ))
    sufficiency = F.when(F.array_contains(codes, "CONFLICTING_EVIDENCE"), "AMBIGUOUS").when(F.size(codes) > 0, "INSUFFICIENT").otherwise("SUFFICIENT")
    return both.select("fact_id", coverage.alias("coverage"), F.array_join(codes, ",").alias("codes"), sufficiency.alias("sufficiency"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as facts, and their pieces in movements as evidence: what came back contradicts, what was accepted supports."""
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), (F.col("p_size") > 25).alias("documented"))
    relation = F.when(F.col("l_returnflag") == "A", "SUPPORTS").when(F.col("l_returnflag") == "R", "CONTRADICTS").otherwise("INCONCLUSIVE")
    links = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("fact_id"), relation.alias("relation"), F.when(F.col("l_discount") > 0.05, "FULL").otherwise("PARTIAL").alias("scope"), F.col("l_orderkey").alias("evidence_id"))
    return facts, links


def evidence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each fact, with the codes of what is missing in order."""
    return gaps(*_evidence(spark, sf_dir))


def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that one piece of evidence supports and another contradicts, with the first of each, and an id that does not
    depend on which is named first."""
    first = lambda r: F.min(F.when(F.col("relation") == r, F.col("evidence_id")))
    g = _evidence(spark, sf_dir)[1].groupBy("fact_id").agg(first("SUPPORTS").alias("supports"), first("CONTRADICTS").alias("contradicts")).filter("supports is not null and contradicts is not null")
    ends = F.concat_ws("|", F.lit("FACT_EVIDENCE"), F.least("supports", "contradicts").cast("string"), F.greatest("supports", "contradicts").cast("string"))
    return g.withColumn("pair_id", F.left(F.sha2(ends, 256), F.lit(24)))


def evidence_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as a validator leaves them: support of unclear identity becomes inconclusive, and says why."""
    rows = _evidence(spark, sf_dir)[1].join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), "o_orderstatus"), "evidence_id", "left")
    unclear = (F.col("relation") == "SUPPORTS") & (F.coalesce("o_orderstatus", F.lit("?")) != "F")
    out = rows.select("fact_id", F.when(unclear, "INCONCLUSIVE").otherwise(F.col("relation")).alias("relation"), F.when(unclear, "IDENTITY_UNCLEAR").otherwise("").alias("limitation"))
    return out.groupBy("relation", "limitation").agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("n_facts"))


def burden_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who must prove each fact: rules allocate by size; a conditional rule without its condition allocates nothing, two
    allocations are an error, and facts that no rule covers stay open."""
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), "p_size", "p_retailprice")
    claims = F.array_compact(F.array(
        F.when(F.col("p_size") <= 10, "CLAIMANT"), F.when((F.col("p_size") > 8) & (F.col("p_size") <= 30), "RESPONDENT"),
        F.when((F.col("p_size") > 30) & (F.col("p_retailprice") > 1500), "COURT"),
    ))
    code = F.when(F.size(claims) > 1, "OVERLAP").when(F.size(claims) == 0, F.when(F.col("p_size") > 30, "CONDITION_NOT_SATISFIED").otherwise("RULE_NOT_SUPPLIED"))
    return facts.select("fact_id", F.when(F.size(claims) == 1, F.get(claims, F.lit(0))).alias("bearer"), code.alias("code"))


def contradiction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two claims of a party may be called a contradiction: same subject, exclusive, close enough in time."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    nxt = F.lead(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "day")).over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey"))
    p = o.withColumn("x", nxt).filter("x is not null")
    code = F.when(F.col("o_orderpriority") != F.col("x.o_orderpriority"), "DIFFERENT_SUBJECT").when(F.col("o_orderstatus") == F.col("x.o_orderstatus"), "NOT_EXCLUSIVE").when(F.datediff("x.day", "day") > 180, "TIME_APART")
    strength = F.when(code.isNull(), F.when(F.datediff("x.day", "day") <= 30, "STRONG").otherwise("POSSIBLE"))
    return p.select("o_orderkey", F.col("x.o_orderkey").alias("other"), strength.alias("strength"), code.alias("code"))


def fact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions as sets of facts: for each movement the facts in conflict within it, in either order the same set."""
    links = _evidence(spark, sf_dir)[1].filter("relation <> 'INCONCLUSIVE'")
    g = links.groupBy("evidence_id").agg(F.array_sort(F.collect_set("fact_id")).alias("facts"), F.count_distinct("relation").alias("k")).filter("k = 2 and size(facts) > 1")
    return g.select("evidence_id", F.array_join("facts", ",").alias("facts"), F.size("facts").cast("bigint").alias("n_facts"))


QUERIES = {f.__name__: f for f in (fact_state, evidence_gap, contradiction_pairs, evidence_downgrade, burden_allocation, contradiction_gate, fact_sets)}

_LINKS = """k AS (SELECT doc_id, sha256(text) AS fact, CASE WHEN toxic = 1 THEN 'INCONCLUSIVE' WHEN quality = 1 THEN 'SUPPORTS' WHEN quality = 0 THEN 'CONTRADICTS' END AS relation
  FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL)"""
_SQL_EVIDENCE = """e AS (SELECT l_partkey AS fact_id, CASE l_returnflag WHEN 'A' THEN 'SUPPORTS' WHEN 'R' THEN 'CONTRADICTS' ELSE 'INCONCLUSIVE' END AS relation, CASE WHEN l_discount > 0.05 THEN 'FULL' ELSE 'PARTIAL' END AS scope, l_orderkey AS evidence_id FROM lineitem WHERE l_quantity > 40)"""
ORACLE = {
    "fact_state": f"""WITH {_LINKS}, g AS (SELECT fact, count(relation) AS n_links, count(*) FILTER (relation = 'SUPPORTS') > 0 AS s, count(*) FILTER (relation = 'CONTRADICTS') > 0 AS c, count(*) FILTER (relation = 'INCONCLUSIVE') > 0 AS i FROM k GROUP BY fact)
SELECT fact, n_links, CASE WHEN s AND c THEN 'MIXED' WHEN s THEN 'SUPPORT_PRESENT' WHEN c THEN 'CONTRADICTION_PRESENT' WHEN i THEN 'INCONCLUSIVE' ELSE 'NO_EVIDENCE_IN_CONTEXT' END AS state FROM g""",
    "evidence_gap": f"""WITH {_SQL_EVIDENCE}, g AS (SELECT fact_id, count(relation) AS n, count(*) FILTER (relation = 'SUPPORTS' AND scope = 'FULL') > 0 AS f, count(*) FILTER (relation = 'SUPPORTS') > 0 AS s, count(*) FILTER (relation = 'CONTRADICTS') > 0 AS c, count(*) FILTER (relation = 'INCONCLUSIVE') > 0 AS i, any_value(p_size) > 25 AS d
  FROM (SELECT p_partkey AS fact_id, p_size FROM part) LEFT JOIN e USING (fact_id) GROUP BY fact_id),
v AS (SELECT *, CASE WHEN f THEN 'FULL' WHEN s THEN 'PARTIAL' WHEN n = 0 AND d THEN 'SELF_DOCUMENTED' ELSE 'NONE' END AS coverage FROM g)
SELECT fact_id, coverage, concat_ws(',', CASE WHEN coverage = 'NONE' AND n = 0 THEN 'NO_EVIDENCE_IN_CONTEXT' WHEN coverage = 'NONE' THEN 'NO_SUPPORT_IN_CONTEXT' WHEN coverage = 'PARTIAL' THEN 'PARTIAL_SUPPORT' END, CASE WHEN i THEN 'INCONCLUSIVE_EVIDENCE' END, CASE WHEN s AND c THEN 'CONFLICTING_EVIDENCE' END) AS codes,
  CASE WHEN s AND c THEN 'AMBIGUOUS' WHEN coverage IN ('NONE', 'PARTIAL') OR i THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS sufficiency FROM v""",
    "contradiction_pairs": f"""WITH {_SQL_EVIDENCE}, g AS (SELECT fact_id, min(CASE WHEN relation = 'SUPPORTS' THEN evidence_id END) AS supports, min(CASE WHEN relation = 'CONTRADICTS' THEN evidence_id END) AS contradicts FROM e GROUP BY 1)
SELECT *, left(sha256('FACT_EVIDENCE|' || least(supports, contradicts) || '|' || greatest(supports, contradicts)), 24) AS pair_id FROM g WHERE supports IS NOT NULL AND contradicts IS NOT NULL""",
    "evidence_downgrade": f"""WITH {_SQL_EVIDENCE}, u AS (SELECT e.*, relation = 'SUPPORTS' AND coalesce(o_orderstatus, '?') <> 'F' AS u FROM e LEFT JOIN orders ON o_orderkey = evidence_id)
SELECT CASE WHEN u THEN 'INCONCLUSIVE' ELSE relation END AS relation, CASE WHEN u THEN 'IDENTITY_UNCLEAR' ELSE '' END AS limitation, count(*) AS n, count(DISTINCT fact_id) AS n_facts FROM u GROUP BY 1, 2""",
    "burden_allocation": """
SELECT p_partkey AS fact_id, CASE WHEN p_size <= 8 THEN 'CLAIMANT' WHEN p_size BETWEEN 11 AND 30 THEN 'RESPONDENT' WHEN p_size > 30 AND p_retailprice > 1500 THEN 'COURT' END AS bearer,
  CASE WHEN p_size IN (9, 10) THEN 'OVERLAP' WHEN p_size > 30 AND p_retailprice <= 1500 THEN 'CONDITION_NOT_SATISFIED' END AS code FROM part""",
    "contradiction_gate": """
WITH p AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, lead(o_orderkey) OVER w AS other, lead(o_orderstatus) OVER w AS ns, lead(o_orderpriority) OVER w AS np, CAST(lead(o_orderdate) OVER w AS DATE) AS nd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)),
c AS (SELECT *, CASE WHEN p <> np THEN 'DIFFERENT_SUBJECT' WHEN s = ns THEN 'NOT_EXCLUSIVE' WHEN nd - d > 180 THEN 'TIME_APART' END AS code FROM p WHERE other IS NOT NULL)
SELECT o_orderkey, other, CASE WHEN code IS NULL THEN CASE WHEN nd - d <= 30 THEN 'STRONG' ELSE 'POSSIBLE' END END AS strength, code FROM c""",
    "fact_sets": f"""WITH {_SQL_EVIDENCE} SELECT evidence_id, string_agg(DISTINCT fact_id, ',' ORDER BY fact_id) AS facts, count(DISTINCT fact_id) AS n_facts FROM e WHERE relation <> 'INCONCLUSIVE' GROUP BY 1 HAVING count(DISTINCT relation) = 2 AND count(DISTINCT fact_id) > 1""",
}
