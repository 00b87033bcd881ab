"""Nested values of open shape: VARIANT walked to any depth, and the objects that earlier analyses made known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.tables import dealt, kept, parts, table

#: Collections of an analysis whose items have a key and a text.
COLLECTIONS = ("facts", "claims", "requests", "evidence", "decisions")


#: Levels that ``leaves`` opens in one step.
LEVELS = 16
#: For how many rows a value with its leaves counts in the size of a part.
VALUE_ROWS = 8


def _opened(rows: DataFrame, value: str, outer: bool = False) -> DataFrame:
    """Each member of the objects and arrays in ``value``: the other columns, ``pos``, ``key`` (null in arrays), ``value``.
    With ``outer``, a value without members gives one row of nulls."""
    rows.createOrReplaceTempView("_opened")
    rest = ", ".join(f"t.`{c}`" for c in rows.columns if outer or c != value)
    out = rows.sparkSession.sql(f"SELECT {rest}, e.pos, e.key, e.value FROM _opened t, LATERAL variant_explode{'_outer' if outer else ''}(t.`{value}`) e")
    rows.sparkSession.catalog.dropTempView("_opened")
    return out


def brackets(text: Column) -> Column:
    """The brackets of a JSON text in their order; those in strings are none."""
    plain = F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), r"[^\[\]{}]+", "")


def depth(shape: Column) -> Column:
    """How deep ``brackets`` are nested."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["most"])


def leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, kind, leaf``: every value in the JSON of ``text`` that holds no others, with the way to it.

    A way is ``$.a[0].b``; empty objects and arrays are leaves of their own. Text that is null or no JSON has none. The
    values are read once and written with their brackets, which tell how many levels there are; then the levels are opened
    one after the other in each row, and what is open no more stays as it is. Values are dealt by ``key``, and so are their
    leaves; nothing else is shuffled, and nothing written but between each ``LEVELS`` levels.
    """
    held = kept(rows.select(F.col(key).alias("_id"), F.try_parse_json(F.col(text)).alias("v"), brackets(F.col(text)).alias("shape")).filter("v is not null"), "variant")
    most = held.select("shape").distinct().agg(F.max(depth(F.col("shape")))).first()[0] or 0
    open_ = dealt(held.select("_id", F.lit("$").alias("path"), "v"), "_id", VALUE_ROWS * held.count())
    for level in range(most):
        if level and level % LEVELS == 0:
            open_ = kept(open_, "variant")
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        member = F.col("pos").isNotNull()
        open_ = _opened(open_, "v", outer=True).select("_id", F.when(member, F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.when(member, F.col("value")).otherwise(F.col("v")).alias("v"))
    return open_.select(F.col("_id").alias(key), "path", F.schema_of_variant("v").alias("kind"), F.to_json("v").alias("leaf"))


def known_objects(analyses: DataFrame) -> DataFrame:
    """``id, collection, text, movement_id``: what the analyses of ``analyses (process_id, movement_id, source_hash, analysis)``
    made known, each once.

    Items of ``COLLECTIONS`` have a key and a text; relations have a key and the text is their subject, predicate and object
    as JSON. An id is a hash of where the object comes from, so it changes with its source. Other members, items without a
    key, and analyses that are null or no JSON give nothing.
    """
    top = _opened(analyses.select("process_id", "movement_id", "source_hash", F.try_parse_json("analysis").alias("v")), "v").filter("key is not null")
    top = top.select("process_id", "movement_id", "source_hash", F.col("key").alias("collection"), F.col("value").alias("v"))
    # members of arrays have no key, those of objects have one
    items = _opened(top.filter(F.col("collection").isin(*COLLECTIONS, "relations")), "v").filter("key is null").select("process_id", "movement_id", "source_hash", "collection", "value")
    of = lambda name: F.try_variant_get("value", f"$.{name}", "string")
    relation = F.to_json(F.struct(of("object").alias("object"), of("predicate").alias("predicate"), of("subject").alias("subject")))
    told = items.select("process_id", "movement_id", "source_hash", "collection", of("key").alias("k"), F.when(F.col("collection") == "relations", relation).otherwise(of("text")).alias("text")).filter("k is not null")
    ident = F.sha2(F.concat_ws("\x1f", F.col("process_id").cast("string"), F.col("movement_id").cast("string"), F.col("source_hash"), "collection", "k"), 256)
    return told.select(ident.alias("id"), "collection", "text", "movement_id").distinct()


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as movements whose analysis is a JSON of their lines: facts, requests (what came back) and relations."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    n = parts(lines)
    # lines and orders are dealt once, by order, and what follows stays with its order
    each = lines.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"))
    key = F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("key")
    own = each.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(key, "n", "flag", "part", "supplier"))).alias("x"))
    facts = F.transform("x", lambda x: F.struct(x["key"].alias("key"), F.concat_ws(" ", F.lit("part"), x["part"].cast("string"), F.lit("times"), x["n"].cast("string")).alias("text")))
    requests = F.transform(F.filter("x", lambda x: x["flag"] == "R"), lambda x: F.struct(x["key"].alias("key"), F.concat(F.lit("return of "), x["part"].cast("string")).alias("text")))
    relations = F.transform("x", lambda x: F.struct(x["key"].alias("key"), F.concat(F.lit("s"), x["supplier"].cast("string")).alias("subject"), F.lit("ships").alias("predicate"), F.concat(F.lit("p"), x["part"].cast("string")).alias("object")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(n, "o_orderkey").distinct()
    analysis = F.to_json(F.struct(facts.alias("facts"), requests.alias("requests"), relations.alias("relations")))
    return own.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("process_id"), F.col("l_orderkey").alias("movement_id"), F.sha2("o_orderstatus", 256).alias("source_hash"), analysis.alias("analysis"))


def prior_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that the analyses of all orders made known."""
    return known_objects(_analyses(spark, sf_dir))


def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the analyses of all orders, counted by its way without places and its kind."""
    found = leaves(_analyses(spark, sf_dir), "movement_id", "analysis")
    return found.groupBy("movement_id", F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"), "kind").agg(F.count("*").alias("n"), F.min("leaf").alias("least"))


QUERIES = {f.__name__: f for f in (prior_known, nested_leaves)}
_LINES = "l AS (SELECT l_orderkey AS o, l_linenumber AS i, count(*) AS n, min(l_returnflag) AS flag, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL)"
ORACLE = {
    "prior_known": f"""
WITH {_LINES}, d AS (SELECT DISTINCT o_orderkey, o_custkey, sha256(o_orderstatus) AS h FROM orders),
k AS (SELECT o, i, 'facts' AS collection, 'part ' || p || ' times ' || n AS text FROM l UNION ALL SELECT o, i, 'requests', 'return of ' || p FROM l WHERE flag = 'R'
  UNION ALL SELECT o, i, 'relations', '{{"object":"p' || p || '","predicate":"ships","subject":"s' || s || '"}}' FROM l)
SELECT sha256(concat_ws(chr(31), o_custkey, o, h, collection, 'L' || i)) AS id, collection, text, o AS movement_id FROM k JOIN d ON o = o_orderkey""",
    "nested_leaves": f"""
WITH {_LINES}, v AS (
  SELECT o, '$.facts[].key' AS path, 'L' || i AS x FROM l UNION ALL SELECT o, '$.facts[].text', 'part ' || p || ' times ' || n FROM l
  UNION ALL SELECT o, '$.requests[].key', 'L' || i FROM l WHERE flag = 'R' UNION ALL SELECT o, '$.requests[].text', 'return of ' || p FROM l WHERE flag = 'R'
  UNION ALL SELECT o, '$.relations[].key', 'L' || i FROM l UNION ALL SELECT o, '$.relations[].subject', 's' || s FROM l UNION ALL SELECT o, '$.relations[].predicate', 'ships' FROM l UNION ALL SELECT o, '$.relations[].object', 'p' || p FROM l)
SELECT o AS movement_id, path, 'STRING' AS kind, count(*) AS n, min('"' || x || '"') AS least FROM v GROUP BY ALL
UNION ALL SELECT o, '$.requests', 'ARRAY<VOID>', 1, '[]' FROM l GROUP BY o HAVING count(*) FILTER (flag = 'R') = 0""",
}
