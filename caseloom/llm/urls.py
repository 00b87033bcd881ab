"""URL filters: explicit host and path rules, and a path-template tree learned from labelled pages.

Each host has a tree of path segments. Segments that vary from page to page (numbers inside them, or a level
of the host's paths with many different values that hardly repeat) become wildcards, so that a path turns
into a template. Every node of the tree counts the labelled pages below it. A branch whose share of bad
pages cannot be told from that of its siblings (two-proportion test) is merged with them, that is, judged by
its parent; a page is judged by the deepest node on its way that stands out. A node is rejected if its
purity, smoothed towards the host's and that towards the whole table's, is under a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import dropped, hot_keys, joined_hot, table, written

#: (host, path, verdict): a rule holds for the host and its subdomains and for paths that start with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A level of a host's paths is variable if it has so many values at least and fewer pages a value than that.
MANY_VALUES, PAGES_PER_VALUE = 20, 5
#: Siblings differ if the test statistic is over this.
Z = 1.96
#: Weight of the parent in pages, and the purity under which a template is rejected.
SMOOTHING, MIN_PURITY = 10.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """Path segments with every run of digits as a wildcard."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.regexp_replace(s, "[0-9]+", "*"))


def _number():
    """64 bits of hash of a template as it stands in the pages: all that later stages carry of it."""
    return F.xxhash64("host", "segments")


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``t, host, segments, n, n_good, n_bad``: pages and labelled pages of each template before variable levels are known.

    The label is that of the document whose number ends the path; a document is bad if any of its labels
    says so.
    """
    number = F.regexp_extract("path", r"/([0-9]{1,18})[^0-9/]*/?$", 1)
    ids = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    # pages of one template and number are one row before they meet the labels
    own = pages.select("host", _segments(F.col("path")).alias("segments"), F.when(number != "", number.cast("bigint")).alias("number")).groupBy("host", "segments", "number").agg(F.count("*").alias("n"))
    known = own.join(ids, F.col("number") == F.col("doc_id"), "left")
    of = lambda bad: F.sum(F.when(F.col("bad") == bad, F.col("n")).otherwise(0))
    counted = known.groupBy("host", "segments").agg(F.sum("n").alias("n"), of(0).alias("n_good"), of(1).alias("n_bad"))
    return counted.select(_number().alias("t"), "*")


def _variable_levels(seen: DataFrame) -> DataFrame:
    """``host, level``: the levels at which a host's paths vary."""
    values = seen.select("host", "n", F.posexplode("segments").alias("level", "segment")).groupBy("host", "level", "segment").agg(F.sum("n").alias("n"))
    levels = values.groupBy("host", "level").agg(F.count("*").alias("values"), F.sum("n").alias("n"))
    return levels.filter((F.col("values") >= MANY_VALUES) & (F.col("n") < PAGES_PER_VALUE * F.col("values"))).select("host", "level")


def ways(seen: DataFrame) -> DataFrame:
    """``t, host, depth, segment, node, parent, n_good, n_bad``: the nodes on every template's way, root (node 0) first.

    A row is a number, a place and one segment, so a way costs what its length is. A node is the exclusive or of the
    hashes of the places and segments up to it; a running one, as is its parent, which lacks the last of them.
    """
    counts = ["t", "host", "n_good", "n_bad"]
    steps = seen.select(*counts, F.posexplode("segments").alias("level", "segment"))
    varied = _variable_levels(seen).withColumn("varied", F.lit(True))
    steps = steps.join(varied, ["host", "level"], "left").withColumn("segment", F.when(F.col("varied"), "*").otherwise(F.col("segment")))
    steps = steps.withColumn("h", F.xxhash64("level", "segment"))
    running = F.bit_xor("h").over(Window.partitionBy("t", "host").orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.select(*counts, (F.col("level") + 1).alias("depth"), "segment", running.alias("node"), "h")
    steps = steps.withColumn("parent", F.col("node").bitwiseXOR(F.col("h"))).drop("h")
    roots = seen.select(*counts, F.lit(0).alias("depth"), F.lit("").alias("segment"), F.lit(0).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"))
    return roots.unionByName(steps)


def template_tree(way: DataFrame) -> DataFrame:
    """``host, node, purity`` of the nodes that stand out among their siblings, and of every host's root."""
    nodes = way.groupBy("host", "depth", "node", "parent").agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad"))
    depth = F.col("depth")
    level = nodes.filter(depth > 0).groupBy("host", "parent").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    roots = nodes.filter(depth == 0).select("host", F.col("good").alias("host_good"), F.col("bad").alias("host_bad"))
    whole = roots.agg(F.sum("host_good").alias("table_good"), F.sum("host_bad").alias("table_bad"))
    host_purity = (F.col("host_good") + SMOOTHING * F.col("table_purity")) / (F.col("host_good") + F.col("host_bad") + SMOOTHING)
    table_purity = F.coalesce(F.col("table_good") / F.when(F.col("table_good") + F.col("table_bad") > 0, F.col("table_good") + F.col("table_bad")), F.lit(1.0))
    roots = roots.join(F.broadcast(whole.select(table_purity.alias("table_purity")))).select("host", host_purity.alias("host_purity"))  # one row
    n, rest_good, rest_bad = F.col("good") + F.col("bad"), F.col("all_good") - F.col("good"), F.col("all_bad") - F.col("bad")
    rest = rest_good + rest_bad
    share = (F.col("bad") + rest_bad) / (n + rest)
    gap = F.col("bad") / n - rest_bad / rest
    stands_out = (n > 0) & (rest > 0) & (gap * gap > Z * Z * share * (1 - share) * (1 / n + 1 / rest))
    judged = nodes.join(level, ["host", "parent"], "left").join(roots, "host")
    purity = F.when(depth == 0, F.col("host_purity")).otherwise((F.col("good") + SMOOTHING * F.col("host_purity")) / (n + SMOOTHING))
    return judged.filter((depth == 0) | F.coalesce(stands_out, F.lit(False))).select("host", "node", purity.alias("purity"))


def filtered(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages``.

    A rule's verdict comes first; else a page is blocked if the node that judges it is not pure enough. A
    url that is null or has no ``://`` is judged as a page of the host without a name; one of any length costs what
    its length is. Repeated rows give repeated rows; other columns are ignored; without labels every template is pure.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = written(templates(own, labels), "templates")  # a template once, however many pages
    way = written(ways(seen), "ways")
    deepest = way.join(template_tree(way), ["host", "node"]).groupBy("t").agg(F.max(F.struct("depth", "purity")).alias("j"))
    parts = F.sort_array(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "segment"))))
    named = way.groupBy("t").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "/").alias("template"))
    best = written(deepest.join(named, "t"), "judgements")  # every template has one, that of its host's root at least
    hot = written(hot_keys(seen, "t", "n"), "hot")
    dropped(seen, way)
    keyed = own.withColumn("t", F.xxhash64("host", _segments(F.col("path"))))
    judged = joined_hot(keyed, best, "t", hot)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pure = F.when(F.coalesce(F.col("j.purity"), F.lit(1.0)) < MIN_PURITY, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, pure).alias("verdict"), "template", F.col("j.purity").alias("purity"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's address: a row for each row of ``pages``.

    A url that is null, empty or has no ``://`` has an empty host and path and is judged as one of the nameless
    host; urls of any length are read whole; of rules that fit the longest wins; repeated rows give equal rows;
    an empty table gives none; an empty table of labels makes every template pure; no other column is read,
    whatever its name.
    """
    return filtered(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE = {
    "op6_url_filter": r"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
o AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
s AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '*', 'g')) AS segs,
         TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})[^0-9/]*/?$', 1), '') AS BIGINT) AS num
  FROM o),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT s.*, l.bad AS lab FROM s LEFT JOIN l ON s.num = l.doc_id),
x AS (SELECT host, i AS lvl, segs[i] AS seg, count(*) AS n FROM (SELECT host, segs, unnest(range(1, len(segs) + 1)) AS i FROM k) GROUP BY ALL),
v AS (SELECT host, lvl FROM (SELECT host, lvl, count(*) AS vals, sum(n) AS n FROM x GROUP BY ALL) WHERE vals >= 20 AND n < 5 * vals),
lv AS (SELECT host, list(lvl) AS lvls FROM v GROUP BY host),
g AS (
  SELECT k.*, list_transform(segs, lambda q, i: CASE WHEN list_contains(coalesce(lvls, []), i) THEN '*' ELSE q END) AS t
  FROM k LEFT JOIN lv USING (host)),
w AS (SELECT r, host, lab, d, t[1:d] AS node FROM (SELECT r, host, lab, t, unnest(range(0, len(t) + 1)) AS d FROM g)),
n AS (SELECT host, d, node, count(*) FILTER (lab = 0) AS good, count(*) FILTER (lab = 1) AS bad FROM w GROUP BY ALL),
c AS (SELECT host, d - 1 AS d, node[1:d - 1] AS parent, sum(good) AS ag, sum(bad) AS ab FROM n WHERE d > 0 GROUP BY ALL),
tp AS (SELECT coalesce(sum(good) / nullif(sum(good) + sum(bad), 0), 1.0) AS p FROM n WHERE d = 0),
hp AS (SELECT host, (good + 10.0 * p) / (good + bad + 10.0) AS hp FROM n, tp WHERE d = 0),
j AS (
  SELECT n.host, n.d, n.node, good, bad, hp, good + bad AS m, ag - good AS rg, ab - bad AS rb
  FROM n JOIN hp USING (host) LEFT JOIN c ON c.host = n.host AND c.d = n.d - 1 AND c.parent = n.node[1:n.d - 1]),
e AS (
  SELECT host, d, node, CASE WHEN d = 0 THEN hp ELSE (good + 10.0 * hp) / (m + 10.0) END AS purity
  FROM j
  WHERE d = 0 OR (m > 0 AND rg + rb > 0 AND
    power(bad::DOUBLE / m - rb::DOUBLE / nullif(rg + rb, 0), 2) > 1.96 * 1.96 * ((bad + rb)::DOUBLE / (m + rg + rb)) * (1 - (bad + rb)::DOUBLE / (m + rg + rb)) * (1.0 / nullif(m, 0) + 1.0 / nullif(rg + rb, 0)))),
b AS (SELECT r, arg_max(purity, w.d) AS purity FROM w JOIN e ON w.host = e.host AND w.d = e.d AND w.node = e.node GROUP BY r),
f AS (
  SELECT o.*, purity, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM o LEFT JOIN b USING (r))
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
            ELSE CASE WHEN coalesce(purity, 1.0) < 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM f""",
}
