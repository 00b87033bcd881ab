"""Listings and projections of cases, what synchronises them, and scores of what others say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.text import count_of
from caseloom.operators.retrieval import best_of
from caseloom.sources.tables import table


def set_scores(expected: Column, actual: Column) -> tuple[Column, Column]:
    """Precision and recall of one array against another; 1 where both are empty, 0 where only one side is."""
    both = F.size(F.array_intersect(expected, actual))
    share = lambda of, other: F.when(F.size(of) > 0, F.round(both / F.size(of), 6)).otherwise(F.when(F.size(other) == 0, 1.0).otherwise(0.0))
    return share(actual, expected), share(expected, actual)


def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty purchases and clicks with a whole value, by day, undated ones last."""
    e = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'click')")
    day = F.when(F.col("value") >= 20, F.to_date("ts"))
    rows = e.select("event_id", "event_type", day.alias("day"), F.when(day.isNull(), "UNKNOWN").otherwise("DATE").alias("precision"))
    top = rows.orderBy(F.asc_nulls_last("day"), "event_id").limit(50)
    return top.select("event_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "precision")


def duty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties by status and by a part of their name, whatever its case; signs that patterns know stand for themselves."""
    c = table(spark, sf_dir, "customer")
    return c.filter((F.upper("c_mktsegment") == "BUILDING") & F.lower("c_name").contains("#00000".lower())).select("c_custkey", "c_name", "c_mktsegment")


def substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source its first five documents that hold a piece of text, and whether there are more than that."""
    hit = table(spark, sf_dir, "documents").filter(F.instr(F.lower("text"), "the") > 0).select("source", "doc_id")
    few = best_of(hit, ["source"], [F.asc("doc_id")], 6)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))  # of six rows
    rows = few.withColumn("r", rank)
    return rows.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("doc_id")))), ",").alias("first"), (F.max("r") > 5).alias("truncated"))


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed of movements, pieces and notices: those of one word in title or state, newest first, undated last; fifty."""
    o = table(spark, sf_dir, "orders").select(F.lit("MOVEMENT").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("at"))
    l = table(spark, sf_dir, "lineitem").select(F.lit("PIECE").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("title"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("timestamp")).alias("at"))
    e = table(spark, sf_dir, "events").select(F.lit("NOTICE").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("at"))
    feed = o.unionByName(l).unionByName(e).filter(F.lower("title").contains("ur"))
    top = feed.orderBy(F.desc_nulls_last("at"), "kind", "id").limit(50)
    return top.select("kind", "id", "title", F.date_format("at", "yyyy-MM-dd").alias("day"))


def text_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns to look at first: the first and last two of each conversation, and those with a long number; each once."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    up, down = (F.row_number().over(Window.partitionBy("conv_id").orderBy(o)) for o in (F.asc("turn"), F.desc("turn")))
    rows = c.select("conv_id", "turn", (up <= 2).alias("head"), (down <= 2).alias("tail"), (count_of(F.col("text"), "[0-9]{4,}") > 0).alias("hit"))
    why = F.array_join(F.array_compact(F.array(F.when(F.col("head"), "HEAD"), F.when(F.col("tail"), "TAIL"), F.when(F.col("hit"), "HIT"))), ",")
    return rows.filter("head or tail or hit").select("conv_id", "turn", why.alias("why")).distinct()


def piece_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each movement's first piece and those after it, each once at its first place."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("place"))
    return l.select("l_orderkey", "l_suppkey", "place", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("place", "l_suppkey"))).alias("position"))


def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a case by date, each with its parts, numbered through."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    both = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey", F.asc_nulls_first("l_linenumber")))
    return both.select("o_custkey", "o_orderkey", F.col("l_linenumber").alias("part_no"), n.alias("ordinal"))


def participant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a participant is by the digits of its number: a person, a company, or unknown."""
    digits = F.regexp_replace("c_name", "[^0-9]", "")
    size = F.length(F.regexp_replace(digits, "^0+", ""))
    kind = F.when(size <= 2, "PERSON").when(size == 3, "COMPANY").when(size >= 4, "PUBLIC_BODY").otherwise("UNKNOWN")
    return table(spark, sf_dir, "customer").groupBy(kind.alias("kind"), "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def valid_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications that count: active, dated and with a text whose length is the one stated; the others by reason."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    code = F.when(F.col("text").isNull(), "NO_TEXT").when(F.trim("text") == "", "BLANK").when(F.length("text") != F.col("n_chars"), "LENGTH_DIFFERS").when(F.col("lang").isNull(), "NO_LANGUAGE").otherwise("VALID")
    return d.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An online inventory (all pieces) against what is stored (those of finished movements): what is to be fetched, kept or
    marked as gone, by case."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus").distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    online = l.filter("l_linestatus = 'O' or l_linenumber % 2 = 1").select("l_orderkey", "l_linenumber", F.lit(1).alias("a")).distinct()
    stored = l.filter("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", F.lit(1).alias("b")).distinct()
    both = online.join(stored, ["l_orderkey", "l_linenumber"], "full").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_custkey").agg(F.count_if(F.col("b").isNull()).alias("n_fetch"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_keep"), F.count_if(F.col("a").isNull()).alias("n_gone"))


def bundle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a bundle (pages by their content) matched to an inventory by number: found, repeated content, or missing."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/([0-9]+)(?:[?#]|$)", 1).alias("no"), F.sha2("html", 256).alias("sha"))
    first = p.groupBy("sha").agg(F.min("page_id").alias("first"))
    inv = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("no"), F.lit(True).alias("listed"))
    both = p.join(first, "sha").join(inv, "no", "left")
    state = F.when(F.col("page_id") != F.col("first"), "REPEATED").when(F.col("listed").isNotNull(), "MATCHED").otherwise("NOT_LISTED")
    return both.select("page_id", state.alias("state"))


def target_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own text of each conversation's answering side, turn by turn, and where its turns are."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant' and text is not null").select("conv_id", "turn", "text")
    own = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = c.groupBy("conv_id").agg(own.alias("x"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("x", lambda t: t["text"]), "\n"), 256).alias("text_hash"), F.array_join(F.transform("x", lambda t: t["turn"]), ",").alias("turns"))


def case_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a case shows of itself: only columns on the list, without those that are empty."""
    segment = F.when(F.col("c_mktsegment") != "MACHINERY", F.lower("c_mktsegment"))
    frame = F.to_json(F.struct(F.col("c_name").alias("name"), segment.alias("segment"), F.when(F.col("c_acctbal") > 0, "solvent").alias("state")))
    return table(spark, sf_dir, "customer").select("c_custkey", frame.alias("frame"))


def without_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events without the keys that are on the list of secrets, whatever their case."""
    props = F.from_json("props", "map<string,string>")
    wide = F.map_concat(props, F.create_map(F.lit("Token"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    safe = F.map_filter(wide, lambda k, v: ~F.lower(k).isin("token", "password", "secret"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(safe)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"))


def element_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page is made of: its elements by kind, links among them, and whether it has a script."""
    html = F.coalesce("html", F.lit(""))
    n = lambda p: count_of(html, p)
    return table(spark, sf_dir, "pages").select("page_id", n("(?i)<p[ >]").alias("n_paragraphs"), n("(?i)<a [^>]*href").alias("n_links"), n("(?i)<h[1-6][ >]").alias("n_headings"), n("(?i)<(?:img|svg|video)[ >]").alias("n_visual"), (n("(?i)<script[ >]") > 0).alias("has_script"))


def specialist_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a guess from length and language does against the labels: fields right of two, and dangerous ones (bad called good)."""
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    good, toxic = (F.col("n_chars") >= 400).cast("int"), (F.col("n_chars") % 7 == 0).cast("int")
    right = (good == F.col("quality")).cast("int") + (toxic == F.col("toxic")).cast("int")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(right / 2), 6).alias("field_accuracy"), F.count_if((good == 1) & (F.col("quality") == 0)).alias("n_dangerous"))


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of each movement's suppliers when they are guessed from its first two pieces."""
    l = table(spark, sf_dir, "lineitem")
    g = l.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("want"), F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey") - F.col("l_suppkey") % 2)).alias("got"))
    precision, recall = set_scores(F.col("want"), F.col("got"))
    return g.select("l_orderkey", precision.alias("precision"), recall.alias("recall"))


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different contents and bytes of each source, and how much of it is there more than once."""
    d = table(spark, sf_dir, "documents").filter("text is not null").groupBy("source", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("b"))
    return d.groupBy("source").agg(F.count("*").alias("n_hashes"), F.sum("n").alias("n_docs"), F.sum("b").alias("bytes"), F.sum((F.col("n") - 1) * F.col("b")).alias("bytes_repeated"))


def package_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tables of a package belong together: vectors for documents, labels with documents, pieces with movements."""
    d, e, l, o, i = (table(spark, sf_dir, t) for t in ("documents", "embeddings", "labels", "orders", "lineitem"))
    missing = lambda name, a, b, on: a.join(b, on, "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("n_missing"))
    rows = missing("DOCUMENT_WITHOUT_VECTOR", d.select("doc_id"), e.select(F.col("vec_id").alias("doc_id")), "doc_id")
    rows = rows.unionByName(missing("LABEL_WITHOUT_DOCUMENT", l.select("doc_id"), d.select("doc_id"), "doc_id"))
    rows = rows.unionByName(missing("PIECE_WITHOUT_MOVEMENT", i.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), "k"))
    return rows.withColumn("complete", F.col("n_missing") == 0)


def rule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any text of a conversation says: flags over all its turns."""
    low = F.lower("text")
    flag = lambda p: F.coalesce(F.bool_or(low.rlike(p)), F.lit(False))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(flag("[0-9]{3,}").alias("has_number"), flag(r"\?").alias("has_question"), flag("https?://").alias("has_link"), flag("@").alias("has_address"))


def pull_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental run: from a day before the mark of each user on, what is stored already is passed over, and the mark
    moves to the newest that was pulled; without news it stays."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    stored = e.filter("day <= '2024-01-20' and event_id % 10 <> 0")
    marks = stored.groupBy("user_id").agg(F.max("day").alias("mark"))
    pulled = e.join(marks, "user_id", "left").filter("mark is null or day >= date_sub(mark, 1)").join(stored.select("event_id"), "event_id", "left_anti")
    news = pulled.groupBy("user_id").agg(F.count("*").alias("n_new"), F.max("day").alias("newest"))
    both = marks.join(news, "user_id", "full")
    return both.select("user_id", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.date_format(F.greatest("mark", "newest"), "yyyy-MM-dd").alias("mark"), (F.coalesce("n_new", F.lit(0)) > 0).alias("trigger"))


def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose text has changed since, or is gone or empty, and texts that have none: what a run must make or drop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("now"), (F.trim(F.coalesce("text", F.lit(""))) != "").alias("eligible"), F.col("doc_id") % 9 == 0)
    docs = docs.toDF("doc_id", "now", "eligible", "changed")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("stored"))
    both = docs.join(vecs, "doc_id", "full")
    state = F.when(F.col("eligible").isNull(), "DROP_GONE").when(F.col("stored") & ~F.col("eligible"), "DROP_EMPTY").when(F.col("stored") & F.col("changed"), "REFRESH").when(F.col("stored"), "CURRENT").when(F.col("eligible"), "CREATE").otherwise("NONE")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def job_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for a job reuses the one that is under way for its user, else makes one: of each hour the first makes it."""
    e = table(spark, sf_dir, "events").filter("event_type = 'view'").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"), "ts")
    first = e.groupBy("user_id", "hour").agg(F.min(F.struct("ts", "event_id")).alias("f"), F.count("*").alias("n"))
    return first.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.col("f.event_id").alias("job"), (F.col("n") - 1).alias("n_reused"))


def space_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by whether they are of the space of the query: model, version, backend, quantisation and size must agree."""
    name = lambda c: F.lower(F.trim(c))
    e = table(spark, sf_dir, "embeddings")
    own = e.select("vec_id", name(F.when(F.col("label") % 2 == 0, " EG2").otherwise("eg2")).alias("model"), F.when(F.col("label") == 3, "2").otherwise("1").alias("version"), F.when(F.col("vec_id") % 5 == 0, "q8").otherwise("f32").alias("quantisation"), F.size("embedding").alias("dim"))
    query = F.broadcast(own.filter("vec_id % 100 = 1").select("model", "version", "quantisation", "dim").distinct().withColumn("same", F.lit(True)))  # a handful of spaces
    both = own.join(query, ["model", "version", "quantisation", "dim"], "left")
    return both.groupBy("version", "quantisation").agg(F.count("*").alias("n"), F.count("same").alias("n_comparable"))


QUERIES = {
    f.__name__: f
    for f in (
        event_listing, duty_filter, substring_index, feed_rows, text_probe, piece_pages, inventory_rows, participant_types, valid_publications, sync_plan, bundle_match, target_text, case_frame,
        without_secrets, element_summary, specialist_scores, retrieval_scores, source_audit, package_checks, rule_features, pull_window, stale_vectors, job_reuse, space_matches,
    )
}

ORACLE = {
    "event_listing": """
SELECT event_id, event_type, strftime(day, '%Y-%m-%d') AS day, CASE WHEN day IS NULL THEN 'UNKNOWN' ELSE 'DATE' END AS precision FROM (SELECT *, CASE WHEN value >= 20 THEN CAST(ts AS DATE) END AS day FROM events WHERE event_type IN ('purchase', 'click')) ORDER BY day NULLS LAST, event_id LIMIT 50""",
    "duty_filter": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE upper(c_mktsegment) = 'BUILDING' AND contains(lower(c_name), '#00000')",
    "substring_index": """
WITH h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE contains(lower(text), 'the')) SELECT source, string_agg(CASE WHEN r <= 5 THEN doc_id END, ',' ORDER BY doc_id) AS first, max(r) > 5 AS truncated FROM h GROUP BY 1""",
    "feed_rows": """
WITH f AS (SELECT 'MOVEMENT' AS kind, o_orderkey AS id, o_orderpriority AS title, o_orderdate AS t FROM orders UNION ALL SELECT 'PIECE', l_orderkey * 10 + l_linenumber, l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_shipdate END FROM lineitem UNION ALL SELECT 'NOTICE', event_id, event_type, ts FROM events)
SELECT kind, id, title, strftime(t, '%Y-%m-%d') AS day FROM f WHERE contains(lower(title), 'ur') ORDER BY t DESC NULLS LAST, kind, id LIMIT 50""",
    "text_probe": """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 AS b, coalesce(regexp_matches(text, '[0-9]{4,}'), false) AS c FROM conversations)
SELECT DISTINCT conv_id, turn, concat_ws(',', CASE WHEN a THEN 'HEAD' END, CASE WHEN b THEN 'TAIL' END, CASE WHEN c THEN 'HIT' END) AS why FROM r WHERE a OR b OR c""",
    "piece_pages": "WITH p AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS place FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, l_suppkey) AS position FROM p",
    "inventory_rows": """
SELECT o_custkey, o_orderkey, l_linenumber AS part_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber NULLS FIRST) AS ordinal FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON o_orderkey = l_orderkey""",
    "participant_types": """
WITH k AS (SELECT c_custkey, c_mktsegment, length(ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0')) AS n FROM customer)
SELECT CASE WHEN n <= 2 THEN 'PERSON' WHEN n = 3 THEN 'COMPANY' ELSE 'PUBLIC_BODY' END AS kind, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM k GROUP BY ALL""",
    "valid_publications": """
SELECT CASE WHEN text IS NULL THEN 'NO_TEXT' WHEN trim(text, ' ') = '' THEN 'BLANK' WHEN length(text) <> n_chars THEN 'LENGTH_DIFFERS' WHEN lang IS NULL THEN 'NO_LANGUAGE' ELSE 'VALID' END AS code, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1""",
    "sync_plan": """
WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, 1 AS a FROM lineitem WHERE l_linestatus = 'O' OR l_linenumber % 2 = 1), b AS (SELECT DISTINCT l_orderkey, l_linenumber, 1 AS b FROM lineitem WHERE l_linestatus = 'F')
SELECT o_custkey, count(*) FILTER (b IS NULL) AS n_fetch, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_keep, count(*) FILTER (a IS NULL) AS n_gone FROM a FULL JOIN b USING (l_orderkey, l_linenumber) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
    "bundle_match": r"""
SELECT page_id, CASE WHEN page_id <> min(page_id) OVER (PARTITION BY html) THEN 'REPEATED' WHEN regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) THEN 'MATCHED' ELSE 'NOT_LISTED' END AS state FROM pages""",
    "target_text": """
SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS text_hash, string_agg(turn, ',' ORDER BY turn) AS turns FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1""",
    "case_frame": """
SELECT c_custkey, '{"name":"' || c_name || '"' || CASE WHEN c_mktsegment <> 'MACHINERY' THEN ',"segment":"' || lower(c_mktsegment) || '"' ELSE '' END || CASE WHEN c_acctbal > 0 THEN ',"state":"solvent"' ELSE '' END || '}' AS frame FROM customer""",
    "without_secrets": "SELECT event_id, 'k=' || (props->>'$.k') || ';user=' || user_id AS props FROM events",
    "element_summary": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, len(regexp_extract_all(h, '(?i)<p[ >]')) AS n_paragraphs, len(regexp_extract_all(h, '(?i)<a [^>]*href')) AS n_links, len(regexp_extract_all(h, '(?i)<h[1-6][ >]')) AS n_headings, len(regexp_extract_all(h, '(?i)<(?:img|svg|video)[ >]')) AS n_visual, regexp_matches(h, '(?i)<script[ >]') AS has_script FROM p""",
    "specialist_scores": """
SELECT lang, count(*) AS n, round(avg(((n_chars >= 400)::INT = quality)::INT / 2.0::DOUBLE + ((n_chars % 7 = 0)::INT = toxic)::INT / 2.0::DOUBLE), 6) AS field_accuracy, count(*) FILTER (n_chars >= 400 AND quality = 0) AS n_dangerous FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "retrieval_scores": """
WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS w, coalesce(list(DISTINCT l_suppkey - l_suppkey % 2) FILTER (l_linenumber <= 2), []) AS g FROM lineitem GROUP BY 1), b AS (SELECT *, len(list_intersect(w, g)) AS b FROM g)
SELECT l_orderkey, CASE WHEN len(g) > 0 THEN round(b::DOUBLE / len(g), 6) ELSE 0.0::DOUBLE END AS precision, round(b::DOUBLE / len(w), 6) AS recall FROM b""",
    "source_audit": """
WITH d AS (SELECT source, text, count(*) AS n, octet_length(encode(text)) AS b FROM documents WHERE text IS NOT NULL GROUP BY source, text) SELECT source, count(*) AS n_hashes, CAST(sum(n) AS BIGINT) AS n_docs, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum((n - 1) * b) AS BIGINT) AS bytes_repeated FROM d GROUP BY 1""",
    "package_checks": """
WITH c AS (SELECT 'DOCUMENT_WITHOUT_VECTOR' AS "check", count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'LABEL_WITHOUT_DOCUMENT', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'PIECE_WITHOUT_MOVEMENT', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) SELECT *, n_missing = 0 AS complete FROM c""",
    "rule_features": r"""
SELECT conv_id, coalesce(bool_or(regexp_matches(lower(text), '[0-9]{3,}')), false) AS has_number, coalesce(bool_or(contains(text, '?')), false) AS has_question, coalesce(bool_or(regexp_matches(lower(text), 'https?://')), false) AS has_link, coalesce(bool_or(contains(text, '@')), false) AS has_address FROM conversations GROUP BY 1""",
    "pull_window": """
WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events), s AS (SELECT * FROM e WHERE day <= DATE '2024-01-20' AND event_id % 10 <> 0), m AS (SELECT user_id, max(day) AS mark FROM s GROUP BY 1),
n AS (SELECT user_id, count(*) AS c, max(day) AS newest FROM e LEFT JOIN m USING (user_id) WHERE (mark IS NULL OR day >= mark - 1) AND event_id NOT IN (SELECT event_id FROM s) GROUP BY 1)
SELECT user_id, coalesce(c, 0) AS n_new, strftime(greatest(mark, newest), '%Y-%m-%d') AS mark, coalesce(c, 0) > 0 AS trigger FROM m FULL JOIN n USING (user_id)""",
    "stale_vectors": """
WITH b AS (SELECT coalesce(doc_id, vec_id) AS doc_id, vec_id IS NOT NULL AS s, d.doc_id IS NULL AS gone, trim(coalesce(text, ''), ' ') <> '' AS e FROM documents d FULL JOIN embeddings ON doc_id = vec_id)
SELECT CASE WHEN gone THEN 'DROP_GONE' WHEN s AND NOT e THEN 'DROP_EMPTY' WHEN s AND doc_id % 9 = 0 THEN 'REFRESH' WHEN s THEN 'CURRENT' WHEN e THEN 'CREATE' ELSE 'NONE' END AS state, count(*) AS n, min(doc_id) AS first FROM b GROUP BY 1""",
    "job_reuse": """
SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, arg_min(event_id, (ts, event_id)) AS job, count(*) - 1 AS n_reused FROM events WHERE event_type = 'view' GROUP BY 1, 2""",
    "space_matches": """
WITH v AS (SELECT vec_id, CASE WHEN label = 3 THEN '2' ELSE '1' END AS version, CASE WHEN vec_id % 5 = 0 THEN 'q8' ELSE 'f32' END AS quantisation, len(embedding) AS dim FROM embeddings), q AS (SELECT DISTINCT version, quantisation, dim FROM v WHERE vec_id % 100 = 1)
SELECT version, quantisation, count(*) AS n, count(*) FILTER ((version, quantisation, dim) IN (SELECT (version, quantisation, dim) FROM q)) AS n_comparable FROM v GROUP BY 1, 2""",
}
