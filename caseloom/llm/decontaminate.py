"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

1. The index has a posting for every word of every training text: term, document, position. It is written
   once to the shared folder, where each part is a segment of the index with the postings of its own documents in
   their order; a term's list is what the parts hold under its hash. It does not depend on the benchmark; any number
   of benchmarks can be held against it without going back to the texts.
2. The benchmark's phrases (windows of consecutive words) name the terms to look up. Their counts come from the
   index; a phrase with a term that the corpus lacks cannot occur. A phrase's terms are ranked by their counts.
3. Lists are intersected from the rarest term on. The postings of a phrase's rarest term are its candidates; those
   near which no posting of the second rarest stands are gone; of the rest, all other lists are looked up in
   the candidates' documents. A term at the distance that its offset in the phrase asks for counts for the exact
   phrase, one within ``distance`` words for proximity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table, text_key, written

WINDOW = 13
#: A side of a join is broadcast only if its text is known to have at most so many bytes.
BROADCAST_BYTES = 16_000_000

_ASCII = "".join(map(chr, range(128)))
_FOLDED = "".join(c.lower() if c.isalnum() else " " for c in _ASCII)
_ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters; null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _ASCII, _FOLDED), " "), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, phrase, terms``: every window of ``window`` words, or all words where there are fewer."""
    own = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = own.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, F.least(F.size("w"), F.lit(window))).alias("terms"))
    return cut.select("item_id", F.array_join("terms", " ").alias("phrase"), "terms").distinct()


def term_key(term: Column) -> Column:
    """The 64-bit hash by which the index knows a term."""
    return F.xxhash64(term)


def positional_index(docs: DataFrame) -> DataFrame:
    """``term, doc_id, text_key, pos``: a posting for every word of every text; ``pos`` counts words from 0."""
    own = docs.select("doc_id", text_key().alias("text_key"), words(F.col("text")).alias("w"))  # hashed before the words are exploded
    own = own.select("doc_id", "text_key", F.posexplode("w").alias("pos", "word"))
    return own.select(term_key(F.col("word")).alias("term"), "doc_id", "text_key", "pos")


def ranked_terms(phrase_terms: DataFrame, index: DataFrame, n_bytes: int) -> DataFrame:
    """``no, phrase, length, n_terms, ranked`` of the phrases whose terms all have postings: their different terms
    from the rarest to the most frequent in the whole index, as structs of count, word, term and offsets in the phrase;
    of words with one count the first in the alphabet comes first."""
    spread = phrase_terms.select("phrase", F.posexplode("terms").alias("offset", "word")).groupBy("phrase", "word").agg(F.array_sort(F.collect_set("offset")).alias("offsets")).withColumn("term", term_key(F.col("word")))
    wanted = spread.select("term").distinct()
    counts = index.join(_small(wanted, n_bytes), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    own = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "term", "offsets")))
    ranked = spread.join(counts, "term", "left").groupBy("phrase").agg(own.alias("ranked")).filter(F.col("ranked")[0]["n"] > 0)
    length = F.aggregate("ranked", F.lit(0), lambda n, r: n + F.size(r["offsets"]))
    return ranked.select(F.monotonically_increasing_id().alias("no"), "phrase", length.alias("length"), F.size("ranked").alias("n_terms"), "ranked")


def _near(candidates: DataFrame, lists: DataFrame, distance: int) -> DataFrame:
    """Candidates (id, doc_id, text_key, at, term, offsets and more) with each posting in ``lists`` of their term in
    their document at most ``distance`` words from ``at``.

    An equality join: a posting lies in one stretch of ``distance`` words, a candidate asks in three.
    """
    width = max(distance, 1)
    stretch = F.explode(F.sequence(F.floor((F.col("at") - distance) / width), F.floor((F.col("at") + distance) / width))).alias("stretch")
    asked = candidates.select("*", stretch)
    held = lists.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("term").alias("_term"), "pos", F.floor(F.col("pos") / width).alias("_stretch"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")) & (F.col("term") == F.col("_term")) & (F.col("stretch") == F.col("_stretch"))
    both = asked.join(held, same & (F.abs(F.col("pos") - F.col("at")) <= distance))
    return both.drop("_doc", "_key", "_term", "_stretch", "stretch")


def matches(index: DataFrame, ranked: DataFrame, n_bytes: int, distance: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, phrase, at, length, start, exact``: phrases found by intersecting posting lists.

    A row for each posting of a phrase's rarest term with all of the phrase's terms at most ``distance`` words
    away from it, in any order (proximity), and for each place of that term in the phrase. ``exact`` says that the
    phrase itself stands there, from word ``start`` on. Every exact occurrence is among the rows if ``distance`` is
    no less than the phrase's length, and it must be.
    """
    one, two = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    heads = ranked.select(F.explode(F.array_compact(F.array(one["term"], F.when(F.col("n_terms") > 1, two["term"])))).alias("term")).distinct()
    rare = written(index.join(_small(heads, n_bytes), "term", "left_semi"), "lists")  # the lists of the two rarest terms of each phrase
    first = ranked.select("no", "n_terms", "length", F.explode(one["offsets"]).alias("first"), one["term"].alias("anchor"), two["term"].alias("second"))
    found = rare.join(_small(first, n_bytes), F.col("term") == F.col("anchor"))
    place = ["no", "doc_id", "text_key", "at", "start"]
    found = found.select("no", "n_terms", "length", "second", "doc_id", "text_key", F.col("pos").alias("at"), (F.col("pos") - F.col("first")).alias("start"))
    single = found.filter("n_terms = 1")
    alone = single.filter("length = 1").select(*place, F.lit(1).cast("bigint").alias("near"), F.lit(1).cast("bigint").alias("placed"))

    seconds = ranked.filter("n_terms > 1").select(two["term"].alias("term")).distinct()
    pairs = _near(found.filter("n_terms > 1").withColumnRenamed("second", "term"), rare.join(_small(seconds, n_bytes), "term", "left_semi"), distance)
    left = written(pairs.select(*place).unionByName(single.filter("length > 1").select(*place)).distinct(), "candidates")

    where = left.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    where = _small(where, 32 * where.count())
    lists = index.join(_small(ranked.select(F.explode("ranked.term").alias("term")).distinct(), n_bytes), "term", "left_semi")
    lists = lists.join(where, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left_semi")
    asked = ranked.select("no", F.explode("ranked").alias("r")).select("no", F.col("r.term").alias("term"), F.col("r.offsets").alias("offsets"))
    hits = _near(left.join(_small(asked, n_bytes), "no"), lists, distance)
    placed = F.when(F.array_contains("offsets", F.col("pos") - F.col("start")), F.col("pos"))
    # a place counts once, however often a document is repeated
    tally = hits.groupBy(*place).agg(F.size(F.collect_set("term")).cast("bigint").alias("near"), F.size(F.collect_set(placed)).cast("bigint").alias("placed"))
    whole = tally.unionByName(alone).join(_small(ranked.select("no", "phrase", "length", "n_terms"), n_bytes), "no").filter("near = n_terms")
    return whole.select("doc_id", "text_key", "phrase", "at", "length", "start", (F.col("placed") == F.col("length")).alias("exact"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, n_items, n_near, items_sha256, contaminated`` for every row of ``docs``.

    A word is hit if an occurrence of a phrase covers it; a document is contaminated if it has hits and they
    are at least a twentieth of its words. ``n_near`` counts the items of which all words of a phrase stand
    within ``window`` words of its rarest one, in any order and each once. ``index`` is the postings of ``docs`` if they are
    written already.

    Null and empty texts have no words; items without words have no phrase; an empty table on either side has
    no hits. Repeated rows give equal results, rows of one id with different texts each their own; texts may have
    any length; other columns are ignored.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    if index is None:
        index = written(positional_index(docs), "postings", "zstd")
    listed = written(phrases(items, window), "phrases")
    n_bytes = 4 * (listed.agg(F.sum(F.octet_length("phrase")).alias("n")).first()["n"] or 0)
    ranked = written(ranked_terms(listed.select("phrase", "terms").distinct(), index, n_bytes), "ranked")
    found = written(matches(index, ranked, n_bytes, window), "matches")
    named = found.join(_small(listed.select("item_id", "phrase"), n_bytes), "phrase")
    item = F.col("item_id").cast("string")
    spans = F.collect_set(F.when(F.col("exact"), F.struct("start", "length")))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    hits = named.groupBy("doc_id", "text_key").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.when(F.col("exact"), item))).alias("ids"), F.count_distinct(item).alias("n_near"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"), "ids", "n_near")
    sizes = docs.select("doc_id", text_key().alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(_ANY_WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    every = sizes.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("ids", F.array().cast("array<string>"))
    return every.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; columns stay as they are, whatever their names.

    Rows with null or empty texts stay, as do all rows if a table is empty; a repeated row goes or stays with
    its copies.
    """
    bad = contamination(docs, items, window).filter("contaminated").select("doc_id", "text_key").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what it shares with the benchmark: a row for each row of ``documents``.

    Null and empty texts have no words and no hits; texts of any length are taken whole; repeated rows give
    equal rows; an empty table of documents gives no row, an empty benchmark no hit; no other column is read.
    """
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT g.r, g.i, g.n, p.item_id FROM g JOIN p USING (n, phrase)),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
dp AS (SELECT r, w[i] AS term, i AS pos FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
ct AS (SELECT term, count(*) AS n FROM dp GROUP BY term),
rk AS (SELECT phrase, term, n, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(n, 0), term) AS k, count(*) OVER (PARTITION BY phrase) AS m FROM (SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS term FROM p) LEFT JOIN ct USING (term)),
ca AS (SELECT dp.r, dp.pos AS at, phrase, m FROM dp JOIN rk ON dp.term = rk.term AND k = 1 AND n IS NOT NULL),
nr AS (SELECT ca.r, ca.phrase FROM ca JOIN rk ON ca.phrase = rk.phrase JOIN dp ON dp.r = ca.r AND dp.term = rk.term AND abs(dp.pos - ca.at) <= 13 GROUP BY ca.r, ca.phrase, ca.at, ca.m HAVING count(DISTINCT dp.term) = ca.m),
ni AS (SELECT r, count(DISTINCT item_id) AS n_near FROM nr JOIN p USING (phrase) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(n_near, 0) AS n_near,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN ni USING (r)""",
}
