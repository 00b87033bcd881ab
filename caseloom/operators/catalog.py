"""Listings, scans and summaries over the tables: search, paging, ranges, phrases, triage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.text import count_of
from caseloom.operators.retrieval import SQL_LEXICAL, SQL_TOKENS, SQL_WORD, WORD, _low_docs, _query, _scored_docs, best_of, occurrences, question_blocks, union_of
from caseloom.sources.tables import kept, table, texts


def as_ranges(df: DataFrame, keys: list[str], number: str, name: str = "ranges") -> DataFrame:
    """The numbers of each key as text like ``1-3,7``, and how many there are."""
    distinct = df.select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    runs = distinct.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(number).alias("_a"), F.max(number).alias("_b"))
    text = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")))
    both = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_a", text.alias("t")))).alias("_r"), F.sum(F.col("_b") - F.col("_a") + 1).alias("n"))
    return both.select(*keys, F.array_join(F.col("_r.t"), ",").alias(name), "n")


def from_ranges(df: DataFrame, ranges: str, number: str) -> DataFrame:
    """A row for each number that text like ``1-3,7`` stands for; parts that are no range give none."""
    part = F.explode(F.split(ranges, ","))
    cut = df.withColumn("_p", part).withColumn("_a", F.regexp_extract("_p", r"^\s*([0-9]+)\s*(?:-|$)", 1)).withColumn("_b", F.regexp_extract("_p", r"([0-9]+)\s*$", 1))
    cut = cut.filter("_a <> '' and _b <> '' and cast(_a as bigint) <= cast(_b as bigint)")
    return cut.withColumn(number, F.explode(F.expr("sequence(cast(_a as bigint), cast(_b as bigint))"))).drop("_p", "_a", "_b")


def interval_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ranges(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


def interval_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of each order through their text form and back."""
    lines = from_ranges(as_ranges(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber"), "ranges", "line")
    return lines.groupBy("line").agg(F.count("*").alias("n_orders"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty orders after the median key, by keyset: earlier pages are never sorted or skipped over."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = orders.agg((F.max("o_orderkey") / 2).cast("bigint").alias("after")).first()["after"]  # one number, so that the scan itself starts there
    return orders.filter(F.col("o_orderkey") > F.lit(after)).orderBy("o_orderkey").limit(50)


def search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a pattern in every text; texts that cannot be searched are reported, not left out."""
    text = F.col("text")
    state = F.when(text.isNull() | (F.trim(text) == ""), "UNAVAILABLE").when(count_of(text, "[0-9]{4,}") > 0, "HIT").otherwise("MISS")
    return texts(spark, sf_dir).select("doc_id", count_of(text, "[0-9]{4,}").alias("n_hits"), state.alias("state"))


def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by flag and status with subtotals."""
    g = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.grouping_id().cast("bigint").alias("level"))


def phrases(docs: DataFrame, longest: int = 4) -> DataFrame:
    """``lang, doc_id, n_words, phrase``: different runs of one to ``longest`` neighbouring words of each text."""
    df = docs.select("lang", "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(WORD + "+"), F.lit(0)).alias("p1")).filter(F.size("p1") > 0)
    for n in range(2, longest + 1):  # null where the words end
        df = df.withColumn(f"p{n}", F.zip_with(f"p{n - 1}", F.slice("p1", n, F.size("p1")), lambda a, b: F.concat(a, F.lit(" "), b)))
    by_length = F.array(*[F.struct(F.lit(n).cast("bigint").alias("n_words"), F.array_distinct(f"p{n}").alias("p")) for n in range(1, longest + 1)])
    df = df.select("lang", "doc_id", F.explode(by_length).alias("x")).select("lang", "doc_id", "x.n_words", F.explode("x.p").alias("phrase"))
    return df.filter("phrase is not null")


#: Buckets that the phrases of one language and length are counted in, and the fullest that are looked into first.
BUCKETS, FULLEST = 1 << 16, 32


def _runs_of(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the words of ``batch (lang, w)``, and of every run of so many neighbours of one text its row, the
    place of its first word and its bucket."""
    lists = batch.column("w")
    ends = lists.offsets.to_numpy()
    flat = lists.values.slice(ends[0], ends[-1] - ends[0])
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    coded = flat.dictionary_encode()
    own = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
    runs = own
    for n in range(1, longest + 1):
        if n > 1:
            runs = runs[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[n - 1 :]
        at = np.flatnonzero(row[: len(runs)] == row[n - 1 :])
        yield n, flat, row[at], at, ((runs[at] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype("int64")


def fill_of_buckets(words: DataFrame, longest: int) -> DataFrame:
    """``lang, n_words, bucket, n``: how often a phrase of the bucket stands in ``words (lang, w)``, so that no phrase in it
    stands in more texts."""

    def told(total: dict) -> Iterator[pa.RecordBatch]:
        for (lang, n), counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), n)), pa.array(at), pa.array(counts[at])], ["lang", "n_words", "bucket", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            codes, langs = pd.factorize(batch.column("lang").to_pandas(), use_na_sentinel=False)
            langs = [x if isinstance(x, str) else None for x in langs]
            for n, _, row, _, bucket in _runs_of(batch, longest):
                for i, lang in enumerate(langs):
                    total[lang, n] = total.get((lang, n), 0) + np.bincount(bucket[codes[row] == i], minlength=BUCKETS)
            if len(total) > 64:
                yield from told(total)
                total = {}
        yield from told(total)

    rows = words.mapInArrow(counted, "lang string, n_words bigint, bucket bigint, n bigint")
    return rows.groupBy("lang", "n_words", "bucket").agg(F.sum("n").alias("n"))


def phrases_in(words: DataFrame, buckets: DataFrame, longest: int) -> DataFrame:
    """``lang, n_words, phrase, n_docs``: the phrases of ``words (lang, w)`` whose bucket is one of ``buckets``, and how many
    texts each stands in. To the tasks goes one bit for each bucket of a language and length."""
    wanted = {}
    for r in buckets.groupBy("lang", "n_words").agg(F.collect_list("bucket").alias("b")).collect():
        bits = np.zeros(BUCKETS, bool)
        bits[r["b"]] = True
        wanted[r["lang"], r["n_words"]] = np.packbits(bits)
    shared = words.sparkSession.sparkContext.broadcast(wanted)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            codes, names = pd.factorize(langs.to_pandas(), use_na_sentinel=False)
            names = [x if isinstance(x, str) else None for x in names]
            for n, flat, row, at, bucket in _runs_of(batch, longest):
                bits = [np.unpackbits(shared.value[x, n]) if (x, n) in shared.value else np.zeros(BUCKETS, "uint8") for x in names]
                hit = np.stack(bits)[codes[row], bucket] > 0 if bits else np.zeros(0, bool)
                row, at = row[hit], at[hit]
                parts = [flat.take(pa.array(at + i)) for i in range(n)]
                said = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                once = pa.table({"row": row, "phrase": said}).group_by(["row", "phrase"]).aggregate([])
                rows = pa.table({"lang": langs.take(once["row"].combine_chunks()), "n_words": np.full(len(once), n), "phrase": once["phrase"]})
                yield from rows.combine_chunks().to_batches()

    return words.mapInArrow(found, "lang string, n_words bigint, phrase string").groupBy("lang", "n_words", "phrase").agg(F.count("*").alias("n_docs"))


def common_phrases(words: DataFrame, k: int, longest: int = 4) -> DataFrame:
    """``lang, n_words, phrase, n_docs, rank``: of each language and length the ``k`` phrases that most texts of ``words
    (lang, w)`` hold.

    Nearly all phrases stand in one text, so they are counted in buckets first, and only those of some buckets by
    themselves. Those of the fullest buckets give ``k`` phrases with their counts; a bucket that is less full than the least
    of these holds none of the best, all others are looked into. Nothing is left out: where texts have few phrases in
    common, more buckets are looked into.
    """
    keys, most = ["lang", "n_words"], Window.partitionBy("lang", "n_words").orderBy(F.desc("n"), "bucket")
    fill = kept(fill_of_buckets(words, longest).withColumn("r", F.row_number().over(most)), "buckets")
    first = kept(phrases_in(words, fill.filter(F.col("r") <= FULLEST), longest), "phrases")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_docs"), "phrase"))
    least = F.broadcast(first.withColumn("r", rank).filter(F.col("r") == k).select(F.col("lang").alias("l"), F.col("n_words").alias("w"), "n_docs"))
    more = fill.filter(F.col("r") > FULLEST).join(least, F.col("lang").eqNullSafe(F.col("l")) & (F.col("n_words") == F.col("w")), "left")
    more = more.filter(F.col("n") >= F.coalesce("n_docs", F.lit(0))).select(*keys, "bucket")
    counts = first if more.isEmpty() else first.unionByName(phrases_in(words, more, longest))
    # the best of each language are among those of each part of it, so no task gets a language whole
    part = Window.partitionBy(*keys, F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(F.desc("n_docs"), "phrase")
    few = counts.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k)
    return few.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, "phrase", "n_docs", "rank")


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight phrases of one, two, three and four words that stand in most documents of each language."""
    words = texts(spark, sf_dir).select("lang", F.regexp_extract_all(F.lower("text"), F.lit(WORD + "+"), F.lit(0)).alias("w"))
    return common_phrases(kept(words, "words"), 8)


def hierarchical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiers for each question: the five sources with the best document, then the three best documents of each."""
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("lexical"), "doc_id"))
    heads = _scored_docs(spark, sf_dir, "source").withColumn("rank", rank).filter("rank <= 3")  # three of a source; all else is small
    best = heads.filter("rank = 1").select("query_id", "source", F.col("lexical").alias("best"))
    top = best_of(best, ["query_id"], [F.desc("best"), F.asc("source")], 5).drop("best")
    return heads.join(top, ["query_id", "source"], "left_semi").select("query_id", "source", "doc_id", "lexical", "rank")


def subject_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each question's words that each source's documents hold."""
    docs, rows = _low_docs(spark, sf_dir, "source"), []
    for block in question_blocks(_query(spark, sf_dir).select("query_id", "tokens")):
        asked = F.broadcast(block.agg(F.collect_list(F.struct("query_id", "tokens")).alias("asked")))
        # one pass over a text; an explicit null keeps sources that hold no word
        held = F.transform("asked", lambda q: F.struct(q["query_id"].alias("query_id"), F.size(q["tokens"]).alias("n"), F.filter(q["tokens"], lambda t: F.contains("low", t)).alias("held")))
        rows.append(docs.join(asked).select("source", F.explode(held).alias("h")).select("source", "h.query_id", "h.n", F.explode_outer("h.held").alias("word")).distinct())
    return union_of(rows).groupBy("query_id", "source").agg(F.count("word").alias("n_covered"), F.round(F.count("word") / F.first("n"), 6).alias("coverage"))


def page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be read again by other means: blank, almost blank, broken or unmapped characters, mostly symbols."""
    t = F.coalesce("text", F.lit(""))
    left = lambda outside: F.length(F.regexp_replace(t, outside, "")).cast("bigint")
    rows = texts(spark, sf_dir).select(
        "doc_id", F.length(t).alias("n"), left("[ \\t\\r\\n]+").alias("body"), left(r"[^\p{L}\p{N}]+").alias("alnum"), left(r"[^#$%&*|~^<>{}\[\]\\+=_]+").alias("n_symbols"),
        left(r"[^\x00-\x08\x0B\x0C\x0E-\x1F]+").alias("n_c0"), left(r"[^\x{E000}-\x{F8FF}\x{FFFD}]+").alias("n_unmapped"),
    )
    n = F.greatest("n", F.lit(1))
    broken = (F.col("n_c0") >= 5) | (F.col("n_c0") > 0.01 * n)
    unmapped = (F.col("n_unmapped") >= 5) | (F.col("n_unmapped") > 0.03 * n)
    symbols = (F.col("n") >= 40) & (F.col("alnum") / n < 0.35) & (F.col("n_symbols") > 30)
    state = F.when(F.col("body") == 0, "BLANK").when(F.col("body") < 15, "ALMOST_BLANK").when(broken, "CONTROL_CHARACTERS").when(unmapped, "UNMAPPED_GLYPHS").when(symbols, "SYMBOLS").otherwise("READABLE")
    action = F.when(state == "BLANK", "SKIP").when(state == "READABLE", "KEEP").when(state == "ALMOST_BLANK", "LOOK").otherwise("READ_AGAIN")
    return rows.select("doc_id", state.alias("state"), action.alias("action"), "n_symbols")


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = count_of(F.col("text"), r"[.!?](?: |\n|$)")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(ends).alias("n_sentences"), F.max(ends).alias("most"), F.sum("n_chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (interval_compress, interval_explode, keyset_page, search_scan, rollup_counts, phrase_mining, hierarchical_topk, subject_coverage, page_triage, sentence_stats)}

_RANGES = """i AS (SELECT l_orderkey, l_linenumber AS v, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
r AS (SELECT l_orderkey, min(v) AS a, max(v) AS b FROM i GROUP BY l_orderkey, g)"""
ORACLE = {
    "interval_compress": f"WITH {_RANGES} SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges, CAST(sum(b - a + 1) AS BIGINT) AS n FROM r GROUP BY l_orderkey",
    "interval_explode": "SELECT l_linenumber AS line, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1",
    "keyset_page": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey > (SELECT CAST(trunc(max(o_orderkey) / 2) AS BIGINT) FROM orders) ORDER BY o_orderkey LIMIT 50",
    "search_scan": "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]{4,}')) AS n_hits, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'UNAVAILABLE' WHEN regexp_matches(text, '[0-9]{4,}') THEN 'HIT' ELSE 'MISS' END AS state FROM documents",
    "rollup_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_suppkey) AS n_suppliers, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "phrase_mining": f"""
WITH d AS (SELECT lang, doc_id, regexp_extract_all(lower(text), '{SQL_WORD}+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT lang, doc_id, n AS n_words, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT lang, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),
c AS (SELECT lang, n_words, phrase, count(*) AS n_docs FROM p GROUP BY ALL)
SELECT lang, CAST(n_words AS BIGINT) AS n_words, phrase, n_docs, row_number() OVER (PARTITION BY lang, n_words ORDER BY n_docs DESC, phrase) AS rank FROM c QUALIFY rank <= 8""",
    "hierarchical_topk": f"""WITH {SQL_LEXICAL},
s AS (SELECT query_id, source, doc_id, lexical FROM l JOIN documents USING (doc_id) WHERE lexical > 0),
m AS (SELECT query_id, source, max(lexical) AS best FROM s GROUP BY ALL),
b AS (SELECT query_id, source FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, source) <= 5)
SELECT query_id, source, doc_id, lexical, row_number() OVER (PARTITION BY query_id, source ORDER BY lexical DESC, doc_id) AS rank FROM s SEMI JOIN b USING (query_id, source) QUALIFY rank <= 3""",
    "subject_coverage": f"""WITH {SQL_TOKENS}, n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT query_id, source, count(DISTINCT tok) AS k FROM documents, t WHERE contains(lower(text), tok) GROUP BY ALL)
SELECT n.query_id, source, coalesce(k, 0) AS n_covered, round(coalesce(k, 0)::DOUBLE / n, 6) AS coverage FROM n CROSS JOIN (SELECT DISTINCT source FROM documents) d LEFT JOIN h USING (query_id, source)""",
    "page_triage": r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS alnum, length(regexp_replace(t, '[^#$%&*|~^<>{}\[\]\\+=_]', '', 'g')) AS s, length(regexp_replace(t, '[ \t\r\n]', '', 'g')) AS body,
  length(regexp_replace(t, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS c, length(regexp_replace(t, '[^\x{E000}-\x{F8FF}\x{FFFD}]', '', 'g')) AS u FROM a),
r AS (SELECT *, CASE WHEN body = 0 THEN 'BLANK' WHEN body < 15 THEN 'ALMOST_BLANK' WHEN c >= 5 OR c > 0.01::DOUBLE * n THEN 'CONTROL_CHARACTERS' WHEN u >= 5 OR u > 0.03::DOUBLE * n THEN 'UNMAPPED_GLYPHS' WHEN n >= 40 AND alnum::DOUBLE / n < 0.35 AND s > 30 THEN 'SYMBOLS' ELSE 'READABLE' END AS state FROM m)
SELECT doc_id, state, CASE state WHEN 'BLANK' THEN 'SKIP' WHEN 'READABLE' THEN 'KEEP' WHEN 'ALMOST_BLANK' THEN 'LOOK' ELSE 'READ_AGAIN' END AS action, s AS n_symbols FROM r""",
    "sentence_stats": r"SELECT lang, CAST(sum(c) AS BIGINT) AS n_sentences, max(c) AS most, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (SELECT lang, n_chars, len(regexp_extract_all(coalesce(text, ''), '[.!?](?: |\n|$)')) AS c FROM documents) GROUP BY lang",
}
