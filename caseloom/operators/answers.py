"""From questions to answers: folded scores, re-ranking, passages, mined terms, fair choice, citation contexts.

All questions are put to a text while it is at hand; only heads of a few rows a question go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.passages import folded
from caseloom.operators.retrieval import SQL_BM25, SQL_LEXICAL, SQL_STOP, SQL_TOKENS, SQL_WORD, STOP_WORDS, WORD, _query, _scored_docs, best_of, bm25_heads, excerpt, for_each_query, nearest, occurrences, put_to, question_blocks, similarities, union_of
from caseloom.sources.tables import kept, spread, table

# Weights of a passage's signals: vector, covered words, amount, request, date.
WEIGHTS = {"semantic": 0.34, "coverage": 0.20, "amount": 0.15, "request": 0.10, "date": 0.06}


def folded_score(low: Column, tokens: Column) -> Column:
    """1 for each token that is there, and 0.2 for each of up to five occurrences; ``low`` and tokens are folded."""
    counts = F.transform(tokens, lambda t: F.least(occurrences(low, t), F.lit(5.0)))
    return F.aggregate(counts, F.lit(0.0), lambda s, n: s + F.when(n > 0, 1.0 + 0.2 * n).otherwise(0.0))


def _folded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _query(spark, sf_dir).select("query_id", F.explode("tokens").alias("t")).select("query_id", folded(F.col("t")).alias("t")).distinct()
    return asked.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def folded_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each question by its folded words, with or without accents on either side."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", folded(F.col("text")).alias("low"))
    scored = for_each_query(docs, _folded_queries(spark, sf_dir), lambda q: F.round(folded_score(F.col("low"), q["tokens"]), 6), "doc_id")
    return best_of(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], 20)


def fts_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 160 best by BM25 of each question, put in the order of their folded score, then BM25; ten stay."""
    heads = bm25_heads(spark, sf_dir, 160).withColumnRenamed("score", "bm25")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(kept(heads, "heads"), "doc_id")  # 160 rows a question
    both = spread(docs, "doc_id").withColumn("low", folded(F.col("text"))).join(_folded_queries(spark, sf_dir), "query_id")
    scored = both.select("query_id", "doc_id", "bm25", F.round(folded_score(F.col("low"), F.col("tokens")), 6).alias("lexical"))
    return best_of(scored, ["query_id"], [F.desc("lexical"), F.desc("bm25"), F.asc("doc_id")], 10)


def passage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lines of documents for each question: covered words, amounts, requests, dates, and the document's vector."""
    vectors = table(spark, sf_dir, "embeddings")
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(WORD + "{2,}"), F.lit(0)))

    def score(q: Column) -> Column:
        coverage = F.size(F.array_intersect(q["tokens"], F.col("words"))) / F.greatest(F.size(q["tokens"]), F.lit(1))
        signal = sum((WEIGHTS[n] * F.col(n).cast("int") for n in ("amount", "request", "date")), F.lit(0.0))
        semantic = F.coalesce(F.try_element_at("near", q["query_id"]), F.lit(0.0))
        return F.when(coverage > 0, F.round(WEIGHTS["semantic"] * semantic + WEIGHTS["coverage"] * coverage + signal, 6)).otherwise(0.0)

    found = []
    for block in question_blocks(_query(spark, sf_dir)):
        probes = vectors.join(block.select("query_id"), F.col("vec_id") == F.col("query_id"), "left_semi")
        # a document's cosines to the questions of one block, once for all of its lines
        near = similarities(vectors, probes).groupBy(F.col("vec_id").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("query_id", "semantic"))).alias("near"))
        lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(near, "doc_id", "left").select("doc_id", "near", F.posexplode(F.split("text", "\n")).alias("no", "line")).filter("trim(line) <> ''")
        lines = lines.select("doc_id", "no", "near", words.alias("words"), F.col("line").rlike("[0-9][0-9.,]* *%").alias("amount"), F.col("line").rlike("(?i)(requests?|asks?|bitte|demande|pide)").alias("request"), F.col("line").rlike("[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}").alias("date"))
        found.append(put_to(lines, block, score, "doc_id", "no"))
    return best_of(union_of(found), ["query_id"], [F.desc("score"), F.asc("doc_id"), F.asc("no")], 20).withColumn("no", F.col("no").cast("bigint"))


def semantic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight terms of each question's neighbours: runs of one to four words, in capitals if alone, with two content
    words else, no digits, worth their content words times the neighbour's relevance."""
    vectors = table(spark, sf_dir, "embeddings")
    near = nearest(vectors, vectors.filter("vec_id % 100 = 0"), 5, itself=False).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(near, "doc_id")  # five rows a question
    w = texts.select("query_id", "score", F.regexp_extract_all("text", F.lit(WORD + "+"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    sizes = F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("size")
    runs = w.select("query_id", "score", "w", sizes).filter("size(w) >= size").select("query_id", "score", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("run"))
    content = F.size(F.filter("run", lambda x: ~F.lower(x).isin(*STOP_WORDS)))
    phrase = F.array_join("run", " ")
    good = ~phrase.rlike("[0-9]") & (F.length(phrase) >= 3) & F.when(F.col("size") == 1, phrase.rlike("^[A-Z]{2,}$") & (content == 1)).otherwise(content >= 2)
    rows = runs.filter(good).select("query_id", folded(phrase).alias("term"), (F.col("score") * (content + F.when(F.col("size") == 1, 0.5).otherwise(0.0))).alias("worth"))
    best = rows.groupBy("query_id", "term").agg(F.round(F.max("worth"), 6).alias("worth"))
    return best_of(best, ["query_id"], [F.desc("worth"), F.asc("term")], 8)


def one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve documents for each question: the best of every source first, then the next ones whatever their source."""
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("lexical"), "doc_id")
    heads = _scored_docs(spark, sf_dir, "source").withColumn("in_source", F.row_number().over(w)).filter("in_source <= 12")
    first = F.when(F.col("in_source") == 1, 0).otherwise(1)
    ranked = heads.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(first, F.desc("lexical"), "doc_id")))  # twelve rows a source
    return ranked.filter("position <= 12").select("query_id", "position", "source", "doc_id", "lexical")


def issue_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents for each question: those that hold it whole first; where there are not enough, the best by words."""
    route = F.when(F.col("lexical") >= 10, "WHOLE").otherwise("WORDS")
    top = best_of(_scored_docs(spark, sf_dir).withColumn("route", route), ["query_id"], [F.asc("route"), F.desc("lexical"), F.asc("doc_id")], 5)
    return top.select("query_id", "doc_id", "route", "lexical")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = best_of(_scored_docs(spark, sf_dir, "source"), ["query_id"], [F.desc("lexical"), F.asc("doc_id")], 3)
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "doc_id")))  # of three rows
    docs = table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text"), 200).alias("excerpt"))
    return docs.join(top, "doc_id")


def citation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader gets before answering: three numbered sources for each question, each with where it is from."""
    part = F.format_string("[%d] (%s | Doc %d):\n%s", "n", "source", "doc_id", F.trim("excerpt"))
    g = _sources(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))).alias("p"))
    return g.select("query_id", F.size("p").cast("bigint").alias("n_sources"), F.sha2(F.array_join(F.transform("p", lambda x: x["part"]), "\n\n"), 256).alias("context_hash"))


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer without a model: the first sentence of each source with its number; without a source it says so."""
    sentence = F.trim(F.regexp_extract(F.regexp_replace("excerpt", "[ \\t\\r\\n]+", " "), r"^ ?([^.!?]*[.!?]?)", 1))
    g = _sources(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(sentence, F.lit(" ["), F.col("n").cast("string"), F.lit("]")).alias("s")))).alias("p"))
    both = _query(spark, sf_dir).select("query_id").join(g, "query_id", "left")
    return both.select("query_id", F.coalesce(F.array_join(F.transform("p", lambda x: x["s"]), " "), F.lit("NO_SOURCE")).alias("answer"), F.coalesce(F.size("p"), F.lit(0)).cast("bigint").alias("n_citations"))


def cited_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``query_id, place, n, claim, doc_id, state``: each number in brackets of ``answers (query_id, answer)`` with the words
    before it, held against the source of that number (``query_id, n, doc_id, excerpt``).

    VERIFIED: the source holds the words, white space aside; UNSUPPORTED: it does not; INVENTED: there is no such source. A
    number may stand for several, ``[1, 3]``; the words before it are then held against each. Answers without a citation
    and null ones have no row.
    """
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    cited = r"(?s)(.*?)\[\s*(?:Fonte\s+)?([0-9]{1,9}(?:\s*,\s*[0-9]{1,9})*)\s*\]"
    pairs = F.arrays_zip(F.regexp_extract_all("answer", F.lit(cited), F.lit(1)).alias("claim"), F.regexp_extract_all("answer", F.lit(cited), F.lit(2)).alias("ns"))
    rows = answers.select("query_id", F.posexplode(pairs).alias("place", "c")).select("query_id", "place", one(F.col("c.claim")).alias("claim"), F.explode(F.split("c.ns", r"\s*,\s*")).alias("n"))
    held = sources.select(F.col("query_id").alias("_q"), F.col("n").cast("bigint").alias("_n"), "doc_id", one(F.col("excerpt")).alias("said"))
    both = rows.withColumn("n", F.col("n").cast("bigint")).join(held, (F.col("query_id") == F.col("_q")) & (F.col("n") == F.col("_n")), "left")
    state = F.when(F.col("_n").isNull(), "INVENTED").when(F.contains("said", "claim"), "VERIFIED").otherwise("UNSUPPORTED")
    return both.select("query_id", F.col("place").cast("bigint").alias("place"), "n", "claim", "doc_id", state.alias("state"))


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of each question's answer, and whether their sources hold what is cited."""
    sources = kept(_sources(spark, sf_dir).select("query_id", "n", "doc_id", "excerpt"), "sources")
    found = cited_claims(extractive_answer(spark, sf_dir).select("query_id", "answer"), sources)
    return found.select("query_id", "place", "n", F.sha2("claim", 256).alias("claim"), "doc_id", "state")


QUERIES = {f.__name__: f for f in (answer_citations, folded_score_topk, fts_rerank, passage_scores, semantic_terms, one_per_group, issue_retrieval, citation_context, extractive_answer)}

_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"
_SQL_FOLDED = f"""z AS (SELECT DISTINCT query_id, {_FOLD.format('tok')} AS tok FROM t),
fs AS (SELECT query_id, doc_id, round(sum(CASE WHEN n > 0 THEN 1.0::DOUBLE + 0.2::DOUBLE * least(n, 5.0) ELSE 0 END), 6) AS lexical FROM (SELECT query_id, doc_id, (length(low) - length(replace(low, tok, ''))) / length(tok)::DOUBLE AS n FROM (SELECT doc_id, {_FOLD.format('text')} AS low FROM documents), z) GROUP BY ALL)"""
_SQL_NEAR = """nn AS (SELECT p.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings p WHERE p.vec_id % 100 = 0)"""
_SQL_SOURCES = f"""{SQL_LEXICAL}, top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS n FROM l WHERE lexical > 0 QUALIFY n <= 3),
src AS (SELECT query_id, n, source, doc_id, CASE WHEN length(trim(text, ' ')) > 200 THEN left(trim(text, ' '), 200) || '...' ELSE trim(text, ' ') END AS x FROM top JOIN documents USING (doc_id))"""
ORACLE = {
    "folded_score_topk": f"WITH {SQL_TOKENS}, {_SQL_FOLDED} SELECT query_id, doc_id, lexical AS score FROM fs WHERE lexical > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= 20",
    "fts_rerank": f"""WITH {SQL_BM25}, {_SQL_FOLDED}, h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 160)
SELECT query_id, doc_id, score AS bm25, lexical FROM h JOIN fs USING (query_id, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, score DESC, doc_id) <= 10""",
    "passage_scores": f"""WITH {SQL_TOKENS}, {_SQL_NEAR}, ne AS (FROM nn),
n AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
u AS (SELECT doc_id, no, line, list_distinct(regexp_extract_all(lower(line), '{SQL_WORD}{{2,}}')) AS w FROM n WHERE trim(line, ' ') <> ''), k AS (SELECT query_id, list(tok) AS toks FROM t GROUP BY 1),
s AS (SELECT k.query_id, u.doc_id, no, len(list_intersect(toks, w)) AS hit, round(0.34::DOUBLE * coalesce(ne.score, 0) + 0.20::DOUBLE * (len(list_intersect(toks, w))::DOUBLE / len(toks)) + 0.15::DOUBLE * regexp_matches(line, '[0-9][0-9.,]* *%')::INT + 0.10::DOUBLE * regexp_matches(line, '(?i)(requests?|asks?|bitte|demande|pide)')::INT
  + 0.06::DOUBLE * regexp_matches(line, '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}|[0-9]{{1,2}}:[0-9]{{2}}')::INT, 6) AS score FROM k CROSS JOIN u LEFT JOIN ne ON ne.query_id = k.query_id AND ne.vec_id = u.doc_id)
SELECT query_id, doc_id, no, score FROM s WHERE hit > 0 AND score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, no) <= 20""",
    "semantic_terms": f"""WITH {_SQL_NEAR}, ne AS (SELECT * FROM nn WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5),
d AS (SELECT query_id, score, regexp_extract_all(text, '{SQL_WORD}+') AS w FROM ne JOIN documents ON doc_id = vec_id),
r AS (SELECT query_id, score, n, w[i : i + n - 1] AS run FROM (SELECT query_id, score, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),
c AS (SELECT query_id, score, n, array_to_string(run, ' ') AS p, len(list_filter(run, lambda x: lower(x) NOT IN {SQL_STOP})) AS content FROM r),
b AS (SELECT query_id, {_FOLD.format('p')} AS term, round(max(score * (content + CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE 0 END)), 6) AS worth FROM c WHERE NOT regexp_matches(p, '[0-9]') AND length(p) >= 3 AND CASE WHEN n = 1 THEN regexp_matches(p, '^[A-Z]{{2,}}$') AND content = 1 ELSE content >= 2 END GROUP BY 1, 2)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, term) <= 8""",
    "one_per_group": f"""WITH {SQL_LEXICAL}, s AS (SELECT query_id, source, doc_id, lexical, row_number() OVER (PARTITION BY query_id, source ORDER BY lexical DESC, doc_id) AS g FROM l JOIN documents USING (doc_id) WHERE lexical > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN g = 1 THEN 0 ELSE 1 END, lexical DESC, doc_id) AS position, source, doc_id, lexical FROM s QUALIFY position <= 12""",
    "issue_retrieval": f"""WITH {SQL_LEXICAL}, s AS (SELECT query_id, doc_id, CASE WHEN lexical >= 10 THEN 'WHOLE' ELSE 'WORDS' END AS route, lexical FROM l WHERE lexical > 0) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY route, lexical DESC, doc_id) <= 5""",
    "citation_context": f"""WITH {_SQL_SOURCES} SELECT query_id, count(*) AS n_sources, sha256(string_agg('[' || n || '] (' || source || ' | Doc ' || doc_id || '):' || chr(10) || trim(x, ' '), chr(10) || chr(10) ORDER BY n)) AS context_hash FROM src GROUP BY 1""",
    "answer_citations": rf"""WITH {_SQL_SOURCES}, a AS (SELECT *, trim(regexp_extract(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'), '^ ?([^.!?]*[.!?]?)', 1), ' ') AS claim FROM src)
SELECT query_id, n - 1 AS place, n, sha256(claim) AS claim, doc_id, 'VERIFIED' AS state FROM a""",
    "extractive_answer": rf"""WITH {_SQL_SOURCES}, a AS (SELECT query_id, string_agg(trim(regexp_extract(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'), '^ ?([^.!?]*[.!?]?)', 1), ' ') || ' [' || n || ']', ' ' ORDER BY n) AS answer, count(*) AS k FROM src GROUP BY 1)
SELECT query_id, coalesce(answer, 'NO_SOURCE') AS answer, coalesce(k, 0) AS n_citations FROM q LEFT JOIN a USING (query_id)""",
}
