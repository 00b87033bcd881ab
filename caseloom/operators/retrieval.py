"""Lexical, vector and hybrid retrieval with explicit tie-breaking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import kept, spread, table

#: Constant of reciprocal rank fusion.
RRF_K = 60
#: Bytes and number of questions that are put to all rows in one pass.
BLOCK_BYTES, BLOCK_QUESTIONS = 4_000_000, 1_000

#: A word's letter: letters and digits of all scripts, the low line, and everything from A-grave to y-diaeresis.
WORD = r"[\p{L}\p{N}_\x{C0}-\x{FF}]"
# Words that a question's tokens leave out.
STOP_WORDS = "de da do das dos em no na nos nas para por com sem ou se que ao aos as os um uma".split()


def query_tokens(text: Column) -> Column:
    """Different lower-case words of two letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def occurrences(text: Column, token: Column) -> Column:
    """How often ``token`` stands in ``text``, inside words too; bytes tell, and only a text that has it is taken apart."""
    size = F.octet_length
    n = (size(text) - size(F.replace(text, token, F.lit("")))) / size(token)
    return F.when(F.contains(text, token), n).otherwise(0.0)


#: Cells of texts times tokens that a task holds at a time, texts of such a piece, and bytes that are looked at in one step.
CELLS, PIECE_TEXTS, STEP = 2_000_000, 1_000, 1 << 20


class Tokens:
    """Byte strings of two bytes or more as a trie: a table of the first two bytes, sorted keys of all other branches."""

    def __init__(self, tokens: list[bytes]):
        if any(len(t) < 2 for t in tokens):
            raise ValueError("a token has two bytes at least")
        self.tokens, self.longest = tokens, max(map(len, tokens), default=2)
        nodes: dict[bytes, int] = {}
        for t in tokens:
            for n in range(2, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes))
        self.first = np.full(1 << 16, -1, np.int32)
        self.token = np.full(len(nodes), -1, np.int32)  # of the node that ends it
        self.inner = np.zeros(len(nodes), bool)
        branches = []
        for start, node in nodes.items():
            if len(start) == 2:
                self.first[start[0] << 8 | start[1]] = node
            else:
                branches.append((nodes[start[:-1]] << 8 | start[-1], node))
                self.inner[nodes[start[:-1]]] = True
        for i, t in enumerate(tokens):
            self.token[nodes[t]] = i
        self.keys, self.nodes = np.array(sorted(branches), np.int64).reshape(-1, 2).T.copy()
        #: Tokens that may overlap themselves.
        self.bordered = [i for i, t in enumerate(tokens) if any(t.startswith(t[n:]) for n in range(1, len(t)))]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How often each token stands in each text, read from the left without overlaps. All tokens are followed from all
        places of the texts at once; what that takes beside the texts is bounded by ``STEP``."""
        data = np.frombuffer(b"\xff".join([*texts, b"\xff" * self.longest]), np.uint8)  # that byte is in no text
        ends = np.cumsum([len(t) + 1 for t in texts])
        out = np.zeros(len(texts) * len(self.tokens), np.int64)
        for start in range(0, len(data) - self.longest, STEP):
            part = data[start : start + STEP + self.longest]
            node = self.first[part[: min(STEP, len(data) - start - self.longest)].astype(np.uint16) << 8 | part[1 : 1 + min(STEP, len(data) - start - self.longest)]]
            at = np.flatnonzero(node >= 0)
            node, found, depth = node[at], [], 2
            while len(at):
                done = self.token[node] >= 0
                found.append((at[done], self.token[node[done]]))
                on = self.inner[node]
                at, node = at[on], node[on]
                key = node.astype(np.int64) << 8 | part[at + depth]
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[slot] == key if len(key) else np.zeros(0, bool)
                at, node, depth = at[on], self.nodes[slot[on]], depth + 1
            for place, token in found:
                text = np.searchsorted(ends, place + start, "right")
                out += np.bincount(text * len(self.tokens) + token, minlength=len(out))
        out = out.reshape(len(texts), len(self.tokens))
        for i in self.bordered:
            for text in np.flatnonzero(out[:, i] > 1):
                out[text, i] = texts[text].count(self.tokens[i])
        return out


def word_scores(docs: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """``query_id, columns, score`` of the ``docs`` (with ``low``) that score over 0 for one block of questions ``asked``
    (``query_id, query, tokens``): 10 for the whole query; for each token that is there 1, and 0.2 for each of up to five
    occurrences, inside words too. ``low`` is lower-case already.

    A text is read once for the tokens of all questions. Scores are added up in fifths, so they are exact.
    """
    rows = asked.select("query_id", "tokens", F.lower("query").alias("whole")).collect()  # a block's bytes and questions are bounded
    place = {t: i for i, t in enumerate(sorted({t.encode() for r in rows for t in r["tokens"]}))}
    questions = []
    for r in rows:
        whole, own = r["whole"].encode(), [t.encode() for t in r["tokens"]]
        # a text that lacks a token of the query does not hold the query
        questions.append((r["query_id"], whole, np.array([place[t] for t in own], np.int64), np.array([place[t] for t in own if t in whole], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast((Tokens(list(place)), questions))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, questions = shared.value
        most = max(1, min(PIECE_TEXTS, CELLS // max(1, len(tokens.tokens))))
        for batch in batches:
            for piece in (batch.slice(i, most) for i in range(0, batch.num_rows, most)):
                texts = piece.column("low").cast(pa.binary()).to_pylist()
                n = tokens.counts([t or b"" for t in texts])
                worth = np.where(n > 0, 5 + np.minimum(n, 5), 0)
                for query, whole, own, needed in questions:
                    fifths = worth[:, own].sum(axis=1)
                    for i in np.flatnonzero((n[:, needed] > 0).all(axis=1)):
                        fifths[i] += 50 * (texts[i] is not None and whole in texts[i])
                    at = np.flatnonzero(fifths)
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(at), pa.int64()), *(piece.column(c).take(pa.array(at)) for c in columns), pa.array(fifths[at] / 5)], ["query_id", *columns, "score"])

    fields = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select(*columns, "low").mapInArrow(scored, f"query_id bigint, {fields}score double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def best_of(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps ``k`` rows of a group in every task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def question_blocks(queries: DataFrame, size: Column | None = None) -> list[DataFrame]:
    """``queries`` (with a ``query_id``) in blocks of about half of ``BLOCK_BYTES`` and ``BLOCK_QUESTIONS``, counted first:
    what a pass over all rows carries to every task is bounded, more questions make more passes. ``size`` is the bytes of
    a question, or else those of its columns as JSON."""
    size = F.octet_length(F.to_json(F.struct(*queries.columns))) if size is None else size
    total = queries.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    n = max(-(-2 * (total["bytes"] or 0) // BLOCK_BYTES), -(-2 * total["n"] // BLOCK_QUESTIONS))
    if n <= 1 or (total["bytes"] <= BLOCK_BYTES and total["n"] <= BLOCK_QUESTIONS):
        return [queries]
    held = kept(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n))), "questions")
    return [held.filter(F.col("_block") == i).drop("_block") for i in range(n)]


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ranks_from(scored: DataFrame, wanted: DataFrame, score: str, keys: list[str], name: str, head: int = 0) -> tuple[DataFrame, DataFrame]:
    """1-based rank of the ``wanted`` rows among those of ``scored``, ordered by ``score`` from the top and the last of
    ``keys`` (a whole number), apart for each value of the other key; and the first ``head`` rows of each, with their rank.

    There is one pass over ``scored``, and no task ever sorts everything: every batch of rows is counted between the wanted
    ones, and counts combine; a task keeps ``head`` rows of each value. ``wanted`` has its scores and must be short: it is the
    heads of a few hundred rows of one block of questions, which bounds what comes to the driver and goes to the tasks.
    """
    by, key = keys
    lists: dict = {}
    for r in wanted.select(by, key, score).distinct().collect():
        lists.setdefault(r[0], []).append((-r[2], r[1]))
    bounds = {q: (np.array([x for x, _ in sorted(rows)], float), np.array([i for _, i in sorted(rows)], np.int64)) for q, rows in lists.items()}
    shared = scored.sparkSession.sparkContext.broadcast(bounds)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        best: dict = {}
        for df in batches:
            for q, rows in df.groupby("by", sort=False):
                down, own = -rows["score"].to_numpy(), rows["key"].to_numpy()
                if head:
                    before = best.get(q, (np.zeros(0), np.zeros(0, np.int64)))
                    least = before[0][-1] if len(before[0]) == head else np.inf
                    some, ids = (np.concatenate([x, y[down <= least]]) for x, y in zip(before, (down, own)))
                    first = np.lexsort((ids, some))[:head]
                    best[q] = some[first], ids[first]
                if q not in shared.value:
                    continue
                at, ids = shared.value[q]
                low, high = np.searchsorted(at, down, "left"), np.searchsorted(at, down, "right")
                for tie in np.unique(low[high > low]):  # of rows with a wanted score the lesser ids come first
                    same = (low == tie) & (high > low)
                    low[same] = tie + np.searchsorted(ids[tie : high[same][0]], own[same], "left")
                total[q] = total.get(q, 0) + np.bincount(low, minlength=len(at) + 1)[: len(at)]
        for q, n in total.items():
            yield pd.DataFrame({"by": q, "slot": np.arange(len(n)), "n": n, "key": 0, "score": 0.0})
        for q, (down, ids) in best.items():
            yield pd.DataFrame({"by": q, "slot": -1, "n": 0, "key": ids, "score": -down})

    slots = [(q, n, int(i)) for q, (_, ids) in bounds.items() for n, i in enumerate(ids)]
    kind = scored.schema[by].dataType.simpleString()
    rows = scored.select(F.col(by).alias("by"), F.col(score).alias("score"), F.col(key).alias("key"))
    rows = kept(rows.mapInPandas(counted, f"by {kind}, slot bigint, n bigint, key bigint, score double"), "counts")
    ranks = rows.filter("slot >= 0").groupBy("by", "slot").agg(F.sum("n").alias("n")).withColumn("rank", F.sum("n").over(Window.partitionBy("by").orderBy("slot")))  # of a list's places
    named = scored.sparkSession.createDataFrame(slots, f"by {kind}, slot bigint, id bigint").coalesce(1)
    ranked = named.join(ranks, ["by", "slot"]).select(F.col("by").alias(by), F.col("id").alias(key), F.col("rank").alias(name))
    place = F.row_number().over(Window.partitionBy("by").orderBy(F.desc("score"), F.asc("key"))).cast("bigint")
    top = rows.filter("slot < 0").select(F.col("by").alias(by), F.col("key").alias(key), place.alias(name)).filter(F.col(name) <= head)
    return ranked, top


def fused(legs: dict[str, Callable[[DataFrame | None], DataFrame]], k: int, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """``by, key, rank_<leg>..., score``: the ``k`` best of each question of one block by reciprocal rank fusion of
    ``legs``; a row that a leg lacks gets nothing from it. A leg is a function of a table with some ``key`` that gives ``by,
    key, score`` of these rows, or of all rows for none.

    A row under rank 2 * (60 + k) - 60 in two legs scores less than any of the first k of a leg, so only the heads of the
    legs can be in the result. Only heads are written. A leg's pass finds its head and counts the ranks of what the legs
    before it have in theirs; all legs but the last have a second pass for the heads of the legs after them, so the leg
    whose scores cost most goes last.
    """
    head, keys = len(legs) * (RRF_K + k) - RRF_K, [by, key]
    few, found = None, {name: [] for name in legs}

    def passed(name: str, rows: DataFrame | None, head: int = 0) -> DataFrame:
        leg = legs[name]
        wanted = leg(None).limit(0) if rows is None else leg(rows.select(key).distinct()).join(F.broadcast(rows), keys)
        ranks, top = ranks_from(leg(None), wanted, "score", keys, f"rank_{name}", head)
        found[name].append(kept(ranks.unionByName(top).distinct(), "ranks"))
        return top

    for name in legs:
        top = passed(name, few, head).select(*keys)
        few = kept(top if few is None else few.unionByName(top).distinct(), "heads")
    for name in list(legs)[:-1]:
        rest = kept(few.join(found[name][0].select(*keys), keys, "left_anti"), "heads")
        if not rest.isEmpty():
            passed(name, rest)
    score, out = F.lit(0.0), few
    for name in legs:
        out = out.join(union_of(found[name]), keys, "left")
        score = score + F.coalesce(1 / (RRF_K + F.col(f"rank_{name}")), F.lit(0.0))
    return best_of(out.withColumn("score", F.round(score, 6)), [by], [F.desc("score"), F.asc(key)], k)


def hybrid(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``fused`` for one question, best first, of columns ``lexical``, which counts over 0, and ``semantic``, where not null."""
    own = scored.withColumn("_q", F.lit(0))

    def leg(c: str, condition: str) -> Callable[[DataFrame | None], DataFrame]:
        rows = own.select("_q", key, F.col(c).alias("score")).filter(condition)
        return lambda only: rows if only is None else rows.join(F.broadcast(only), key, "left_semi")

    return fused({"lex": leg("lexical", "score > 0"), "sem": leg("semantic", "score is not null")}, k, "_q", key).drop("_q").orderBy(F.desc("score"), key)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions: every benchmark item whose id is divisible by 100."""
    asked = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0 and text is not null")
    return asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), query_tokens(F.col("text")).alias("tokens"))


def put_to(docs: DataFrame, asked: DataFrame, score, *columns: str) -> DataFrame:
    """``for_each_query`` for one block of questions, which are one row of an array."""
    asked = F.broadcast(asked.agg(F.collect_list(F.struct(*asked.columns)).alias("_asked")))
    told = F.transform("_asked", lambda q: F.struct(q["query_id"].alias("query_id"), score(q).alias("score")))
    rows = docs.join(asked).select(*columns, F.explode(told).alias("_t"))
    return rows.select("_t.query_id", *columns, "_t.score").filter("score > 0")


def for_each_query(docs: DataFrame, queries: DataFrame, score, *columns: str) -> DataFrame:
    """``query_id``, ``columns`` and ``score`` where ``score(query)`` is over 0: all questions of a block are put to a text
    while it is at hand, so that neither texts nor scores are worked out again for a question or a filter. There is one
    pass over ``docs`` for each block of ``queries``."""
    return union_of([put_to(docs, block, score, *columns) for block in question_blocks(queries)])


def _low_docs(spark: SparkSession, sf_dir: str, *columns: str, only: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *columns, "text")
    docs = docs if only is None else docs.join(F.broadcast(only), "doc_id", "left_semi")
    return spread(docs, "doc_id").select("doc_id", *columns, F.lower("text").alias("low"))


def _scored_docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = _low_docs(spark, sf_dir, *columns)
    return union_of([word_scores(docs, block, "doc_id", *columns) for block in question_blocks(_query(spark, sf_dir))]).withColumnRenamed("score", "lexical")


def _units(vectors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of ``vectors`` the places of those and their unit vectors; null vectors have length 0."""
    own = [np.asarray([] if v is None else v, dtype="float64") for v in vectors]
    sizes = np.array([v.size for v in own], dtype="int64")
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        rows = np.stack([own[i] for i in at])
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        yield int(dim), at, np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _asked_vectors(queries: DataFrame) -> list:
    """For each block of queries, at the tasks: ``dim, ids, unit vectors`` of each length. What a task holds of them is the
    bound of a block, whatever the number of vectors."""
    blocks = question_blocks(queries.withColumn("query_id", F.col("vec_id")), 8 * F.coalesce(F.size("embedding"), F.lit(0)))
    out = []
    for block in blocks:
        rows = block.select("vec_id", "embedding").collect()  # a block's bytes and questions are bounded
        ids = np.array([r[0] for r in rows], dtype="int64")
        out.append(queries.sparkSession.sparkContext.broadcast([(dim, ids[at], unit) for dim, at, unit in _units([r[1] for r in rows])]))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """``query_id, vec_id, label, score``: the ``k`` rows of ``vectors`` of highest cosine for each of ``queries``.

    Each batch of vectors meets the queries as matrices and keeps ``k`` rows a query, so a task holds one batch at a time;
    there is one pass over the vectors for each block of queries. The cosine is 0 for empty vectors, different lengths and
    zero norms; ties go to the lower id. Without ``itself`` a query's own row is not among its neighbours.
    """

    def scorer(shared):
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                for dim, here, mine in _units(df["embedding"]):
                    ids, labels = df["vec_id"].to_numpy()[here], df["label"].astype(object).to_numpy()[here]
                    for query_dim, own, asked in shared.value:
                        for start in range(0, len(own), 256):
                            some = own[start : start + 256]
                            cos = asked[start : start + 256] @ mine.T if dim == query_dim and dim > 0 else np.zeros((len(some), len(ids)))
                            cos = np.round(cos, 6) + 0.0
                            if not itself:
                                cos[some[:, None] == ids[None, :]] = -np.inf
                            n = min(k, len(ids))
                            least = -np.partition(-cos, n - 1, axis=1)[:, n - 1]
                            q, at = np.nonzero((cos >= least[:, None]) & (cos > -np.inf))
                            order = np.lexsort((ids[at], -cos[q, at], q))
                            q, at = q[order], at[order]
                            few = np.arange(len(q)) - np.searchsorted(q, q, "left") < n  # of equal scores the lower ids
                            q, at = q[few], at[few]
                            yield pd.DataFrame({"query_id": some[q], "vec_id": ids[at], "label": labels[at], "score": cos[q, at]})

        return score

    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", "embedding")
    found = [rows.mapInPandas(scorer(asked), f"query_id bigint, vec_id bigint, label {label}, score double") for asked in _asked_vectors(queries)]
    return best_of(union_of(found), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.filter("vec_id % 100 = 0")


def pages_scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.withColumn("evidence", F.when(F.col("quality").isNull(), "UNLABELLED").when(F.col("toxic") == 1, "EXCLUDED").otherwise("USABLE"))


def lexical_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of(_scored_docs(spark, sf_dir), ["query_id"], [F.desc("lexical"), F.asc("doc_id")], 20)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(*_vectors(spark, sf_dir), 20)


def similarities(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, vec_id, semantic``: the cosine of every vector with every one of ``queries``, batch by batch."""

    def scorer(shared):
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                for dim, here, mine in _units(df["embedding"]):
                    ids = df["vec_id"].to_numpy()[here]
                    for query_dim, own, asked in shared.value:
                        for q, vector in zip(own, asked):
                            yield pd.DataFrame({"query_id": q, "vec_id": ids, "semantic": np.round(mine @ vector, 6) + 0.0 if dim == query_dim and dim > 0 else np.zeros(len(ids))})

        return score

    rows = vectors.select("vec_id", "embedding")
    found = [rows.mapInPandas(scorer(asked), "query_id bigint, vec_id bigint, semantic double") for asked in _asked_vectors(queries)]
    return union_of(found)


def excerpt(text: Column, size: int = 400) -> Column:
    """The first characters of a text, and dots if there are more."""
    bare = F.trim(text)
    return F.when(F.length(bare) > size, F.concat(F.left(bare, F.lit(size)), F.lit("..."))).otherwise(bare)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions are those of the benchmark; the vector of a question is that of its number, if there is one. Block by
    block, only the heads of both legs are written; the heads of the result get their excerpt."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    placed = vectors.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    best = []
    for block in question_blocks(_query(spark, sf_dir)):
        probes = vectors.join(block.select("query_id"), F.col("vec_id") == F.col("query_id"), "left_semi")

        def near(only: DataFrame | None, probes: DataFrame = probes) -> DataFrame:
            rows = placed if only is None else placed.join(F.broadcast(only), F.col("vec_id") == F.col("doc_id"), "left_semi")
            return similarities(rows, probes).select("query_id", F.col("vec_id").alias("doc_id"), F.col("semantic").alias("score"))

        def worded(only: DataFrame | None, block: DataFrame = block) -> DataFrame:
            return word_scores(_low_docs(spark, sf_dir, only=only), block, "doc_id")

        best.append(kept(fused({"sem": near, "lex": worded}, 20), "fused"))
    return union_of(best).join(docs.select("doc_id", excerpt(F.col("text")).alias("excerpt")), "doc_id").select("query_id", "doc_id", "rank_lex", "rank_sem", "score", "excerpt")


def relative_threshold_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max("score").over(Window.partitionBy("query_id"))  # of at most twenty rows
    return nearest(*_vectors(spark, sf_dir), 20, itself=False).withColumn("best", best).filter("score >= greatest(0.30, 0.82 * best)").select("query_id", "vec_id", "label", "score")


def bm25_heads(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The ``k`` best documents of each question by BM25 over whole words. Words are rows only until they meet the
    questions', and are counted there; the corpus statistics are an aggregate of the same words."""
    asked = _query(spark, sf_dir).select("query_id", F.explode("tokens").alias("term"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD + "{2,}"), F.lit(0))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", words.alias("w"))
    sizes = docs.select(F.when(F.col("w").isNotNull(), F.size("w")).alias("len")).agg(F.count("*").alias("n_all"), F.avg("len").alias("mean"))
    rows = docs.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term")
    tf = kept(rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "words")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    both = tf.join(df, "term").join(F.broadcast(kept(sizes, "sizes"))).join(asked, "term")  # sizes: one row
    idf = F.log(1 + (F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    scores = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 4).alias("score"))
    return best_of(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_heads(spark, sf_dir, 20)


def compose_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists fused with a discount for groups that are chosen already.

    Choosing by votes / (1 + chosen in group) again and again gives the order of votes / rank in group.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    streams = []
    for order in ([F.desc("n_chars"), F.asc("doc_id")], [F.asc("n_chars"), F.asc("doc_id")]):
        top = docs.orderBy(*order).limit(50)
        streams.append(top.withColumn("vote", 1 / (RRF_K + F.row_number().over(Window.orderBy(*order)))))  # of fifty rows
    votes = streams[0].unionByName(streams[1]).groupBy("doc_id", "source").agg(F.sum("vote").alias("votes"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("votes"), "doc_id"))
    return votes.withColumn("group_rank", rank).select("doc_id", "source", "group_rank", F.round(F.col("votes") / F.col("group_rank"), 6).alias("value"))


QUERIES = {f.__name__: f for f in (hybrid_rrf, pages_scan_evidence, lexical_score_topk, cosine_topk, relative_threshold_neighbours, bm25_topk, compose_diversified)}

#: What the SQL takes for a word, and the words that it leaves out.
SQL_WORD = r"[\p{L}\p{N}_\x{C0}-\x{FF}]"
SQL_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
SQL_TOKENS = f"""q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0 AND text IS NOT NULL),
t AS (SELECT DISTINCT query_id, tok FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{SQL_WORD}{{2,}}')) AS tok FROM q) WHERE tok NOT IN {SQL_STOP})"""
SQL_LEXICAL = f"""{SQL_TOKENS},
c AS (SELECT query_id, doc_id, tok, (length(low) - length(replace(low, tok, ''))) / length(tok)::DOUBLE AS n FROM (SELECT doc_id, lower(text) AS low FROM documents), t),
w AS (SELECT query_id, doc_id, CASE WHEN contains(lower(text), lower(query)) THEN 10.0::DOUBLE ELSE 0.0 END AS whole FROM documents, q WHERE text IS NOT NULL),
l AS (SELECT query_id, doc_id, round(max(whole) + coalesce(sum(CASE WHEN n > 0 THEN 1.0::DOUBLE + 0.2::DOUBLE * least(n, 5.0) ELSE 0 END), 0), 6) AS lexical
      FROM w LEFT JOIN c USING (query_id, doc_id) GROUP BY query_id, doc_id)"""
SQL_BM25 = f"""{SQL_TOKENS},
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{SQL_WORD}{{2,}}') AS w FROM documents),
s AS (SELECT count(*) AS n_all, avg(len(w)) AS mean FROM d),
f AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT tok FROM t) GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 4) AS score
  FROM f JOIN g USING (term) JOIN t ON tok = term, s GROUP BY query_id, doc_id)"""
_VEC = """v AS (SELECT p.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, embeddings p WHERE p.vec_id % 100 = 0)"""
ORACLE = {
    "pages_scan_evidence": "SELECT doc_id, lang, n_chars, quality, toxic, CASE WHEN quality IS NULL THEN 'UNLABELLED' WHEN toxic = 1 THEN 'EXCLUDED' ELSE 'USABLE' END AS evidence FROM documents LEFT JOIN labels USING (doc_id)",
    "lexical_score_topk": f"WITH {SQL_LEXICAL} SELECT query_id, doc_id, lexical FROM l WHERE lexical > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= 20",
    "cosine_topk": f"WITH {_VEC} SELECT query_id, vec_id, label, score FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20",
    "hybrid_rrf": f"""WITH {SQL_LEXICAL}, {_VEC},
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS rank_lex FROM l WHERE lexical > 0),
b AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank_sem FROM v WHERE vec_id IN (SELECT doc_id FROM documents) AND query_id IN (SELECT query_id FROM q)),
f AS (SELECT query_id, doc_id, rank_lex, rank_sem, round(coalesce(1.0::DOUBLE / (60 + rank_lex), 0) + coalesce(1.0::DOUBLE / (60 + rank_sem), 0), 6) AS score FROM a FULL JOIN b USING (query_id, doc_id)),
h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20)
SELECT h.*, CASE WHEN length(trim(text, ' ')) > 400 THEN left(trim(text, ' '), 400) || '...' ELSE trim(text, ' ') END AS excerpt FROM h JOIN documents USING (doc_id)""",
    "relative_threshold_neighbours": f"""WITH {_VEC}, w AS (SELECT * FROM v WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20),
b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM w)
SELECT query_id, vec_id, label, score FROM b WHERE score >= greatest(0.30::DOUBLE, 0.82::DOUBLE * best)""",
    "bm25_topk": f"""WITH {SQL_BM25}
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20""",
    "compose_diversified": """WITH a AS (SELECT doc_id, source, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS vote FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 50
  UNION ALL SELECT doc_id, source, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY n_chars, doc_id)) FROM documents QUALIFY row_number() OVER (ORDER BY n_chars, doc_id) <= 50),
b AS (SELECT doc_id, source, sum(vote) AS votes FROM a GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, doc_id) AS group_rank FROM b)
SELECT doc_id, source, group_rank, round(votes / group_rank, 6) AS value FROM c""",
}
