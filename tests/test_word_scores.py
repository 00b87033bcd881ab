"""Scores by words against plain counting, and how often a fusion reads its legs."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import retrieval


def test_tokens_are_counted_as_text_counts_them(monkeypatch):
    rnd = random.Random(3)
    for _ in range(400):
        tokens = sorted({"".join(rnd.choice("abñ") for _ in range(rnd.randint(2, 5))).encode() for _ in range(rnd.randint(0, 12))})
        texts = ["".join(rnd.choice("abñ ") for _ in range(rnd.randint(0, 60))).encode() for _ in range(rnd.randint(0, 9))]
        monkeypatch.setattr(retrieval, "STEP", rnd.choice([1, 7, 50, 1 << 20]))
        assert retrieval.Tokens(tokens).counts(texts).tolist() == [[t.count(x) for x in tokens] for t in texts]
    with pytest.raises(ValueError):
        retrieval.Tokens([b"a"])


def test_scores_of_odd_texts(spark, monkeypatch):
    asked = [(0, "aa bb", ["aa", "bb"]), (100, "The The", []), (200, "", []), (300, "ÀÉ x", ["àé"]), (400, "zz", ["zz"])]
    texts = ["aaaaa bb", "aa bb", None, "", "the the", "àéàé " * 9, "aaa aaa aaa aaa aaa aaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, low string").repartition(2)

    def score(text, query, tokens):
        if text is None:
            return 0
        return round((10 if query.lower() in text else 0) + sum(1 + 0.2 * min(5, text.count(t)) for t in tokens if t in text), 6)

    want = {(q, d, s) for q, query, tokens in asked for d, t in enumerate(texts) if (s := score(t, query, tokens))}
    block = spark.createDataFrame(asked, "query_id long, query string, tokens array<string>")
    for cells in (1, 2_000_000):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        assert {tuple(r) for r in retrieval.word_scores(docs, block, "d").collect()} == want and len(want) > 10
    assert retrieval.word_scores(docs, block.limit(0), "d").count() == 0


def test_the_last_leg_is_read_whole_once(spark):
    """``fused`` worked the scores of each leg out three times."""
    rows = [(q, i, round(((i * 37 + q) % 101) / 7, 6), round(((i * 53 + q) % 97) / 5, 6)) for q in (0, 100) for i in range(700)]
    table = spark.createDataFrame(rows, "query_id long, doc_id long, a double, b double").repartition(5)
    read = {"a": spark.sparkContext.accumulator(0), "b": spark.sparkContext.accumulator(0)}

    def leg(name):
        def counted(batches):
            for batch in batches:
                read[name].add(batch.num_rows)
                yield batch

        def of(only):
            some = table if only is None else table.join(F.broadcast(only), "doc_id", "left_semi")
            return some.select("query_id", "doc_id", F.col(name).alias("score")).mapInArrow(counted, "query_id long, doc_id long, score double")

        return of

    got = {(r.query_id, r.doc_id, r.rank_a, r.rank_b, r.score) for r in retrieval.fused({"a": leg("a"), "b": leg("b")}, 5).collect()}
    want = set()
    for q in (0, 100):
        own = [r for r in rows if r[0] == q]
        a, b = ({r[1]: n for n, r in enumerate(sorted(own, key=lambda r: (-r[k], r[1])), 1)} for k in (2, 3))
        best = sorted((-round(1 / (60 + a[i]) + 1 / (60 + b[i]), 6), i) for i in a)[:5]
        want |= {(q, i, a[i], b[i], -s) for s, i in best}
    assert got == want
    assert read["b"].value < 1.5 * len(rows) and read["a"].value < 2.5 * len(rows)
