"""Whole results, held against brute force: what the lines, words and single questions of earlier versions missed."""

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.functions import passages
from caseloom.operators import catalog, linkage, retrieval


def frame(sf_dir, name, *columns):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet", columns=list(columns))


def flat(text):
    return " ".join(unicodedata.normalize("NFKC", text or "").split()).casefold()


def test_quotes_inside_lines(spark):
    items = [(1, "one whole quoted sentence here"), (2, "Short Bit"), (3, "runs over\na line break of it"), (4, " \n"), (5, None), (6, "stands nowhere at all here"), (7, "ﬁrst of four words")]
    docs = [(10, "before one  whole QUOTED sentence hereafter"), (11, "xshort bitx. It runs over a line\nbreak OF it"), (12, None), (13, ""), (14, "first of four wordsmiths")]
    got = linkage.contained(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 10), (2, 11), (3, 11), (7, 14)}


def test_quote_verify_finds_every_item(spark, sf_dir):
    items, docs = frame(sf_dir, "benchmark", "item_id", "text"), frame(sf_dir, "documents", "doc_id", "text")
    texts = {d: flat(t) for d, t in docs.itertuples(index=False)}
    want = {}
    for item, text in items.itertuples(index=False):
        held = [d for d, t in texts.items() if flat(text) and flat(text) in t]
        if held:
            want[item] = (len(held), min(held))
    assert {r.item_id: (r.n_docs, r.first_doc) for r in linkage.quote_verify(spark, sf_dir).collect()} == want


def test_quotes_as_the_sql_reads_them(spark, tmp_path):
    import duckdb

    texts = ["one masse stands here", "one maße stands here", "ﬁrst of four words", "first of four words", "a b\u00a0c d e", "a b c d e", "ΟΔΟΣ και ΟΔΟΣ εκεί", "İki üç dört beş", "e\u0301 x  y\tz", "é x y z", "a\vb", "a b", "ﬁ", "x² y", None, "", " \n"]
    items = pd.DataFrame({"item_id": range(len(texts)), "text": texts})
    docs = pd.DataFrame({"doc_id": range(2 * len(texts)), "text": [t if t is None else f"{t}" for t in texts] + [t if t is None else f"Before {t} after" for t in texts]})
    items.to_parquet(tmp_path / "benchmark.parquet"), docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = {tuple(r) for r in con.sql(linkage.ORACLE["quote_verify"]).fetchall()}
    assert {(r.item_id, r.n_docs, r.first_doc) for r in linkage.quote_verify(spark, str(tmp_path)).collect()} == want


def test_words_of_all_scripts(spark):
    rows = spark.createDataFrame([("Ação ñandú a x1 Łódź 日本語 snake_case, Ação",)], "t string")
    assert rows.select(retrieval.query_tokens(F.col("t"))).first()[0] == ["ação", "ñandú", "x1", "łódź", "日本語", "snake_case"]


def test_phrases_join_neighbours_only(spark):
    rows = spark.createDataFrame([("pt", 1, "Um é ação só. Um é"), ("pt", 2, None), ("pt", 3, "só")], "lang string, doc_id long, text string")
    want = {(1, 1, w) for w in ("um", "é", "ação", "só")} | {(3, 1, "só")}
    want |= {(1, 2, p) for p in ("um é", "é ação", "ação só", "só um")}
    want |= {(1, 3, p) for p in ("um é ação", "é ação só", "ação só um", "só um é")}
    want |= {(1, 4, p) for p in ("um é ação só", "é ação só um", "ação só um é")}
    assert sorted((r.doc_id, r.n_words, r.phrase) for r in catalog.phrases(rows).collect()) == sorted(want)


def test_phrase_mining_counts_documents(spark, sf_dir):
    seen = {}
    for lang, text in frame(sf_dir, "documents", "lang", "text").itertuples(index=False):
        words = re.findall(r"\w+", text.lower()) if text else []
        for n in range(1, 5):
            seen.setdefault((lang, n), Counter()).update({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})
    got = {}
    for r in catalog.phrase_mining(spark, sf_dir).orderBy("rank").collect():
        got.setdefault((r.lang, r.n_words), []).append((r.phrase, r.n_docs))
    assert {k: [n for _, n in v] for k, v in got.items()} == {k: sorted(c.values(), reverse=True)[:8] for k, c in seen.items() if c}
    assert all(seen[k][p] == n for k, v in got.items() for p, n in v)


@pytest.mark.parametrize("fullest, buckets", [(32, 1 << 16), (1, 1 << 16), (1, 8)])
def test_phrases_of_any_bucket(spark, monkeypatch, fullest, buckets):
    """Few phrases in common, equal counts, a language that is null, one with less than eight phrases; full buckets too."""
    monkeypatch.setattr(catalog, "FULLEST", fullest)
    if buckets < 1 << 16:  # all phrases in eight buckets
        real = catalog._runs_of
        monkeypatch.setattr(catalog, "_runs_of", lambda b, n: ((m, f, r, a, k % buckets) for m, f, r, a, k in real(b, n)))
    draw = np.random.default_rng(3)
    docs = [(lang, [f"w{x}" for x in draw.zipf(1.4, 40) % 50]) for lang in ("de", None, "en") for _ in range(30)] + [("pt", ["a", "b"]), ("pt", ["a"]), ("es", [])]
    seen = {}
    for lang, w in docs:
        for n in range(1, 5):
            seen.setdefault((lang, n), Counter()).update({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)})
    want = {(*k, p, c, i + 1) for k, v in seen.items() for i, (p, c) in enumerate(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:8])}
    got = catalog.common_phrases(spark.createDataFrame(docs, "lang string, w array<string>").filter("size(w) > 0"), 8)
    assert {tuple(r) for r in got.collect()} == want


def cosines(sf_dir):
    df = frame(sf_dir, "embeddings", "vec_id", "embedding").sort_values("vec_id")
    m = np.stack(df["embedding"]).astype("float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = df["vec_id"].to_numpy()
    return {int(q): dict(zip(ids.tolist(), np.round(m @ m[i], 6).tolist())) for i, q in enumerate(ids) if q % 100 == 0}


def first(scores, k):
    return sorted(((i, s) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def listed(df, key):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, -r.score, r[key])):
        out.setdefault(r.query_id, []).append((r[key], pytest.approx(r.score, abs=2e-6)))
    return out


def test_every_hundredth_vector_is_searched(spark, sf_dir):
    every = cosines(sf_dir)
    assert len(every) > 1
    assert listed(retrieval.cosine_topk(spark, sf_dir), "vec_id") == {q: first(s, 20) for q, s in every.items()}
    near = {q: first({i: x for i, x in s.items() if i != q}, 20) for q, s in every.items()}
    near = {q: [(i, x) for i, x in s if x >= max(0.30, 0.82 * s[0][1])] for q, s in near.items()}
    assert listed(retrieval.relative_threshold_neighbours(spark, sf_dir), "vec_id") == {q: s for q, s in near.items() if s}


def test_nearest_of_odd_vectors(spark):
    rows = [(1, 5, [1.0, 0.0]), (2, 6, [0.0, 0.0]), (3, 7, [1.0]), (4, 8, []), (5, 9, None), (6, 9, [2.0, 0.0]), (7, None, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = retrieval.nearest(df, df.filter("vec_id in (1, 4)"), 3, itself=False).collect()
    assert sorted((r.query_id, -r.score, r.vec_id, r.label) for r in got) == [(1, -1.0, 6, 9), (1, 0.0, 2, 6), (1, 0.0, 3, 7), (4, 0.0, 1, 5), (4, 0.0, 2, 6), (4, 0.0, 3, 7)]
    assert {(r.vec_id, r.score) for r in retrieval.nearest(df, df.filter("vec_id = 1"), 9).collect()} == {(1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0), (6, 1.0), (7, -1.0)}


@pytest.fixture(scope="module")
def asked(spark, sf_dir, tmp_path_factory):
    """The tables with three questions, of which one has no vector."""
    home = str(tmp_path_factory.mktemp("asked"))
    items = frame(sf_dir, "benchmark", "item_id", "text").sort_values("item_id").head(4)
    items["item_id"] = [0, 100, 101, 1_000_000]
    items.to_parquet(f"{home}/benchmark.parquet")
    for name in ("documents", "embeddings"):
        pd.read_parquet(f"{sf_dir}/{name}.parquet").to_parquet(f"{home}/{name}.parquet")
    return home


def lexical(home):
    docs = [(d, (t or "").lower()) for d, t in frame(home, "documents", "doc_id", "text").itertuples(index=False)]
    out = {}
    for q, text in frame(home, "benchmark", "item_id", "text").itertuples(index=False):
        if q % 100 == 0:
            words = set(re.findall(r"\w{2,}", text.lower())) - set(retrieval.STOP_WORDS)
            each = {d: (10.0 if text.lower() in t else 0.0) + sum(1 + 0.2 * min(n, 5) for n in map(t.count, words) if n) for d, t in docs}
            out[q] = {d: round(s, 6) for d, s in each.items() if s > 0}
    return out


def test_every_hundredth_item_is_asked(spark, asked):
    lex, sem = lexical(asked), cosines(asked)
    got = retrieval.lexical_score_topk(spark, asked).withColumnRenamed("lexical", "score")
    assert listed(got, "doc_id") == {q: first(s, 20) for q, s in lex.items()} and set(lex) == {0, 100, 1_000_000}
    docs = set(frame(asked, "documents", "doc_id")["doc_id"])
    want = {}
    for q in lex:
        total = {}
        for leg in (lex[q], {i: s for i, s in sem.get(q, {}).items() if i in docs}):
            for n, (i, _) in enumerate(first(leg, len(leg)), 1):
                total[i] = total.get(i, 0) + 1 / (60 + n)
        want[q] = first({i: round(s, 6) for i, s in total.items()}, 20)
    assert listed(retrieval.hybrid_rrf(spark, asked), "doc_id") == want
    for query in (retrieval.bm25_topk, catalog.hierarchical_topk, catalog.subject_coverage):
        assert {r.query_id for r in query(spark, asked).collect()} == set(lex)


def test_citations_are_bracketed_whole_numbers(spark):
    texts = [(1, "In 2024 see [4] and [Fonte 7, 12]."), (2, "202 and 4, [x1], [2024] [99999999999999999999] [04] [30]"), (3, "no 123"), (4, None)]
    got = passages.verified_citations(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(4,), (7,), (202,)], "n long"), "k", "n")
    assert {(r.k, r.n_verified, r.invented, r.all_verified) for r in got.collect()} == {(1, 2, "12", False), (2, 1, "30,2024,99999999999999999999", False)}


def test_all_terms_of_a_text(spark):
    rows = spark.createDataFrame([("Within 15 business days 2 Monate, 10 days; x3 days, 12345 days, 4 daysy",), (None,), ("none",)], "text string")
    got = [[tuple(t) for t in r[0]] for r in rows.select(passages.all_terms(F.col("text"))).collect()]
    assert got == [[(1, 15, "BUSINESS_DAYS"), (2, 2, "MONTHS"), (3, 10, "DAYS")], [], []]


def test_terms_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "3 jours or 5 Stunden"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, passages.explicit_terms(spark, str(tmp_path)).collect())) == [(1, 1, 3, "DAYS"), (1, 2, 5, "HOURS")]


def test_coverage_has_no_set_of_a_source(spark, asked):
    query = catalog.subject_coverage(spark, asked)
    assert "collect_set" not in query._jdf.queryExecution().optimizedPlan().toString()
    docs = [(s, (t or "").lower()) for s, t in frame(asked, "documents", "source", "text").itertuples(index=False)]
    want = set()
    for q, text in frame(asked, "benchmark", "item_id", "text").itertuples(index=False):
        words = set(re.findall(r"\w{2,}", text.lower())) - set(retrieval.STOP_WORDS)
        want |= {(q, s, sum(any(w in t for o, t in docs if o == s) for w in words), len(words)) for s in {s for s, _ in docs} if q % 100 == 0}
    assert {(r.query_id, r.source, r.n_covered, r.coverage) for r in query.collect()} == {(q, s, n, round(n / m, 6)) for q, s, n, m in want}


def test_blocks_of_questions_change_nothing(spark, sf_dir, monkeypatch):
    from caseloom.operators import answers, catalog

    queries = [retrieval.hybrid_rrf, retrieval.lexical_score_topk, retrieval.cosine_topk, answers.folded_score_topk, catalog.subject_coverage]
    asked = retrieval.table(spark, sf_dir, "benchmark").filter("text is not null").selectExpr("item_id as query_id", "text as query")
    asked = asked.withColumn("tokens", retrieval.query_tokens(F.col("query")))
    for module in (retrieval, catalog):
        monkeypatch.setattr(module, "_query", lambda *_: asked)
    assert len(retrieval.question_blocks(asked)) == 1
    whole = [sorted(map(str, q(spark, sf_dir).collect())) for q in queries]
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 9)
    blocks = retrieval.question_blocks(asked)
    assert len(blocks) > 2 and sum(b.count() for b in blocks) == asked.count()
    assert [sorted(map(str, q(spark, sf_dir).collect())) for q in queries] == whole
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 1000)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 3000)
    assert len(retrieval.question_blocks(asked)) > 2 and len(retrieval.question_blocks(asked.limit(0))) == 1


def test_vectors_meet_questions_without_a_join(spark):
    """Pairs of matrices as rows of a join come to a task by the thousand; ties, lengths, nulls and zero norms as before."""
    rows = [(i, i % 3, None if i == 7 else [0.0, 0.0] if i == 8 else [1.0, float(i % 5), 2.0] if i % 4 == 0 else [1.0, float(i % 4)]) for i in range(301)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    found = retrieval.nearest(vectors, vectors.filter("vec_id % 100 = 0 or vec_id in (7, 8)"), 20, itself=False)
    also = retrieval.similarities(vectors, vectors.filter("vec_id % 100 = 0"))
    assert not any(j in df._jdf.queryExecution().toString() for df in (found, also) for j in ("NestedLoop", "Cartesian"))

    def cos(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return float(np.round(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), 6))

    every = {q: {i: cos(e, v) for i, _, v in rows} for q, _, e in rows}
    assert {(r.query_id, r.vec_id): pytest.approx(r.semantic, abs=2e-6) for r in also.collect()} == {(q, i): c for q in (0, 100, 200, 300) for i, c in every[q].items()}
    assert listed(found, "vec_id") == {q: first({i: c for i, c in every[q].items() if i != q}, 20) for q in (0, 7, 8, 100, 200, 300)}


def test_pages_are_dealt_once_and_in_more_parts_as_they_grow(spark, sf_dir, monkeypatch):
    from caseloom.functions import fields
    from caseloom.operators import layout, timeline
    from caseloom.sources import tables

    few = [tuple(r) for r in layout.cell_matrix(spark, sf_dir).collect()]
    monkeypatch.setattr(tables, "PART_ROWS", 500)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    for query in (layout.cell_matrix, layout.reading_slots, layout.column_slots, fields.heading_paths, timeline.recipient_label):
        found = query(spark, sf_dir)
        assert f", {n})" in found._jdf.queryExecution().executedPlan().toString(), query.__name__
    assert sorted(few) == sorted(tuple(r) for r in layout.cell_matrix(spark, sf_dir).collect())
