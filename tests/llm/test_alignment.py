"""Token alignment against a walk over both token lists, byte by byte."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from caseloom.llm import alignment
from tests.llm.test_spark_ops import docs_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slow(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in shown)}
    word_a = lambda i: bytes(shown[c] for c in a.id_to_token(i))
    word_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, corpus = [], Counter()
    for t in texts:
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids
        y = b.encode(t or "")
        links, groups = [], []
        if t and b"".join(map(word_a, x)) == b"".join(map(word_b, y)) == (" " + t).encode():
            i = j = ends_a = ends_b = 0
            left, right = [], []
            while i < len(x) or j < len(y):
                if ends_a <= ends_b:
                    ends_a, i = ends_a + len(word_a(x[i])), i + 1
                    left.append(x[i - 1])
                else:
                    ends_b, j = ends_b + len(word_b(y[j])), j + 1
                    right.append(y[j - 1])
                if ends_a == ends_b:
                    links.append((left[-1], right[-1]))
                    groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                    left, right = [], []
        else:
            x = y = []
        corpus.update(links)
        out.append((len(x), len(y), links, ";".join(groups)))
    best = {}
    for (_, q), n in corpus.items():
        best[q] = max(best.get(q, 0), n)
    return [
        {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": len(links),
            "n_links": len(links),
            "n_best": sum(corpus[p] == best[p[1]] for p in links),
            "count_sum": sum(corpus[p] for p in links),
            "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        }
        for n_a, n_b, links, groups in out
    ], corpus


def texts():
    rnd = random.Random(13)
    out = [None, "", " ", "  two  spaces ", "\n\n\t", "a", "<|endoftext|> and <s> </s> <unk> <0x0A>", "é 𝒳 ▁ \u0000 \x7f", "é ﬁ Ⅳ ｆｕｌｌ", "日本語 العربية 👩‍👩‍👧", " nbsp em", "x" * 3000, "word " * 20_000]
    out += ["".join(rnd.choice(["token", " tok", "isation", "\n", " ", ".", "12", "ß", "ñ", "中", "🙂"]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    return out + ["The same words, again.", "The same words, again."]


@pytest.mark.parametrize("chars", [200, 1_000_000])
def test_alignment_against_a_walk(spark, chars):
    docs = docs_of(spark, texts()).repartition(3)
    before, alignment.SLICE_CHARS = alignment.SLICE_CHARS, chars
    try:
        got = {r["doc_id"]: r for r in alignment.aligned(docs, A, B).collect()}
        pairs = {(r["pair"] // 32000, r["pair"] % 32000): r["n"] for r in alignment.pair_counts(alignment.alignment(docs, A, B)).collect()}
    finally:
        alignment.SLICE_CHARS = before
    want, corpus = slow(texts())
    assert len(got) == len(want) and pairs == dict(corpus)
    for i, row in enumerate(want):
        assert {k: got[i][k] for k in row} == row, i
    assert sum(r["n_a"] > 0 for r in want) > 60


def test_groups_as_text_and_empty_table(spark):
    docs = docs_of(spark, ["Tokens end here.", None])
    shown = {r["doc_id"]: r["groups"] for r in alignment.alignment(docs, A, B, digest=False).collect()}
    plain = {r["doc_id"]: r["groups_sha256"] for r in alignment.alignment(docs, A, B).collect()}
    assert hashlib.sha256(shown[0].encode()).hexdigest() == plain[0] and shown[1] == plain[1] == ""
    assert alignment.aligned(docs.limit(0), A, B).count() == 0


def test_vocabularies_bound_the_pairs():
    pair = alignment.loaded(A, B)
    assert len(pair.words_a) < pair.bound() < 1_000_000
