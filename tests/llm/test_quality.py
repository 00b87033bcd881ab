"""Quality rules against counts in plain Python, on texts that are null, empty, long, repeated and odd."""

import random
import re
from collections import Counter

from caseloom.llm import quality
from tests.llm.test_spark_ops import docs_of

WORD = "[^\x20\x09-\x0d]+"


def slow(text):
    t = text or ""
    words, lines = re.findall(WORD, t), [x for x in t.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    low = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w).rstrip(".,;:!?")
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_lines": len(lines),
        "n_signs": sum(c in quality.SIGNS for c in t),
        "n_stop_words": sum(low(w) in quality.STOP_WORDS for w in words),
        "n_echoes": sum(a == b for a, b in zip(words, words[1:])),
    }


def texts():
    rnd = random.Random(11)
    line = "the and of one two three four five"
    out = [None, "", " \n\t", "\x0b\x0c\r", "a", "\xa0 \x85  ", "a\n\na\n a\na ", "É é\nÉ é\nthe. The! LES?", "#*$%&|<> a\\b \"q\" 'x'"]
    out += [f"{line}\n{line}", f"{line} {line} {line}", f"{line} x {line[4:]} {line}", "w " * 7, "w " * 8, "w " * 9, "the cat " * 30000]
    for _ in range(60):
        words = [rnd.choice("ab") if rnd.random() < 0.7 else rnd.choice(["the", "de", "𝒳y", "é", "|", "x\x00y"]) for _ in range(rnd.randint(1, 90))]
        out.append("".join(w + rnd.choice([" ", "\n", "  ", "\r\n", "\t"]) for w in words))
    return out + [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(50_000)), out[20]]


def test_measures_and_verdicts(spark):
    docs = docs_of(spark, texts())
    got = quality.judged(docs.unionByName(docs.limit(3))).collect()
    assert len(got) == docs.count() + 3
    for r in got:
        want = slow(texts()[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        failed = [x.name for x in quality.RULES if (x.least is not None and 100 * want[x.part] < x.least * want[x.whole]) or (x.most is not None and 100 * want[x.part] > x.most * want[x.whole])]
        assert (r["base_failed"], r["failed"], r["kept"]) == (base, failed, not base and not failed)


def test_own_table_of_rules_and_empty_table(spark):
    docs = docs_of(spark, ["one two three four five six seven eight nine ten " * 2 + "!", "plain words that differ " + " ".join(map(str, range(40)))])
    kept = {r["doc_id"]: r["failed"] for r in quality.judged(docs, (quality.Rule("digits", "n_signs", "n_words", least=1),)).collect()}
    assert kept == {0: [], 1: ["digits"]}
    assert quality.judged(docs.limit(0)).count() == 0


def test_no_shuffle_and_no_python(spark):
    plan = quality.judged(docs_of(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
