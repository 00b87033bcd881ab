"""Pairs of lines looked at together, and what a search for recurring lines does with all of them."""

import random

from pyspark.sql import functions as F

from caseloom.functions.passages import folded, furniture_signature
from caseloom.operators import furniture


def test_pairs_looked_at_together_are_as_each_by_itself():
    rnd, n = random.Random(7), 0
    for _ in range(1500):
        percent = rnd.choice([85, 85, 60, 100])
        a = "".join(rnd.choice("abc é") for _ in range(rnd.randint(1, 90)))
        pairs = []
        for _ in range(rnd.randint(0, 5)):
            b = list(a)
            for _ in range(rnd.randint(0, 9)):
                at = rnd.randrange(len(b) + 1)
                b[at : at + rnd.randint(0, 4)] = rnd.choice(["", "x", "ab", "c", "abcab"])
            pairs.append((a, "".join(b) or "z"))
        want = [furniture.ratio(x, y) >= percent / 100 for x, y in pairs]
        assert furniture.all_like(pairs, percent) == want
        assert furniture.common_lengths(a, [b for _, b in pairs], [0] * len(pairs)) == [furniture.common_length(a, b) for _, b in pairs]
        n += sum(want)
    assert n > 1500


def test_signatures_are_made_once_and_single_lines_go_no_further(spark, monkeypatch):
    """Each signature was made for the filter and again for the row, and all lines were joined with families."""
    plans, written, keep = [], {}, furniture.kept

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = keep(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(furniture, "kept", kept)
    rnd = random.Random(8)
    rows = [(d, "header", p, 0, "".join(rnd.choice("abcdefghij") for _ in range(40))) for d in range(20) for p in range(40)]
    rows += [(0, "footer", p, 1, f"same line on page {p}") for p in range(5)] + [(1, "footer", p, 1, f"nearly the same line {'xy'[p]}") for p in range(2)]
    rows += [(None, "footer", p, 1, "of no document") for p in range(3)]
    lines = spark.createDataFrame(rows, "doc int, region string, page int, line int, text string")
    got = {tuple(r)[:4] for r in furniture.recurring(lines).collect()}
    assert got == {(0, "footer", p, 1) for p in range(5)} | {(1, "footer", p, 1) for p in range(2)}
    assert not any("regexp_replace" in line for plan in plans for line in plan.splitlines() if "Filter" in line)
    assert written["decided"] <= 2 and sum(plan.count("regexp_replace") > 0 for plan in plans) == 1


def test_signatures_with_and_without_digits(spark):
    texts = ["Page 3 of 12", "fls. 7", "Straße ﬁn 2024", "ÉTÉ", "p7", "seite  9x", "٣ abc", None, "", "a1b2", "ß", "plain words, only"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(folded(F.col("t")), r"(^|[^a-z0-9])(pages?|pag|p|fls?|seite) *[0-9]+", "$1 ")
    always = F.trim(F.regexp_replace(F.regexp_replace(plain, "[0-9]+", "#"), "[^a-z#]+", " "))
    assert all(a == b for a, b in df.select(furniture_signature(F.col("t")), always).collect())
    assert [r[0] for r in df.select(folded(F.col("t"))).collect()][2:4] == ["strasse fin 2024", "ete"]
