"""Fuzzy furniture against all pairs of lines, and names in windows against a search for every name."""

import random
import re
import time
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from caseloom.functions.passages import furniture_signature
from caseloom.operators import furniture, names


def slow_furniture(rows):
    """rows: (doc, region, page, line, norm). Families in order of first appearance, then runs."""
    out = set()
    for key in {r[:2] for r in rows}:
        own = sorted(r[2:] for r in rows if r[:2] == key)
        heads, family = [], {}
        for _, _, norm in own:
            if norm not in family:
                head = next((h for h in heads if SequenceMatcher(None, h, norm, autojunk=False).ratio() >= 0.85), None)
                if head is None:
                    heads.append(norm)
                family[norm] = head or norm
        for head in heads:
            run = []
            for page, line, norm in [*(x for x in own if family[x[2]] == head), (10**9, 0, "")]:
                if run and page - run[-1][0] > 2:
                    if len(run) > 1:
                        out |= {(*key, *x, head) for x in run}
                    run = []
                run.append((page, line))
    return out


def test_shared_pairs_are_a_necessary_condition():
    rnd = random.Random(1)
    for _ in range(4000):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randint(4, 24)))
        b = list(a)
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "ab", "c"])
        b = "".join(b)
        if len(b) >= 4 and furniture.ratio(a, b) >= 0.85:
            assert set(furniture.rarest(a, {})) & set(furniture.rarest(b, {})) and furniture.like(a, b), (a, b)


def test_common_length_bounds_the_blocks():
    rnd = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 40))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        assert furniture.common_length(a, b) == row[-1] >= furniture.ratio(a, b) * (len(a) + len(b)) / 2 - 1e-9
        assert furniture.like(a, b) == (furniture.ratio(a, b) >= 0.85)


def test_recurring_lines_against_all_pairs(spark):
    rnd = random.Random(2)
    base = ["court of appeals first chamber", "confidential draft of the parties", "case number # page", "annex to the minutes"]
    rows = [("d0", "header", p, 0, t) for p, t in enumerate(["abcdefghij", "abcdefghix", "abcdefghxy", None, "", "abc"])]
    for doc in ("d1", "d2"):
        for page in range(60):
            for line, region in enumerate(("header", "footer")):
                text = list(rnd.choice(base))
                for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
                    text[rnd.randrange(len(text))] = rnd.choice("abcxyz")
                rows.append((doc, region, page * rnd.choice([1, 1, 2]), line + page * 2, "".join(text)))
    lines = spark.createDataFrame([*rows, rows[7]], "doc string, region string, page int, line int, text string").repartition(3)
    signed = lines.distinct().withColumn("norm", furniture_signature(F.col("text"))).filter("length(norm) >= 4")
    want = slow_furniture([tuple(r) for r in signed.select("doc", "region", "page", "line", "norm").collect()])
    few = furniture.FEW
    try:
        for furniture.FEW in (few, 1):
            assert {tuple(r)[:5] for r in furniture.recurring(lines).collect()} == want and len(want) > 60
    finally:
        furniture.FEW = few
    assert furniture.recurring(lines.limit(0)).count() == 0


def plain(text):
    text = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()
    return " ".join(re.sub(r"[^A-Za-z0-9\s]", " ", text).upper().split())


def slow_near(texts, parties, mark, roles):
    out = set()
    for doc, text in texts:
        for m in re.finditer(mark, text or ""):
            window = text[max(0, m.start() - 900) : m.end() + 350]
            hit = [(i, r) for i, n, r in parties if plain(n) and plain(n) in plain(window)]
            role = next((r for r, p in roles if re.search(p, window.lower())), None)
            mine = [i for i, r in hit if r == role and role]
            if hit:
                party, how = (hit[0][0], "UNIQUE") if len(hit) == 1 else (mine[0], "ROLE") if len(mine) == 1 else (None, None)
                out.add((doc, *m.span(), len(hit), party, how))
    return out


ROLES = [("R", r"\br[eé]u\b"), ("C", r"\bautora?\b")]


def test_names_in_windows(spark):
    rnd = random.Random(3)
    parties = [(1, "Ana  Maria", "R"), (2, "JOSÉ d'Ávila", "C"), (3, "Ávila", "C"), (4, "ana", "C"), (5, "", "R"), (6, None, "R"), (7, "Straße Ltd.", "R"), (8, "Straße  Ltd", "R"), (9, "ﬁx 9", "C")]
    words = ["ana", "Maria", "María", "josé d'avila", "Jose  D’Ávila", "OAB 12345", "réu", "autora", "x", "Strasse", "Straße ltd", "ﬁx 9", "FIX-9", "…", "\n", "word " * 30, "漢字", "é"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "OAB 1"), (3, "OAB 12 ana"), (103, ("Ana Maria " + "y" * 200 + " OAB 77 ") * 300)]
    want = slow_near(texts, parties, r"OAB \d+", ROLES)
    table = spark.createDataFrame([*texts, texts[0]], "doc_id bigint, text string").repartition(3)
    held = spark.createDataFrame(parties, "id int, name string, role string")
    size = names.BLOCK_BYTES
    try:
        for names.BLOCK_BYTES in (size, 60):
            got = [tuple(r) for r in names.parties_near(table, held, r"OAB \d+", ROLES).collect()]
            assert set(got) == want and len(got) == len(want) and {x[5] for x in want} == {"UNIQUE", "ROLE", None}
    finally:
        names.BLOCK_BYTES = size
    assert names.parties_near(table.limit(0), held, "x", ROLES).count() == names.parties_near(table, held.limit(0), "x", ROLES).count() == 0


def test_time_does_not_grow_with_the_names():
    text, took = "some words of a text OAB 123 and more of them " * 4000, []
    for n in (10, 100_000):
        held = names.Parties([(i, f"name {i} of someone", "R") for i in range(n)])
        began = time.perf_counter()
        held.hits(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 1
