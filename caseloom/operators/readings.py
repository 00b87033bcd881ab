"""Two readings of one page held against each other: what both have in order, what moved, what one has lost or recovered.

The blocks that both readings have in one order are a longest common subsequence; blocks that both have but not in that
order have moved. It is found as a longest rising chain among the places of equal blocks (Hunt and Szymanski), so it
costs what the equal blocks are, not the product of the lengths.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.tables import table


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of a longest common subsequence of two lists, rising."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict = {}
    for j in range(len(b) - tail - 1, head - 1, -1):  # from the back, so that one block of a takes one place at most
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple[int, int, int]] = []
    last: list[int] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            at = bisect_left(ends, j)
            links.append((i, j, last[at - 1] if at else -1))
            if at == len(ends):
                ends.append(j)
                last.append(len(links) - 1)
            else:
                ends[at], last[at] = j, len(links) - 1
    middle, link = [], last[-1] if last else -1
    while link >= 0:
        i, j, link = links[link]
        middle.append((i, j))
    return [(i, i) for i in range(head)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def states(a: list, b: list) -> tuple[list[str], list[str]]:
    """KEPT, MOVED or LOST for each block of the first reading, KEPT, MOVED or RECOVERED for each of the second. Of equal
    blocks out of order the earliest in each reading have moved, as many as both have."""
    pairs = common(a, b)
    one, two = [""] * len(a), [""] * len(b)
    for i, j in pairs:
        one[i] = two[j] = "KEPT"
    rest_a = Counter(x for x, s in zip(a, one) if not s)
    rest_b = Counter(x for x, s in zip(b, two) if not s)
    moved = rest_a & rest_b
    for blocks, told, gone in ((a, one, "LOST"), (b, two, "RECOVERED")):
        left = moved.copy()
        for i, x in enumerate(blocks):
            if not told[i]:
                told[i] = "MOVED" if left[x] > 0 else gone
                left[x] -= 1
    return one, two


def compared(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``page, first, second, n_kept, n_moved, n_lost, n_recovered`` for each of ``pairs (page, first, second)``: two readings
    whose blocks are in ``blocks (reading, place, block)``. A reading without blocks has lost or recovers all; null blocks
    are blocks like others; ties of place go by block."""
    own = blocks.select("reading", F.struct("place", F.sha2(F.coalesce(F.concat(F.lit("="), "block"), F.lit("")), 256).alias("h")).alias("x"))
    lists = own.groupBy("reading").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]).alias("blocks"))
    none = F.array().cast("array<string>")
    both = pairs.join(lists.select(F.col("reading").alias("first"), F.col("blocks").alias("a")), "first", "left").join(lists.select(F.col("reading").alias("second"), F.col("blocks").alias("b")), "second", "left")

    @F.pandas_udf("struct<n_kept:bigint,n_moved:bigint,n_lost:bigint,n_recovered:bigint>")
    def told(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            one, two = states(list(x), list(y))
            rows.append((one.count("KEPT"), one.count("MOVED"), one.count("LOST"), two.count("RECOVERED")))
        return pd.DataFrame(rows, columns=["n_kept", "n_moved", "n_lost", "n_recovered"])

    out = both.select("page", "first", "second", told(F.coalesce("a", none), F.coalesce("b", none)).alias("t"))
    return out.select("page", "first", "second", "t.*")


def reading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a page are the documents of a source that begin alike; each is held against the first of them, sentence by
    sentence."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "text", F.left("text", F.lit(40)).alias("head"))
    first = docs.groupBy("source", "head").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = docs.join(first, ["source", "head"]).filter("doc_id <> first").select(F.sha2(F.concat_ws("\x1f", "source", "head"), 256).alias("page"), "first", F.col("doc_id").alias("second")).distinct()
    wanted = pairs.select(F.col("first").alias("doc_id")).unionByName(pairs.select(F.col("second").alias("doc_id"))).distinct()
    held = docs.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    blocks = held.select(F.col("doc_id").alias("reading"), F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("place", "block"))
    return compared(pairs, blocks).drop("page")


QUERIES = {"reading_changes": reading_changes}
ORACLE: dict[str, str] = {}
