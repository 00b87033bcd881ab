"""Recurring headers and footers whose words differ a little from page to page.

Two lines are alike if their matching blocks (the longest common block, then what stands on both sides of it) hold 85
in a hundred of their characters. No two lines are compared before they share a rare pair of letters: if 2 M / (la + lb)
is to reach the bound, at most U = la + lb - 2 M characters lie between blocks, so there are at most U + 1 blocks and at
least M - U - 1 common pairs of neighbouring letters. Lines that share so many must share one among the rarest few of
each (a prefix filter); those pairs are verified exactly. Where a document has only a few lines in a region, the lines
meet without that detour.

Families are greedy: a line joins the earliest line before it that heads a family and is like it, else it heads one
itself. Lines decide in rounds, as soon as what stands before them has.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.passages import furniture_signature
from caseloom.sources.tables import dealt, kept, texts

#: Least similarity in percent, most pages between two of a run, fewest characters of a line that counts, and lines of a
#: document's region that are few.
SIMILARITY, PAGE_GAP, LEAST_CHARS, FEW = 85, 2, 4, 128
KEY = ["doc", "region"]


def ratio(a: str, b: str) -> float:
    """Share of both lines that lies in matching blocks."""
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


@functools.lru_cache(maxsize=4096)
def pairs_of(line: str) -> Counter:
    """How often each pair of neighbouring letters stands in a line; a line meets several others in a row."""
    return Counter(map(str.__add__, line, line[1:]))


@functools.lru_cache(maxsize=4096)
def _places(line: str) -> dict[str, int]:
    """The places of each character of a line as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(line):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(a: str, b: str) -> int:
    """Length of a longest common subsequence, all places of ``a`` at once; matching blocks hold no more."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _reach(row: int, size: int, done: int, left: int) -> int:
    """No common subsequence is longer: the bits of ``row`` that are off tell how much of each start of a line of ``size`` is
    common with the letters read; of the rest no more is common than either side has ``left``. Starts go by sixteenths."""
    step = max(4, size // 16)
    out = 0
    for i in range(0, size, step):
        end = min(size, i + step)
        out = max(out, min(done, end - (row & (1 << end) - 1).bit_count()) + min(size - i, left))
    return out


def common_lengths(a: str, lines: list[str], least: list[int]) -> list[int]:
    """``common_length`` of ``a`` and each of ``lines``, whose places lie side by side, a bit apart for what is carried; 0 for
    all if none can have its ``least`` any more, which is looked at on the way."""
    places: dict[str, int] = {}
    full = at = 0
    for line in lines:
        for c, bits in _places(line).items():
            places[c] = places.get(c, 0) | bits << at
        full |= (1 << len(line)) - 1 << at
        at += len(line) + 1

    def rows() -> Iterator[int]:
        left = row
        for line in lines:
            yield left & (1 << len(line)) - 1
            left >>= len(line) + 1

    row, done = full, 0
    for part in (0.4, 0.5, 0.6, 0.75, 1):
        until = int(part * len(a))
        for c in a[done:until]:
            met = row & places.get(c, 0)
            row = (row + met | row - met) & full
        done = until
        if part < 1 and all(_reach(own, len(line), done, len(a) - done) < n for own, line, n in zip(rows(), lines, least)):
            return [0] * len(lines)
    return [len(line) - own.bit_count() for own, line in zip(rows(), lines)]


def letters_of(lines: list[str]) -> np.ndarray:
    """How often each letter stands in each line; letters that share a column only make lines look more alike."""
    return np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 128, minlength=128) for x in lines], np.int32).reshape(-1, 128)


def all_like(pairs: list[tuple[str, str]], percent: int = SIMILARITY) -> list[bool]:
    """``like`` of each pair; only pairs with enough letters in common are looked at, and a line's pairs together."""
    place: dict[str, int] = {}
    one, two = np.array([[place.setdefault(x, len(place)) for x in pair] for pair in pairs], np.int64).reshape(-1, 2).T
    letters = letters_of(list(place))
    size = letters.sum(axis=1)
    common = np.concatenate([np.zeros(0, np.int64), *(np.minimum(letters[one[i : i + 4096]], letters[two[i : i + 4096]]).sum(axis=1) for i in range(0, len(pairs), 4096))])
    out, partners = [False] * len(pairs), {}
    for i in np.flatnonzero(200 * common >= percent * (size[one] + size[two])):
        partners.setdefault(pairs[i][0], []).append(i)
    for a, own in partners.items():
        lines = [pairs[i][1] for i in own]
        least = [-(-percent * (len(a) + len(b)) // 200) for b in lines]
        for i, b, n, m in zip(own, lines, common_lengths(a, lines, least), least):
            out[i] = n >= m and ratio(a, b) >= percent / 100
    return out


def like(a: str, b: str, percent: int = SIMILARITY) -> bool:
    """Whether the matching blocks of both lines hold ``percent`` of them; asked only where enough pairs are shared and a
    common subsequence is long enough."""
    total = len(a) + len(b)
    matched = -(-percent * total // 200)
    if a != b:
        one, two = pairs_of(a), pairs_of(b)
        if sum(map(min, one.values(), map(two.__getitem__, one))) < 3 * matched - total - 1 or 200 * common_length(a, b) < percent * total:
            return False
    return ratio(a, b) >= percent / 100


def least_shared(length: int, percent: int = SIMILARITY) -> int:
    """Pairs of neighbouring letters that a line of ``length`` shares with any line like it."""
    total = length + -(-percent * length // (200 - percent))  # the shortest line that may be like it
    matched = -(-percent * total // 200)
    return max(1, 3 * matched - total - 1)


def rarest(line: str, counts: dict[str, int], percent: int = SIMILARITY) -> list[str]:
    """The pairs of letters, numbered where they repeat, of which a line like ``line`` has one among its own rarest."""
    seen: Counter = Counter()
    pairs = []
    for i in range(len(line) - 1):
        pair = line[i : i + 2]
        seen[pair] += 1
        pairs.append((counts.get(pair, 0), pair, seen[pair]))
    pairs.sort()
    return [f"{pair}{k}" for _, pair, k in pairs[: max(1, len(pairs) - least_shared(len(line), percent) + 1)]]


def alike(norms: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """``doc, region, a, b, at``: norms of one document and region that are alike, ``a`` the earlier by ``at``. ``norms`` has
    with each (``doc, region, norm, at``) the number ``c`` of those of its document and region."""
    many = norms.filter(F.col("c") > FEW)
    letters = many.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("norm") - 1), lambda i: F.substring(F.col("norm"), i, F.lit(2)))).alias("pair"))
    counts = {r["pair"]: r["n"] for r in letters.groupBy("pair").agg(F.count("*").alias("n")).collect()}  # a-z, # and blank: 784 at most

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [rarest(x, counts, percent) for x in batch.column("norm").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], [*batch.schema.names, "keys"])

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        other = rows.select(*on, F.col("norm").alias("b"), F.col("at").alias("at_b"), F.col("n").alias("n_b"))
        near = 100 * 2 * F.least("n", "n_b") >= percent * (F.col("n") + F.col("n_b"))
        earlier = F.struct("at", "norm") < F.struct("at_b", "b")
        return rows.join(other, on).filter(earlier & near).select(*KEY, F.col("norm").alias("a"), "b", "at")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in norms.schema)
    rows = many.mapInArrow(keyed, f"{fields}, keys array<string>").select(*KEY, "norm", "at", F.length("norm").alias("n"), F.explode("keys").alias("k"))
    few = norms.filter(F.col("c").between(2, FEW)).select(*KEY, "norm", "at", F.length("norm").alias("n"))
    pairs = met(few, KEY).unionByName(met(rows, [*KEY, "k"]).distinct())

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = all_like(list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())), percent)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(verified, pairs.schema)


def families(edges: DataFrame) -> DataFrame:
    """``doc, region, norm, head``: each norm that follows another in its family, by ``edges`` as ``alike`` gives them, with
    the norm that heads it; all others head their own."""
    # only norms with an earlier one like them have anything to decide
    open_ = kept(edges.select(*KEY, F.col("b").alias("norm")).distinct(), "open")
    decided = edges.select(*KEY, F.col("a").alias("norm")).distinct().join(open_, [*KEY, "norm"], "left_anti").withColumn("heads", F.lit(True))
    decided = kept(decided, "decided")
    while not open_.isEmpty():
        told = edges.join(open_.withColumnRenamed("norm", "b"), [*KEY, "b"], "left_semi").join(decided.withColumnRenamed("norm", "a"), [*KEY, "a"], "left")
        state = told.groupBy(*KEY, F.col("b").alias("norm")).agg(F.max(F.coalesce("heads", F.lit(False))).alias("follows"), F.count_if(F.col("heads").isNull()).alias("waiting"))
        fresh = kept(state.filter("follows or waiting = 0").select(*KEY, "norm", (~F.col("follows")).alias("heads")), "fresh")
        decided = kept(decided.unionByName(fresh), "decided")
        open_ = kept(open_.join(fresh, [*KEY, "norm"], "left_anti"), "open")
    heads = decided.filter("heads").select(*KEY, F.col("norm").alias("a"))
    followed = edges.join(heads, [*KEY, "a"]).groupBy(*KEY, F.col("b").alias("norm")).agg(F.min_by("a", F.struct("at", "a")).alias("head"))
    return followed.join(decided.filter("not heads").select(*KEY, "norm"), [*KEY, "norm"], "left_semi")


def recurring(lines: DataFrame, percent: int = SIMILARITY, gap: int = PAGE_GAP) -> DataFrame:
    """``doc, region, page, line, family, run``: the lines (``doc, region, page, line, text``) that come again.

    A run is two lines or more of a family with no more than ``gap`` pages from one to the next. Null and short lines
    recur nowhere; equal rows are one; an empty table gives none. Work grows with the lines that share a rare pair of
    letters in one document and region; the number of rounds with the longest chain of lines that each wait for the one before.
    """
    # signatures are written before they are asked for their length, else each would be made twice
    signed = kept(lines.select(*KEY, "page", "line", furniture_signature(F.col("text")).alias("norm")), "signatures")
    held = dealt(signed.filter(F.length("norm") >= LEAST_CHARS).dropna(subset=KEY), "doc").distinct()
    norm, place = Window.partitionBy(*KEY, F.xxhash64("norm"), "norm"), F.struct("page", "line")  # a hash sorts faster than a line
    held = held.withColumn("at", F.min(place).over(norm)).withColumn("again", F.max(place).over(norm) != F.col("at")).withColumn("first", place == F.col("at"))
    held = kept(held.withColumn("c", F.count_if("first").over(Window.partitionBy(*KEY))), "furniture")
    edges = kept(alike(held.filter("first"), percent), "alike")
    # a line that stands once and is like no other comes again nowhere, and that is most of them
    linked = edges.select(*KEY, F.col("a").alias("norm")).unionByName(edges.select(*KEY, F.col("b").alias("norm"))).distinct()
    once = held.filter("not again and c > 1").join(linked, [*KEY, "norm"], "left_semi")
    placed = held.filter("again").unionByName(once).join(families(edges), [*KEY, "norm"], "left").withColumn("head", F.coalesce("head", "norm"))
    w = Window.partitionBy("doc", "region", "head").orderBy("page", "line")
    cut = F.when(F.col("page") - F.lag("page").over(w) <= gap, 0).otherwise(1)
    runs = placed.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = F.count("*").over(Window.partitionBy("doc", "region", "head", "run"))
    return runs.withColumn("n", sizes).filter("n >= 2").select("doc", "region", "page", "line", F.col("head").alias("family"), F.col("run").cast("bigint").alias("run"))


#: Lines of a document's page in ``fuzzy_furniture``.
PAGE_LINES = 3


def fuzzy_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring first and last lines of the pages of each document, three lines to a page."""
    parts = F.split("text", "\n")
    several = texts(spark, sf_dir).filter(F.size(parts) > PAGE_LINES)  # on one page no line comes again
    docs = several.select("doc_id", F.posexplode(parts).alias("line", "text"))
    place = F.col("line") % PAGE_LINES
    region = F.when(place == 0, "header").when(place == PAGE_LINES - 1, "footer")
    lines = docs.select(F.col("doc_id").alias("doc"), region.alias("region"), F.floor(F.col("line") / PAGE_LINES).alias("page"), "line", "text").filter("region is not null")
    found = recurring(lines)
    return found.select(F.col("doc").alias("doc_id"), "region", "page", F.col("line").cast("bigint").alias("line"), F.sha2("family", 256).alias("family"), "run")


#: SQL has no matching blocks; a test compares all pairs.
QUERIES = {"fuzzy_furniture": fuzzy_furniture}
ORACLE: dict[str, str] = {}
