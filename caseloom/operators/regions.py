"""Table regions of a page: seeds that grow line by line, boxes that join unless prose stands between them.

A line counts for a table by its score, from 0 (prose) to 1. Seeds score high; lines that score less are taken in while
they stand next to what is in already; what hangs together is a box. Boxes above each other are one region if they share
room sideways and no line between them speaks against it: one that is surely prose where they are close, one that is
rather prose where they are apart. All of it is within a page, whose lines are few; pages spread.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.tables import printed
from caseloom.sources.tables import table

#: Scores of seeds and of lines that may be taken in; points between neighbours; points up to which boxes are close, and up
#: to which they may join at all; scores under which a line parts close boxes, and such that are apart.
SEED, GROW, NEXT_TO, CLOSE, FAR, SURE_PROSE, RATHER_PROSE = 0.7, 0.35, 20.0, 60.0, 160.0, 0.2, 0.4


class Line(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    score: float


def _beside(a: Line, b: Line) -> bool:
    """Whether two lines share room sideways."""
    return min(a.x1, b.x1) > max(a.x0, b.x0)


def _apart(a: Line, b: Line) -> float:
    """Points from one to the other, up or down."""
    return max(a.y0 - b.y1, b.y0 - a.y1, 0.0)


def _components(n: int, edges: list[tuple[int, int]]) -> list[int]:
    top = list(range(n))

    def head(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in edges:
        x, y = sorted((head(a), head(b)))
        top[y] = x
    return [head(i) for i in range(n)]


def grown(lines: list[Line]) -> list[int]:
    """The lines in any box: seeds, and what may be taken in next to them, to the end. Lines come from the top."""
    inside = [x.score >= SEED for x in lines]
    waiting = [i for i, x in enumerate(inside) if x]
    while waiting:
        i = waiting.pop()
        for step in (-1, 1):
            j = i + step
            # past lines of the same height that share no room with this one
            while 0 <= j < len(lines) and _apart(lines[i], lines[j]) <= NEXT_TO:
                if not inside[j] and lines[j].score >= GROW and _beside(lines[i], lines[j]):
                    inside[j] = True
                    waiting.append(j)
                j += step
    return [i for i, x in enumerate(inside) if x]


def union(lines: list[Line]) -> Line:
    return Line(min(x.x0 for x in lines), min(x.y0 for x in lines), max(x.x1 for x in lines), max(x.y1 for x in lines), 0.0)


def barred(a: Line, b: Line, lines: list[Line]) -> bool:
    """Whether a line between two boxes parts them."""
    upper, lower = (a, b) if a.y0 >= b.y0 else (b, a)
    gap = upper.y0 - lower.y1
    if gap <= 0:
        return False
    least = RATHER_PROSE if gap > CLOSE else SURE_PROSE
    return any(x.score < least and x.y0 >= lower.y1 - 2 and x.y1 <= upper.y0 + 2 for x in lines)


def regions(lines: list[Line]) -> dict[int, int]:
    """The region of each line that is in one, by the first line of the region."""
    lines = sorted(lines, key=lambda x: (-x.y1, x.x0, -x.y0, x.x1, x.score))
    inside = grown(lines)
    near = []
    for k, i in enumerate(inside):
        for m in range(k + 1, len(inside)):
            j = inside[m]
            if lines[i].y0 - lines[j].y1 > NEXT_TO:
                break
            if _beside(lines[i], lines[j]):
                near.append((k, m))
    box = _components(len(inside), near)
    members: dict[int, list[Line]] = {}
    for k, i in enumerate(inside):
        members.setdefault(box[k], []).append(lines[i])
    names = sorted(members)
    hulls = [union(members[b]) for b in names]
    joins = [(x, y) for x in range(len(names)) for y in range(x + 1, len(names)) if _apart(hulls[x], hulls[y]) <= FAR and _beside(hulls[x], hulls[y]) and not barred(hulls[x], hulls[y], lines)]
    whole = _components(len(names), joins)
    at = {b: names[whole[x]] for x, b in enumerate(names)}
    return {i: inside[at[box[k]]] for k, i in enumerate(inside)}


def assembled(lines: DataFrame, key: list[str]) -> DataFrame:
    """``key, region, n_lines, n_taken_in, x0, y0, x1, y1``: the regions of each page of ``lines (key, x0, y0, x1, y1, score)``,
    numbered from the top. Lines without a box or a score are none; a page without seeds has no region; equal lines count
    as often as they stand."""

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        own = sorted((Line(*r) for r in zip(frame.x0, frame.y0, frame.x1, frame.y1, frame.score)), key=lambda x: (-x.y1, x.x0, -x.y0, x.x1, x.score))
        groups: dict[int, list[Line]] = {}
        for i, head in regions(own).items():
            groups.setdefault(head, []).append(own[i])
        rows = []
        for n, head in enumerate(sorted(groups)):
            hull = union(groups[head])
            rows.append((*frame[key].iloc[0], n, len(groups[head]), sum(x.score < SEED for x in groups[head]), *hull[:4]))
        return pd.DataFrame(rows, columns=[*key, "region", "n_lines", "n_taken_in", "x0", "y0", "x1", "y1"])

    kinds = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in key)
    held = lines.select(*key, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "score")]).dropna()
    return held.groupBy(*key).applyInPandas(told, f"{kinds}, region bigint, n_lines bigint, n_taken_in bigint, x0 double, y0 double, x1 double, y1 double")


#: Printed lines of a page in ``barrier_regions``.
PAGE_LINES = 60


def barrier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table regions on the pages of documents with bars: a line scores by its bars among its words."""
    runs = printed(table(spark, sf_dir, "documents"))
    words = F.sum(F.size(F.split("text", r"\s+")))
    lines = runs.groupBy("doc_id", "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), ((F.count("*") - 1) / F.greatest(words - 1, F.lit(1))).alias("score"))
    return assembled(lines.withColumn("page", F.floor(F.col("band") / PAGE_LINES)), ["doc_id", "page"])


QUERIES = {"barrier_regions": barrier_regions}
ORACLE: dict[str, str] = {}
