"""Folios of pages: candidates of three kinds, one choice that rises from page to page, and what lies between.

A stamp names its folio after words of filing, the tail of a page may hold one, and the body cites others. No page alone
tells which is its own; of all ways to take at most one candidate a page so that folios rise strictly, the one with the
most confidence is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import table

# Words before a folio in a stamp, and how folios and case numbers are written.
_CASE = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
_STAMP = rf"protocolado\s+em|liberado\s+nos\s+autos\s+em|processo\s+{_CASE}|código\s+[A-Za-z0-9]+"
_FOLIO = r"fls\.\s*(\d{1,9})"
_CITED = r"(?:fls?\.?|folhas?)\s*(\d{1,9})"
#: Characters at the end of a page that are its tail.
TAIL = 350
#: Confidence in hundredths.
SURE, STAMPED, IN_TAIL, CITED = 100, 80, 90, 20


def candidates(pages: DataFrame, case_id: str | None = None) -> DataFrame:
    """``doc, page, folio, source, weight`` of ``pages (doc, page, text)``: each folio of a page once, by its best kind.

    A stamp is a folio with words of filing between it and the folio before it; it is sure if no case is looked for or its
    words name the case, and is a citation if they name another. The last folio of a page's tail is its own unless stamped.
    Null and blank pages have none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(rf"(?is)(.*?){_FOLIO}"), F.lit(1)).alias("words"), F.regexp_extract_all(text, F.lit(rf"(?is)(.*?){_FOLIO}"), F.lit(2)).alias("n"))
    digits = "".join(c for c in case_id or "" if c.isdigit())
    cases = lambda c: F.transform(F.regexp_extract_all(c, F.lit(rf"({_CASE})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))

    def stamp(x: Column) -> Column:
        words = x["words"]
        other = F.exists(cases(words), lambda c: c != digits) if digits else F.lit(False)
        named = F.exists(cases(words), lambda c: c == digits) if digits else F.lit(True)
        return F.struct(x["n"].cast("bigint").alias("folio"), F.when(other, "body_citation").otherwise("court_stamp").alias("source"), F.when(other, CITED).when(named, SURE).otherwise(STAMPED).alias("weight"))

    stamps = F.transform(F.filter(found, lambda x: x["words"].rlike(rf"(?is){_STAMP}")), stamp)
    kind = lambda n, source, weight: F.struct(n.cast("bigint").alias("folio"), F.lit(source).alias("source"), F.lit(weight).alias("weight"))
    last = F.try_element_at(F.regexp_extract_all(F.right(text, F.lit(TAIL)), F.lit(f"(?i){_FOLIO}"), F.lit(1)), F.lit(-1))
    tail = F.when(last.isNull(), F.array().cast("array<struct<folio:bigint,source:string,weight:int>>")).otherwise(F.array(kind(last, "page_tail", IN_TAIL)))
    cited = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){_CITED}"), F.lit(1)), lambda n: kind(n, "body_citation", CITED))
    every = pages.select("doc", "page", F.explode(F.concat(stamps, tail, cited)).alias("c")).select("doc", "page", "c.*")
    rank = F.when(F.col("source") == "court_stamp", 2).when(F.col("source") == "page_tail", 1).otherwise(0)
    best = every.groupBy("doc", "page", "folio").agg(F.max(F.struct(rank.alias("r"), "weight", "source")).alias("b"))
    return best.select("doc", "page", "folio", "b.source", "b.weight")


def heaviest_chain(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``(page, folio)`` of the choice from ``(page, folio, weight)`` rows: at most one a page, rising strictly, of the
    greatest weight; of equal ones that whose last folio is least, and so on backwards.

    One pass over the pages. ``ends`` holds the folios at which a chain ends that no chain to a lower folio outweighs, so a
    folio's best chain before it is its left neighbour's.
    """
    ends: list[int] = []
    best: dict[int, tuple[int, int]] = {}  # folio: weight of the chain that ends there, number of its last link
    links: list[tuple[int, int, int]] = []  # page, folio, link before
    # a page's candidates from the greatest folio down, so that none follows another of its own page
    for page, folio, weight in sorted(rows, key=lambda r: (r[0], -r[1], -r[2])):
        at = bisect_left(ends, folio)
        before, link = best[ends[at - 1]] if at else (0, -1)
        total = before + weight
        if at < len(ends) and ends[at] == folio and best[folio][0] >= total:
            continue
        links.append((page, folio, link))
        if not (at < len(ends) and ends[at] == folio):
            insort(ends, folio)
        best[folio] = (total, len(links) - 1)
        at = bisect_left(ends, folio) + 1
        while at < len(ends) and best[ends[at]][0] <= total:
            del best[ends[at]]
            del ends[at]
    out, link = [], best[ends[-1]][1] if ends else -1
    while link >= 0:
        page, folio, link = links[link]
        out.append((page, folio))
    return out[::-1]


def anchors(found: DataFrame) -> DataFrame:
    """``doc, page, folio``: the chain of each document of ``found (doc, page, folio, weight)``. A document's candidates, three
    numbers each, are one task's; documents spread."""
    kind = found.schema["doc"].dataType.simpleString()

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        chain = heaviest_chain(list(zip(frame.page.tolist(), frame.folio.tolist(), frame.weight.tolist())))
        return pd.DataFrame([(frame.doc.iloc[0], *x) for x in chain], columns=["doc", "page", "folio"])

    held = found.filter("doc is not null").groupBy("doc", "page", "folio").agg(F.max("weight").cast("bigint").alias("weight"))
    return held.select("doc", F.col("page").cast("bigint").alias("page"), F.col("folio").cast("bigint").alias("folio"), "weight").groupBy("doc").applyInPandas(chosen, f"doc {kind}, page bigint, folio bigint")


def resolved(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``doc, page, folio, resolution`` for every page of ``pages (doc, page)``.

    EXPLICIT pages are anchors. Others are INFERRED by the offset (folio less page) of the next anchor, or of the last one
    behind the last. In a document without anchors a page with several candidates is AMBIGUOUS, another UNKNOWN.
    """
    chain = anchors(found).withColumn("offset", F.col("folio") - F.col("page"))
    several = found.groupBy("doc", "page").agg(F.count("*").alias("n"))
    own = pages.select("doc", F.col("page").cast("bigint").alias("page")).distinct().join(chain, ["doc", "page"], "left").join(several, ["doc", "page"], "left")
    w = Window.partitionBy("doc").orderBy("page")
    ahead = F.first("offset", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last("offset", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    offset = F.coalesce(ahead, behind)
    state = F.when(F.col("folio").isNotNull(), "EXPLICIT").when(F.col("_o").isNotNull(), "INFERRED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNKNOWN")
    return own.withColumn("_o", offset).select("doc", "page", F.coalesce("folio", F.col("page") + F.col("_o")).alias("folio"), state.alias("resolution"))


def folio_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each user's file are events by time; the ``k`` of an event is the number that it shows, a purchase stamps it,
    a click shows it at the foot, a view cites it, an error has none."""
    ev = table(spark, sf_dir, "events")
    placed = ev.select(F.col("user_id").alias("doc"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("page"), F.get_json_object("props", "$.k").cast("bigint").alias("folio"), "event_type")
    weight = F.when(F.col("event_type") == "purchase", SURE).when(F.col("event_type") == "click", IN_TAIL).when(F.col("event_type") == "view", CITED)
    found = placed.withColumn("weight", weight).filter("weight is not null and folio is not null")
    return resolved(placed, found).withColumnRenamed("doc", "user_id")


QUERIES = {"folio_chains": folio_chains}
ORACLE: dict[str, str] = {}
