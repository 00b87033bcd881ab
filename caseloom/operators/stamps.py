"""Lateral stamps of filing: what each says, which of a page is its outer one, and runs of pages that one filing made.

A stamp names an event (filed or released), its time, who signed, a protocol number, a verification code and cases. The
outer stamp of a page is that of the case looked for with the most to tell, then the largest. Pages in a row whose outer
stamps tell of one filing are a group; a filing is known by its protocol number, else by all of event, time and signer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.passages import folded

# How the provider writes its stamps.
_START = r"(?i)(?=este\s+documento)"
_EVENT = r"\b(protocolado|liberado nos autos)\s+em\s+(?:(\d{2}/\d{2}/\d{4})[^\d]{0,12})?(?:as\s+)?(\d{1,2}:\d{2})"
_SIGNER = r"(?is)assinado digitalmente por\s+(.+?)(?=,?\s*(?:protocolado|liberado nos autos)\b|\.|$)"
_ISSUER = r"(?i)\s+e\s+Tribunal\s+de\s+Justi.a\s+do\s+Estado\s+de\s+S.o\s+Paulo\s*$"
_PROTOCOL = r"(?i)\b(WPRC[A-Za-z0-9]+)\b"
_CODE = r"(?i)c.{0,3}digo\s+([A-Za-z0-9]+)(?:\.|\s|$)"
_URL = r"(?i)https?://[^\s,]+"
_CASE = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"


def _some(value: Column) -> Column:
    return F.when(value != "", value)


def fields(text: Column) -> Column:
    """What one stamp says, as a struct; what it does not say is null, and its cases are an array."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", " ")
    low = F.trim(F.regexp_replace(folded(plain), r"\s+", " "))
    signer = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(plain, _SIGNER, 1), r"\s+", " ")), _ISSUER, ""))
    return F.struct(
        _some(F.upper(F.regexp_extract(low, _EVENT, 1))).alias("event"),
        _some(F.regexp_extract(low, _EVENT, 2)).alias("event_date"),
        _some(F.regexp_extract(low, _EVENT, 3)).alias("event_time"),
        _some(signer).alias("signer"),
        _some(F.upper(F.regexp_extract(plain, _PROTOCOL, 1))).alias("protocol"),
        _some(F.regexp_extract(plain, _CODE, 1)).alias("code"),
        _some(F.regexp_extract(plain, _URL, 0)).alias("url"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({_CASE})"), F.lit(1)))).alias("cases"),
    )


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def stamps(regions: DataFrame, case_id: str | None = None) -> DataFrame:
    """``doc, page, stamp, text, area, <fields>, filing, artifact, score``: the stamps of ``regions (doc, page, region, x0, y0,
    x1, y1, text)``, numbered on their page; a region may hold several, each from its own opening words on.

    ``filing`` is the digest of a protocol number or of event, date, time and signer together; ``artifact`` of a
    verification code and its cases. Regions that hold no words of a stamp are none; null texts neither.
    """
    low = F.trim(F.regexp_replace(folded(F.coalesce("text", F.lit(""))), r"\s+", " "))
    about = low.rlike("assinado digitalmente por|para conferir o original|pastadigital|liberado nos autos")
    parts = F.filter(F.split("text", _START), lambda x: F.trim(x) != "")
    # words before the first opening belong to a stamp only where there is a single one
    opened = F.filter(parts, lambda x: x.rlike(r"(?i)^este\s+documento"))
    own = F.when(F.size(opened) >= 2, opened).otherwise(F.array("text"))
    rows = regions.filter(about).select("doc", "page", "region", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.posexplode(own).alias("part", "text"))
    told = rows.select("doc", "page", "region", "part", "area", "text", fields(F.col("text")).alias("f")).select("doc", "page", "region", "part", "area", "text", "f.*")
    number = F.row_number().over(Window.partitionBy("doc", "page").orderBy("region", "part"))  # of one page's stamps
    whole = F.col("event").isNotNull() & F.col("event_date").isNotNull() & F.col("event_time").isNotNull() & F.col("signer").isNotNull()
    filing = F.when(F.col("protocol").isNotNull(), _digest("protocol")).when(whole, _digest(F.lit(case_id).alias("case"), "event", "event_date", "event_time", "signer"))
    mine = F.array_contains("cases", case_id) if case_id else F.lit(False)
    score = F.when(mine, 4).when(F.col("protocol").isNotNull(), 3).when(F.col("event").isNotNull(), 2).otherwise(1)
    return told.withColumn("stamp", number).drop("region", "part").withColumn("filing", filing).withColumn("artifact", F.when(F.col("code").isNotNull(), _digest("code", "cases"))).withColumn("score", score)


def outer_stamps(found: DataFrame, case_id: str | None = None) -> DataFrame:
    """The outer stamp of each page of ``stamps``: of those that name the case, if one is looked for, that of the greatest
    score, then area, then number. Pages whose stamps all name other cases have none."""
    mine = found.filter(F.array_contains("cases", case_id)) if case_id else found
    return mine.withColumn("_r", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("score"), F.desc("area"), F.desc("stamp")))).filter("_r = 1").drop("_r")


def filing_groups(outer: DataFrame) -> DataFrame:
    """``doc, filing, first_page, last_page, n_pages``: pages in a row whose outer stamps have one filing."""
    w = Window.partitionBy("doc").orderBy("page")
    same = (F.lag("page").over(w) == F.col("page") - 1) & (F.lag("filing").over(w) == F.col("filing"))
    rows = outer.withColumn("cut", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("filing is not null").groupBy("doc", "filing", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages")).drop("run")
