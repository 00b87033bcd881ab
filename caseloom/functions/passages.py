"""Passages of texts and what is read off them: chunks, windows, folds, terms, addresses, citations."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import count_of
from caseloom.sources.tables import table, texts

_BLANKS = r"[ \t\r\n\f\x0B]+"


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the letters they carry, by canonical decomposition."""
    marked = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    marked = {k: v for k, v in marked.items() if v.isascii() and v.isalpha()}
    return "".join(marked), "".join(marked.values())


# Letters that compatibility forms and case folding spell with several.
_SPELLED = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ŉ": "ʼn", "ĳ": "ij"}


def folded(text: Column) -> Column:
    """Lower case without accents; sharp s and ligatures as the letters that they stand for."""
    low = F.lower(text)
    plain = F.translate(low, *_folds())
    for one, several in _SPELLED.items():
        plain = F.replace(plain, F.lit(one), F.lit(several))
    return F.when(F.octet_length(low) != F.length(low), plain).otherwise(low)  # not by a pattern: several in a row slow each other


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def chunks(text: Column, size: int = 600) -> Column:
    """Pieces of at most ``size`` characters, cut at the last space in reach, or hard where that space comes
    before a third of the size. The text is spaced singly first; an empty or null text has no pieces."""
    cut = rf"(?s) ?(.{{1,{size}}}\z|.{{{size // 3},{size}}}(?= )|.{{{size}}})"
    return F.filter(F.regexp_extract_all(one_spaced(F.coalesce(text, F.lit(""))), F.lit(cut), 1), lambda c: c != "")


def window_around(text: Column, pattern: str, radius: int) -> Column:
    """``radius`` characters on both sides of the start of the first match, spaced singly; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    first = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, one_spaced(F.substring(text, first, at - first + radius)))


def clipped(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("…")))


def furniture_signature(line: Column) -> Column:
    """What stays of a line from page to page: no page references, digits as ``#``, letters only."""
    plain = folded(line)
    numbered = F.regexp_replace(F.regexp_replace(plain, r"(^|[^a-z0-9])(pages?|pag|p|fls?|seite) *[0-9]+", "$1 "), "[0-9]+", "#")
    digits = reduce(or_, (F.contains(line, F.lit(d)) for d in "0123456789"))  # few lines have any
    return F.trim(F.regexp_replace(F.when(digits, numbered).otherwise(plain), "[^a-z#]+", " "))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return docs.select("doc_id", F.col("chunk_no").cast("bigint"), F.length("chunk").cast("bigint").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_hash"))


def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.sha2(folded(F.col("text")), 256).alias("fold_hash"))


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty characters on both sides of the first long number of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", window_around(F.col("text"), "[0-9]{4,}", 40).alias("context"))
    return docs.filter("context is not null")


def clip_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", clipped(F.col("text"), 80).alias("clip"), (F.length("text") > 80).alias("cut"))


def furniture_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ only in numbers, marks and page references, in two documents or more of a source."""
    # signed before the lines are exploded, so that the filter does not work every signature out again
    signed = texts(spark, sf_dir).select("source", "doc_id", F.explode(F.transform(F.split("text", "\n"), furniture_signature)).alias("signature")).filter(F.length("signature") >= 4)
    # documents are counted after the rows of one document have been combined, so a hot line costs no task more
    own = signed.groupBy("source", F.sha2("signature", 256).alias("signature_hash"), "doc_id").agg(F.count("*").alias("n"))
    return own.groupBy("source", "signature_hash").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines")).filter("n_docs >= 2")


# Units of a term by language and what they count.
_UNITS = {"BUSINESS_DAYS": "(?:working|business) days?", "DAYS": "days?|jours?|tagen?|tage", "HOURS": "hours?|heures?|stunden?", "MONTHS": "months?|mois|monaten?|monate"}
_TERM = r"(?:^|[^0-9a-z])([0-9]{1,4}) +(" + "|".join(_UNITS.values()) + r")(?:[^a-z]|$)"


def terms(text: Column) -> tuple[Column, Column]:
    """The first term of a text in words like ``15 business days``: its value (null without one) and unit."""
    low = F.lower(F.coalesce(text, F.lit("")))
    value, word = F.regexp_extract(low, _TERM, 1), F.regexp_extract(low, _TERM, 2)
    unit = F.when(value == "", "UNSPECIFIED")
    for name, pattern in _UNITS.items():
        unit = unit.when(word.rlike(f"^(?:{pattern})$"), name)
    return F.when(value != "", value).cast("bigint"), unit


def all_terms(text: Column) -> Column:
    """Every term of a text in its order, as structs of its place from 1, value and unit."""
    # what follows a term is only looked at, so that it can begin the next one
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM.replace("(?:[^a-z]|$)", "(?![a-z])").replace("(?:^|[^0-9a-z])", "(?<![0-9a-z])")), F.lit(0))
    return F.transform(found, lambda t, i: F.struct((i + 1).cast("bigint").alias("term_no"), *(c.alias(n) for c, n in zip(terms(t), ("value", "unit")))))


def explicit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of each document; a document without one has no row."""
    return texts(spark, sf_dir).select("doc_id", F.inline(all_terms(F.col("text"))))


def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page is by its address: tracking parameters and fragments away, the page number by itself."""
    url = F.coalesce("url", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "([?&])ref=[^&]*", "$1"), "[?&]+$", "")
    number = F.regexp_extract(url, "[?&]page=([0-9]+)", 1)
    identity = F.regexp_replace(bare, "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", identity.alias("identity"), F.when(number != "", number).cast("bigint").alias("page_number"), count_of(url, "[?&][a-z]+=").alias("n_params"))


_CITATION = r"(?i)\[(?:Fonte\s*)?[0-9]+(?:\s*,\s*(?:Fonte\s*)?[0-9]+)*\]"


def verified_citations(texts: DataFrame, sources: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers that each text cites as ``[n]``, ``[Fonte n]`` or ``[n, m]``, held against the numbers of ``sources``."""
    groups = F.regexp_extract_all("text", F.lit(_CITATION), F.lit(0))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("[0-9]+"), F.lit(0))))
    # compared as text without leading zeros, as a cited number can have more digits than a bigint holds
    cited = texts.select(key, F.explode(numbers).alias("n")).select(key, F.expr("coalesce(nullif(ltrim('0', n), ''), '0')").alias("n")).distinct()
    known = sources.select(F.col(number).cast("string").alias("n")).distinct().withColumn("known", F.lit(True))
    held = cited.join(known, "n", "left").groupBy(key).agg(F.count("known").alias("n_verified"), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.struct(F.length("n").alias("size"), F.col("n"))))), lambda x: x["n"]), ",").alias("invented"))
    return held.withColumn("all_verified", F.col("invented") == "")


def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text cites, held against the benchmark's items: verified and invented ones."""
    return verified_citations(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


QUERIES = {f.__name__: f for f in (text_chunks, accent_fold, context_windows, clip_turns, furniture_families, explicit_terms, url_identity, citation_verify)}

ORACLE = {
    "text_chunks": r"""
WITH RECURSIVE c AS (
  SELECT doc_id, -1 AS chunk_no, '' AS chunk, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ') AS rest FROM documents
  UNION ALL
  SELECT doc_id, chunk_no + 1, substr(rest, 1, cut), ltrim(substr(rest, cut + 1), ' ')
  FROM (SELECT *, CASE WHEN length(rest) <= 600 THEN length(rest) WHEN s = 0 OR 601 - s < 200 THEN 600 ELSE 601 - s END AS cut
        FROM (SELECT *, strpos(reverse(substr(rest, 1, 601)), ' ') AS s FROM c WHERE rest <> '')))
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, length(chunk) AS n_chars, sha256(chunk) AS chunk_hash FROM c WHERE chunk_no >= 0""",
    "accent_fold": "SELECT doc_id, sha256(replace(strip_accents(lower(text)), 'ß', 'ss')) AS fold_hash FROM documents",
    "context_windows": r"""
WITH a AS (SELECT doc_id, text, strpos(text, regexp_extract(text, '[0-9]{4,}')) AS p FROM documents WHERE regexp_matches(text, '[0-9]{4,}'))
SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, p - 40), p - greatest(1, p - 40) + 40), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ') AS context FROM a""",
    "clip_turns": "SELECT conv_id, turn, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(left(text, 80), ' ') || '…' END AS clip, length(text) > 80 AS cut FROM conversations",
    "furniture_families": r"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower(line)), 'ß', 'ss'), '(^|[^a-z0-9])(pages?|pag|p|fls?|seite) *[0-9]+', '\1 ', 'g'), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), ' ') AS g FROM l)
SELECT source, sha256(g) AS signature_hash, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM s WHERE length(g) >= 4 GROUP BY source, g HAVING count(DISTINCT doc_id) >= 2""",
    "explicit_terms": r"""
WITH m AS (SELECT doc_id, unnest(x) AS hit, unnest(range(1, len(x) + 1)) AS term_no FROM (SELECT doc_id, regexp_extract_all(lower(text), '\b[0-9]{1,4} +(?:(?:working|business) days?|days?|jours?|tagen?|tage|hours?|heures?|stunden?|months?|mois|monaten?|monate)\b') AS x FROM documents)),
p AS (SELECT *, regexp_extract(hit, ' +(.*)$', 1) AS word FROM m)
SELECT doc_id, term_no, CAST(regexp_extract(hit, '^[0-9]+') AS BIGINT) AS value,
  CASE WHEN regexp_full_match(word, '(working|business) days?') THEN 'BUSINESS_DAYS' WHEN regexp_full_match(word, 'days?|jours?|tagen?|tage') THEN 'DAYS' WHEN regexp_full_match(word, 'hours?|heures?|stunden?') THEN 'HOURS' ELSE 'MONTHS' END AS unit FROM p""",
    "url_identity": r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '#.*$', ''), '([?&])ref=[^&]*', '\1', 'g'), '[?&]+$', ''), '^https?://', '') AS identity,
  TRY_CAST(nullif(regexp_extract(u, '[?&]page=([0-9]+)', 1), '') AS BIGINT) AS page_number, len(regexp_extract_all(u, '[?&][a-z]+=')) AS n_params FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)""",
    "citation_verify": r"""
WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\[(?:Fonte\s*)?[0-9]+(?:\s*,\s*(?:Fonte\s*)?[0-9]+)*\]')) AS mark FROM documents),
c AS (SELECT DISTINCT doc_id, coalesce(nullif(ltrim(n, '0'), ''), '0') AS n FROM (SELECT doc_id, unnest(regexp_extract_all(mark, '[0-9]+')) AS n FROM g)),
k AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS n, true AS known FROM benchmark),
h AS (SELECT doc_id, count(known) AS n_verified, coalesce(string_agg(CASE WHEN known IS NULL THEN n END, ',' ORDER BY length(n), n), '') AS invented FROM c LEFT JOIN k USING (n) GROUP BY doc_id)
SELECT *, invented = '' AS all_verified FROM h""",
}
