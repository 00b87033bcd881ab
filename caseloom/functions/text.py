"""Text functions as column expressions: quality, content signals, extraction, dates and JSON."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caseloom.sources.tables import table, texts


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


# Punctuation that prose hardly has, and what counts as a word.
UNUSUAL = '!"#$%&*+<=>?@[\\]^_`{|}~'
_WORD = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]{2,}"
_BLANK = "[ \\t\\n\\x0B\\f\\r]+"


def _kept(text: Column, outside: str) -> Column:
    """How many characters are left of ``text`` without the runs of ``outside``: one pass, not one match a character."""
    return F.length(F.regexp_replace(text, outside, "")).cast("bigint")


def quality_columns(text: Column) -> dict[str, Column]:
    """Counts that the quality classes rest on; null counts as empty. Shares are of the characters that are no blanks."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
    size = F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w))
    return {
        "n_chars": F.length(t).cast("bigint"),
        "n_base": _kept(t, _BLANK),
        "n_letters": _kept(t, r"\P{L}+"),
        "n_digits": _kept(t, "[^0-9]+"),
        "n_unusual": (F.length(t) - F.length(F.translate(t, UNUSUAL, ""))).cast("bigint"),
        "n_c0": _kept(t, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]+"),
        "n_replaced": (F.length(t) - F.length(F.translate(t, "\ufffd", ""))).cast("bigint"),
        "n_words": F.size(words).cast("bigint"),
        "n_word_chars": size,
        "n_long_runs": count_of(t, r"[^ \t\n\x0B\f\r]{40,}"),
        "n_lines": (F.length(t) - F.length(F.translate(t, "\n", "")) + 1).cast("bigint"),
    }


def quality_of() -> tuple[Column, Column]:
    """BAD, SUSPECT or OK from the columns of ``quality_columns``, and the reasons in order."""
    n, base = F.col("n_chars"), F.greatest("n_base", F.lit(1))
    letters, unusual = F.col("n_letters") / base, F.col("n_unusual") / base
    bad = F.array_compact(F.array(
        F.when(n <= 24, "empty_or_near_empty_text"),
        F.when((F.col("n_c0") >= 20) | (F.col("n_c0") >= 0.02 * F.greatest(n, F.lit(1))), "high_c0_control_ratio"),
        F.when(F.col("n_replaced") > 0, "unicode_replacement_characters"),
        F.when((n >= 300) & (letters < 0.20) & (unusual >= 0.08), "low_letter_high_unusual_punctuation"),
        F.when((n >= 500) & (F.col("n_words") < 12), "low_recognized_word_density"),
    ))
    suspect = F.array_compact(F.array(
        F.when(F.col("n_c0") > 1, "c0_controls_present"),
        F.when((n >= 250) & (letters < 0.32) & (unusual >= 0.04), "degraded_character_distribution"),
        F.when((n >= 300) & (F.col("n_words") < 25), "low_word_density"),
    ))
    state = F.when(F.size(bad) > 0, "BAD").when(F.size(suspect) > 0, "SUSPECT").otherwise("OK")
    return state, F.array_join(F.when(F.size(bad) > 0, bad).otherwise(suspect), ",")


# Signals and their patterns; the first three weigh heavily.
SIGNALS = {
    "override": r"(?i)ignore (all |any )?(previous|earlier) (rules|instructions)",
    "secret": r"(?i)(api[_ ]?key|password|secret|token) *[=:]",
    "exfiltrate": r"(?i)(send|post|upload) .{0,40}https?://",
    "address": r"https?://",
    "markup": r"</?[a-zA-Z][^>]*>",
}


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in quality_columns(F.col("text")).items()))


def quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, reasons = quality_of()
    return quality_metrics(spark, sf_dir).select("doc_id", state.alias("quality_class"), reasons.alias("reasons"))


def security_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a conversation's turns, and its risk: high with two heavy ones, medium with any."""
    hit = {k: F.bool_or(F.coalesce(F.col("text").rlike(p), F.lit(False))).alias(k) for k, p in SIGNALS.items()}
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*hit.values())
    heavy = sum((F.col(k).cast("int") for k in ("override", "secret", "exfiltrate")), F.lit(0))
    anything = F.col("override") | F.col("secret") | F.col("exfiltrate") | F.col("address") | F.col("markup")
    return g.withColumn("risk", F.when(heavy >= 2, "high").when(anything, "medium").otherwise("low"))


# What outside content may try to make a reader do, in two languages; all but the first and last are of high
# impact.
CONTENT_SIGNALS = {
    "IGNORE_PREVIOUS_INSTRUCTIONS": r"(?i)\bignore (?:all |any |the )?(?:previous|prior) instructions?\b|\bignore (?:as )?instru[cç][oõ]es (?:anteriores|pr[eé]vias)\b",
    "OVERRIDE_SYSTEM_INSTRUCTIONS": r"(?i)\b(?:override|replace|change) (?:the )?(?:system|developer) (?:prompt|instructions?)\b|\b(?:substitua|altere|ignore) (?:o )?(?:prompt|instru[cç][oõ]es) (?:do )?sistema\b",
    "REQUEST_SYSTEM_PROMPT": r"(?i)\b(?:reveal|show|print|provide) (?:the )?(?:system|developer) prompt\b|\b(?:revele|mostre|exiba|forne[cç]a) (?:o )?prompt (?:do )?sistema\b",
    "REQUEST_SECRET_OR_CREDENTIAL": r"(?i)\b(?:reveal|show|send|provide) (?:(?:all|the) )?(?:secrets?|credentials?|api ?keys?|passwords?)\b|\b(?:revele|mostre|envie|forne[cç]a) (?:(?:os|as) )?(?:segredos?|credenciais|chaves? (?:de )?api|senhas?)\b",
    "EXECUTE_TOOL_OR_COMMAND": r"(?i)\b(?:execute|run|call|invoke|use) (?:the )?(?:tool|command|terminal|shell)\b|\b(?:execute|rode|chame|invoque|use) (?:a )?(?:ferramenta|comando|terminal|shell)\b",
    "ACCESS_UNRELATED_FILES": r"(?i)\b(?:read|open|access) (?:all |the )?(?:files?|filesystem|system files?)\b|\b(?:leia|abra|acesse) (?:todos )?(?:os )?(?:arquivos?|sistema de arquivos)\b",
    "EXFILTRATE_DATA": r"(?i)\b(?:send|upload|exfiltrate|forward) (?:the )?(?:data|files?|contents?) (?:to|via)\b|\b(?:envie|fa[cç]a upload|exfiltre|encaminhe) (?:os )?(?:dados|arquivos?|conte[uú]do) (?:para|por)\b",
    "MODEL_OR_AGENT_DIRECTIVE": r"(?i)\b(?:chatgpt|claude|assistant|ai model|agent),?\s+(?:ignore|follow|do|you must)\b|\b(?:chatgpt|claude|assistente|agente|modelo),?\s+(?:ignore|siga|fa[cç]a|voc[eê] deve)\b",
}
_HEAVY = list(CONTENT_SIGNALS)[1:7]


# Words that say a passage is quoted as evidence, and words that say it is about such instructions.
EVIDENTIARY = r"(?i)\b(?:a instru[cç][aã]o dizia|o invasor enviou|exemplo\s*:|transcri[cç][aã]o\s*:|cita[cç][aã]o\s*:|o texto continha)\b"
DESCRIPTIVE = r"(?i)\b(?:artigo acad[eê]mico|pesquisa acad[eê]mica|laudo t[eé]cnico|explica|analisa|descreve|conceito de prompt injection)\b"
#: Characters on both sides of a signal that tell its context.
CONTEXT_CHARS = 180
#: Each pattern of a signal holds one of these; a text without any has no signal.
_NEEDED = {
    "IGNORE_PREVIOUS_INSTRUCTIONS": ("instru",),
    "OVERRIDE_SYSTEM_INSTRUCTIONS": ("prompt", "instru"),
    "REQUEST_SYSTEM_PROMPT": ("prompt",),
    "REQUEST_SECRET_OR_CREDENTIAL": ("secret", "credential", "api", "password", "segredo", "credenciais", "senha"),
    "EXECUTE_TOOL_OR_COMMAND": ("tool", "command", "terminal", "shell", "ferramenta", "comando"),
    "ACCESS_UNRELATED_FILES": ("file", "arquivo"),
    "EXFILTRATE_DATA": ("data", "file", "content", "dados", "arquivo", "conte"),
    "MODEL_OR_AGENT_DIRECTIVE": ("chatgpt", "claude", "assist", "model", "agent"),
}
_RISKS = ["low", "medium", "high"]


def _inspector():
    """A function from a text to its signals (by name, comma-joined), context and risk."""
    patterns = {k: re.compile(p) for k, p in CONTENT_SIGNALS.items()}
    evidence, description = re.compile(EVIDENTIARY), re.compile(DESCRIPTIVE)

    def inspected(text: str | None) -> tuple[str, str, str]:
        t = text or ""
        t = " ".join((t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)).split())
        # letters that a pattern without regard to case takes for i and s
        low = t.lower() if t.isascii() else t.replace("ſ", "s").lower().replace("\u0307", "").replace("ı", "i")
        hits = {k: m for k, p in patterns.items() if any(w in low for w in _NEEDED[k]) and (m := p.search(t))}
        windows = [t[max(0, m.start() - CONTEXT_CHARS) : m.end() + CONTEXT_CHARS] for m in hits.values()]
        if not hits:
            context = "unknown"
        elif any(evidence.search(w) and re.search("[\'\"“]", w) for w in windows):
            context = "quoted_or_evidentiary"
        else:
            context = "descriptive" if any(description.search(w) for w in windows) else "ambiguous"
        heavy = sum(k in _HEAVY for k in hits)
        return ",".join(sorted(hits)), context, "high" if heavy >= 2 else "medium" if hits else "low"

    return inspected


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("signals", "context", "risk")]))
def content_security(text: pd.Series) -> pd.DataFrame:
    """Signals, context and risk of each text, after compatibility forms and white space are evened out; a null text is
    empty. Compatibility forms are what the JVM lacks."""
    inspected = _inspector()
    return pd.DataFrame([inspected(t) for t in text], columns=["signals", "context", "risk"])


def content_risk(text: Column) -> tuple[Column, Column]:
    """The signals of a text in the order of their names, comma-joined, and its risk: high with two of high impact."""
    told = content_security(text)
    return told["signals"], told["risk"]


def security_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest risk of each source's documents, the signals of all, their context where it is one, and how many have any."""
    rows = texts(spark, sf_dir).select("source", content_security("text").alias("c")).select("source", "c.*")
    rank = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    every = F.array_distinct(F.flatten(F.collect_set(F.split("signals", ","))))  # of at most 256 different lists
    context = F.when(F.min("context") == F.max("context"), F.min("context")).otherwise("ambiguous")
    return rows.groupBy("source").agg(F.max(rank).cast("bigint").alias("risk"), F.array_join(F.array_sort(F.filter(every, lambda x: x != "")), ",").alias("signals"), context.alias("context"), F.count_if(F.col("signals") != "").alias("n_flagged"), F.count("*").alias("n"))


def regex_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    first = lambda p: F.regexp_extract(text, p, 0)
    return texts(spark, sf_dir).select(
        "doc_id", first(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+").alias("first_email"), first(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}").alias("first_ip"), first(r"(SPDX|Copyright|License)[^\n]*").alias("license_line"), count_of(text, "[0-9]{4,}").alias("n_long_numbers")
    )


def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's turn asks for, by the first pattern that fits; ambiguous ones stay unclassified."""
    low = F.lower(F.coalesce("text", F.lit("")))
    date, amount, list_ = low.rlike(r"\b(when|date|deadline|quand|wann)\b"), low.rlike(r"\b(how much|amount|value|price|total)\b|[0-9]+,[0-9]{2}"), low.rlike(r"(^|\n)[-*] ")
    fits = date.cast("int") + amount.cast("int") + list_.cast("int")
    intent = F.when(fits > 1, "AMBIGUOUS").when(date, "DATE").when(amount, "AMOUNT").when(list_, "LIST").otherwise("OTHER")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", intent.alias("intent"), F.length(low).cast("bigint").alias("n_chars"))


def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of mixed spelling to ISO with their precision; what is no date keeps its raw form."""
    raw = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("31/02/"), F.date_format("o_orderdate", "yyyy")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    day = F.coalesce(F.try_to_date(F.regexp_extract("raw", "^[0-9]{2}/[0-9]{2}/[0-9]{4}", 0), "dd/MM/yyyy"), F.try_to_date(F.regexp_extract("raw", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 0), "yyyy-MM-dd"))
    precision = F.when(day.isNull(), "UNKNOWN").when(F.col("raw").rlike(" [0-9]{2}:[0-9]{2}$"), "DATETIME").otherwise("DATE")
    return o.select("o_orderkey", "raw", F.date_format(day, "yyyy-MM-dd").alias("iso"), precision.alias("precision"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


QUERIES = {f.__name__: f for f in (quality_metrics, quality_class, security_signals, security_rollup, regex_extract_fields, intent_classify, date_normalise, json_props)}

_METRICS = r"""m AS (SELECT doc_id, length(t) AS n_chars, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS n_base, length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
  length(regexp_replace(t, '[^!"#$%&*+<=>?@\[\\\]^_`{|}~]', '', 'g')) AS n_unusual, length(regexp_replace(t, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS n_c0, length(t) - length(replace(t, chr(65533), '')) AS n_replaced,
  len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS n_word_chars, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]{40,}')) AS n_long_runs, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]{2,}') AS w FROM documents))"""
ORACLE = {
    "quality_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "quality_class": f"""WITH {_METRICS}, r AS (SELECT *, n_letters::DOUBLE / greatest(n_base, 1) AS l, n_unusual::DOUBLE / greatest(n_base, 1) AS o FROM m),
q AS (SELECT doc_id, concat_ws(',', CASE WHEN n_chars <= 24 THEN 'empty_or_near_empty_text' END, CASE WHEN n_c0 >= 20 OR n_c0 >= 0.02::DOUBLE * greatest(n_chars, 1) THEN 'high_c0_control_ratio' END, CASE WHEN n_replaced > 0 THEN 'unicode_replacement_characters' END,
    CASE WHEN n_chars >= 300 AND l < 0.2 AND o >= 0.08 THEN 'low_letter_high_unusual_punctuation' END, CASE WHEN n_chars >= 500 AND n_words < 12 THEN 'low_recognized_word_density' END) AS bad,
  concat_ws(',', CASE WHEN n_c0 > 1 THEN 'c0_controls_present' END, CASE WHEN n_chars >= 250 AND l < 0.32 AND o >= 0.04 THEN 'degraded_character_distribution' END, CASE WHEN n_chars >= 300 AND n_words < 25 THEN 'low_word_density' END) AS suspect FROM r)
SELECT doc_id, CASE WHEN bad <> '' THEN 'BAD' WHEN suspect <> '' THEN 'SUSPECT' ELSE 'OK' END AS quality_class, CASE WHEN bad <> '' THEN bad ELSE suspect END AS reasons FROM q""",
    "security_signals": """
WITH a AS (SELECT conv_id, coalesce(text, '') AS t FROM conversations),
g AS (SELECT conv_id, bool_or(regexp_matches(t, '(?i)ignore (all |any )?(previous|earlier) (rules|instructions)')) AS override, bool_or(regexp_matches(t, '(?i)(api[_ ]?key|password|secret|token) *[=:]')) AS secret,
  bool_or(regexp_matches(t, '(?i)(send|post|upload) .{0,40}https?://')) AS exfiltrate, bool_or(regexp_matches(t, 'https?://')) AS address, bool_or(regexp_matches(t, '</?[a-zA-Z][^>]*>')) AS markup FROM a GROUP BY conv_id)
SELECT *, CASE WHEN override::INT + secret::INT + exfiltrate::INT >= 2 THEN 'high' WHEN override OR secret OR exfiltrate OR address OR markup THEN 'medium' ELSE 'low' END AS risk FROM g""",
    "security_rollup": "WITH x AS (SELECT source, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM documents), y AS (SELECT source, "
    + ", ".join(f"regexp_matches(t, '{p}') AS {k}" for k, p in CONTENT_SIGNALS.items())
    + " FROM x), z AS (SELECT *, "
    + " + ".join(f"{k}::INT" for k in _HEAVY)
    + " AS h, "
    + " OR ".join(CONTENT_SIGNALS)
    + " AS f FROM y) SELECT source, max(CASE WHEN h >= 2 THEN 2 WHEN f THEN 1 ELSE 0 END)::BIGINT AS risk, concat_ws(',', "
    + ", ".join(f"CASE WHEN bool_or({k}) THEN '{k}' END" for k in sorted(CONTENT_SIGNALS))
    + ") AS signals, CASE WHEN count(*) FILTER (f) = 0 THEN 'unknown' ELSE 'ambiguous' END AS context, count(*) FILTER (f) AS n_flagged, count(*) AS n FROM z GROUP BY source",
    "regex_extract_fields": r"""
SELECT doc_id, regexp_extract(t, '[a-z0-9]+@[a-z0-9]+\.[a-z]+') AS first_email, regexp_extract(t, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS first_ip, regexp_extract(t, '(SPDX|Copyright|License)[^\n]*') AS license_line,
  len(regexp_extract_all(t, '[0-9]{4,}')) AS n_long_numbers FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "intent_classify": r"""
WITH a AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'user'),
b AS (SELECT *, regexp_matches(t, '\b(when|date|deadline|quand|wann)\b') AS d, regexp_matches(t, '\b(how much|amount|value|price|total)\b|[0-9]+,[0-9]{2}') AS m, regexp_matches(t, '(^|\n)[-*] ') AS l FROM a)
SELECT conv_id, turn, CASE WHEN d::INT + m::INT + l::INT > 1 THEN 'AMBIGUOUS' WHEN d THEN 'DATE' WHEN m THEN 'AMOUNT' WHEN l THEN 'LIST' ELSE 'OTHER' END AS intent, length(t) AS n_chars FROM b""",
    "date_normalise": """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%d/%m/%Y %H:%M') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '31/02/' || strftime(o_orderdate, '%Y') END AS raw,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso, CASE o_orderstatus WHEN 'F' THEN 'DATETIME' WHEN 'O' THEN 'DATE' ELSE 'UNKNOWN' END AS precision FROM orders""",
    "json_props": "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'$.k' AS BIGINT)) AS most FROM events GROUP BY event_type",
}
