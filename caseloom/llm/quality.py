"""Quality rules: a table of thresholds compiled into one projection of Spark expressions.

Each rule bounds the share of one measure in another, as whole percents, so that no verdict hangs on a rounded
fraction. Measures are expressions over the text alone: no user function, no shuffle, no second pass. What a measure
shares with another (the words, the lines, the windows) is bound once to a lambda variable and so worked out once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table


class Rule(NamedTuple):
    """``least <= 100 * part / whole <= most``, where a bound is given."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: Words between the bounds of a language text's mean length, few symbols, few signs, some function words of the four
#: languages, few repeated lines, few words said twice in a row.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=250, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("signs", "n_signs", "word_chars", most=20),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("dup_lines", "n_dup_lines", "n_lines", most=40),
    Rule("echoes", "n_echoes", "n_words", most=20),
)

#: The base rule of every table: so many words at least, so large a share of words in repeated windows at most.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Common function words of English, French, German and Spanish.
STOP_WORDS = """the of and to in a is that it for la le les de des et un une que est der die das und ist nicht ein eine zu
mit el los las y en por""".split()

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_signs", "n_stop_words", "n_echoes"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def in_text(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(without(text, chars))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, the first of them included.

    Windows are told apart by 64 bits of hash. Where all differ, which is the common case, nothing is sorted; else
    equal ones become neighbours by a sort, and the union of their places is folded from left to right.
    """

    def covered(marks: Column) -> Column:
        again = F.filter(marks, lambda m, i: (F.get(marks, i - 1)["h"] == m["h"]) | (F.get(marks, i + 1)["h"] == m["h"]))
        starts = F.sort_array(F.transform(again, lambda m: m["i"]))
        nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, nothing, lambda a, i: F.struct((i + window).alias("end"), (a["n"] + F.least(F.lit(window), i + window - a["end"])).alias("n")), lambda a: a["n"])

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bound(placed, covered))

    def windows(codes: Column) -> Column:
        whole = F.slice(codes, 1, F.greatest(F.size(codes) - (window - 1), F.lit(0)))
        return F.transform(whole, lambda _, i: F.xxhash64(*[F.get(codes, i + k) for k in range(window)]))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda codes: bound(windows(codes), counted))


def measures(text: Column) -> Column:
    """All of ``MEASURES`` of a text as one struct of longs; a null text has none of anything."""

    def over(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(without(x, BLANKS)) > 0)
        trimmed = F.btrim(t, F.lit(BLANKS))
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))
        return bound(words, lambda w: bound(lines, lambda x: whole(t, w, x)))

    def whole(t: Column, words: Column, lines: Column) -> Column:
        plain = lambda w: F.rtrim(F.translate(w, UPPER, LOWER), F.lit(".,;:!?"))
        found = {
            "n_words": F.size(words),
            "word_chars": F.length(without(t, BLANKS)),
            "n_symbols": in_text(t, SYMBOLS),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_lines": F.size(lines),
            "n_signs": in_text(t, SIGNS),
            "n_stop_words": F.size(F.filter(words, lambda w: plain(w).isin(STOP_WORDS))),
            "n_echoes": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))),
        }
        return F.struct(*[found[name].cast("long").alias(name) for name in MEASURES])

    return bound(F.coalesce(text, F.lit("")), over)


def broken(rule: Rule) -> Column:
    part, whole = F.col(rule.part) * 100, F.col(rule.whole)
    tests = [part < whole * rule.least] if rule.least is not None else []
    tests += [part > whole * rule.most] if rule.most is not None else []
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measures, ``base_failed``, ``failed`` (names of the table's rules that a text breaks, in the table's
    order) and ``kept`` (the base holds and no rule is broken), one row for each row of ``docs``.

    A null text and a text of blanks have no words: they fail the base. Texts are read whole, whatever their length.
    Repeated rows give repeated rows, an empty table gives none; other columns are not read, whatever their names.
    """
    found = docs.select(key, measures(F.col(text)).alias("_m")).select(key, "_m.*")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))
    return found.select("*", base.alias("base_failed"), failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document: a row for each row of ``documents``.

    Null and empty texts have no words, fail the base and are not kept; very long texts are measured whole; repeated rows
    and ties give equal rows; an empty table gives none; further columns are not read.
    """
    return judged(table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


def _broken_sql(rule: Rule) -> str:
    tests = [f"100 * {rule.part} < {rule.least} * {rule.whole}"] if rule.least is not None else []
    tests += [f"100 * {rule.part} > {rule.most} * {rule.whole}"] if rule.most is not None else []
    return " OR ".join(tests)


_SIGNS_SQL = SIGNS.replace("'", "''")
_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE = {
    "op11_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM docs),
placed AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW})),
again AS (SELECT rid, i FROM placed QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, sum(least({WINDOW}, i - before))::BIGINT AS n FROM (
  SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -{WINDOW}) AS before FROM again) GROUP BY rid),
measured AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(x)::BIGINT AS n_lines,
  (length(t) - length(translate(t, '{_SIGNS_SQL}', '')))::BIGINT AS n_signs,
  len(list_filter(w, lambda v: list_contains([{_STOP_SQL}], rtrim(translate(v, '{UPPER}', '{LOWER}'), '.,;:!?'))))::BIGINT AS n_stop_words,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echoes
  FROM split LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  concat_ws(',', {", ".join(f"CASE WHEN {_broken_sql(r)} THEN '{r.name}' END" for r in RULES)}) AS failed FROM measured)
SELECT *, NOT base_failed AND failed = '' AS kept FROM judged"""
}
QUERIES = {"op11_quality_rules": op11_quality_rules}
