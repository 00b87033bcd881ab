"""Personal data in plain sight and in disguise, with offsets into the text as it stands.

Plain identifiers (e-mail, IPv4, payment card, phone) are found by fixed patterns. For the disguised ones
the text runs through transducers that rewrite look-alike characters, spelled digits and at/dot words while
each output character keeps the source range it came from; the same patterns then run over the rewritten
text, and what they find there goes back to source offsets. Only finds that hold a rewritten character are
added, so the plain ones always stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table
from caseloom.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
SLICE_CHARS = 2_000_000

# --- plain identifiers -------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, so no run is scanned twice.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from the @ outwards."""
    floor = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            floor = m.end()
            yield start, floor


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, number of kind, end)`` of every plain identifier, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- disguises ---------------------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones, and what they look like.
_LOOKALIKE = dict(zip("авеѕіјкмнорстухԁԛԝһАВЕЅІЈКМНОРСТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abesijkmhopctyxdqwhABESIJKMHOPCTYXaeiknoptuxABEZHIKMNOPTYX"))
# Dots, at signs, hyphens and pluses of other kinds.
_LOOKALIKE |= {"․": ".", "。": ".", "·": ".", "•": ".", "∙": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " "}
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# The digits as words, English, German, French, Spanish.
_DIGIT_WORDS = {
    "zero": 0, "oh": 0, "null": 0, "zéro": 0, "cero": 0,
    "one": 1, "eins": 1, "un": 1, "uno": 1,
    "two": 2, "zwei": 2, "zwo": 2, "deux": 2, "dos": 2,
    "three": 3, "drei": 3, "trois": 3, "tres": 3,
    "four": 4, "vier": 4, "quatre": 4, "cuatro": 4,
    "five": 5, "fünf": 5, "cinq": 5, "cinco": 5,
    "six": 6, "sechs": 6, "seis": 6,
    "seven": 7, "sieben": 7, "sept": 7, "siete": 7,
    "eight": 8, "acht": 8, "huit": 8, "ocho": 8,
    "nine": 9, "neun": 9, "neuf": 9, "nueve": 9,
}
_AT = "at|arroba|ät|arobase"
_DOT = "dot|punkt|point|punto"

_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_ODD = re.compile("[" + re.escape("".join(_LOOKALIKE)) + _INVISIBLE + "！-～٠-٩۰-۹०-९₀-₉²³¹⁰-⁹①-⑨\U0001d400-\U0001d7ff]")
#: A spelled run: three digit words at least, with digits, spaces, commas, hyphens between them.
_SPELLED = re.compile(rf"\b(?:{_WORD})(?:[\s,-]{{1,3}}(?:{_WORD}|[0-9]+))*[\s,-]{{1,3}}(?:{_WORD})(?:[\s,-]{{1,3}}(?:{_WORD}|[0-9]+))*\b", re.I)
_SPELLED_PART = re.compile(rf"{_WORD}|[0-9]+", re.I)
_PLUS = re.compile(r"\bplus\s+(?=[0-9])", re.I)
#: Matched from the bracket; the blanks around it are taken in afterwards, so that no run of blanks is scanned twice.
_HELD_AT = re.compile(rf"[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]", re.I)
_HELD_DOT = re.compile(rf"[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]", re.I)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{_DOT})\s+(?=[A-Za-z0-9])", re.I)
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{_AT})\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}\b)", re.I)
#: An at sign between blanks, before a domain of labels that dots join, all of them tight or all of them loose.
_LABEL = "[A-Za-z0-9-]+"
_LOOSE_AT = re.compile(r"(?<=[A-Za-z0-9])\s+@\s+(?=[A-Za-z0-9])")
_LOOSE_DOMAIN = re.compile(rf"@{_LABEL}(?:\s+\.\s+[a-z0-9-]+)+")
_BLANKS = re.compile(r"\s+")
_HELD = re.compile(rf"[\[({{<]\s*(?:{_AT}|{_DOT}|@|\.)\s*[\])}}>]", re.I)
_DOT_WORDS = frozenset(_DOT.split("|"))
_CUES = _DOT_WORDS | _DIGIT_WORDS.keys()
_TOKEN = re.compile(r"\w+")
#: Characters that a pattern without regard to case takes for an ASCII letter though they are none.
_FOLDED = re.compile("[ſKİı]")
_NAME = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TLD = re.compile(r"\.[A-Za-z]{2,}$")


def _look(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


class Rewritten:
    """A text on its way through the transducers; every character knows its source range."""

    def __init__(self, text: str):
        self.text = text
        self.low = np.arange(len(text), dtype=np.int32)
        self.high = self.low + np.int32(1)
        self.new = np.zeros(len(text), bool)

    def step(self, pattern: re.Pattern, rewrite, blanks: bool = False) -> bool:
        """Rewrite every match, with the blanks around it if ``blanks``; ``rewrite`` gives the new text, or None to
        leave a match alone."""
        text, out, low, high, new, at = self.text, [], [], [], [], 0
        for m in pattern.finditer(text):
            put = rewrite(m)
            if put is None:
                continue
            a, b = m.span()
            while blanks and a > at and text[a - 1].isspace():
                a -= 1
            while blanks and b < len(text) and text[b].isspace():
                b += 1
            out += [text[at:a], put]
            low += [self.low[at:a], np.full(len(put), self.low[a])]
            high += [self.high[at:a], np.full(len(put), self.high[b - 1])]
            kept = self.new[at:a]
            if not put and a > at:
                kept = kept.copy()
                kept[-1] = True  # what was between this character and the next is gone
            elif not put and new and len(new[-1]):
                new[-1][-1] = True
            new += [kept, np.ones(len(put), bool)]
            at = b
        if not at:
            return False
        self.text = "".join([*out, text[at:]])
        self.low, self.high = np.concatenate([*low, self.low[at:]]), np.concatenate([*high, self.high[at:]])
        self.new = np.concatenate([*new, self.new[at:]])
        return True


def _digits(m: re.Match) -> str | None:
    """The digits of a run of words; a pattern without regard to case also takes long s, dotted and dotless i and the
    Kelvin sign for letters."""
    parts = _SPELLED_PART.findall(m[0])
    words = [unicodedata.normalize("NFKC", p).lower().replace("\u0307", "").replace("ı", "i") for p in parts]
    if sum(w in _DIGIT_WORDS for w in words) < 3:
        return None
    return "".join(str(_DIGIT_WORDS.get(w, w)) for w in words)


def hinted(text: str) -> bool:
    """False only if no transducer can change ``text``: each of their patterns holds one of these cues. Digit words are
    whole tokens, as blanks, commas, hyphens or the ends of words are around them."""
    if not text.isascii() and (_ODD.search(text) or _FOLDED.search(text)):
        return True
    if _HELD.search(text) or ("@" in text and _LOOSE_AT.search(text)):
        return True
    low = text.lower()
    if "plus" in low and _PLUS.search(text):
        return True
    words = _TOKEN.findall(low)
    cues = _CUES.intersection(words)
    if not cues.isdisjoint(_DOT_WORDS):
        return True
    run = 0
    for w in words if cues else ():
        if w in _DIGIT_WORDS:
            run += 1
            if run == 3:
                return True
        elif not w.isdigit():
            run = 0
    return False


def disguised_spans(text: str, filtered: bool = True) -> list[tuple[int, int, int]]:
    """``(start, number of kind, end)`` in ``text`` of identifiers that show only after rewriting. With ``filtered`` off,
    texts without cues are rewritten too; they give nothing."""
    if filtered and not hinted(text):
        return []
    t = Rewritten(text)
    if not text.isascii():
        t.step(_ODD, lambda m: _look(m[0]))
    t.step(_SPELLED, _digits)
    t.step(_PLUS, lambda m: "+")
    t.step(_HELD_AT, lambda m: "@", blanks=True)
    t.step(_HELD_DOT, lambda m: ".", blanks=True)
    t.step(_BARE_DOT, lambda m: ".")
    t.step(_LOOSE_AT, lambda m: "@")
    t.step(_LOOSE_DOMAIN, lambda m: _BLANKS.sub("", m[0]))

    def bare(m: re.Match) -> str | None:  # only before a domain whose dots are all disguised
        domain = _NAME.match(t.text, m.end())
        return "@" if domain and all(t.new[i] for i in range(*domain.span()) if t.text[i] == ".") else None

    t.step(_BARE_AT, bare)
    found = []
    for a, kind, b in plain_spans(t.text):
        if t.new[a:b].any() and (kind or _TLD.search(t.text[a:b])):
            found.append((int(t.low[a]), kind, int(t.high[b - 1])))
    return found


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and plain and added ones together; an added span inside a plain one of its kind is dropped."""
    base = plain_spans(text)
    ends = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]  # those of one kind do not overlap
    more = []
    for a, k, b in disguised_spans(text):
        at = bisect_right(ends[k], (a, len(text))) - 1  # the last one that begins no later
        if at < 0 or ends[k][at][1] < b:
            more.append((a, k, b))
    return base, sorted({*base, *more})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, all_email, all_ip, all_card, all_phone`` for every
    whole text.

    The first counts and the digest are of the plain spans; ``spans`` has all, as kind:start:end in code points,
    by start, then kind, and the last counts are of these. A null text counts as empty. Repeated rows and other
    columns do no harm; an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "all_email", "all_ip", "all_card", "all_phone"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes, SLICE_CHARS):
                counts: list[list[int]] = [[], [], [], []]
                totals: list[list[int]] = [[], [], [], []]
                digests, spans = [], []
                for t in batch.column(1)[i:j].to_pylist():
                    base, every = all_spans(t or "")
                    for k in range(4):
                        counts[k].append(sum(x[1] == k for x in base))
                        totals[k].append(sum(x[1] == k for x in every))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(every))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), *(pa.array(c, pa.int64()) for c in totals)], names)

    return docs.select(key, text).mapInArrow(found, f"`{key}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, all_email bigint, all_ip bigint, all_card bigint, all_phone bigint")


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping ones by the first."""
    out, at = [], 0
    for a, k, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars`` (if there) the new length.

    Null texts stay null, empty ones empty; of overlapping spans the first is masked; no row goes, repeated rows
    stay and every other column stays as it is, whatever its name; an empty table gives an empty table.
    """

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: None if t is None else redact(t))

    out = docs.withColumn("text", masked(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: a row for each row of ``documents``.

    Null and empty texts have none; texts of any length are read whole, in time that grows with their length; of
    spans that begin together the kind listed first comes first; repeated rows give equal rows; an empty table
    gives none; no other column is read, whatever its name.
    """
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op10_personal_data": op10_personal_data}
ORACLE: dict[str, str] = {}
