"""Which parties are named around a mark in a text: one automaton over all names, one pass over each text.

Names and texts are folded alike (plain capitals and digits, single blanks), each folded character with its place in
the text as it stands. An Aho-Corasick automaton finds all names in one pass, however many there are; hits enter and
leave a window that slides from mark to mark. The names of an automaton are limited in bytes; more names make more
automata, each sent to the tasks for a pass of its own, and their counts are added up.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.tables import table

#: Characters before and after a mark in which a name counts, and bytes of names in one automaton.
BEFORE, AFTER, BLOCK_BYTES = 900, 350, 4_000_000

_FOREIGN = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[A-Za-z0-9]+")


@functools.lru_cache(maxsize=10_000)
def _ascii(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


def folded(text: str) -> tuple[str, np.ndarray]:
    """``text`` in plain capitals and digits with single blanks, and the place in ``text`` of each of its characters."""
    place = None
    if not text.isascii():
        sizes, parts, at = np.ones(len(text), np.int64), [], 0
        for m in _FOREIGN.finditer(text):
            plain = _ascii(m[0])
            parts += [text[at : m.start()], plain]
            sizes[m.start()] = len(plain)
            at = m.end()
        place, text = np.repeat(np.arange(len(text)), sizes), "".join([*parts, text[at:]])
    runs = [m.span() for m in _RUN.finditer(text)]
    if not runs:
        return "", np.zeros(0, np.int64)
    starts, ends = np.array(runs).T
    sizes = ends - starts + 1  # each with the blank behind it
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(first - starts, sizes)
    at = at[:-1]
    shown = " ".join(text[a:b] for a, b in runs).upper()
    return shown, at if place is None else place[np.minimum(at, len(place) - 1)]


def fold_name(name: str | None) -> str:
    return folded(name or "")[0]


class Parties:
    """An automaton over the folded names of ``(id, name, role)`` rows."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.rows: dict[str, list[tuple]] = {}
        for ident, name, role in rows:
            self.rows.setdefault(fold_name(name), []).append((ident, role))
        self.automaton = ahocorasick.Automaton()
        for name in self.rows:
            if name:
                self.automaton.add_word(name, name)
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, name)`` in ``text`` of every folded name, those inside others too."""
        shown, at = folded(text)
        if not shown or not len(self.automaton):
            return []
        return [(int(at[end - len(name) + 1]), int(at[end]) + 1, name) for end, name in self.automaton.iter(shown)]

    def around(self, text: str, marks: list[tuple[int, int]], roles: list[tuple[str, re.Pattern]], before: int, after: int) -> Iterator[tuple]:
        """For each mark with a name near it: (start, end, names found, the first id, role of the window, ids of that role
        found, the first of them)."""
        enter = self.hits(text)
        enter.sort(key=lambda h: h[1])
        leave = sorted(range(len(enter)), key=lambda i: enter[i][0])
        inside, present = np.zeros(len(enter), bool), Counter()
        i = j = 0
        for start, end in marks:
            low, high = max(0, start - before), min(len(text), end + after)
            while i < len(enter) and enter[i][1] <= high:
                if enter[i][0] >= low:
                    inside[i] = True
                    present[enter[i][2]] += 1
                i += 1
            while j < len(leave) and enter[leave[j]][0] < low:
                if inside[leave[j]]:
                    inside[leave[j]] = False
                    name = enter[leave[j]][2]
                    present[name] -= 1
                    if not present[name]:
                        del present[name]
                j += 1
            if not present:
                continue
            window = text[low:high].lower()
            role = next((r for r, pattern in roles if pattern.search(window)), None)
            found = [row for name in present for row in self.rows[name]]
            of_role = [ident for ident, r in found if r == role and role is not None]
            yield start, end, len(found), min(ident for ident, _ in found), role, len(of_role), min(of_role, default=None)


def _blocks(parties: DataFrame) -> Iterator[list[tuple]]:
    """The rows of ``parties`` in lists of ``BLOCK_BYTES`` of names at the most; no more than one is with the driver."""
    block, size = [], 0
    for r in parties.toLocalIterator():
        if block and size + 32 + len(r["name"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(tuple(r))
        size += 32 + len(r["name"])
    if block:
        yield block


def parties_near(texts: DataFrame, parties: DataFrame, mark: str, roles: list[tuple[str, str]], before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """``doc_id, mark_start, mark_end, n_named, party, how``: for each match of ``mark`` in ``texts (doc_id, text)`` with a
    party of ``parties (id, name, role)`` named from ``before`` characters before it to ``after`` behind it, the party that
    is meant: the one named (UNIQUE), or the one named of the role that the window's words tell (ROLE), else null.

    Null and empty texts and names name nobody. Parties whose names fold alike are all named at once. Rows that repeat a
    text with its doc_id are one. An empty table gives none.
    """
    sc = texts.sparkSession.sparkContext
    fields = "doc_id {kind}, text_key bigint, mark_start bigint, mark_end bigint, n bigint, party bigint, role string, n_role bigint, of_role bigint"
    fields = fields.format(kind=texts.schema["doc_id"].dataType.simpleString())
    own = texts.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    named = parties.filter("name is not null").select(F.col("id").cast("bigint").alias("id"), "name", "role")
    passes = []
    for block in _blocks(named):
        sent = sc.broadcast(block)

        def marked(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held, sign = Parties(sent.value), re.compile(mark)
            told = [(r, re.compile(p)) for r, p in roles]
            for batch in batches:
                out = []
                for doc, text, key in zip(*(c.to_pylist() for c in batch.columns)):
                    marks = [m.span() for m in sign.finditer(text)]
                    if marks:
                        out += [(doc, key, *row) for row in held.around(text, marks, told, before, after)]
                columns = list(zip(*out)) if out else [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], [x.split()[0] for x in fields.split(", ")])

        passes.append(own.mapInArrow(marked, fields).distinct())
    if not passes:
        return own.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("mark_start", "bigint"), ("mark_end", "bigint"), ("n_named", "bigint"), ("party", "bigint"), ("how", "string"))]).limit(0)
    every = passes[0]
    for more in passes[1:]:
        every = every.unionAll(more)
    sums = every.groupBy("doc_id", "text_key", "mark_start", "mark_end").agg(F.sum("n").alias("n_named"), F.min("party").alias("party"), F.sum("n_role").alias("n_role"), F.min("of_role").alias("of_role"))
    how = F.when(F.col("n_named") == 1, "UNIQUE").when(F.col("n_role") == 1, "ROLE")
    party = F.when(F.col("n_named") == 1, F.col("party")).when(F.col("n_role") == 1, F.col("of_role"))
    return sums.select("doc_id", "mark_start", "mark_end", "n_named", party.alias("party"), how.alias("how"))


#: The mark, and words of a window that tell whose side it speaks of, in ``parties_in_windows``.
MARK = r"[0-9]{3,}"
ROLES = [("RESPONDENT", r"\b(?:was|dans|der|por)\b"), ("CLAIMANT", r"\b(?:from|avec|und|con)\b")]


def parties_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties named around the numbers of all documents: the parties are the benchmark's items, by their first three words."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ").alias("name"))
    parties = items.select(F.col("item_id").alias("id"), "name", F.when(F.col("item_id") % 2 == 0, "CLAIMANT").otherwise("RESPONDENT").alias("role"))
    return parties_near(table(spark, sf_dir, "documents").select("doc_id", "text"), parties, MARK, ROLES)


#: SQL cannot say where a pattern matches; a test looks for every name in every window.
QUERIES = {"parties_in_windows": parties_in_windows}
ORACLE: dict[str, str] = {}
