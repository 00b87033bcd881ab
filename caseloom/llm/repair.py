"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

Rows are dealt by conversation, sorted by turn inside their partitions and streamed through ``mapInPandas``. What a
conversation needs in memory is the state of a dynamic program over four positions in ``(s?(ua)+)?``: for each the
least cost, the rank of its edits in ASCII order and the digest of the text repaired so far. The state is carried from
one Arrow batch to the next, so a conversation may be of any length. One byte a position and row tells where it came
from; these go to an unnamed file of the task once they are many, as Spark's own sorts do, and are read backwards.
A task that is lost runs again from the shuffle.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import table

BLANKS = " \t\n\x0b\x0c\r"
RAW = ["conv_id", "turn", "role", "text"]

#: Kinds of a row: fine, blank, said before, cut off. A row's first fault counts.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_OFF = 3

#: Positions: nothing yet, after s, after u, after a. What each role leads to from there, and the role due next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
DUE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LETTERS = "KRD"
LEGAL = {"su", "ua", "au"}

#: Rows whose back pointers stay in memory, and rows and characters of a frame that is sent on.
SPILL_ROWS, FRAME_ROWS, FRAME_CHARS = 1_000_000, 5_000, 4_000_000

FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _ways(initial: str, kind: int) -> list[tuple]:
    """Best step over one row from each position to each other: (from, to, cost, rows put in before, letter).

    Steps between the same two positions differ in cost and letters only, so the best of them is known beforehand."""
    best: dict[tuple[int, int], tuple] = {}
    for start in NEXT:
        at, put = start, 0
        while put <= 2:
            steps = [("D", at, DELETE)]
            if kind not in (BLANK, DUPLICATE):
                more = CUT_OFF if kind == TRUNCATED else 0
                if initial in NEXT[at]:
                    steps.append(("K", NEXT[at][initial], KEEP + more))
                steps.append(("R", NEXT[at][DUE[at][0]], REROLE + more))
            for letter, to, cost in steps:
                found = (cost + INSERT * put, "I" * put + letter, put)
                if (start, to) not in best or found < best[start, to]:
                    best[start, to] = found
            at, put = NEXT[at][DUE[at][0]], put + 1
    return [(a, b, cost, put, letters[-1]) for (a, b), (cost, letters, put) in best.items()]


WAYS = {(initial, kind): _ways(initial, kind) for initial in ("s", "u", "a", "") for kind in range(4)}


class Repair:
    """The program over one conversation, fed row by row."""

    def __init__(self, spill_rows: int = SPILL_ROWS):
        self.best = {START: (0, 0, hashlib.sha256())}
        self.back, self.spilled, self.blocks, self.spill_rows = bytearray(), None, 0, spill_rows
        self.counts, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turn: int | None, role: str, text: str, kind: int) -> None:
        self.counts[kind] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.first_turn = turn if self.turns == 0 else self.first_turn
            self.turns, self.last_turn = self.turns + 1, turn
        found: dict[int, tuple] = {}
        for a, b, cost, put, letter in WAYS[initial if initial in ("s", "u", "a") else "", kind]:
            if a in self.best:
                step = (self.best[a][0] + cost, self.best[a][1], "I" * put + letter, a, put, letter)
                if b not in found or step < found[b]:
                    found[b] = step
        ranks = {b: i for i, b in enumerate(sorted(found, key=lambda b: found[b][1:3]))}
        codes, held = bytearray(4), {}
        for b, (cost, _, _, a, put, letter) in found.items():
            said, at = self.best[a][2], a
            if put or letter != "D":
                said = said.copy()
                for _ in range(put):
                    said.update(b"\n" * (at != START) + f"{DUE[at]}:".encode())
                    at = NEXT[at][DUE[at][0]]
                if letter != "D":
                    said.update(b"\n" * (at != START) + f"{role if letter == 'K' else DUE[at]}:{text}".encode())
            held[b] = (cost, ranks[b], said)
            codes[b] = a | put << 2 | LETTERS.index(letter) << 4
        self.best = held
        self.back += codes
        if len(self.back) >= 4 * self.spill_rows:
            self.spilled = self.spilled or tempfile.TemporaryFile()
            self.spilled.write(self.back)
            self.back, self.blocks = bytearray(), self.blocks + 1

    def _backwards(self) -> Iterator[bytes]:
        yield self.back
        size = 4 * self.spill_rows
        for block in reversed(range(self.blocks)):
            self.spilled.seek(block * size)
            yield self.spilled.read(size)

    def finish(self) -> tuple:
        """What ``FIELDS`` names."""
        ends = []
        for at, (cost, rank, said) in self.best.items():
            put = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[at]
            ends.append((cost + INSERT * put, rank, at, put, said))
        cost, _, at, put, said = min(ends, key=lambda e: e[:2])
        said, state = said.copy(), at
        for _ in range(put):
            said.update(b"\n" * (state != START) + f"{DUE[state]}:".encode())
            state = NEXT[state][DUE[state][0]]
        letters = bytearray(b"I" * put)
        for block in self._backwards():
            for i in range(len(block) - 4, -1, -4):
                code = block[i + at]
                letters.append(ord(LETTERS[code >> 4]))
                letters += b"I" * (code >> 2 & 3)
                at = code & 3
        letters.reverse()
        if self.spilled:
            self.spilled.close()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost, letters.decode(), said.hexdigest()


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done, chars, conv, repair = [], 0, None, None

    def sent() -> pd.DataFrame:
        return pd.DataFrame(done, columns=["conv", *FIELDS])

    for frame in frames:
        for c, has_turn, turn, role, text, kind, gone in zip(*(frame[x].tolist() for x in ("conv", "has_turn", "turn", "role", "text", "kind", "gone"))):
            if repair is None or c != conv:
                if repair is not None:
                    done.append((conv, *repair.finish()))
                    chars += len(done[-1][-2])
                    if len(done) >= FRAME_ROWS or chars >= FRAME_CHARS:
                        yield sent()
                        done, chars = [], 0
                conv, repair = c, Repair()
            if not gone:
                repair.add(turn if has_turn else None, role, text, kind)
    if repair is not None:
        done.append((conv, *repair.finish()))
    if done:
        yield sent()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: rows harmed by crc32 of ``conv_id:turn`` modulo 20. 0 is gone, 1 is left
    without text, 2 loses its ``.!?``, 3 stands twice, 4 is the user's. A null in role, text or that key is one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("_fate"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_fate") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of one conversation in one partition, by turn (nulls first), role and text, each with its kind. Whether a row
    was said before is a window over the same partitions: it needs a sort that can spill, and no shuffle of its own."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    said = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    kind = F.when(F.length(F.translate("text", BLANKS, "")) == 0, BLANK).when(F.col("_said") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    dealt = rows.repartition("conv_id").withColumn("_said", said)
    return dealt.withColumn("kind", kind).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def repairs(rows: DataFrame) -> DataFrame:
    """Report of each conversation of ``rows`` (``conv_id, turn, role, text`` and, if wanted, ``gone``): its faults, the
    cost and the letters of the cheapest edits, and the digest of the repaired text.

    Rows that are gone keep their conversation in the result and count for nothing else; a conversation without rows
    has zeros, no letters and the digest of nothing. Null roles and texts are one space; rows of equal turn are taken by
    role and text; rows without conv_id are one conversation. Repeated rows are repeats in the conversation. An empty
    table gives none; other columns are not read.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    fed = _sorted(plain).select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "kind", "gone"
    )
    kinds = ", ".join(f"{x} {'string' if x in ('audit', 'repaired_sha256') else 'bigint'}" for x in FIELDS)
    found = fed.mapInPandas(_streamed, f"conv string, {kinds}")
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *FIELDS)


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of all conversations after repair: ``conv_id, place, edit, role, text``, places from 1.

    Letters of the report meet the numbered rows by conversation and number, so a long conversation spreads; a role that
    an edit gives follows from the place: behind a leading system row, user and assistant take turns.
    """
    held = rows.filter(~F.coalesce("gone", F.lit(False))) if "gone" in rows.columns else rows
    held = held.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    conv = W.partitionBy("conv_id")
    numbered = held.withColumn("n", F.row_number().over(conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    letters = repairs(rows).select("conv_id", F.posexplode(F.split("audit", "")).alias("pos", "edit")).filter("edit <> ''")
    letters = letters.withColumn("n", F.sum((F.col("edit") != "I").cast("int")).over(conv.orderBy("pos")))
    own = letters.withColumn("n", F.when(F.col("edit") != "I", F.col("n"))).filter("edit <> 'D'").alias("a")
    met = own.join(numbered.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.n") == F.col("b.n")), "left")
    met = met.select("a.conv_id", "pos", "edit", "role", F.coalesce("text", F.lit("")).alias("text"))
    met = met.withColumn("place", F.row_number().over(conv.orderBy("pos")))
    lead = F.max((F.col("place") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s")).over(conv)
    due = F.when((F.col("place") - F.coalesce(lead, F.lit(False)).cast("int")) % 2 == 1, "user").otherwise("assistant")
    return met.select("conv_id", F.col("place").cast("long").alias("place"), "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(due).alias("role"), "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of every conversation of ``conversations`` after the stated damage: a row for each conv_id.

    Null roles and texts are one space, null turns come first and count for no gap, a null conv_id is a conversation;
    empty texts are blank; very long texts and conversations stream; rows that repeat are duplicates, ties of turn go by
    role and text; an empty table gives none; further columns are not read.
    """
    return repairs(damaged(table(spark, sf_dir, "conversations")))


#: The least edits are a dynamic program with a tie rule over letters; a test enumerates all edits of short conversations.
ORACLE: dict[str, str] = {}
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
