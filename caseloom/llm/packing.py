"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt into shards of about ``SHARD_PIECES`` pieces by a hash of the row, not of its id, so that rows
with one id or none spread as all others do. Each shard is packed on its own, by lengths alone: texts never move. Within a shard pieces go in order of falling length, each into the
open sequence with the least room that still holds it. Where none does, a sequence is opened at the length
that costs least per unit that it can be expected to hold, given what is still to come; at the end every
sequence shrinks to the shortest permitted length that holds its pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table, written

#: Permitted sequence lengths, in UTF-8 bytes with one separator for each piece.
CAPACITIES = (2048, 4096, 8192, 16384)
#: What one more sequence costs, in units of length; and the length from which attention costs as much again.
OPEN_COST, DOUBLE_AT = 256, 65536
#: A shard's pieces meet in one task: so many on average, whatever the input's size.
SHARD_PIECES = 20_000


def cost(capacity: int) -> float:
    """What a sequence of this length costs: its units, its opening, and attention that grows with the square."""
    return OPEN_COST + capacity * (1 + capacity / DOUBLE_AT)


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Sequence number and offset of each piece, and the lengths of the sequences.

    ``sizes`` must be falling and none over the largest capacity.
    """
    capacities = tuple(sorted(capacities))
    tail = np.cumsum(sizes[::-1])[::-1].tolist() + [0] if len(sizes) else [0]
    negative = [-s for s in sizes]  # rising, for bisection
    room: list[tuple[int, int]] = []  # of open sequences, sorted
    used: list[int] = []
    bin_of, offset = [], []
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            best = None
            for c in capacities:
                if c < size:
                    continue
                fits = max(i + 1, bisect_left(negative, size - c))  # the first later piece that fits beside
                held = size + min(c - size, tail[fits])
                if best is None or cost(c) / held < best[0]:
                    best = (cost(c) / held, c)
            left, b = best[1], len(used)
            used.append(0)
        bin_of.append(b)
        offset.append(used[b])
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return bin_of, offset, [capacities[bisect_left(capacities, u)] for u in used]


def packed(docs: DataFrame, size: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Where every piece of every row of ``docs`` goes.

    ``doc_id, piece, piece_start, piece_length, shard, sequence, sequence_length, sequence_offset``: a
    document longer than the largest capacity is cut into pieces of that size at most, the last one shorter;
    ``piece_length`` counts units of ``size`` (by default UTF-8 bytes of ``text``, and cuts are where a character
    begins) and each piece takes one unit more for a separator. A null or empty text has one piece of length 0.
    A sequence is named by shard and number. Repeated rows are packed as often as they come, and pieces of equal
    length go by id, number and row; rows without id are packed like others; other columns are ignored; an empty
    table gives an empty table.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1] - 1
    length = F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("bigint")
    own = docs.select("doc_id", length.alias("n"), *([F.col("text")] if size is None else []))
    short = own.filter(F.col("n") <= most).select("doc_id", "n", F.array(F.lit(0).cast("bigint")).alias("starts"))
    long = own.filter(F.col("n") > most)
    if size is None:
        starts = _starts(most)(F.col("text"))
    else:
        starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(most).cast("bigint"))
    rows = short.unionByName(long.select("doc_id", "n", starts.alias("starts"))).withColumn("row", F.monotonically_increasing_id())
    pieces = rows.select("doc_id", "row", "n", "starts", F.posexplode("starts").alias("piece", "piece_start"))
    end = F.coalesce(F.try_element_at("starts", F.col("piece") + 2), F.col("n"))
    # written, so that every row keeps its number whatever is run again
    pieces = written(pieces.select("doc_id", "row", "piece", "piece_start", (end - F.col("piece_start")).alias("piece_length")), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)).cast("bigint"))

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["piece_length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        bin_of, offset, lengths = pack((shard["piece_length"] + 1).tolist(), capacities)
        return shard.assign(sequence=bin_of, sequence_length=np.array(lengths, np.int64)[bin_of], sequence_offset=offset)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, piece_start bigint, piece_length bigint, shard bigint, sequence bigint, sequence_length bigint, sequence_offset bigint"
    return dealt.groupBy("shard").applyInPandas(lambda x: one(x)[["doc_id", "piece", "piece_start", "piece_length", "shard", "sequence", "sequence_length", "sequence_offset"]], schema)


def cuts(data: bytes, most: int) -> list[int]:
    """Starts of the pieces of UTF-8 ``data``: of at most ``most`` bytes each, every one at a character's start."""
    out = [0]
    while len(data) - out[-1] > most:
        at = out[-1] + most
        while data[at] & 0xC0 == 0x80 and at > out[-1] + 1:
            at -= 1
        out.append(at)
    return out


def _starts(most: int):
    @F.pandas_udf("array<bigint>")
    def starts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cuts(t.encode(), most))

    return starts


def sequences(assigned: DataFrame) -> DataFrame:
    """One row a sequence: ``shard, sequence, sequence_length, n_pieces, used, padding, doc_ids`` in order of offset."""
    by = F.array_sort(F.collect_list(F.struct("sequence_offset", "doc_id")))
    used = F.sum(F.col("piece_length") + 1)
    rows = assigned.groupBy("shard", "sequence").agg(F.first("sequence_length").alias("sequence_length"), F.count("*").alias("n_pieces"), used.alias("used"), by.alias("held"))
    return rows.select("shard", "sequence", "sequence_length", "n_pieces", "used", (F.col("sequence_length") - F.col("used")).alias("padding"), F.col("held.doc_id").alias("doc_ids"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of the permitted lengths.

    Null and empty texts are one piece of length 0; texts of any length are cut into pieces and lose no byte; ties
    go by id, number of the piece and row; repeated rows and rows without id are packed each; an empty table
    gives no row; no other column is read, whatever its name.
    """
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE: dict[str, str] = {}
