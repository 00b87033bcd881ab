"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. Every text becomes its set of hashed word shingles. Texts with equal sets form one node, so copies cost
   nothing from here on.
2. A node's sketch has ``BANDS * ROWS`` coordinates, filled in rounds: in each of the first t rounds every
   shingle is thrown into one random coordinate, and in round t + i into coordinate i, so after 2t rounds at
   the latest all are filled; a coordinate keeps the least value of the first round that reached it. Two
   sketches agree in a coordinate with a chance of their similarity, with the concentration of sampling
   without replacement. Rows of ``ROWS`` coordinates are hashed to band keys.
3. Nodes that share a band key are a bucket. The pairs of a bucket of up to ``SMALL`` nodes are compared on
   full sets if their sketches agree well enough. A larger bucket is never expanded into pairs: it gets a
   pivot, and every member is compared with the pivot on full sets. A link between two members that are not
   both linked to the pivot shows in what they have beyond it: such members must share one of few shingles
   (a prefix filter on the rest after the pivot is taken out). Nodes that hang together by such shingles are
   a family. Its members meet block against block, in tasks of bounded size that hold full sets and give
   out no more links than they join components.
4. Components are found by alternating star contraction.

Hashes have 64 bits; "full sets" are sets of such hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import dropped, hot_keys, joined_hot, table, text_key, written
from caseloom.llm.tokens import slices

#: Two sets of similarity 0.85 share none of the band keys with a chance of (1 - 0.85**6)**30, under 1e-6; for
#: 0.8, the default of ``near_duplicates``, 36 bands of 5 rows do the same.
BANDS, ROWS = 30, 6
#: Nodes of a bucket whose pairs are looked at one by one, and nodes in a block of a family.
SMALL, BLOCK = 8, 1024
#: Standard deviations by which the agreement of two sketches may fall short of the least similarity.
DEVIATIONS = 6
SLICE_BYTES = 1_000_000

_LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles of ``width`` words.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a text with fewer words has
    all of them as its one shingle, one without words has none.
    """
    raw = [b"" if t is None else t.encode() for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space]))
    first, stop = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)]
    words = mixed((total[stop] - total[first]) * inverse[first])
    at = np.searchsorted(first, np.r_[0, ends])  # the words of a text
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += words[k : k + n] * _PLACES[k]
    grams = mixed(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            out.append(mixed((words[a:b] * _PLACES[8 : 8 + b - a]).sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A fast similarity sketch of ``size`` coordinates for each set; those of an empty set are all ones."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * size, empty, np.uint64)
    counts = np.array([len(s) for s in sets], np.int64)
    members = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), counts)
    for turn in range(2 * size):
        if not members.size:
            break
        x = mixed(members ^ np.uint64((turn + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        spot = ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if turn < size else turn - size
        value = np.uint64(turn << 32) | (x & np.uint64(0xFFFFFFFF))
        # values of later turns are larger, so the least one is of the first turn that reached a coordinate
        np.minimum.at(out, row * size + spot, value)
        open_ = (out.reshape(-1, size) == empty).any(axis=1)
        stay = open_[row]
        if not stay.all():
            members, row = members[stay], row[stay]
    return out.reshape(-1, size)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = sketch.reshape(len(sketch), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _PLACES[32]
    for r in range(rows):
        key = mixed(key + grouped[:, :, r] * _PLACES[33 + r])
    return key


def node_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each whole set, whatever the order of its members."""
    total = np.array([mixed(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mixed(total + np.array([len(s) for s in sets], np.uint64)).view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, bands, sketch``: hash of the text, set size, hash of the whole set, band keys
    and one byte of each coordinate for every text."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes, SLICE_BYTES):
                sets = shingle_sets(batch.column(1)[i:j].to_pylist(), width)
                n = np.array([len(s) for s in sets], np.int64)
                node = node_hashes(sets)
                filled = sketches(sets, bands * rows)
                keys, low = band_keys(filled, bands, rows), filled.astype(np.uint8)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(n), pa.array(node, mask=n == 0), keys, pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(signed, f"doc_id {kind}, text_key bigint, n_shingles bigint, node bigint, bands array<bigint>, sketch binary")


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches agree in as many coordinates as a similarity of ``percent`` gives, less
    ``DEVIATIONS`` standard deviations; a link is lost with a chance of about one in a billion."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= _least_agreement(a.shape[1], percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["node", "pivot"])

    own = nodes.select("node", "sketch")
    both = pairs.join(own, "node").join(own.select(F.col("node").alias("pivot"), F.col("sketch").alias("other")), "pivot")
    return both.select("node", "pivot", "sketch", "other").mapInArrow(judged, "node bigint, pivot bigint")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` (packed, sorted) of the nodes in ``wanted (doc_id, text_key, node)``: ids alone are not enough,
    as one may be missing from many rows, or come with many texts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist(), SLICE_BYTES):
                sets = shingle_sets(batch.column(1)[i:j].to_pylist(), width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    own = docs.select("doc_id", "text", text_key().alias("text_key"))
    picked = own.join(wanted, (own["text_key"] == wanted["text_key"]) & own["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "text")
    return picked.mapInArrow(packed, "node bigint, shingles binary").dropDuplicates(["node"])


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare each node with its pivot on full sets.

    ``node, pivot, open, linked, novel, whole``; the last two, where ``open``, are the shingles by which a link to another node of this pivot would
    show. With need = the overlap that any partner must have minus the overlap with the pivot: if need is
    positive, a partner shares that many of the shingles beyond the pivot, so all but need - 1 of these
    suffice (``novel``); else all of them (they are few), and a prefix of the set (``whole``) for partners
    that share nothing beyond the pivot.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, novel, whole = [], [], []
            for a, b, go_on in zip(batch.column(3), batch.column(4), batch.column(2).to_pylist()):
                x, p = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(p, x), len(p) - 1)
                beyond = x[p[at] != x]
                inter = len(x) - len(beyond)
                ok = 100 * inter >= percent * (len(x) + len(p) - inter)
                need = -(-percent * len(x) // 100) - inter
                linked.append(ok)
                if not go_on:
                    x = beyond = x[:0]
                novel.append((beyond[: len(beyond) - need + 1] if need > 0 else beyond).view(np.int64))
                whole.append((x[:0] if need > 0 else x[: len(x) - -(-percent * len(x) // 100) + 1]).view(np.int64))
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (novel, whole)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(linked, pa.bool_()), *lists], ["node", "pivot", "open", "linked", "novel", "whole"])

    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of_pivot")), "pivot")
    return both.select("node", "pivot", "open", "shingles", "of_pivot").mapInArrow(judged, "node bigint, pivot bigint, open boolean, linked boolean, novel array<bigint>, whole array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: the least node that can be reached.

    Alternating large-star and small-star contraction; every step is written to the shared folder.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    last = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        stars = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if last is not None:
            dropped(last)
        last = stars
        # done when all are stars: no node has two parents, and none is a parent and a child
        ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _pairs(closed: DataFrame, open_: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``node, pivot, open``: pairs of small buckets, for their link only, and pairs with a pivot."""
    sizes = nodes.select("node", "n_shingles")
    near = closed.distinct().join(sizes, "node").join(sizes.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("n")), "pivot")
    near = near.filter(100 * F.least("n", "n_shingles") >= percent * F.greatest("n", "n_shingles")).select("node", "pivot")
    near = _alike(near, nodes, percent)
    both = near.withColumn("open", F.lit(False)).unionByName(open_.withColumn("open", F.lit(True)))
    return both.groupBy("node", "pivot").agg(F.max("open").alias("open"))


def _within(members: DataFrame) -> DataFrame:
    """``node, pivot`` (the lesser) for all pairs of each ``key``: small buckets only."""
    other = members.select("key", F.col("node").alias("pivot"))
    return members.join(other, "key").filter("pivot < node").select("node", "pivot")


def _with_pivots(large: DataFrame) -> DataFrame:
    """``node, pivot`` from ``key, node, c`` of large buckets: all members of a bucket get the same pivot.

    The pivot should be the middle of its group, as what all others have in common beyond a pivot keeps them
    together in a family. A text in the middle agrees with many others, so it stands in many and large
    buckets: nodes are ranked by the sum of the sizes of their buckets. A bucket's pivot is the highest of
    any bucket that one of its members is in, so that a large group of near copies agrees on few pivots.
    """
    hot = written(hot_keys(large.groupBy("key").agg(F.first("c").alias("c")), "key", "c"), "hot")
    rank = large.groupBy("node").agg(F.sum("c").alias("weight"))
    ranked = written(large.join(rank, "node").select("key", "node", F.struct("weight", "node").alias("r")), "ranked")
    highest = ranked.groupBy("key").agg(F.max("r").alias("high"))
    choice = joined_hot(ranked, highest, "key", hot).groupBy("node").agg(F.max("high").alias("choice"))
    pivots = ranked.join(choice, "node").groupBy("key").agg(F.max("choice").alias("pivot"))
    return joined_hot(ranked, pivots, "key", hot).select("node", F.col("pivot.node").alias("pivot")).filter("node <> pivot").distinct()


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs to compare, from the band keys of all nodes."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    many = bands.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = written(bands.join(many, "key").select("key", "node", "c"), "buckets")
    open_ = _with_pivots(members.filter(F.col("c") > SMALL))
    closed = _within(members.filter(F.col("c") <= SMALL).select("key", "node"))
    return _pairs(closed, open_, nodes, percent)


def _least_agreement(size: int, percent: int) -> float:
    p = percent / 100
    return size * p - DEVIATIONS * (size * p * (1 - p)) ** 0.5


def _families(judged: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, family`` of the nodes that may have links which the pivots don't show: nodes of one pivot that
    share a shingle, not all of them linked to it, and are in several components."""
    rows = judged.filter("open")
    unsettled = rows.filter("not linked").groupBy("pivot").agg(F.max(F.size("whole") > 0).alias("contained"))
    rows = rows.join(unsettled, "pivot")
    keys = rows.select("node", "linked", F.explode("novel").alias("e"), "pivot", F.lit(0).alias("kind")).unionByName(rows.filter("contained").select("node", "linked", F.explode("whole").alias("e"), "pivot", F.lit(1).alias("kind")))
    keys = keys.select(F.xxhash64("pivot", "kind", "e").alias("key"), "node", "linked").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    many = keys.groupBy("key").agg(F.min("node").alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("linked").alias("all_linked"))
    spokes = keys.join(many.filter("low < high and not all_linked").select("key", "hub"), "key").select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    return components(spokes).withColumnRenamed("root", "family")


def _links_within(families: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that join the components of each family, found on full sets.

    A family's blocks meet two by two, each meeting a task. In a meeting all pairs whose sketches agree well
    enough and whose components are still apart are verified; a link joins theirs, so that at most one link
    comes out for each component that is joined.
    """
    rows = families.join(families.groupBy("family").agg(F.count("*").alias("c")), "family").join(roots, "node", "left")
    rows = rows.join(nodes.select("node", "n_shingles", "sketch"), "node").join(sets, "node")
    blocks = F.ceil(F.col("c") / BLOCK)
    rows = rows.withColumn("b", F.pmod(F.xxhash64(F.lit("block"), "node"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.select("family", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", F.coalesce("root", "node").alias("root"), "n_shingles", "sketch", "shingles")

    def met(block: pa.Table) -> pa.Table:
        b, node, root, n = (block[c].to_numpy() for c in ("b", "node", "root", "n_shingles"))
        sketch = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        held = [np.frombuffer(x, np.uint64) for x in block["shingles"].to_pylist()]
        least = _least_agreement(sketch.shape[1], percent)
        _, root = np.unique(root, return_inverse=True)  # from here on the component as it grows in this meeting
        here, there = np.flatnonzero(b == block["i"][0].as_py()), np.flatnonzero(b == block["j"][0].as_py())
        out = []
        for x in here:
            apart = there[(root[there] != root[x]) & (100 * np.minimum(n[there], n[x]) >= percent * np.maximum(n[there], n[x]))]
            agree = (sketch[apart] == sketch[x]).sum(axis=1)
            order = np.argsort(-agree, kind="stable")
            for y in apart[order[agree[order] >= least]]:
                if root[y] == root[x]:
                    continue
                at = np.minimum(np.searchsorted(held[y], held[x]), n[y] - 1)
                both = int((held[y][at] == held[x]).sum())
                if 100 * both >= percent * (n[x] + n[y] - both):
                    out.append((node[x], node[y]))
                    root[root == root[y]] = root[x]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("family", "i", "j").applyInArrow(met, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 36, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key`` for every row of ``docs``; ``text_key`` tells rows apart that
    have one id, or none, and different texts.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word
    shingles; a component is named after its least doc_id, and the document of that id is kept. A text that
    is null or without words has an empty set and is linked with nothing. Rows that repeat a document are
    the same document. A row without doc_id joins the component of its text but names none; alone it has
    component null; it is kept if no other row of its component has an id. Other columns are ignored; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    signed = written(signatures(docs, width, bands, rows), "signatures")
    found = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")  # a row of the node, with an id if any has one
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(found).alias("found"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    nodes = written(nodes.select("node", "found.doc_id", "found.text_key", "copies", "n_shingles", "bands", "sketch"), "nodes")
    pairs = written(_candidates(nodes, percent), "pairs")
    involved = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    sets = written(_full_sets(docs, nodes.join(involved, "node", "left_semi").select("doc_id", "text_key", "node"), width), "sets")
    judged = written(_compared(pairs, sets, percent), "judged")
    links = judged.filter("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    roots = written(components(links), "roots")
    more = written(_links_within(_families(judged, roots), nodes, sets, roots, percent), "links")
    dropped(pairs, sets, judged)
    if not more.isEmpty():
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    named = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = written(named.join(least, "root").select("node", "component_id"), "labels")
    own = signed.select("doc_id", "text_key", "n_shingles", "node")
    # texts without words need no label; a text with a large share of all copies gets its label by broadcast
    hot = written(hot_keys(nodes.select("node", "copies"), "node", "copies"), "hot")
    labelled = joined_hot(own.filter("node is not null"), label, "node", hot).select("doc_id", "n_shingles", "component_id", "text_key")
    every = labelled.unionByName(own.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key"))
    return every.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "text_key")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, told by doc_id and text; columns stay as they are, whatever
    their names.

    Texts that are null or without words are like no other and stay; rows that repeat a kept document stay
    with it; of rows with one doc_id and different texts, or without doc_id, each text has its own answer; an empty
    table gives an empty table.
    """
    kept = near_duplicates(docs, width, percent).filter("kept").select("doc_id", "text_key").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]) & (F.xxhash64(docs["text"]) == kept["text_key"]), "left_semi")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of three-word shingles and the group it is in at 0.85.

    Null and empty texts have no shingles and are alone; a text of any length is taken whole; of a group the
    least doc_id is kept; repeated rows are the same document and give equal rows; an empty table gives none; no
    other column is read, whatever its name.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, bands=BANDS, rows=ROWS)


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLE: dict[str, str] = {}
