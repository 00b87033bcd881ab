"""Cross-tokenizer alignment: where two tokenizers end a token at the same byte.

Inside tasks all is Arrow: token lists are flattened with the index of their document, byte ends are segmented
cumulative sums, common ends are an Acero hash join on (document, end), and counts are partial ``group_by`` tables that
Spark merges. Tokens are made once: each document's linked pairs are written to the shared folder and read twice, for the
counts of the whole corpus and for each document's share in them.

The table of pairs goes to every task. It cannot grow with the corpus: tokens that end at one byte are suffixes of each
other, so there are no more pairs than ``Pair.bound`` finds in the two vocabularies.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table, written
from caseloom.llm.tokens import slices

#: Characters of text that are encoded together, and rows of pairs that are counted together.
SLICE_CHARS, COUNTED_ROWS = 1_000_000, 2_000_000


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, all other bytes for the characters
    from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers of two files, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte, size = _byte_alphabet(), self.a.get_vocab_size(with_added_tokens=True)
        words_a = [bytes(byte[c] for c in self.a.id_to_token(i) or "") for i in range(size)]
        words_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        if not all(words_a) or not all(words_b):
            raise ValueError("a token without bytes has no end of its own")
        self.words_a, self.words_b = pa.array(words_a, pa.large_binary()), pa.array(words_b, pa.large_binary())

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)

    def bound(self) -> int:
        """Pairs of tokens of which one is a suffix of the other: no text can link more."""
        a, b = self.words_a.to_pylist(), self.words_b.to_pylist()
        held_a, held_b = set(a), set(b)
        ends = lambda words, held: sum(w[i:] in held for w in words for i in range(len(w)))
        return ends(a, held_b) + ends(b, held_a)


@functools.lru_cache(maxsize=2)
def loaded(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _lists(ids: list[list[int]]) -> pa.LargeListArray:
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate([np.array(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _joined(lists: pa.LargeListArray, words: pa.Array) -> pa.Array:
    """The bytes of each list of tokens, one after the other."""
    return pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, words.take(lists.values)), pa.scalar(b"", pa.large_binary()))


def _ends(lists: pa.LargeListArray, words: pa.Array) -> pa.Table:
    """``doc, end, id, at``: each token with its document, the byte it ends before, counted in the document, and its place."""
    ids = lists.flatten()
    sums = pc.cumulative_sum(pc.cast(pc.binary_length(words.take(ids)), pa.int64()))
    doc = pc.list_parent_indices(lists)
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums]).take(pc.cast(lists.offsets, pa.int64()))
    return pa.table({"doc": doc, "end": pc.subtract(sums, before.take(doc)), "id": ids, "at": pa.array(np.arange(len(ids)))})


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def _texts_of(values: pa.Array, offsets: pa.Array, sign: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), pa.scalar(sign, pa.large_string()))


def align(pair: Pair, texts: list[str | None]) -> dict[str, pa.Array]:
    """Columns for ``texts``: ``n_a, n_b, n_groups, n_links``, ``groups`` (the text of all groups), and the linked pairs of
    each as lists ``pairs`` (id of A times the size of B's vocabulary, plus id of B) and ``times``."""
    a, b = (_lists(x) for x in pair.encode([t or "" for t in texts]))
    wanted = pa.array([b"" if not t else b" " + t.encode() for t in texts], pa.large_binary())
    fits = pc.and_(pc.and_(pc.equal(_joined(a, pair.words_a), wanted), pc.equal(_joined(b, pair.words_b), wanted)), pc.greater(pc.binary_length(wanted), 0))
    held = pc.indices_nonzero(fits)
    n, place = len(texts), held.to_numpy().astype(np.int64)
    a, b = a.take(held), b.take(held)
    left, right = _ends(a, pair.words_a), _ends(b, pair.words_b)
    met = left.join(right, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("at").combine_chunks()
    links = np.bincount(met["doc"].to_numpy(), minlength=len(held)).astype(np.int64) if len(met) else np.zeros(len(held), np.int64)
    cuts = lambda at: pa.array(np.concatenate([[0], at.to_numpy() + 1]).astype(np.int64))
    said = [_texts_of(pc.cast(t["id"].combine_chunks(), pa.large_string()), cuts(met[at]), ",") for t, at in ((left, "at"), (right, "at_b"))]
    groups = _texts_of(pc.binary_join_element_wise(*said, pa.scalar("|", pa.large_string())), _offsets(links), ";")
    codes = pc.add(pc.multiply(met["id"], len(pair.words_b)), met["id_b"])
    counted = pa.table({"doc": met["doc"], "pair": codes}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    kinds = np.bincount(counted["doc"].to_numpy(), minlength=len(held)) if len(counted) else np.zeros(len(held), np.int64)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[place] = values
        return out

    at = np.full(n, -1, np.int64)
    at[place] = np.arange(len(held))
    offsets = _offsets(spread(kinds))
    of = lambda name, kind: pa.LargeListArray.from_arrays(offsets, pc.cast(counted[name], kind).combine_chunks())
    return {
        "n_a": pa.array(spread(pc.list_value_length(a).to_numpy())),
        "n_b": pa.array(spread(pc.list_value_length(b).to_numpy())),
        "n_groups": pa.array(spread(links)),
        "n_links": pa.array(spread(links)),
        "groups": groups.take(pa.array(at, mask=at < 0)),
        "pairs": of("pair", pa.int64()),
        "times": of("count_all", pa.int64()),
    }


def alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = True) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links``, the groups (``groups``, or ``groups_sha256`` with ``digest``), ``pairs`` and
    ``times`` for each row of ``docs``.

    Null and empty texts, and those whose tokens do not spell a space and the text, have no tokens: zeros, no groups,
    empty lists. Texts are encoded whole. Repeated rows give repeated rows, an empty table none; other columns are not
    read. Both files must exist on every worker.
    """
    kind = docs.schema[key].dataType
    said = "groups_sha256" if digest else "groups"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(path_a, path_b)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(lengths, SLICE_CHARS):
                found = align(pair, batch.column(1)[i:j].to_pylist())
                groups = found.pop("groups").to_pylist()
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                lists = {c: pc.cast(found[c], pa.list_(pa.int64())) for c in ("pairs", "times")}
                columns = {key: batch.column(0)[i:j]} | {c: found[c] for c in ("n_a", "n_b", "n_groups", "n_links")} | {said: pa.array([g or "" for g in groups], pa.string())} | lists
                yield pa.RecordBatch.from_pydict(columns)

    numbers = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return docs.select(key, text).mapInArrow(encoded, f"`{key}` {kind.simpleString()}, {numbers}, {said} string, pairs array<bigint>, times array<bigint>")


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, n``: how many links of ``links`` hold each pair. Tasks send partial counts, Spark adds them up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(waiting).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in batches:
            waiting.append(pa.table({"pair": pc.list_flatten(batch.column(0)), "n": pc.list_flatten(batch.column(1))}))
            rows += len(waiting[-1])
            if rows > COUNTED_ROWS:
                waiting, rows = [summed()], 0
        if waiting:
            yield from summed().combine_chunks().to_batches()

    return links.select("pairs", "times").mapInArrow(partial, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def shares(links: DataFrame, counts: pa.Table, size_b: int, key: str) -> DataFrame:
    """``links`` with ``n_best`` and ``count_sum`` in place of its lists; ``counts`` holds every pair of them."""
    order = np.argsort(counts["pair"].to_numpy())
    pairs, n = counts["pair"].to_numpy()[order], counts["n"].to_numpy()[order]
    highest = np.zeros(size_b, np.int64)
    np.maximum.at(highest, pairs % size_b, n)
    sent = links.sparkSession.sparkContext.broadcast((pairs, n, n == highest[pairs % size_b]))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            doc, times = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(batch.column("times")).to_numpy()
            at = np.searchsorted(pairs, pc.list_flatten(lists).to_numpy())
            rows = {"doc": doc, "n_best": times * best[at], "count_sum": times * n[at]}
            sums = pa.table(rows).group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
            out = {c: np.zeros(len(batch), np.int64) for c in ("n_best", "count_sum")}
            for c, values in out.items():
                values[sums["doc"].to_numpy()] = sums[f"{c}_sum"].to_numpy()
            kept = {f: batch.column(f) for f in batch.schema.names if f not in ("pairs", "times")}
            yield pa.RecordBatch.from_pydict(kept | {c: pa.array(v) for c, v in out.items()})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema if f.name not in ("pairs", "times"))
    return links.mapInArrow(added, f"{kept}, n_best bigint, count_sum bigint")


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Alignment of every row of ``docs`` with its share in the counts of the whole corpus: ``alignment`` without its lists,
    ``n_best`` and ``count_sum``."""
    pair = loaded(path_a, path_b)
    links = written(alignment(docs, path_a, path_b, key, text), "alignment", codec="zstd")
    counts = pair_counts(links).toArrow()
    if len(counts) > pair.bound():
        raise RuntimeError("more pairs than the vocabularies allow")
    return shares(links, counts, len(pair.words_b), key)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document under two public tokenizers: a row for each row of ``documents``.

    Null and empty texts and texts that tokens do not spell have zeros and no digest; texts of any length are encoded
    whole; repeated rows count as often as they stand and give equal rows; of pairs with equal counts all are best; an
    empty table gives none; further columns are not read.
    """
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: SQL has no tokenizers; a test aligns token by token.
ORACLE: dict[str, str] = {}
QUERIES = {"op13_token_alignment": op13_token_alignment}
