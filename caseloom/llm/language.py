"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted from labelled texts. A byte
that a context has seen gets its share of the context's mass; the escape mass d / (n + d) (n bytes seen, d
different ones) goes to the next shorter context, shared over the bytes that the longer one has not seen
(full exclusion), down to a uniform order below zero. The statistics are frozen after training, so the code
length of a byte depends on the few bytes before it alone: lengths are laid out once in hash tables, in
units of 1/256 bit, and a text's exact code length under each language is a sum of integers. The shortest
code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import table
from caseloom.llm.tokens import slices

#: Bytes of context.
ORDER = 3
#: About so many labelled texts of each language are learned from; all of them where there are fewer.
TRAIN_ROWS = 1500
#: Texts of more bytes than this are not among those learned from: with TRAIN_ROWS it bounds what is counted.
TRAIN_BYTES = 1_000_000
#: Code lengths are whole numbers of 1/256 bit.
UNIT = 256
#: Texts are worked on together up to so many bytes.
SLICE_BYTES = 250_000

UNKNOWN = "und"
_LETTER = r"\p{L}"


class Grams:
    """Exact hash table from byte strings of one length (as numbers) to rows of code lengths."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros((1 << self.bits, rows.shape[1]), np.int32)
        at, left = self.home(keys), np.arange(len(keys))
        self.probes = 0
        while left.size:
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]  # of several for one slot the last stays
            won = free & (self.slots[at] == keys[left])
            self.rows[at[won]] = rows[left[won]]
            at, left = (at[~won] + 1) & ((1 << self.bits) - 1), left[~won]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not in the table."""
        at = self.home(keys)
        held = self.slots[at]
        out = np.where(held == keys, at, -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.probes - 1):
            if not open_.size:
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Model:
    """Frozen context trees of all languages, as tables of code lengths."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """``counts[k]``: the different strings of k+1 bytes as numbers, sorted, and their counts by language."""
        self.languages, self.order = languages, len(counts) - 1
        n_lang = len(languages)
        self.grams: list[Grams] = []
        self.escapes: list[Grams] = []
        shorter_keys, shorter = np.arange(256), np.full((256, n_lang), 1 / 256)  # the order below zero
        for k, (keys, seen) in enumerate(counts):
            context, symbol = keys >> 8, keys & 0xFF
            suffix = keys & ((1 << 8 * k) - 1) if k else symbol
            below = shorter[np.searchsorted(shorter_keys, suffix)]
            contexts, of = np.unique(context, return_inverse=True)
            n, d, held = (np.zeros((len(contexts), n_lang)) for _ in range(3))
            np.add.at(n, of, seen)
            np.add.at(d, of, seen > 0)
            np.add.at(held, of, np.where(seen > 0, below, 0))
            escape = np.where(n > 0, d / np.maximum(n + d, 1) / np.maximum(1 - held, 1e-6), 1.0)
            # over 1 where the shorter context leaves little to the rest; the product is a probability all the same
            p = np.where(seen > 0, seen / np.maximum(n + d, 1)[of], escape[of] * below)
            self.grams.append(Grams(keys, self.length(p)))
            self.escapes.append(Grams(contexts, self.length(escape)))
            shorter_keys, shorter = keys, p
        self.base = int(round(8 * UNIT))

    @staticmethod
    def length(p: np.ndarray) -> np.ndarray:
        return np.rint(-np.log2(p) * UNIT).astype(np.int32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in units of 1/256 bit.

        The first bytes of a text have the zero bytes before it as context.
        """
        sizes = np.array([len(t) for t in texts])
        lead = bytes(self.order)
        data = np.frombuffer(b"".join(lead + t for t in texts), np.uint8).astype(np.int64)
        gram = data.copy()
        for k in range(1, self.order + 1):
            gram[k:] |= data[:-k] << (8 * k)
        inside = np.ones(len(data), bool)
        start = np.cumsum(sizes + self.order) - sizes - self.order
        for k in range(self.order):
            inside[start + k] = False
        gram = gram[inside]
        cost = np.zeros((len(gram), len(self.languages)), np.int32)
        left = np.arange(len(gram))
        for k in range(self.order, -1, -1):
            keys = gram[left] & ((1 << 8 * (k + 1)) - 1)
            slot = self.grams[k].find(keys)
            hit = slot >= 0
            cost[left[hit]] += self.grams[k].rows[slot[hit]]
            left = left[~hit]
            if left.size:
                slot = self.escapes[k].find(keys[~hit] >> 8)
                known = slot >= 0
                cost[left[known]] += self.escapes[k].rows[slot[known]]
        cost[left] += self.base
        total = np.zeros((len(texts) + 1, len(self.languages)), np.int64)
        ends = np.cumsum(sizes)
        whole = np.cumsum(cost, axis=0, dtype=np.int64)
        total[1:][ends > 0] = whole[ends[ends > 0] - 1]
        return np.diff(total, axis=0)


def _counts(docs: DataFrame, languages: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the strings of so many bytes and one more, with their counts by language."""
    number = {x: i for i, x in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            for x, i in number.items():
                own = [bytes(order) + t for t, lang in zip(texts, langs) if lang == x]
                if not own:
                    continue
                data = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
                sizes = np.array([len(t) for t in own])
                gram = data.copy()
                for k in range(1, order + 1):
                    gram[k:] |= data[:-k] << (8 * k)
                inside = np.ones(len(data), bool)
                for k in range(order):
                    inside[np.cumsum(sizes) - sizes + k] = False
                keys, n = np.unique(gram[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    grams = docs.select("lang", "text").mapInArrow(counted, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for k in range(order + 1):
        keys, of = np.unique(grams["gram"].to_numpy() & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        seen = np.zeros((len(keys), len(languages)))
        np.add.at(seen, (of, grams["lang"].to_numpy()), grams["n"].to_numpy())
        out.append((keys, seen))
    return out


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, key: str = "doc_id", rows: int = TRAIN_ROWS, order: int = ORDER) -> Model | None:
    """Fit the trees on labelled texts: ``text`` and ``lang`` not null, remainder of the key's CRC-32 not 0.

    At most about ``rows`` texts of a language, of at most ``TRAIN_BYTES`` bytes each, chosen by a hash of the key
    and taken whole; these bounds limit the byte strings of ``order + 1`` that reach the driver. None if there is
    nothing to learn from.
    """
    usable = docs.select(key, "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(~held_out(key), F.lit(True)) & (F.octet_length("text") <= TRAIN_BYTES))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows / n))])
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    languages = sorted(sizes)
    return Model(languages, _counts(usable.filter(draw < share[F.col("lang")]), languages, order))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """The columns of ``docs`` and ``lang_pred``, ``score``, ``bits_per_byte`` of every whole text.

    ``score`` is the chance of the language if all are equally likely beforehand: 2 to the minus its code
    length over the sum for all. A text that is null or has no letter gets ``und``, 0 and null, and so does
    every text if nothing was learned. Columns of these names are replaced; repeated rows stay.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    letters, judged = _judge(docs.sparkSession, model)
    # the judgement is asked for once; no name that it needs on the way can clash with a column's
    spare = next(f"judged_{i}" for i in range(len(names) + 1) if f"judged_{i}" not in names)
    got = docs.select(*names, F.when(letters, judged).alias(spare))
    return got.select(
        *names,
        F.coalesce(got[spare]["lang_pred"], F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(got[spare]["score"], F.lit(0.0)).alias("score"),
        got[spare]["bits_per_byte"].alias("bits_per_byte"),
    )


def _judge(spark: SparkSession, model: Model) -> tuple[Column, Column]:
    """Whether ``text`` has a letter, and its language, score and bits a byte as a struct."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def judge(texts):
        import pandas as pd

        m = shared.value
        raw = [t.encode() if t is not None else b"" for t in texts]
        lengths = np.concatenate([m.code_lengths(raw[i:j]) for i, j in slices([len(t) for t in raw], SLICE_BYTES)]) if raw else np.zeros((0, len(m.languages)), np.int64)
        best = lengths.argmin(axis=1) if len(raw) else np.zeros(0, int)
        least = lengths.min(axis=1, keepdims=True) if len(raw) else lengths
        score = 1 / np.exp2(np.maximum((least - lengths) / UNIT, -1000.0)).sum(axis=1)
        size = np.maximum([len(t) for t in raw], 1)
        return pd.DataFrame({"lang_pred": [m.languages[i] for i in best], "score": score, "bits_per_byte": least[:, 0] / UNIT / size})

    return F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)), judge(F.col("text"))


def recognised(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages that its labelled rows teach.

    Rejected are texts without a letter (null and empty ones among them) and texts for which no language gives
    a code shorter than the plain eight bits a byte; without labelled rows all are. Of equal codes the language
    first in the alphabet counts. Columns stay as they are, whatever their names; repeated rows stay.
    """
    model = train(docs, key)
    if model is None:
        return docs.limit(0)
    letters, judged = _judge(docs.sparkSession, model)
    return docs.filter(letters).filter(judged["bits_per_byte"] < 8)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by models learned from those that are not held out.

    Null and empty texts and texts without letters are ``und`` with score 0; texts of any length are read whole;
    of equal code lengths the language first in the alphabet is predicted; repeated rows give equal rows; an
    empty table gives no row; columns other than doc_id, text and lang are not read.
    """
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
