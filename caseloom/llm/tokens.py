"""Token counts without token lists.

Texts arrive as Arrow batches. Each is cut where a non-space character meets a space: the byte-level
pre-tokenizer never joins characters across that border, so lengths of the parts add up exactly to the
length of the whole, however long the text is. Parts repeat a lot (they are words), so each worker
remembers the lengths it has seen, in a table of bounded size; parts not seen before go to the
tokenizer's batch call, in batches that are balanced by bytes rather than by rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from caseloom.llm.common import table

#: Words whose lengths a worker may remember; once it has so many, it learns no more.
MEMORY_ENTRIES = 600_000
#: Parts longer than this are counted but never remembered.
MEMORY_CHARS = 48
#: Characters of text that are looked at together, and bytes in one call of the tokenizer.
SLICE_CHARS = 2_000_000
CALL_BYTES = 256_000

_DOUBTFUL = re.compile(r"\s ")
_LOADED: dict[str, "Counter"] = {}


def _separable(path: str) -> bool:
    """Whether the tokenizer in this file never joins or changes text across a space that follows another
    character: byte-level with the usual word pattern, no prefix space, nothing normalised before, no truncation
    or padding, no added token that takes the blanks beside it."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    whole = not told.get("normalizer") and not told.get("truncation") and not told.get("padding")
    added = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in told.get("added_tokens") or [])
    return bool(plain and whole and not added and model.get("type") == "BPE" and not model.get("dropout"))


class Counter:
    """Counts the tokens of texts with the tokenizer in one file; one of these lives in each worker."""

    def __init__(self, path: str, memory: int = MEMORY_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separable = _separable(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}  # lengths of words, each with the space that stands before it
        self.tails: dict[str, int] = {}
        self.memory = memory

    def encode(self, parts: list[str]) -> list[int]:
        """Lengths of the parts, in calls of about as many bytes each."""
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        got = [0] * len(parts)
        for i, j in slices([len(parts[k]) + 16 for k in order], CALL_BYTES):
            call = order[i:j]
            for k, e in zip(call, self.tokenizer.encode_batch_fast([parts[k] for k in call], add_special_tokens=False)):
                got[k] = len(e)
        return got

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The head of ``text`` and the words after it, each to be read with one space before it.

        Cuts only before a space that follows a non-space character and has one after it. A text whose
        spaces would cut through an added token stays whole, and so does every text if the tokenizer is not
        known to keep such parts apart.
        """
        if not self.separable or any(" " in s and s in text for s in self.specials):
            return text, []
        head, *words = text.split(" ")
        if words and (_DOUBTFUL.search(text) or text[0] == " " or text[-1] == " "):
            parts = [head]
            for w in words:
                if w and not w[0].isspace() and parts[-1] and not parts[-1][-1].isspace():
                    parts.append(w)
                else:
                    parts[-1] += " " + w
            head, *words = parts
        return head, words

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        known, tails = self.known, self.tails
        new = set()
        for _, words in cut:
            new.update(words)
        new.difference_update(known)
        stems = {w: w.rstrip(".,") for w in new}  # letters never share a token with what follows them
        stems = {w: s if s.isalpha() else w for w, s in stems.items()}
        ask = list({s for s in stems.values() if s not in known})
        more = list({w[len(s) :] for w, s in stems.items() if w != s} - tails.keys())
        got = self.encode([" " + w for w in ask] + more + [h for h, _ in cut])
        heads = got[len(ask) + len(more) :]
        if len(tails) + len(more) > self.memory:
            tails.clear()
            more = list({w[len(s) :] for w, s in stems.items() if w != s})
            tails.update(zip(more, self.encode(more)))
        else:
            tails.update(zip(more, got[len(ask) :]))
        known.update(zip(ask, got))
        for w, s in stems.items():
            if w != s:
                known[w] = known[s] + tails[w[len(s) :]]
        counts = [h + sum(map(known.__getitem__, words)) for h, (_, words) in zip(heads, cut)]
        for w, s in stems.items():
            if w != s:
                del known[w]
        for w in ask:
            if len(known) <= self.memory and len(w) <= MEMORY_CHARS:
                break
            del known[w]
        for w in ask:
            if len(w) > MEMORY_CHARS:
                known.pop(w, None)
        return counts


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most ``most`` units each, or one row."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    No begin, end or added special tokens; special strings inside texts are handled as the tokenizer does
    by default. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows, an empty
    table an empty table; other columns are ignored. ``tokenizer_path`` must exist on every worker.
    """
    kind = docs.schema[key].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _LOADED.get(tokenizer_path)
        if counter is None:
            counter = _LOADED[tokenizer_path] = Counter(tokenizer_path)
        for batch in batches:
            chars = pa.compute.fill_null(pa.compute.utf8_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(chars, SLICE_CHARS):
                ids, texts = batch.column(0)[i:j], [t or "" for t in batch.column(1)[i:j].to_pylist()]
                n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(counted, f"`{key}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document: a row for each row of ``documents``.

    Null and empty texts have no bytes and no tokens; texts of any length are counted whole; repeated rows give
    equal rows; an empty table gives none; no other column is read, whatever its name.
    """
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE: dict[str, str] = {}
