"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of ``documents``;
the last says where each piece of each document goes in the packed sequences. In every stage texts of any
length are taken whole, repeated rows are treated alike, more columns of any name pass through untouched (the
last leaves them out), and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm.common import table, written
from caseloom.llm.decontaminate import decontaminated
from caseloom.llm.language import recognised
from caseloom.llm.neardup import deduplicated
from caseloom.llm.packing import packed
from caseloom.llm.pii import redacted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach. Null and empty texts and those without letters go;
    of languages with equal codes the first in the alphabet counts."""
    return recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least doc_id, of each group of near duplicates: five words, 0.8. Texts that are
    null or without words are in no group and stay."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth at least is passages of the benchmark. Null and empty texts stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; no document goes. Null texts stay null; of overlapping finds the first is masked."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of permitted lengths. Null and empty texts are pieces of length 0; ties go by
    id, piece and row."""
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL has neither the language model nor the packing; tests hold the stages against brute force: the code lengths
#: against a slow coder, groups against all pairs, passages against every window, finds against the bare patterns and
#: literal disguises, the packing against a slow best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table; what lies between them goes to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
