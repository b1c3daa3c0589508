"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before has kept, and its result is written as Parquet and read again. A null or
empty text, repeated rows, ties and further columns are handled as the operators' docstrings say; an empty table
gives an empty table after every stage. A stage's frame is to be written before the next stage is called, which deletes what the
stage had staged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rubrica.llm import exact_dedup, mixing, near_dedup, packing, queries, toxicity
from rubrica.llm.common import release, staged, staged_so_far, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last = [0, 0]  # the last stage's own tables in the shared folder


def stage(f: Stage) -> Stage:
    """A stage is called when the one before is written: the tables that one staged on its way go first."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(*_last)
        _last[:] = staged_so_far(), staged_so_far()
        out = f(spark, docs, sf_dir)
        _last[1] = staged_so_far()
        return out

    return run_stage


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at 0.5 or more go."""
    return toxicity.rejected(docs, table(spark, sf_dir, "labels"))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space at most, one stays."""
    return exact_dedup.deduplicate(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest id stays."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The first and the last stage have no SQL; tests hold every stage against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        out = f(spark, docs, sf_dir)
        mark = staged_so_far()
        docs = staged(out, name.replace(" ", "-"))
        if before is not None:
            release(before, before + 1)  # its input has been read
        before = mark
    return docs
