"""Corpus pipeline: language, near-duplicates, repeated passages, source mix, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns
a DataFrame; all but the last return the columns of ``docs``. What a stage returns is written to the
shared folder and read back by the next one, so no stage computes another one's work again.

Empty tables give empty tables; null ids, null and empty texts, repeated rows, ties and extra columns of any name
are kept or dropped as each operator's docstring says, and extra columns pass unchanged up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import langid, mixing, near_copies, packing, suffix
from ledgerloom.llm.common import fold, table
from ledgerloom.session import StagingScope, stage, staging_scope

StageFunction = Callable[[SparkSession, DataFrame, str], DataFrame]
# What earlier stages staged inside and their results read; deleted when the next stage begins.
_inner: list[StagingScope] = []


def _freeing(function: StageFunction) -> StageFunction:
    """Stage function that first deletes the inner tables of stages whose results are written.

    A result is to be written before the next stage function is called, as ``run`` does. Tables that ``docs``
    itself still reads stay.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        for scope in list(_inner):
            if not any(path.split("/")[-2] in file for path in scope.paths for file in files):
                scope.drop()
                _inner.remove(scope)
        with staging_scope(spark, drop=False) as scope:
            result = function(spark, docs, sf_dir)
        _inner.append(scope)
        return result

    return run_stage


@_freeing
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a wide enough margin; null texts and texts without a letter go."""
    learned = langid.learn_dictionaries(docs, fold("doc_id", 4) != 2)
    return langid.accepted_rows(docs, learned)


@_freeing
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates (five-word Jaccard of 0.8).

    Null ids come last; rows that repeat an id count one by one; all texts without words are one group.
    """
    return near_copies.keep_one(docs)


@_freeing
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that occur earlier; no row goes, null texts become empty."""
    return suffix.without_repeats(docs)


@_freeing
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; documents without words have no size and are not taken."""
    return mixing.mixed(docs)


@_freeing
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of token ids; every row is a document of its own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("simhash_dedup", one_of_near_duplicates),
    ("passage_dedup", without_repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]
# Compression sizes, XXH64 and the tokenizer are not in DuckDB; tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        with staging_scope(spark, drop=False) as scope:
            docs = stage(function(spark, docs, sf_dir), name)
        # the result before this one has been read for the last time
        if before is not None:
            before.drop()
        before = scope
    return STAGES[-1][1](spark, docs, sf_dir)
