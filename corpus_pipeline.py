"""A training corpus out of raw documents, in five stages that each call one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last return the columns of documents.

Defined results, for every stage: a null text counts as empty, and empty ones fail the quality rules; rows without an id go through
(they are in no group of copies by id, come last in repeated passages, and share one number in sampling); rows that
repeat are judged alike and stay or go together, but for equal passages, which only rows with smaller ids take away; ties go to the
smaller id; texts of any length are worked on whole; further columns come along untouched, whatever their names; an
empty table gives an empty one with the same columns. Without labels the fixed rules alone decide.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reachlens.llm import mixing, packing, quality, simhash, suffix_dedup
from reachlens.runtime import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short ones, repetitive ones, and those that the model (fitted on
    the labels of ``sf_dir``) finds below the threshold."""
    return quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows with that id all do, and rows without an id."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of a document with a smaller id are cut out, by whole characters, and ``n_chars`` follows; a document of which nothing
    is left goes."""
    return suffix_dedup.deduped(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their target shares, as far as KEEP of the tokens can. Null
    classes are a class of their own; texts without words weigh nothing."""
    return mixing.mix(docs, keep=mixing.KEEP).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences; a text that is empty still has its end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixture", mixture), ("sequences", sequences)]

#: SimHash, the fitted model and the tokenizer can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)  # the stage's input, if a stage wrote it
    return STAGES[-1][1](spark, docs, sf_dir)
