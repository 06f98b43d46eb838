"""The corpus pipeline: reject, deduplicate, redact, mix, encode.

Each stage takes the rows its predecessor kept, as Parquet read again, and makes
its decisions take effect. All stages but the last return the columns of
``documents``; the last returns token ids.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
an empty table and further columns of any name; each says below what comes of
them. Columns beyond those that a stage names pass through it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigraph.llm import bpe, jaccard_join, mixing, pii, quality
from lexigraph.llm.common import Scratch, made, sweep
from lexigraph.llm.queries import tokenizer_file


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more, learned from the labelled rows of ``docs``.

    A null or empty text scores as an empty one, a long text by the whole of it;
    equal texts fare alike, so repeated rows stay or go together; a score of
    exactly 0.5 stays; ids, null or not, decide nothing; without labels of both
    classes all stay; an empty table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of like shingle sets.

    A null text, or one without words, is like nothing and stays, each row of it;
    long texts are compared whole; of rows with the group's smallest id, or of a
    group without ids, one row stays; an id with several texts is judged text by
    text; an empty table stays empty.
    """
    return jaccard_join.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` counted anew where the text changed.

    A null text stays null and an empty one empty; long texts are searched whole;
    spans that overlap are replaced once; repeated rows stay, changed alike; an
    empty table stays empty.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, no copy, one, two or more of a row.

    A null or empty text has no words and is not taken; a null source is a source
    of its own; a long text counts by all its words and can be what a source is
    off its target; rows alike in id, source and size are rounded each, so some
    of them may be taken and others not; an empty table stays empty.
    """
    return mixing.repeat(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every copy taken.

    A null or empty text has no ids, a null id stays null; long texts are encoded
    whole; repeated rows give repeated rows; an empty table gives no rows.
    """
    return bpe.encode(docs, tokenizer_file("byte_bpe_50k.json"), decode=False)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

#: A trained classifier and random rounding have no SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = made()
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        sweep(before)  # what the stage kept for itself
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
