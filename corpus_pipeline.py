"""A corpus pipeline over ``documents``: drop toxic texts, near-duplicates and benchmark leaks, mix to target weights, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Nulls in any column, empty and
very long texts and an empty table pass through all stages: a null text scores as one without words, links with nothing, hits nothing and is drawn
only where its source has tokens. Rows that repeat id and text count once after the second stage; ties go as each operator's docstring says. Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sastra.llm import decontamination, mixing, near_dedup, sharding, toxicity
from sastra.llm.common import read, release, store

#: Part of its input's tokens that the mixture keeps; no document is taken twice.
FRACTION, EPOCHS = 0.8, 1
#: (percent, words of a shingle): documents alike by either are near-duplicates. The first is op3's rule, which sees words
#: replaced here and there; the second sees longer texts added or cut off.
NEAR = ((85, 3), (80, 5))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows of ``docs``, scores below 0.5."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.add_scores(docs, model, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by any rule of ``NEAR``."""
    release(spark)
    return near_dedup.one_of_each(docs, *NEAR[0], also=NEAR[1:])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    release(spark)
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the weights of the domain, language and source tree."""
    release(spark)
    return mixing.mix_documents(docs, fraction=FRACTION, max_epochs=EPOCHS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there."""
    release(spark)
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
    ("sharding", shards),
]

#: SQL can't train or apply the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
