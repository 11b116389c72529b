"""The corpus pipeline: stages over documents, each one of the operators in netdrift.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, what the stages before it kept. All but
the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netdrift.llm import langid, line_dedup, near_dedup, packing, toxicity
from netdrift.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or of no clear language, go."""
    return langid.keep_known(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, by the labels of ``sf_dir`` on the documents at hand."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least 3 of them share; n_chars follows the text."""
    return line_dedup.without_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' ids, each a sequence of a power-of-two length."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [("language", language), ("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("packing", packed)]
#: The models and the near-duplicate classes are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
