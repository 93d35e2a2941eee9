"""The corpus pipeline: language ID, near-duplicates, personal data, source mixing, packing.

Each stage works on everything its predecessor kept; between stages the documents are written as Parquet to the shared
folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import langid, minmax_dedup, mixing, packing, pii
from candela.llm.common import mark, materialise, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept.

    Texts that are null or without letters and texts unlike every language go; repeated rows share their fate, and an
    empty table stays empty.
    """
    told = langid.identify(docs, ~langid.held_out())
    return told.where(~F.col(f"`{told.columns[-1]}`.rejected")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose five-word shingles agree by 0.8 or more.

    The smallest doc_id of a group stays, once even if its row repeats; documents without words or without a doc_id stay.
    """
    return minmax_dedup.drop_near_duplicates(docs, link=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null."""
    return pii.redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate draws them, in a global random order.

    Documents without a source are a source of their own; a document drawn zero times goes.
    """
    return mixing.replicate(docs).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Language models cannot be expressed in SQL; tests/llm checks the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has put aside is removed once the stage's own result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        start = mark()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            end = mark()
            docs = materialise(docs, name)
            release(spark, start, end)
    return docs
