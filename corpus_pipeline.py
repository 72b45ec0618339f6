"""The corpus pipeline: language ID, line dedup, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of ``documents``; more columns, whatever their names, are carried along. An empty table gives
an empty result at every stage, and repeated rows are rows like others unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutloom.llm import jaccard_join, langid, line_dedup, mixing, packing
from cutloom.llm.common import drop_folder, scratch, shared_dir, staged, table
from cutloom.llm.queries import tokenizer_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null or empty text, no letters) go; very long texts are judged whole.

    Equal texts share their fate. If no document is labelled, every text with a letter stays.
    """
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go, in texts of any length; documents stay, with empty text if no line is left.

    A null text stays null. Repeated rows count as documents; a line in exactly ten documents goes.
    """
    return line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (word 5-grams, similarity 0.8) stays, of least id, a null id last.

    Texts without words are alike only if equal, null and empty ones among them; of repeated rows one stays.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1, at most three times.

    A null source is one of its own; null and empty texts have no words and are taken as often as their neighbours.
    """
    return mixing.mix(docs, weights=(5, 2, 1), cap=3.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens; null and empty texts are an end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages on ``docs``. A stage's own tables go when its result is written, and that goes when the next one's is."""
    at, before = shared_dir(spark), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), f"{at}/{name}")
        if before:
            drop_folder(spark, f"{at}/{before}")
        before = name
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)
