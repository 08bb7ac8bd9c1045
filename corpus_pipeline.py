"""The corpus pipeline: five operators of codegraph.llm in a row, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegraph.llm import decontaminate, jaccard, langid, mixing, sharding
from codegraph.llm.shared import drop_staged, free_name, quoted, step, written

#: Texts whose best language has a smaller cosine are rejected with those that have no letter.
MIN_SCORE = 0.05


@step
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language: rejected are null texts, texts without a letter or like no known language.

    Prototypes are learned from the labels of the documents themselves, but for the held-out third. Repeated rows are
    judged one by one; further columns of any name are kept.
    """
    prototypes = langid.learn(docs.where(~langid.held_out()))
    lang, score = free_name("found_lang", docs), free_name("found_score", docs)
    judged = langid.predict(docs, prototypes, lang_col=lang, score_col=score)
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*map(quoted, docs.columns))


@step
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more.

    Candidates come from the covering tables of SimHash fingerprints and, for pairs that differ in more bits than any
    tables cover, from a prefix filter; all are verified. The smallest id of a group stays, rows without an id last.
    Texts without words, null ones too, are one group.
    """
    return jaccard.keep_one(docs)


@step
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a test item, those without an id too. Null and empty texts hold none."""
    return decontaminate.drop_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@step
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take from each source the words that its weight asks for; ``n_chars`` is that of the words taken.

    Null is a source. Documents of which nothing is taken go, null and empty texts among them; of others row k holds
    the blocks that are taken at least k times. Rows with equal ids are told apart by their place.
    """
    mixed = mixing.mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(quoted, docs.columns))


@step
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle all rows into shards of equal counts, whatever they hold; nulls and repeated rows are rows like others."""
    return sharding.shard(docs)


STAGES = [("language_id", identify), ("simhash_dedup", near_dedup), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]

#: Hyperdimensional profiles and keyed permutations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it; what a stage has read is deleted once its own rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, apply) in enumerate(STAGES[:-1]):
        done = written(apply(spark, docs, sf_dir), name)
        if at:
            drop_staged(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
