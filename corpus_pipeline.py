"""Documents through language ID, near-dedup, decontamination, secret scans and mixing, each stage written and read again."""

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm import decontaminate, langid, mixing, secrets, simhash
from fieldmark.llm.common import cut, table

#: A prediction below this share is no prediction.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told; those without a letter, or that no language's model tells apart, go.

    lang becomes the predicted language.
    """
    return langid.keep_told(docs, langid.learn(docs.select("doc_id", "text", "lang")), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 and somewhat below), that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many copies and words."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("mixing", mixing_stage)]
#: Language ID, fingerprints and links can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
