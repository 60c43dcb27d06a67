"""Corpus pipeline: documents through the stages in order, each stage's rows the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import decontaminate, mixing, ngram_join, pii, quality
from helicase.llm._common import WORD, checkpoint

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the lines that passed."""
    return _documents(quality.clean_lines(docs).where("quality.kept").withColumn("text", F.col("quality.text")))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: these are cut out; a document with nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark, then="clean")
    return _documents(found.where((F.size("spans") == 0) | F.col("text").rlike(WORD)))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _documents(pii.pseudonymize(docs, pii.DEMO_KEY))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with whole repetitions and the words of a further, fractional one."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII surrogates", pii_stage),
    ("mixing sources", mixing_stage),
]

#: Keyed surrogates change the texts in ways SQL doesn't express; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it kept is written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
