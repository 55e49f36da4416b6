"""A corpus pipeline of five stages over `documents`: toxicity, line dedup, MinHash near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame, which is written as
Parquet and read back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesalith.llm import line_dedup, near_dedup, packing, secrets, toxicity
from mesalith.llm._common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field doesn't predict toxic. A repeated id goes only with its text; null ids are judged like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.labelled.sample(docs, labels, "toxic", 3, 1, toxicity.SAMPLE_DOCS))
    return toxicity.drop_toxic(docs, model).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus, equal or within one edit; all documents stay."""
    return _counted(line_dedup.line_dedup(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; all documents stay."""
    return _counted(secrets.redact_secrets(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_near), ("secret scan", mask_secrets), ("packing", pack)]

#: A classifier, an edit-distance join, sketches and a tokenizer: SQL can't express these; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
