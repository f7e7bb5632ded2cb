"""From documents to token ids: the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import bpe, decontaminate, exact_dedup, quality, simhash

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer accepts."""
    return quality.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.representatives(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that they share with the benchmark; n_chars follows."""
    clean = decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", cut_benchmark_passages),
    ("byte-level BPE", encode),
]
#: The stages learn a model, follow chains of links and merge byte pairs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Each stage is written to the shared folder before the next one reads it;
    what it took to get there is deleted, and the stage's own rows when the next
    one is written.
    """
    from treeloom.llm.common import collected, drop_written, written

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        with collected() as made:
            docs = stage(spark, docs, sf_dir)
            if i == len(STAGES) - 1:
                break
            docs, path = written(docs, "stage")
        for old in before + made:
            if old != path:
                drop_written(spark, old)
        before = [path]
    return docs
