"""The corpus pipeline: documents in, packed token sequences out.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents; documents that a stage rejects are gone after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.llm import decontaminate, langid, minhash, packing, quality
from palaver.llm.shared import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the line field scores at 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, quality.fold(F.col("doc_id"), 3) != 1)
    scored = quality.score(_aside(docs, "score"), model)
    return _columns(scored.where("score >= 0.5"), docs, "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; texts without a letter go."""
    model = langid.train(docs, quality.fold(F.col("doc_id"), 4) != 2)
    found = langid.identify(_aside(docs, "lang_pred", "score"), model)
    return _columns(found.where(F.col("lang_pred") != langid.UNKNOWN), docs, "lang_pred", "score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate class."""
    return minhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the token ids of what is left into sequences."""
    return packing.pack(docs)


def _aside(docs: DataFrame, *added: str) -> DataFrame:
    """docs with columns of these names under other ones, as the operator would replace them."""
    return docs.withColumnsRenamed({c: f"{c}__own" for c in docs.columns if c.lower() in added})


def _columns(rows: DataFrame, docs: DataFrame, *added: str) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col(f"{c}__own").alias(c) if c.lower() in added else F.col(c) for c in docs.columns))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    scratch = Scratch(spark)
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch.put(stage(spark, out, sf_dir), name)
    return out


#: Model scores, random walks and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
