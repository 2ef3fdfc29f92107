"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

Every stage takes rows with a null in any column, empty and very long texts, repeated rows, further columns of any name and
empty tables; what it does with them stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, ngram_join, packing, quality, secrets
from corpuscle.session import staged

DROP_ROWS = 1_000_000
ROW = "near_duplicates_row"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts, all rows of them. Null texts score as empty; without labels of both kinds all stay."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect: that of the smallest doc_id, the first such row of docs if several.

    Rows are told apart by a number, not by doc_id, so a text stays whatever another row of its doc_id holds. Exact copies
    are linked, so of repeated rows one stays. Rows without doc_id all stay, as do texts without words.
    """
    own = staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    found = staged(ngram_join.rooted(own, keys=(ROW,)).filter("root IS NOT NULL AND doc_id IS NOT NULL").select("root", "doc_id", "least", ROW), "rooted")
    first = found.filter("doc_id = least").groupBy("root").agg(F.min(ROW).alias(ROW))
    gone = staged(found.select(ROW).join(first.select(ROW), ROW, "left_anti"), "gone")
    small = gone.limit(DROP_ROWS + 1).count() <= DROP_ROWS  # 8 MB of numbers; more are joined by shuffling
    return own.join(F.broadcast(gone) if small else gone, ROW, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Null and empty texts hold none; without items all rows stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced. Null texts stay null; no row goes."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets. Null and empty texts are one piece; repeated rows repeat."""
    return packing.pack(packing.pieces(docs, with_ids=False))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # learned scores, automata and packing have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
