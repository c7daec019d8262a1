"""The corpus pipeline: quality, lines, near duplicates, benchmarks, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept.  Its result is written as Parquet and read again as the next one's
documents; all but the last return the columns of ``documents``.

Odd rows: quality rules drop null, empty and short texts (too few words).  The stages
after them take such texts as their operators say: no line, no shingle, no item, one
end id.  Texts of any length count whole.  Rows with a null id lose no line, are near
duplicates of nothing and hold no item; rows that share an id are one document to the
line, duplicate and benchmark stages, and documents of their own to the others.
Columns of any other name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontam, linedup, minhash, packing, quality
from textquarry.plans.joins import cut_lineage, fits_broadcast


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the length, repetition and fertility bands."""
    return quality.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in one; n_chars follows the text."""
    columns = docs.columns
    cleaned = linedup.dedup_lines(docs)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(kind))
    return cleaned.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates; ids that are few travel to the texts."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = cut_lineage(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    gone = F.broadcast(gone) if fits_broadcast(gone, max_rows=minhash.BROADCAST_IDS) else gone
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.clean_documents(docs, items)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids and their places in 4,096-token sequences."""
    packed = packing.pack(docs)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Stages encode texts by a public vocabulary, which SQL cannot express; the
# pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
