"""Corpus pipeline: documents in, training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read back as the next stage's documents.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, quality, queries, secrets, simhash
from ledgerlens.llm.common import importable, kept, stored, table

#: the columns that all stages but the last one return
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.3).

    It learns from the labels of documents whose crc32(doc_id) mod 5 is not 0.  Null and empty
    texts take the labels' mean score; without labels nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    model = quality.fit(docs, labels)
    return quality.scored(docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: that of the smallest doc_id.

    Between rows of that id the text decides (by hash), and of repeated rows one is kept.  A row
    without an id stays only where its whole component has none, and then one of them.
    """
    found = simhash.near_duplicates(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_key")
    keep = found.groupBy("component").agg(F.min(rank).alias("row")).select("row.*")
    keep = kept(keep)
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_key"))
    rows = docs.alias("d").join(keep.alias("k"), same, "left_semi").select(*COLUMNS)
    repeated = (found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .limit(1).count())
    return rows.dropDuplicates(["doc_id", "text"]) if repeated else rows


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mask; all documents stay, ``n_chars`` follows the text."""
    found = secrets.scanned(docs)
    masked = F.when(F.size("secrets") > 0, secrets.redacted()).otherwise(F.col("text"))
    return (found.withColumn("text", masked)
            .withColumn("n_chars", F.when(F.size("secrets") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
                        .otherwise(F.col("n_chars"))).select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens; a row is a piece of a document."""
    return queries.op3_packing(spark, sf_dir, docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicate_filter),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: the classifiers and fingerprints have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each stage's result stored before the next one reads it."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
