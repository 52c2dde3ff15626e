"""One registered query per operator, over its whole intended table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    dac,
    decontamination,
    html_text,
    langid,
    minhash,
    neighbours,
    packing,
    quality,
    runs,
    secrets,
    sharding,
    simhash,
    spelling,
)
from ledgerlens.llm.common import new_path, table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return (langid.identified(docs.select("doc_id", "text"), model)
            .select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy",
                    "rejected"))


def op3_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents") if docs is None else docs,
                          public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "source", "padded_to")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (html_text.extracted(table(spark, sf_dir, "pages"))
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)
            .withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dac")
    dac.write_token_files(table(spark, sf_dir, "documents"), path,
                          public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return (dac.read_documents(spark, path)
            .select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"),
                        F.sha2(F.concat_ws(",", "secrets"), 256).alias("secrets_sha256"), "max_probability")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return (quality.scored(docs.select("doc_id", "text"), model)
            .select("doc_id", quality.held_out().alias("held_out"), "score", "predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", "fingerprint", "component_id"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), plant=True)


def planted_period(doc_id: int, n: int) -> tuple[int, int] | None:
    """Of one document in ten by crc32 of its id, a repetition that begins at a hashed word."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return (g % n, 1 + (n - g % n) // (3 + g % 8)) if h % 10 == 0 else None


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (minhash.near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id", "kept"))


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_langid": op2_langid,
    "op3_packing": op3_packing,
    "op4_html": op4_html,
    "op5_sharding": op5_sharding,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_runs": op12_runs,
    "op13_minhash": op13_minhash,
}

#: DuckDB SQL where it can express a query
ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": decontamination.SQL,
    "op11_spelling": spelling.SQL,
    "op12_runs": runs.SQL,
    "op13_minhash": minhash.SQL,
}
