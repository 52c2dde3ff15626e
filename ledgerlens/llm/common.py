"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import session


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the session was started
    (on a cluster, ship it with --py-files or install it)."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder of intermediate tables (see :func:`ledgerlens.session.work_dir`)."""
    importable(spark)
    return session.work_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    importable(spark)
    return f"{session.common_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage by a reliable checkpoint."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows that share a key from which on the key counts as hot, and hot keys that are broadcast at most
HOT_ROWS, HOT_KEYS, SALTS = 1_000, 100_000, 8


def hot_join(rows: DataFrame, slim: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to ``slim`` (one row a ``key``) on ``key``; ``slim.count`` says how many rows
    share the key.

    Rows of hot keys are not shuffled: the few hot rows of ``slim`` (counted) go to them.  With
    more than ``HOT_KEYS`` of them, both sides are salted instead.
    """
    hot = kept(slim.where(F.col(count) > HOT_ROWS))
    held = hot.count()
    if not held:
        return rows.join(slim, key)
    if held > HOT_KEYS:
        others = [F.col(c) for c in rows.columns if c != key]
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)) if others else F.lit(0).cast("long"))
        spread = slim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return salted.join(spread, [key, "_salt"]).drop("_salt")
    near = F.broadcast(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(slim.where(F.col(count) <= HOT_ROWS), key)
    return rows.join(near, key).unionByName(cold)


def crc32_text(column: str = "doc_id"):
    """Unsigned crc32 of a value as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
