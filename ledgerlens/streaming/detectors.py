"""Incremental forms of the late-night (3d) and velocity (3c / V6) patterns.

* :func:`late_night_alerts` is stateless: filter by hour, then a stream-static
  join to the account and merchant dimensions (broadcast when proven small).
* :func:`velocity_alerts` is a stream-stream inner self-join on the account
  (and day) with an event-time range condition.  Watermarks on both sides let
  Spark drop join state older than ``max_minutes + 1`` minutes plus the allowed
  lateness, so state stays bounded however long the stream runs.  A pair is
  emitted as soon as both rows have arrived; rows later than the watermark are
  not paired (the batch report over the same rows remains the exact answer).

Checkpoints go under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens import schema as S
from ledgerlens.functions.measures import hour_between, transaction_time
from ledgerlens.functions.sizing import bounded_broadcast
from ledgerlens.operators.interval import utc_instant
from ledgerlens.session import checkpoint_dir


def read_transactions(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of model-layout transaction files (Parquet) arriving in ``path``."""
    reader = spark.readStream.schema(S.TRANSACTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def late_night_alerts(stream_tx: DataFrame, accounts: DataFrame, merchants: DataFrame,
                      first_hour: int = S.LATE_NIGHT_FIRST_HOUR,
                      last_hour: int = S.LATE_NIGHT_LAST_HOUR) -> DataFrame:
    """Streaming 3d: each late-night transaction with account and merchant details."""
    a = accounts.select("account_id", "full_name", "risk_tier")
    m = merchants.select("merchant_id", "merchant_name", "merchant_category")
    return (stream_tx.filter(hour_between(first_hour, last_hour))
            .join(bounded_broadcast(a), "account_id", "inner")
            .join(bounded_broadcast(m), "merchant_id", "inner")
            .select("account_id", "full_name", "risk_tier", "transaction_id", "transaction_date",
                    transaction_time().alias("transaction_time"), "amount", "transaction_status",
                    "merchant_name", "merchant_category"))


def velocity_alerts(stream_tx: DataFrame, min_minutes: int = S.VELOCITY_MIN_MINUTES,
                    max_minutes: int = S.VELOCITY_MAX_MINUTES, lateness: str = "10 minutes",
                    same_day: bool = True) -> DataFrame:
    """Streaming 3c: (current, previous) pairs ``min..max`` whole minutes apart."""
    if min_minutes < 1 or max_minutes < min_minutes:
        raise ValueError("streaming velocity needs 1 <= min_minutes <= max_minutes")
    cols = ["account_id", "transaction_id", "transaction_date", "transaction_ts", "amount",
            "transaction_status", "event_time"]
    base = (stream_tx.withColumn("event_time", utc_instant("transaction_ts"))
            .select(*cols).withWatermark("event_time", lateness))
    cur = base.select(*[F.col(c).alias(f"c_{c}") for c in cols])
    prev = base.select(*[F.col(c).alias(f"p_{c}") for c in cols])
    cond = ((F.col("c_account_id") == F.col("p_account_id"))
            & (F.col("c_transaction_id") != F.col("p_transaction_id"))
            & (F.col("c_event_time") >= F.col("p_event_time")
               + F.expr(f"INTERVAL {int(min_minutes)} MINUTES"))
            & (F.col("c_event_time") < F.col("p_event_time")
               + F.expr(f"INTERVAL {int(max_minutes) + 1} MINUTES")))
    if same_day:
        cond = cond & (F.col("c_transaction_date") == F.col("p_transaction_date"))
    return cur.join(prev, cond, "inner").select(
        F.col("c_account_id").alias("account_id"),
        F.col("c_transaction_id").alias("current_txn"),
        F.col("c_transaction_date").alias("transaction_date"),
        transaction_time("c_transaction_ts").alias("transaction_time"),
        F.col("c_amount").alias("current_amount"),
        F.col("c_transaction_status").alias("current_status"),
        F.col("p_transaction_id").alias("previous_txn"),
        transaction_time("p_transaction_ts").alias("previous_time"),
        F.col("p_amount").alias("previous_amount"),
        F.timestamp_diff("MINUTE", F.col("p_event_time"), F.col("c_event_time"))
         .alias("minutes_apart"))


def start(df: DataFrame, sink_path: str, name: str | None = None,
          trigger: dict | None = None) -> StreamingQuery:
    """Append ``df`` to Parquet at ``sink_path`` with a checkpoint in the shared folder."""
    spark = df.sparkSession
    qname = name or f"ledgerlens_{uuid.uuid4().hex[:8]}"
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{qname}"
    writer = (df.writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", ckpt).outputMode("append").queryName(qname))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
