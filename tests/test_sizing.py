"""Broadcast only behind a proof of rows and bytes."""

from ledgerlens.functions import sizing


def test_byte_size_counts_actual_text(spark):
    small = spark.createDataFrame([(1, "ab"), (2, "abcd")], "k long, s string")
    # per row: 8 (null bits) + 2 fields x 8; text rounded up to 8 bytes each
    assert sizing.byte_size(small) == 2 * (8 + 16) + 8 + 8
    big = spark.createDataFrame([(i, "x" * 10_000) for i in range(50)], "k long, s string")
    assert sizing.byte_size(big) >= 50 * 10_000


def test_few_rows_with_long_text_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, "x" * 10_000) for i in range(50)], "k long, s string")
    assert sizing.fits_broadcast(df, max_rows=1000, max_bytes=10 ** 7)
    assert not sizing.fits_broadcast(df, max_rows=1000, max_bytes=100_000)
    assert not sizing.fits_broadcast(df, max_rows=10)
    hinted = sizing.bounded_broadcast(df.select("k"), size_of=df, max_rows=10)
    assert "broadcast" not in hinted._jdf.queryExecution().logical().toString().lower()


def test_a_grown_dimension_is_measured_again(spark, scratch):
    """Files that grow in a session are not broadcast on an old measurement."""
    import os
    path = os.path.join(scratch, "grow-dim")
    spark.range(10).write.mode("overwrite").parquet(path)
    assert "broadcast" in sizing.bounded_broadcast(spark.read.parquet(path))._jdf.queryExecution().logical().toString().lower()
    spark.range(3_000_000).write.mode("append").parquet(path)
    grown = spark.read.parquet(path)
    assert sizing.row_count(grown) == 3_000_010
    assert "broadcast" not in sizing.bounded_broadcast(grown)._jdf.queryExecution().logical().toString().lower()
