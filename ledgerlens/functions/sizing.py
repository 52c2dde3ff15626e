"""Size-checked broadcast.

A join side is broadcast only after it is proven small, by one aggregate over the
side itself: its rows, and the actual bytes of its text columns, which give its
in-memory size as rows x (row header + 8 bytes per field) + variable-length
bytes.  The measurement is a Spark job over the (usually small) dimension when
the plan is built.  It is not kept between calls: files may grow in a session.
Above either limit the side is returned untouched and Spark plans a shuffle
join, where AQE can still split skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import settings
from ledgerlens.session import work_dir


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df`` as broadcast rows: per row a null-bit word plus 8
    bytes per field, plus the measured bytes of variable-length columns (each
    rounded up to 8)."""
    fields = df.schema.fields
    var = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    wide = [f.name for f in fields if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 18]
    parts = [F.count(F.lit(1)).alias("n")]
    parts += [F.coalesce(F.sum((F.octet_length(F.col(c)) + 7).bitwiseAND(F.lit(-8))), F.lit(0))
              .alias(f"v{i}") for i, c in enumerate(var)]
    row = df.agg(*parts).first()
    n = row["n"]
    return n, n * (8 + 8 * len(fields) + 16 * len(wide)) + sum(row[f"v{i}"] for i in range(len(var)))


def row_count(df: DataFrame) -> int:
    """Rows of ``df`` now."""
    return df.count()


def byte_size(df: DataFrame) -> int:
    """In-memory size of ``df`` as broadcast rows (see :func:`measure`)."""
    return measure(df)[1]


def fits_broadcast(df: DataFrame, max_rows: int | None = None,
                   max_bytes: int | None = None) -> bool:
    """True when ``df`` has, as measured now, at most ``max_rows`` rows and at most
    ``max_bytes`` bytes in memory."""
    rows = settings.BROADCAST_MAX_ROWS if max_rows is None else max_rows
    limit = settings.BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    n, size = measure(df)
    return n <= rows and size <= limit


def bounded_broadcast(df: DataFrame, max_rows: int | None = None,
                      size_of: DataFrame | None = None) -> DataFrame:
    """Hint ``df`` for broadcast iff it is provably small (see :func:`fits_broadcast`).

    ``size_of`` names a cheaper DataFrame whose size bounds ``df``'s; by default
    ``df`` itself is measured.
    """
    return F.broadcast(df) if fits_broadcast(df if size_of is None else size_of, max_rows) else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored by a reliable checkpoint in the session's shared folder,
    so that what it holds survives the loss of an executor."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
