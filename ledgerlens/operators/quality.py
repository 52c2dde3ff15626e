"""Data-quality checks for the declared constraints (Q1-Q6).

Spark tables do not enforce keys, uniqueness or NOT NULL, so the declared rules
of :data:`ledgerlens.schema.CONSTRAINTS` are checked as jobs:

* key / uniqueness: one aggregate on the key (partial counts, then a shuffle of
  one row per distinct key and split);
* NOT NULL and length limits: one single-pass aggregate per table, no shuffle
  beyond one row per split;
* foreign keys: a left-anti join; the parent side is broadcast only when its row
  count is proven small.

Per-violation functions return the offending rows or keys; the ``*_report``
functions return one summary row per rule for all four tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.sizing import bounded_broadcast
from ledgerlens.sources.tables import TABLE_NAMES, Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---------------------------------------------------------------------------
# Row-level checks
# ---------------------------------------------------------------------------

def duplicate_keys(df: DataFrame, cols: list[str] | tuple[str, ...]) -> DataFrame:
    """Q1/Q2. Key values that occur more than once, with their multiplicity."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("occurrences"))
              .filter(F.col("occurrences") > 1))


def null_rows(df: DataFrame, cols: list[str] | tuple[str, ...]) -> DataFrame:
    """Q3. Rows with a NULL in any of ``cols``."""
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.filter(cond)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Q4. Child rows whose non-NULL ``fk`` has no parent row (NULL is not checked)."""
    keys = parent.select(F.col(pk).alias("_pk"))
    return (child.filter(F.col(fk).isNotNull())
                 .join(bounded_broadcast(keys), F.col(fk) == F.col("_pk"),
                       "left_anti"))


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Q5. Rows with a value longer than its declared VARCHAR length."""
    have = set(df.columns)
    present = {c: n for c, n in limits.items() if c in have}
    cond = reduce(lambda a, b: a | b,
                  [F.length(F.col(c).cast("string")) > n for c, n in present.items()])
    return df.filter(cond)


def fill_default(df: DataFrame, column: str, value: object) -> DataFrame:
    """Q6. Apply a column DEFAULT: add the column when it is absent.  An explicit NULL is no
    omission; it stays and Q3 reports it."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


# ---------------------------------------------------------------------------
# Summary reports over the whole bundle
# ---------------------------------------------------------------------------

def primary_key_report(tables: Tables) -> DataFrame:
    """Per table: rows, key values occurring more than once, rows with a NULL key."""
    frames = []
    for name in TABLE_NAMES:
        pk = list(S.CONSTRAINTS[name].primary_key)
        df = tables.as_dict()[name]
        null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
        per_key = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_c"))
        frames.append(per_key.agg(
            F.sum("_c").alias("row_count"),
            F.count(F.when(F.col("_c") > 1, F.lit(1))).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(null_key, F.col("_c"))), F.lit(0)).alias("null_keys"),
        ).select(F.lit(name).alias("table_name"), F.lit(",".join(pk)).alias("key_columns"),
                 F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
                 "duplicate_keys", F.col("null_keys").cast("long").alias("null_keys")))
    return _union(frames)


def unique_report(tables: Tables) -> DataFrame:
    """Per declared UNIQUE column set: number of values held by more than one row."""
    frames = []
    for name in TABLE_NAMES:
        df = tables.as_dict()[name]
        have = set(df.columns)
        for cols in S.CONSTRAINTS[name].unique:
            if not all(c in have for c in cols):
                continue
            dup = (df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
                     .groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
                     .agg(F.count(F.when(F.col("_c") > 1, F.lit(1))).alias("duplicate_values")))
            frames.append(dup.select(F.lit(name).alias("table_name"),
                                     F.lit(",".join(cols)).alias("column_name"),
                                     "duplicate_values"))
    return _union(frames)


def _per_column_counts(df: DataFrame, name: str, checks: dict[str, Column],
                       value_name: str) -> DataFrame:
    """One aggregate pass computing one count per column, returned as rows."""
    counts = [F.struct(F.lit(c).alias("column_name"), F.count_if(cond).alias(value_name))
              for c, cond in checks.items()]
    return df.agg(F.array(*counts).alias("_r")).select(
        F.lit(name).alias("table_name"), F.inline("_r"))


def not_null_report(tables: Tables) -> DataFrame:
    """Per NOT NULL column: number of NULLs (one scan per table)."""
    frames = []
    for name in TABLE_NAMES:
        df = tables.as_dict()[name]
        have = set(df.columns)
        cols = [c for c in S.CONSTRAINTS[name].not_null if c in have]
        frames.append(_per_column_counts(df, name, {c: F.col(c).isNull() for c in cols},
                                         "null_count"))
    return _union(frames)


def limits_report(tables: Tables) -> DataFrame:
    """Per length-limited column: values longer than the declared length; for the
    money column: values that DECIMAL(12,2) cannot hold exactly.

    Typed money can hold nothing else, so that rule tells something on a bundle
    whose amounts are raw text or wider decimals.
    """
    frames = []
    for name in TABLE_NAMES:
        df = tables.as_dict()[name]
        have = set(df.columns)
        checks = {c: F.length(F.col(c).cast("string")) > n
                  for c, n in S.CONSTRAINTS[name].max_length.items() if c in have}
        if name == "transactions" and "amount" in have:
            typed, wide = F.col("amount").try_cast(S.MONEY), F.col("amount").try_cast("decimal(38,18)")
            checks["amount"] = F.col("amount").isNotNull() & ~wide.eqNullSafe(typed.cast("decimal(38,18)"))
        frames.append(_per_column_counts(df, name, checks, "violations"))
    return _union(frames)


def foreign_key_report(tables: Tables) -> DataFrame:
    """Per foreign key: child rows whose key has no parent row."""
    frames = []
    d = tables.as_dict()
    for name in TABLE_NAMES:
        for fk, parent, pk in S.CONSTRAINTS[name].foreign_keys:
            # rows per key first: the join sees each key once, however many rows hold it
            held = d[name].groupBy(fk).agg(F.count(F.lit(1)).alias("_rows"))
            n = orphans(held, fk, d[parent], pk).agg(
                F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("orphan_rows"))
            frames.append(n.select(F.lit(name).alias("child_table"), F.lit(fk).alias("column_name"),
                                   F.lit(parent).alias("parent_table"), "orphan_rows"))
    return _union(frames)
