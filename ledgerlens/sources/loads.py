"""Loads that keep the declared keys: rows that break one leave with a reason, and later batches are
merged into a stored model by primary key.

Rules, in this order (a row leaves by the first that it breaks; broken references are listed
together): the primary key is not NULL; of rows with one key the first by the values of all its
columns stays; of rows with one UNIQUE value that with the smallest key stays; every non-NULL
reference has a row among the parents that stay.  Tables are judged parents first, so a flag of
a rejected transaction is an orphan.

Every rule first reduces the table to its keys, by aggregates that combine before the shuffle, and
then looks at the rows of the few broken keys alone; those keys are broadcast behind a size check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.sizing import bounded_broadcast, checkpointed
from ledgerlens.sources import publish as publishing
from ledgerlens.sources.tables import PARTITION_COLUMNS, TABLE_NAMES, Tables, namespace_path

REASON = "reject_reason"


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _split_by_keys(df: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` with and without a row of ``keys`` (distinct) at ``columns``."""
    k = bounded_broadcast(keys).alias("k")
    return tuple(df.alias("d").join(k, _same("d", "k", columns), how) for how in ("left_semi", "left_anti"))


def _one_a_key(df: DataFrame, columns: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: of rows that agree in ``columns`` (none of them NULL) the first stays."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    repeated = checkpointed(df.where(filled).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
                            .where("_n > 1").select(*columns))
    if not repeated.limit(1).count():
        return df, df.where(F.lit(False)).withColumn(REASON, F.lit(reason))
    several, single = _split_by_keys(df, repeated, columns)
    # equal rows are combined before they are shuffled; keys come first in the order of values
    order = [*S.CONSTRAINTS[_table_of(df)].primary_key] if _table_of(df) else []
    order += [c for c in df.columns if c not in order]
    distinct = several.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    first = distinct.groupBy(*columns).agg(F.min(F.struct(*order)).alias("_first"))
    marked = checkpointed(distinct.alias("d").join(bounded_broadcast(first).alias("f"), _same("d", "f", columns))
                          .select("d.*", F.struct(*[F.col(f"d.{c}") for c in order]).eqNullSafe(F.col("f._first")).alias("_stays")))
    kept = single.unionByName(marked.where("_stays").select(*df.columns))
    too_many = F.col("_copies") - F.col("_stays").cast("long")
    rejected = (marked.withColumn("_again", F.explode(F.sequence(F.lit(0).cast("long"), too_many)))
                .where("_again > 0").select(*df.columns, F.lit(reason).alias(REASON)))
    return kept, rejected


def _table_of(df: DataFrame) -> str | None:
    """The model table whose columns a frame has."""
    have = set(df.columns)
    return next((n for n in TABLE_NAMES if set(S.SCHEMAS[n].names) <= have), None)


def _missing(child: DataFrame, fk: str, parents: list[tuple[DataFrame, str]]) -> DataFrame:
    """Values of ``fk`` in ``child`` that no parent has, one row each."""
    asked = checkpointed(child.select(F.col(fk).alias("_key")).where("_key is not null").distinct())
    hint = bounded_broadcast(asked)
    found = [p.select(F.col(pk).alias("_key")).join(hint, "_key", "left_semi") for p, pk in parents]
    return checkpointed(asked.join(reduce(DataFrame.union, found), "_key", "left_anti"))


def _without_orphans(df: DataFrame, name: str, parents: dict[str, list[DataFrame]]) -> tuple[DataFrame, DataFrame]:
    out, reasons = df, []
    for fk, parent, pk in S.CONSTRAINTS[name].foreign_keys:
        gone = bounded_broadcast(_missing(df, fk, [(p, pk) for p in parents[parent]]).select(
            F.col("_key").alias(f"_no_{fk}")))
        out = out.join(gone, F.col(fk) == F.col(f"_no_{fk}"), "left")
        reasons.append(F.when(F.col(f"_no_{fk}").isNotNull(), F.lit(f"orphan {fk}")))
    if not reasons:
        return df, df.where(F.lit(False)).withColumn(REASON, F.lit(""))
    judged = out.withColumn(REASON, F.concat_ws("; ", *reasons)).select(*df.columns, REASON)
    return judged.where(F.col(REASON) == "").drop(REASON), judged.where(F.col(REASON) != "")


def enforce_keys(df: DataFrame, name: str, parents: dict[str, list[DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)`` rows of model table ``name`` by its declared keys and references;
    ``parents`` holds per table the frames whose rows may be referred to."""
    rules = S.CONSTRAINTS[name]
    pk = list(rules.primary_key)
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
    rejected = [df.where(null).withColumn(REASON, F.lit("null " + ",".join(pk)))]
    kept, bad = _one_a_key(df.where(~null), pk, "duplicate " + ",".join(pk))
    rejected.append(bad)
    for columns in rules.unique:
        if all(c in df.columns for c in columns):
            kept, bad = _one_a_key(kept, list(columns), "duplicate " + ",".join(columns))
            rejected.append(bad)
    kept, bad = _without_orphans(kept, name, parents)
    return kept, reduce(DataFrame.unionByName, [*rejected, bad])


def _parents(name: str) -> list[str]:
    return [p for _, p, _ in S.CONSTRAINTS[name].foreign_keys]


def enforce_model(tables: Tables, names: tuple[str, ...] = TABLE_NAMES) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Per table of ``names`` (and of those they refer to): its rows without those that break a key or
    a reference, and those rows with their ``reject_reason``."""
    wanted, kept, rejected, keys = set(names), {}, {}, {}
    for name in reversed(TABLE_NAMES):          # parents stand before their children
        if name in wanted:
            wanted.update(_parents(name))
    for name in TABLE_NAMES:
        if name in wanted:
            kept[name], rejected[name] = enforce_keys(tables.as_dict()[name], name, keys)
            if any(name in _parents(n) for n in wanted):
                keys[name] = [checkpointed(kept[name].select(*S.CONSTRAINTS[name].primary_key))]
    return kept, rejected


# ---------------------------------------------------------------------------
# Later loads
# ---------------------------------------------------------------------------

def _against_stored(batch: DataFrame, stored: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(new, rejected)`` rows of a batch: rows that are stored already are left out, rows whose key
    (or UNIQUE value) is stored with other values are rejected.  The stored table is scanned
    once a key and not shuffled while the batch's keys are small."""
    rules = S.CONSTRAINTS[name]
    pk, columns = list(rules.primary_key), batch.columns
    known = checkpointed(stored.select(*columns).alias("d").join(
        bounded_broadcast(batch.select(*pk).distinct()).alias("k"), _same("d", "k", pk), "left_semi"))
    there = known.select(F.struct(*columns).alias("_stored"), *[F.col(c).alias(f"_k_{c}") for c in pk])
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in pk])
    judged = batch.join(there, match, "left")
    new = checkpointed(judged.where("_stored is null").select(*columns))
    clash = judged.where(F.col("_stored").isNotNull() & ~F.struct(*columns).eqNullSafe(F.col("_stored")))
    rejected = [clash.select(*columns, F.lit("duplicate " + ",".join(pk)).alias(REASON))]
    for unique in map(list, rules.unique):
        if all(c in columns for c in unique):
            taken = checkpointed(stored.select(*unique).alias("d").join(
                bounded_broadcast(new.select(*unique).distinct()).alias("k"), _same("d", "k", unique), "left_semi")
                .dropna().distinct())
            held, new = _split_by_keys(new, taken, unique)
            rejected.append(held.withColumn(REASON, F.lit("duplicate " + ",".join(unique))))
    return new, reduce(DataFrame.unionByName, rejected)


def load_batch(spark: SparkSession, base: str, batch: Tables, tag: str,
               database: str = S.DEFAULT_DATABASE) -> dict[str, str]:
    """Merges a batch of the four tables into the stored model ``<base>/<database>`` by primary key.

    New rows that keep all rules are added as a part of the published table (nothing stored is
    rewritten); rows that are stored already change nothing; rows that break a key or a reference,
    stored rows and parents included, are added to ``<table>_rejected`` with their reason.  A
    ``tag`` that was loaded before changes nothing.  Returns table -> published path.
    """
    root, out = namespace_path(base, database), {}
    for name in TABLE_NAMES:
        path, bad_path = f"{root}/{name}", f"{root}/{name}_rejected"
        out[name] = path
        now = publishing.current(spark, path)
        if now and tag in now.tags:
            continue
        rows = batch.as_dict()[name]
        twice = None
        if now:
            rows, twice = _against_stored(rows, publishing.read_published(spark, path), name)
        parents = {p: [publishing.read_published(spark, f"{root}/{p}")]
                   for _, p, _ in S.CONSTRAINTS[name].foreign_keys}
        kept, rejected = enforce_keys(rows, name, parents)
        if twice is not None:
            rejected = twice.unionByName(rejected)
        publishing.publish_part(rejected, bad_path, tag)
        month = PARTITION_COLUMNS.get(name, [])
        publishing.publish_part(kept.repartition(*month) if month else kept, path, tag, month)
    return out


def loaded_tables(spark: SparkSession, base: str, database: str = S.DEFAULT_DATABASE) -> tuple[Tables, dict[str, DataFrame]]:
    """The stored model of :func:`load_batch` and per table the rows rejected so far."""
    root = namespace_path(base, database)
    return (Tables(**{n: publishing.read_published(spark, f"{root}/{n}") for n in TABLE_NAMES}),
            {n: publishing.read_published(spark, f"{root}/{n}_rejected") for n in TABLE_NAMES})
