"""Table bundle and file ingest (declared schemas, typed loading, quarantine).

``load_table`` reads one table from Parquet, CSV or JSON with its declared
schema.  Text formats are read as strings and converted with ``try_cast`` so a
malformed value becomes a quarantined row instead of a failed job.  Transactions
get their date and time-of-day folded into one ``transaction_ts`` column.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.functions.measures import HOUR
from ledgerlens.functions.sizing import bounded_broadcast, checkpointed
from ledgerlens.session import delete_path, folder_bytes, work_dir
from ledgerlens.sources import publish as publishing


@dataclass(frozen=True)
class Tables:
    """The four model tables an operator reads (all lazy DataFrames)."""

    accounts: DataFrame
    merchants: DataFrame
    transactions: DataFrame
    fraud_flags: DataFrame

    def with_(self, **kwargs: DataFrame) -> "Tables":
        return replace(self, **kwargs)

    def as_dict(self) -> dict[str, DataFrame]:
        return {"accounts": self.accounts, "merchants": self.merchants,
                "transactions": self.transactions, "fraud_flags": self.fraud_flags}


TABLE_NAMES = ("accounts", "merchants", "transactions", "fraud_flags")


def namespace_path(base: str, database: str = S.DEFAULT_DATABASE) -> str:
    """Root folder of one database namespace (``CREATE DATABASE`` / ``USE``)."""
    return f"{base.rstrip('/')}/{database}"


def use_database(spark: SparkSession, database: str = S.DEFAULT_DATABASE) -> None:
    """Create (if needed) and select a catalog database for views and tables."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.catalog.setCurrentDatabase(database)


def _source_schema(table: str) -> T.StructType:
    return S.TRANSACTIONS_RAW if table == "transactions" else S.SCHEMAS[table]


#: column of a raw frame that holds a text record which does not fit the table's columns
BAD_RECORD = "_bad_record"
#: a time of day, with or without seconds and fractions
TIME_OF_DAY = r"^\s*([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9])(\.[0-9]{1,6})?)?\s*$"


def _typed(c: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.col(c).cast("string")
    return F.col(c).try_cast(dtype)


def _changed(c: str, typed: Column, dtype: T.DataType) -> Column:
    """Whether a present value does not convert, or only by rounding digits away."""
    bad = F.col(c).isNotNull() & typed.isNull()
    if isinstance(dtype, T.DecimalType):
        exact = F.col(c).try_cast(T.DecimalType(38, 18))
        bad = bad | (typed.isNotNull() & ~exact.eqNullSafe(typed.cast(T.DecimalType(38, 18))))
    return bad


def mark_types(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Every row of ``raw`` with its raw columns, a struct ``typed`` of the declared types and
    ``reject_reason`` (empty for a good row).

    A row is bad when its text record has more or fewer fields than the table, when a declared
    NOT NULL column is NULL, when a present value does not convert, and when a decimal has more
    digits after the point than its column (it is not rounded).
    """
    checks, typed_cols = [], []
    if BAD_RECORD in raw.columns:
        checks.append(F.when(F.col(BAD_RECORD).isNotNull(), F.lit("bad record")))
    for f in schema.fields:
        typed = _typed(f.name, f.dataType)
        typed_cols.append(typed.alias(f.name))
        checks.append(F.when(_changed(f.name, typed, f.dataType), F.lit(f"bad {f.name}")))
        if not f.nullable:
            checks.append(F.when(F.col(f.name).isNull(), F.lit(f"null {f.name}")))
    return raw.withColumns({"typed": F.struct(*typed_cols), "reject_reason": F.concat_ws("; ", *checks)})


def split_marked(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (the struct ``typed``) and rejected rows (all other columns) of a marked frame."""
    clean = marked.filter(F.col("reject_reason") == "").select("typed.*")
    return clean, marked.filter(F.col("reject_reason") != "").drop("typed")


def enforce_types(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Cast columns to ``schema``; return ``(clean, rejected)``, rejected rows with their raw
    values and a ``reject_reason`` (see :func:`mark_types`)."""
    return split_marked(mark_types(raw, schema))


def wall_clock(date: Column, time: Column) -> Column:
    """Date and time-of-day text as TIMESTAMP_NTZ; NULL for a time outside 00:00:00-23:59:59.

    The text is cast straight to a wall-clock timestamp, so no session time zone (and no gap of
    one) has a part in it.
    """
    def part(i: int) -> Column:
        return F.regexp_extract(time, TIME_OF_DAY, i)

    seconds = F.when(part(3) == "", "00").otherwise(part(3))
    text = F.concat(date.cast("string"), F.lit(" "), F.lpad(part(1), 2, "0"), F.lit(":"), part(2),
                    F.lit(":"), seconds, part(4))
    return F.when(time.rlike(TIME_OF_DAY), text.try_cast(T.TimestampNTZType()))


def fold_time(raw_tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw transactions (date + time text) -> model layout with ``transaction_ts``, and the rows
    whose time of day does not form a timestamp."""
    ts = wall_clock(F.col("transaction_date"), F.col("transaction_time"))
    with_ts = raw_tx.withColumn("transaction_ts", ts)
    model = with_ts.where("transaction_ts is not null").select(*[f.name for f in S.TRANSACTIONS.fields])
    bad = with_ts.where("transaction_ts is null").drop("transaction_ts")
    return model, bad.withColumn("reject_reason", F.lit("bad transaction_time"))


def _fold_time(marked: DataFrame) -> DataFrame:
    """Marked raw transactions (date + time text) with the model layout in ``typed``.

    A time of day outside 00:00:00-23:59:59 does not form a timestamp; such rows are rejected.
    """
    ts = wall_clock(F.col("typed.transaction_date"), F.col("typed.transaction_time"))
    model = F.struct(*[ts.alias(f.name) if f.name == "transaction_ts" else F.col(f"typed.{f.name}")
                       for f in S.TRANSACTIONS.fields])
    late = (F.col("reject_reason") == "") & ts.isNull()
    return marked.withColumns({
        "reject_reason": F.when(late, F.lit("bad transaction_time")).otherwise(F.col("reject_reason")),
        "typed": model})


def canonical_case(df: DataFrame, table: str) -> DataFrame:
    """Map case / surrounding-space variants of known domain values to their
    declared spelling (``'flagged '`` -> ``'Flagged'``), as a case-insensitive
    collation would compare them; other values are kept as they are."""
    for col, values in S.DOMAINS.get(table, {}).items():
        if col not in df.columns:
            continue
        key = F.lower(F.trim(F.col(col)))
        expr = F.col(col)
        for v in reversed(values):
            expr = F.when(key == F.lit(v.lower()), F.lit(v)).otherwise(expr)
        df = df.withColumn(col, expr)
    return df


def read_raw(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
             **options: str) -> DataFrame:
    """Read one table file without schema inference.

    Parquet keeps its stored types.  CSV with a header binds columns by name
    (all read as text); CSV without a header binds them by position in the
    declared order, like a positional INSERT.  JSON binds by field name.
    """
    schema = _source_schema(table)
    if fmt == "parquet":
        return spark.read.parquet(path)
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    if fmt == "csv":
        opts = {"header": "true", "nullValue": "NULL", "encoding": "UTF-8", "mode": "PERMISSIVE",
                "inferSchema": "false", "columnNameOfCorruptRecord": BAD_RECORD,
                "columnPruning": "false"}      # a record's fields are counted whatever is selected
        opts.update(options)
        reader = spark.read.options(**opts)
        if opts["header"].lower() == "true":   # bound by the header's names
            as_text = T.StructType([T.StructField(c, T.StringType(), True) for c in reader.csv(path).columns])
        return reader.schema(as_text.add(BAD_RECORD, T.StringType(), True)).csv(path)
    if fmt == "json":
        return (spark.read.schema(as_text.add(BAD_RECORD, T.StringType(), True))
                .options(columnNameOfCorruptRecord=BAD_RECORD, **options).json(path))
    raise ValueError(f"unsupported format {fmt!r}")


def load_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
               canonical: bool = False, **options: str) -> tuple[DataFrame, DataFrame]:
    """Load ``table`` from ``path``: returns ``(model rows, rejected rows)``.

    Every column is converted to its declared type with :func:`enforce_types`;
    a column with a declared DEFAULT (``is_verified``) gets it when absent.
    Transactions may come in the raw layout (date + time text) or in the model
    layout written by :func:`write_tables`.  ``canonical=True`` applies
    :func:`canonical_case` to the domain columns.
    """
    return ingest(read_raw(spark, path, table, fmt, **options), table, canonical)


def ingest(raw: DataFrame, table: str, canonical: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw rows of ``table`` (text or typed columns, by name) -> ``(model, rejected)``.

    Applies the declared DEFAULT to an omitted column, converts every column to
    its declared type, folds date + time of day into ``transaction_ts`` for
    transactions, and returns rows that fail any of it with a reason.
    """
    clean, rejected = split_marked(ingest_marked(raw, table))
    return (canonical_case(clean, table) if canonical else clean), rejected


def ingest_marked(raw: DataFrame, table: str) -> DataFrame:
    """Every raw row once: its raw values as text, the model row in ``typed`` and a
    ``reject_reason``.  Written and read back, it splits into good and rejected rows
    (:func:`split_marked`) without parsing the input twice."""
    schema = _source_schema(table)
    have = set(raw.columns)
    model_layout = (table == "transactions" and "transaction_ts" in have
                    and "transaction_time" not in have)
    if model_layout:                           # already folded: typed check only
        schema = S.TRANSACTIONS
        if HOUR in have:                       # stored with its hour
            schema = T.StructType([*schema.fields, T.StructField(HOUR, T.IntegerType(), True)])
    for column, value in S.CONSTRAINTS[table].defaults.items():
        if column not in raw.columns:          # DEFAULT applies to an omitted column
            raw = raw.withColumn(column, F.lit(value))
    have = set(raw.columns)
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{table}: columns missing: {missing}")
    names = [f.name for f in schema.fields]
    marked = mark_types(raw.select(*names, *[c for c in (BAD_RECORD,) if c in have]), schema)
    if table == "transactions" and not model_layout:
        marked = _fold_time(marked)
    elif table == "transactions" and HOUR in have:
        # a filter on the stored hour must mean the hour of the time
        wrong = (F.col("reject_reason") == "") & ~F.col(f"typed.{HOUR}").eqNullSafe(F.hour("typed.transaction_ts"))
        marked = marked.withColumn("reject_reason", F.when(wrong, F.lit(f"bad {HOUR}")).otherwise(F.col("reject_reason")))
    return marked.select(*[F.col(c).cast("string").alias(c) for c in names], "typed", "reject_reason")


PARTITION_COLUMNS = {"transactions": ["transaction_month"]}
#: bytes that a stored file aims at, and rows that are written to measure bytes a row
FILE_BYTES = 128 << 20
MEASURED_ROWS = 100_000


def with_hour(transactions: DataFrame) -> DataFrame:
    """Transactions with the hour of their time as a column of its own, which a filter on the
    hour reaches in Parquet files."""
    return transactions.withColumn(HOUR, F.hour("transaction_ts"))


def bytes_a_row(df: DataFrame, rows: int, key: list[str], order: list[str]) -> float:
    """Stored bytes a row, measured: some rows (by a hash of the key, about ``MEASURED_ROWS``) are
    written as Parquet and removed again."""
    spark = df.sparkSession
    every = max(1, rows // MEASURED_ROWS)
    some = df.where(F.pmod(F.xxhash64(*key), F.lit(every)) == 0)
    path = f"{work_dir(spark).rstrip('/')}/measured-{uuid.uuid4().hex}"
    some.repartition(1).sortWithinPartitions(*order).write.parquet(path)
    held = spark.read.schema(some.schema).parquet(path).count()
    size = folder_bytes(spark, path)
    delete_path(spark, path)
    return size / held if held else 0.0


def by_size(df: DataFrame, group: str | None, key: list[str], order: list[str], file_bytes: int) -> DataFrame:
    """``df`` dealt into one task a file: files of a group hold about ``file_bytes`` each, as
    measured, and are sorted by ``order`` so that row groups hold ranges of it.

    A group of any size is cut by a hash of the key; groups never share a file.
    """
    place = F.col(group) if group else F.lit(0)
    counts = checkpointed(df.groupBy(place.alias("_group")).agg(F.count(F.lit(1)).alias("_rows")))
    rows = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    if not rows:
        return df.coalesce(1)
    width = bytes_a_row(df, rows, key, order)
    files = F.greatest(F.lit(1), F.ceil(F.col("_rows") * width / file_bytes)).cast("long")
    # one row a group: numbers of the first file and of files of each
    ahead = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.select("_group", files.alias("_files")).withColumn(
        "_first", F.coalesce(F.sum("_files").over(ahead), F.lit(0)))
    plan = checkpointed(plan)
    total = plan.agg(F.sum("_files").alias("n")).first()["n"]
    dealt = df.join(bounded_broadcast(plan), place.eqNullSafe(F.col("_group")))
    number = (F.col("_first") + F.pmod(F.xxhash64(*key), F.col("_files"))).cast("int")
    return dealt.repartitionById(total, number).select(*df.columns).sortWithinPartitions(*order)


def stored_form(name: str, df: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """A model table as it is stored: dealt into files by measured size; transactions with their
    hour, sorted by it within a file."""
    key = list(S.CONSTRAINTS[name].primary_key)
    if name == "transactions":
        return by_size(with_hour(df), PARTITION_COLUMNS[name][0], key, [HOUR, *key], file_bytes)
    return by_size(df, None, key, key, file_bytes)


def write_tables(tables: Tables, base: str, database: str = S.DEFAULT_DATABASE,
                 mode: str = "overwrite", file_bytes: int = FILE_BYTES) -> str:
    """Store the model tables as Parquet under ``<base>/<database>/<table>``.

    Transactions are partitioned by ``transaction_month`` so month-sliced reads
    prune whole folders.  Each month has as many files as its measured size asks for.
    :func:`load_tables` reads the result back.  The folders are rewritten in place;
    readers of a live model use :func:`publish_tables`.
    """
    root = namespace_path(base, database)
    for name, df in tables.as_dict().items():
        month = PARTITION_COLUMNS.get(name, [])
        stored_form(name, df, file_bytes).write.mode(mode).partitionBy(*month).parquet(f"{root}/{name}")
    return root


def publish_tables(tables: Tables, base: str, database: str = S.DEFAULT_DATABASE,
                   file_bytes: int = FILE_BYTES) -> publishing.Version:
    """Store all four model tables as one new version of the database and switch readers to it: a
    reader sees the four old tables or the four new ones."""
    root = namespace_path(base, database)
    name, folder = publishing.new_folder(root)
    for table, df in tables.as_dict().items():
        month = PARTITION_COLUMNS.get(table, [])
        stored_form(table, df, file_bytes).write.partitionBy(*month).parquet(f"{folder}/{table}")
    return publishing.switch(tables.accounts.sparkSession, root, name)


def load_published(spark: SparkSession, base: str, database: str = S.DEFAULT_DATABASE) -> Tables:
    """The newest published version of the model tables.  What is published is the model already: it
    is read as it is stored, without the checks of :func:`load_table`, so that filters on stored
    columns reach the files."""
    root = namespace_path(base, database)
    at = publishing.current(spark, root)
    if at is None:
        raise FileNotFoundError(f"{root}: nothing is published there")
    (folder,) = at.paths(root)
    return Tables(**{name: spark.read.parquet(f"{folder}/{name}") for name in TABLE_NAMES})


def load_tables(spark: SparkSession, base: str, fmt: str = "parquet",
                database: str = S.DEFAULT_DATABASE, canonical: bool = False,
                **options: str) -> tuple[Tables, dict[str, DataFrame]]:
    """Load all four tables from ``<base>/<database>/<table>[.fmt]``."""
    root = namespace_path(base, database)
    loaded, rejected = {}, {}
    for name in TABLE_NAMES:
        loaded[name], rejected[name] = load_table(spark, f"{root}/{name}", name, fmt,
                                                  canonical, **options)
    return Tables(**loaded), rejected
