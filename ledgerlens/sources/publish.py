"""Published tables: versions that readers switch between, never a table half written.

A published path holds data folders that are written once and never changed, and one entry per
version in ``_versions`` that lists the folders of the version.  A writer first writes its data and
then creates the next entry, which exists only as a whole; a reader takes the newest entry.  So a
reader during a rewrite sees the old or the new table.  Frames that were opened on an older version
stay readable until that version is retired, ``KEEP`` versions later.

Entries are claimed by number with a create that fails if the file exists.  Two writers at once
therefore get one number each: of two that replace the table the later number stands, and one that
adds to it looks at the new version and adds to that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlens.session import delete_path, file_names, read_text, write_new_text

#: versions that stay readable, the current one included
KEEP = 3
#: tries of a writer whose number another one took
TRIES = 100

_ENTRIES = "_versions"


@dataclass(frozen=True)
class Version:
    number: int
    folders: tuple[str, ...]          # names below the published path
    tags: tuple[str, ...]             # names of the batches that the version holds
    schema: str | None = None         # of its rows, as JSON (a part may hold no file)

    def text(self) -> str:
        return json.dumps({"folders": self.folders, "tags": self.tags, "schema": self.schema})

    def paths(self, path: str) -> list[str]:
        return [f"{path.rstrip('/')}/{f}" for f in self.folders]


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in file_names(spark, f"{path.rstrip('/')}/{_ENTRIES}") if n.isdigit())


def _entry(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{_ENTRIES}/{number:012d}"


def _read_entry(spark: SparkSession, path: str, number: int) -> Version | None:
    """A version, or None while its entry is still being written."""
    try:
        held = json.loads(read_text(spark, _entry(path, number)) or "null")
    except (Py4JJavaError, ValueError):
        return None
    return Version(number, tuple(held["folders"]), tuple(held["tags"]), held.get("schema")) if held else None


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The versions that can be read, oldest first."""
    return [v for n in _numbers(spark, path) if (v := _read_entry(spark, path, n))]


def current(spark: SparkSession, path: str) -> Version | None:
    """The version that a reader takes now; None before the first publication."""
    for n in reversed(_numbers(spark, path)):
        found = _read_entry(spark, path, n)
        if found:
            return found
    return None


def new_folder(path: str) -> tuple[str, str]:
    """``(name, path)`` of a fresh data folder of a published path."""
    name = f"data-{uuid.uuid4().hex}"
    return name, f"{path.rstrip('/')}/{name}"


def switch(spark: SparkSession, path: str, folder: str, add: bool = False, tag: str | None = None,
           keep: int = KEEP, schema: T.StructType | None = None) -> Version:
    """Makes ``folder`` (a data folder that is written in full) the published table, or with ``add``
    a further part of it.  A part whose ``tag`` the table holds already is not added again."""
    for _ in range(TRIES):
        taken, now = _numbers(spark, path), current(spark, path)   # a version that comes between takes the number
        if add and now and tag is not None and tag in now.tags:
            return now
        folders = (*now.folders, folder) if add and now else (folder,)
        tags = (now.tags if add and now else ()) + ((tag,) if tag is not None else ())
        found = Version(taken[-1] + 1 if taken else 1, folders, tags, schema.json() if schema else None)
        if write_new_text(spark, _entry(path, found.number), found.text()):
            retire(spark, path, keep)
            return found
    raise RuntimeError(f"{path}: no version could be claimed in {TRIES} tries")


def replace(spark: SparkSession, path: str, seen: Version, folder: str, keep: int = KEEP) -> Version:
    """Makes ``folder`` stand for the parts of version ``seen`` (the same rows in another form); parts
    that were added since stay.  A version in which a part of ``seen`` is gone is left as it is."""
    for _ in range(TRIES):
        taken, now = _numbers(spark, path), current(spark, path)   # a version that comes between takes the number
        if now is None or not set(seen.folders) <= set(now.folders):
            return now
        later = tuple(f for f in now.folders if f not in seen.folders)
        found = Version(taken[-1] + 1, (folder, *later), now.tags, now.schema)
        if write_new_text(spark, _entry(path, found.number), found.text()):
            retire(spark, path, keep)
            return found
    raise RuntimeError(f"{path}: no version could be claimed in {TRIES} tries")


def publish(df: DataFrame, path: str, partition_by: Iterable[str] = (), keep: int = KEEP) -> Version:
    """Writes ``df`` as a new version of the table at ``path`` and switches readers to it."""
    name, folder = new_folder(path)
    df.write.partitionBy(*partition_by).parquet(folder)
    return switch(df.sparkSession, path, name, keep=keep, schema=df.schema)


def publish_part(df: DataFrame, path: str, tag: str | None = None, partition_by: Iterable[str] = (),
                 keep: int = KEEP) -> Version:
    """Adds the rows of ``df`` to the table at ``path`` without rewriting it; a ``tag`` that it holds
    already changes nothing (the same batch a second time)."""
    now = current(df.sparkSession, path)
    if now and tag is not None and tag in now.tags:
        return now
    name, folder = new_folder(path)
    df.write.partitionBy(*partition_by).parquet(folder)
    return switch(df.sparkSession, path, name, add=True, tag=tag, keep=keep, schema=df.schema)


def read_published(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The published table as it is now (or a given version of it)."""
    at = version or current(spark, path)
    if at is None:
        raise FileNotFoundError(f"{path}: nothing is published there")
    schema = T.StructType.fromJson(json.loads(at.schema)) if at.schema else None
    parts = [(spark.read.schema(schema) if schema else spark.read).parquet(p) for p in at.paths(path)]
    if schema:
        parts = [p.select(*schema.names) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retire(spark: SparkSession, path: str, keep: int = KEEP) -> list[str]:
    """Removes all but the newest ``keep`` versions and the data folders that only those had;
    returns the folders removed."""
    found = versions(spark, path)
    old, held = found[:-max(1, keep)], found[-max(1, keep):]
    needed = {f for v in held for f in v.folders}
    gone = sorted({f for v in old for f in v.folders} - needed)
    for v in old:                      # entries first: no entry names a missing folder
        delete_path(spark, _entry(path, v.number))
    for f in gone:
        delete_path(spark, f"{path.rstrip('/')}/{f}")
    return gone
