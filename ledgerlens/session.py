"""Session construction for local runs (tests, bench, tools).

On a cluster the session comes from the platform; the library only reads
settings from it.  ``work_dir`` is the one place where it is decided where intermediate
tables go: the shared folder named by ``spark.checkpoint.dir``, or, in a session of this
process alone that names none (tests, bench), a scratch folder made once per session.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "ledgerlens",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    b = (SparkSession.builder.master(f"local[{n}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # coalesce small shuffle partitions to the advisory size (fewer tiny tasks)
         .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext          # not available on Spark Connect sessions
    except Exception:  # noqa: BLE001
        return None


def shared_dir(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (or the context's
    checkpoint dir), or None when the session names none.

    On a cluster, a folder of the local file system may be a mount of all machines or belong to
    one of them; its name doesn't tell, so it is tried once (see :func:`is_shared`).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = _context(spark)
        d = sc.getCheckpointDir() if sc is not None else None
    if d and sc_is_remote(spark) and (app_id(spark), d) not in _tried:
        if _file_system(spark, d)[1].getUri().getScheme() == "file" and not is_shared(spark, d):
            raise RuntimeError(f"spark.checkpoint.dir {d!r} is a folder of one machine; name a shared one")
        _tried.add((app_id(spark), d))
    return d.rstrip("/") if d else None


#: applications and the folders that they have tried
_tried: set[tuple[str, str]] = set()


def is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether all rows that executors write to a folder, one file for each core, are seen by the
    driver and read by executors."""
    n = parallelism(spark)
    path = f"{folder.rstrip('/')}/ledgerlens-trial-{uuid.uuid4().hex}"
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == n
    except Exception as e:
        raise RuntimeError(f"spark.checkpoint.dir {folder!r} can't be written and read by all executors") from e
    finally:
        delete_path(spark, path)


def sc_is_remote(spark: SparkSession) -> bool:
    """Whether executors run on other machines than the driver."""
    sc = _context(spark)
    return sc is not None and not sc.master.startswith("local")


def in_process(spark: SparkSession) -> bool:
    """Whether driver and executors are this one process."""
    sc = _context(spark)
    return sc is not None and (sc.master == "local" or sc.master.startswith("local["))


def work_dir(spark: SparkSession) -> str:
    """The folder of intermediate tables and checkpoints, the same from the first call of a session
    on."""
    found = shared_dir(spark)
    if not found:
        if not in_process(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
        found = tempfile.mkdtemp(prefix="ledgerlens-")
    sc = _context(spark)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def common_dir(spark: SparkSession, name: str) -> str:
    """A folder inside that of :func:`work_dir`, common to all sessions: it has the rights of that
    folder, so sessions of other users may write in it as well."""
    path = f"{work_dir(spark).rstrip('/')}/{name}"
    place, fs = _file_system(spark, path)
    if not fs.exists(place) and fs.mkdirs(place):
        rights = fs.getFileStatus(place.getParent()).getPermission()
        if not fs.getFileStatus(place).getPermission().equals(rights):
            with contextlib.suppress(Py4JError):       # made by another user meanwhile, who sets them
                fs.setPermission(place, rights)
    return path


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, bytes, modification time) of the files of a table."""
    place, fs = _file_system(spark, path)
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(place))


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    place, fs = _file_system(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder; -1 if there is no such folder."""
    place, fs = _file_system(spark, folder)
    return fs.getContentSummary(place).getLength() if fs.exists(place) else -1


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    place, fs = _file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small text file; False if there is one already."""
    place, fs = _file_system(spark, path)
    if fs.exists(place):
        return False
    try:
        stream = fs.create(place, False)
    except Exception as e:  # noqa: BLE001
        if "already exists" in str(e):
            return False
        raise
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    return True


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder."""
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store when the session's JVM ends."""
    place, fs = _file_system(spark, path)
    fs.deleteOnExit(place)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder configured for this session."""
    d = shared_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    return d


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (scopes per-session files and caches)."""
    return spark.conf.get("spark.app.id", None) or _context(spark).applicationId


_owners: dict[str, str] = {}


def owner_id(spark: SparkSession) -> str:
    """Name of the folders that belong to the running application alone.

    Application ids repeat: every master counts its applications from 0 within a second, so two that
    start at once and share a folder may have one id.  A random part is drawn once per application.
    """
    app = app_id(spark)
    return f"{app}-{_owners.setdefault(app, uuid.uuid4().hex)}"


def parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", "8"))
