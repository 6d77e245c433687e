"""Folders that the driver and all executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that the cluster names in
    ``spark.checkpoint.dir``, which the driver and all executors see. A path without a
    scheme is where Spark itself would look for it: on the cluster's default file system.
    A session on one machine (local tests) that names none gets a folder of its own until
    it ends; on a cluster that is an error, because executors don't see each other's disks.
    The folder goes with the stage that it belongs to (``written_stage``), when it is
    discarded, or when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    path = f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    if _SCOPES.stack:
        _SCOPES.stack[-1].add(path)
    return path


_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="kilnworks-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, as Spark's own readers and writers resolve it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


class _Scopes(threading.local):
    """By thread, the sets of folders that the stages at work have made so far."""

    def __init__(self):
        self.stack: list[set[str]] = []


_SCOPES = _Scopes()
_WRITTEN: dict[str, SparkSession] = {}
#: Spark's setting to delete an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_CLEANING: dict[int, tuple[int, str]] = {}


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEANUP holds while any thread of the session is inside, then what held before."""
    with _LOCK:
        n, before = _CLEANING.get(id(spark), (0, spark.conf.get(CLEANUP)))
        _CLEANING[id(spark)] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _CLEANING.pop(id(spark))
            if n > 1:
                _CLEANING[id(spark)] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The same rows, written to the shared folder (by folders of by's values) and read
    again: work that several later steps use is done once, and a lost executor loses none
    of it. The shuffles that made it go at once: nothing reads them again."""
    path = shared_folder(df.sparkSession, name)
    with cleaning(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written_stage(make, name: str) -> DataFrame:
    """make()'s rows, written; the folders that this thread made on the way are deleted."""
    _SCOPES.stack.append(set())
    try:
        out = written(make(), name)
    finally:
        made = _SCOPES.stack.pop()
    for path in made - {out.written_to}:
        delete(path)
    if _SCOPES.stack:
        _SCOPES.stack[-1].add(out.written_to)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again: not even a lost task of
    what is still to run, whose inputs are written tables of their own."""
    for t in tables:
        delete(t.written_to)


def delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


@atexit.register
def _delete_rest() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the process ends; a session may be gone already
            delete(path)


#: What pyarrow calls the stores that Hadoop knows by these schemes.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def store_uri(uri: str) -> str:
    """The shared folder's name as pyarrow has it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder, for byte-level files that tasks write."""
    return pyarrow.fs.FileSystem.from_uri(store_uri(uri))
