"""Tables and files in the folder that the driver and all executors share.

The folder is the cluster's ``spark.checkpoint.dir``. Only where a local session
leaves that unset (unit tests, a laptop) is a folder chosen here.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What Spark hands a Python worker at once; see ``small_batches``.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "2097152"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder as a full URI.

    Where the setting is missing, a temporary folder serves a local session;
    on a cluster it would not be shared, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quillgraph.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillgraph-shared-")
        spark.conf.set("quillgraph.shared.dir", found)
    return _qualified(spark, found.rstrip("/"))


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark itself would take, so that workers open the same file system."""
    files, where = _path(spark, path)
    return files.makeQualified(where).toString()


_watched: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    for made in _watched:
        made.append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    This cuts the lineage: what follows reads committed files, so that neither
    a lost executor nor a second use computes ``df`` again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def write_and_clear(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``make`` returns; whatever else was stored on the way is deleted then."""
    made: list[str] = []
    _watched.append(made)
    try:
        out = write_table(make(), name)
    finally:
        _watched.pop()
    for path in made:
        if path != out.stored_at:
            files, where = _path(spark, path)
            files.delete(where, True)
    return out


def drop_paths(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, where = _path(spark, path)
        files.delete(where, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of ``write_table`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            drop_paths(table.sparkSession, path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, for workers that write or read single files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, jobs hand their Python workers small batches of rows; the session's own settings are put back.

    Spark's batches of 10,000 rows or 64 MB are held several times over: by the
    executor outside its heap, in Arrow's vectors and in the buffer of the
    socket, and by the worker. This affects memory, never the result.
    """
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
