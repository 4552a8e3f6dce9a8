"""Cutting lineage through tables written to the folder that all executors share.

What a returned DataFrame still reads stays in that folder, as a checkpoint does, until its owner empties it; tables
that nothing reads any more are deleted with ``discard``.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode one of our own when unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="gistra-")
        atexit.register(shutil.rmtree, _own["root"], ignore_errors=True)
    return _own["root"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Executions that begin in here delete their shuffle files when they end: what they wrote is read from then on."""
    was = spark.conf.get(FREES, None)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREES) if was is None else spark.conf.set(FREES, was)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later plans start at the table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with freeing(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that ``fresh_path`` gave."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned. Whatever was derived from them must have been written."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            remove(table.sparkSession, path)
