"""Tables between the steps of a query: written as Parquet to the folder that all executors share, and read back.

That cuts lineage, survives lost executors, fixes what range partitioning placed where, and tells the optimiser real
sizes. All tables of a process lie in one folder, which goes when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDER = f"bagforge-{uuid.uuid4().hex}"
_tables: dict[str, list[str]] = {}
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where the setting is absent (tests, a single machine) a temporary folder is set for this context.
    """
    sc = spark.sparkContext
    told = sc.getConf().get(_DIR, None) or spark.conf.get(_DIR, None)
    if told:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(told)
        return told
    if not sc.getCheckpointDir():
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise ValueError(f"set {_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="bagforge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _tidy_up(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the context may have ended before the process
        delete(spark, folder)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, what an action shuffles goes from the disks as soon as the action ends; else it stays until the driver happens to collect its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def _write(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{_FOLDER}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_tidy_up, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame, tag: str = "") -> DataFrame:
    """df, written once to the shared folder and read back. Tables of a tag stay until drop_scratch(tag) or the process's end."""
    path, table = _write(df)
    _tables.setdefault(tag, []).append(path)
    return table


def drop_scratch(spark: SparkSession, tag: str) -> None:
    """Deletes a tag's tables; only for work whose results are already written."""
    for path in _tables.pop(tag, []):
        delete(spark, path)


class Rounds:
    """The tables of an iterative operator: a name's new table replaces its old one."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df, written under name and read back; the table that had the name before goes."""
        path, table = _write(df)
        if name in self.paths:
            delete(df.sparkSession, self.paths[name])
        self.paths[name] = path
        return table

    def drop(self, spark: SparkSession, name: str) -> None:
        """Deletes the table that has the name; only for what is read no more."""
        delete(spark, self.paths.pop(name))
