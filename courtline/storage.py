"""Where intermediate tables live, and how long lineage is cut.

Everything that must outlive an executor goes to the folder named by ``spark.checkpoint.dir``.
Only a local session without that setting gets a temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_tables: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; one per application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            root = tempfile.mkdtemp(prefix="courtline-")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        _folders[app] = f"{root.rstrip('/')}/courtline-{uuid.uuid4().hex}"
    return _folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Partitions that a task may write at a time; with more of them it sorts its rows by partition.
OPEN_PARTITIONS = 16


# Bytes of a file that a task reads where it sorts what it reads before a shuffle.
SORTED_SPLIT = 16 << 20


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def open_partitions(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, a task that writes few partitions keeps a file open for each instead of sorting its rows."""
    return setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_PARTITIONS))


def small_splits(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, tasks read at most ``SORTED_SPLIT`` bytes of a file, so that what they sort fits their memory."""
    name = "spark.sql.files.maxPartitionBytes"
    number, unit = re.fullmatch(r"([0-9]+)([kmgt]?)i?b?", spark.conf.get(name).lower()).groups()
    return setting(spark, name, str(min(int(number) << 10 * " kmgt".index(unit or " "), SORTED_SPLIT)))


def write_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    with open_partitions(df.sparkSession):
        writer = df.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a new table, computed once however often they are read."""
    path = new_path(df.sparkSession, name)
    write_partitions(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_folder(spark: SparkSession, scope: str, name: str, write: Callable[[str], str]) -> DataFrame:
    """Call ``write`` with a new path once per application and scope; the folder it returns is read by all calls."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _tables:
        path = write(new_path(spark, name))
        _tables[key] = (path, spark.read.parquet(path))
    path, kept = _tables[key]
    return kept if kept.sparkSession is spark else spark.read.parquet(path)


def kept_table(
    spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write ``build()`` once per application and scope; later calls read the table back."""

    def write(path: str) -> str:
        write_partitions(build(), path, partition_by)
        return path

    return kept_folder(spark, scope, name, write)


_models: dict[tuple[str, str, str], object] = {}


def kept_model(spark: SparkSession, scope: str, name: str, build: Callable[[], object]) -> object:
    """Fit ``build()`` once per application and scope; later calls get the same model."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _models:
        _models[key] = build()
    return _models[key]
