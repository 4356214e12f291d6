"""Several tables that change together: every commit is one small file that names the folders all of them consist of.

A store is a folder with a log and the data folders the log names. A commit first writes its rows to folders of their own
and then adds its line to the log, by one rename of one file: until then nobody sees any of it, afterwards everybody sees
all of it. Rows are dealt to a fixed number of key ranges by a hash of the key. New keys are added as further folders of
their range; where a commit replaces keys, the ranges that hold them are written anew and the others stay as they are. A
read takes the folders of the last commit, each key once, and groups nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

LOG = "version long, commit string, table string, range int, folder string"
RANGES = 32
# Folders of a range that are read as they are; a commit that finds more writes the range anew.
MOST_FOLDERS = 16


class Conflict(RuntimeError):
    """Another commit took the version first; nothing of this one is seen."""


class Store:
    """Tables with a common key. ``tables`` names them with their schemas."""

    def __init__(self, spark: SparkSession, path: str, key: str, tables: dict[str, StructType], ranges: int = RANGES) -> None:
        self.spark, self.path, self.key, self.tables, self.ranges = spark, path.rstrip("/"), key, tables, ranges

    def _lines(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def _state(self) -> tuple[int, list]:
        """The last version and its lines: tables times ranges times folders, whatever the number of rows.

        Of two commits of one version the one with the smaller name counts.
        """
        lines = self._lines()
        last = lines.groupBy("version").agg(F.min("commit").alias("commit")).orderBy(F.col("version").desc()).limit(1)
        rows = lines.join(last, ["version", "commit"]).collect()
        return max((r.version for r in rows), default=0), [r for r in rows if r.folder is not None]

    def version(self) -> int:
        return self._state()[0]

    def _range(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.ranges)).cast("int")

    def _open(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.tables[table])
        return self.spark.read.schema(self.tables[table]).parquet(*folders)

    def read(self, table: str) -> DataFrame:
        """The rows of a table as of the last commit."""
        return self._open(table, [r.folder for r in self._state()[1] if r.table == table])

    def commit(self, changes: dict[str, DataFrame], before_log: Callable[[], None] = lambda: None) -> int:
        """Add rows to the tables, in place of those of the same keys; returns the version.

        A key's rows come in one commit together. ``before_log`` is called when all data is written and nothing of it can
        be seen yet. Raises :class:`Conflict` if another commit was faster.
        """
        version, lines = self._state()
        name, out = uuid.uuid4().hex, []
        for table, rows in changes.items():
            staged = f"{self.path}/data/{table}-{name}"
            own = [*self.tables[table].fieldNames()]
            rows.select(*own).withColumn("_range", self._range()).repartition("_range").write.partitionBy("_range").parquet(staged)
            new = self.spark.read.schema(StructType([*self.tables[table].fields, StructField("_range", IntegerType())])).parquet(staged)
            # A commit touches at most as many ranges as there are.
            touched = [r["_range"] for r in new.select("_range").distinct().collect()]
            folders = {r: [x.folder for x in lines if x.table == table and x.range == r] for r in range(self.ranges)}
            held = [f for r in touched for f in folders[r]]
            old = self._open(table, held).withColumn("_range", self._range())
            changed = old.join(new.select(self.key).distinct(), self.key, "left_semi").select("_range").distinct()
            again = {r["_range"] for r in changed.collect()} if held else set()
            again |= {r for r in touched if len(folders[r]) >= MOST_FOLDERS}
            if again:
                merged = f"{self.path}/data/{table}-{name}-merged"
                kept = old.where(F.col("_range").isin(*again)).join(new.select(self.key).distinct(), self.key, "left_anti")
                rest = new.where(F.col("_range").isin(*again))
                kept.select(*own, "_range").unionByName(rest.select(*own, "_range")).repartition("_range").write.partitionBy("_range").parquet(merged)
            for r in range(self.ranges):
                if r in again:
                    folders[r] = [f"{merged}/_range={r}"]
                elif r in touched:
                    folders[r] = [*folders[r], f"{staged}/_range={r}"]
                out += [(version + 1, name, table, r, f) for f in folders[r]]
        out += [(version + 1, name, x.table, x.range, x.folder) for x in lines if x.table not in changes]
        before_log()
        lines_out = self.spark.createDataFrame(out or [(version + 1, name, None, None, None)], LOG)
        lines_out.coalesce(1).write.mode("append").json(f"{self.path}/log")
        winner = self._lines().where(F.col("version") == version + 1).agg(F.min("commit")).first()[0]
        if winner != name:
            raise Conflict(f"version {version + 1} belongs to {winner}")
        return version + 1
