"""Small helpers the operators share: tables written once, and renamed working columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.storage import new_path

BATCH_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, computes once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame) -> None:
    """Limit what Spark hands to a Python worker at a time by bytes, not rows, so long texts do not add up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def crc_residue(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}{n}"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by their exact names, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
