"""Distributed vocabularies, fixed-bound scaling and reproducible splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.schemas import STATS
from courtline.storage import cut_lineage


def dense_index(values: DataFrame, order: list[Column], out: str = "index", partitions: int | None = None) -> DataFrame:
    """Number distinct rows 0, 1, 2, ... in ``order``, without a single-task sort.

    Rows are range-partitioned, numbered inside their range, and shifted by the sizes of the ranges
    before. The ranges are checkpointed, so both uses see the same ones. Only one row per range
    (not per value) meets in one task.
    """
    spread = values.repartitionByRange(partitions, *order) if partitions else values.repartitionByRange(*order)
    ranged = cut_lineage(spread.withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_place", within)
        .join(shift, "_range")
        .withColumn(out, (F.col("_place") - 1 + F.col("_shift")).cast("int"))
        .drop("_range", "_place", "_shift")
    )


def frequency_index(df: DataFrame, column: str, out: str = "index") -> DataFrame:
    """Vocabulary of a text column, most frequent value first, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return dense_index(counts, [F.col("n").desc(), F.col(column)], out)


def with_index(df: DataFrame, vocabulary: DataFrame, value: str, column: str, out: str, unknown: int) -> DataFrame:
    """Look a column up in a fitted vocabulary; values it does not know get ``unknown``."""
    known = vocabulary.select(F.col(value).alias(column), F.col("index").alias(out))
    return df.join(known, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(unknown)))


def fit_bounds(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """Bounds of the thirteen counts as a fitted scaler: thirteen rows, whatever the input size."""
    found = {r["stat"]: (r["lo"], r["hi"]) for r in bounds.limit(len(STATS)).collect()}
    return {s: (float(found[s][0] or 0), float(found[s][1] or 0)) for s in STATS}


def scaled_sql(value: str, lo: float, hi: float) -> str:
    """Min-max scaling without clipping; a constant count scales by 1."""
    return f"({value} - {lo!r}D) / {(hi - lo if hi > lo else 1.0)!r}D"


def hash_bucket(key: Column, seed: int) -> Column:
    """A bucket 0..99 from the key alone, so a split survives any repartitioning.

    Fixed values: a prime modulus and a multiplier without common factors.
    """
    return F.pmod(F.pmod(key, F.lit(1000003)) * 48271 + seed, F.lit(100))


def hash_split(df: DataFrame, key: str, seed: int, held_out: int = 30) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows) at 100 - ``held_out`` to ``held_out`` percent of the keys."""
    out = hash_bucket(F.col(key), seed) < held_out
    return df.filter(~out), df.filter(out)
