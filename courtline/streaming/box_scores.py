"""The same ingest over a growing folder: the stream's own checkpoint remembers what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from courtline.operators.ingest import orient, page_status, pending, typed_games


def stream_statuses(spark: SparkSession, folder: str, schema: StructType, ledger: DataFrame) -> DataFrame:
    """Scraped cells not yet in the ledger, each with its status, as files arrive."""
    cells = spark.readStream.schema(schema).parquet(folder)
    return page_status(pending(cells, ledger))


def ingest_available(
    spark: SparkSession, folder: str, schema: StructType, ledger: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Process every file not seen before, then stop; output is split by status.

    Good rows and rejected rows land in one append, so neither can be committed without the other.
    """
    return (
        stream_statuses(spark, folder, schema, ledger)
        .writeStream.format("parquet")
        .partitionBy("status")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def accepted_games(spark: SparkSession, out: str) -> DataFrame:
    """Typed games of the accepted rows; only their partition is read."""
    return typed_games(orient(spark.read.parquet(out).filter("status = 'Downloaded'").drop("status"))).distinct()
