"""Session builder with the settings the plans rely on; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs a later shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM compiles no longer method than this. Projections of many columns, fused into one, are interpreted otherwise.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "courtline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(spark: SparkSession) -> SparkSession:
    """A session that was built elsewhere, with the limit of compiled methods, if it sets none itself."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, SETTINGS[limit])
    return spark
