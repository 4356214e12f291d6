"""As-of join: each row with the latest row of another table before its own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, values: dict[str, str],
    strict: bool = True, width: int | None = None,
) -> DataFrame:
    """``left`` with columns of the latest ``right`` row of equal ``keys`` whose ``right_time`` is before ``time``.

    ``values`` names the right columns to attach and what to call them. Without ``strict`` an equal time counts as
    before. Of right rows of one key and time the greatest counts, by the values in their order. Left rows without such
    a row, or with a null key or time, get nulls; right rows with a null key or time are ignored.

    Both sides become one stream per key, ordered by time, in which the last right row is carried along: one shuffle of
    each side and no row is multiplied. ``width`` cuts every key into spans of that many units of time, so a hot key is
    spread over tasks; what a span begins with is found from one row per key and span.
    """
    row = F.struct(F.col(right_time).alias("time"), *[F.col(c).alias(v) for c, v in values.items()])
    usable = " and ".join(f"`{c}` is not null" for c in keys)
    found = right.where(usable).where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_time"), row.alias("_row")
    )
    ready = left.where(usable).where(F.col(time).isNotNull())
    rest = left.where(f"not ({usable}) or `{time}` is null")
    kind = found.schema["_row"].dataType
    spanned: list[str] = [*keys, "_span"]
    span = F.floor(F.col("_time") / width) if width else F.lit(0)
    stream = ready.select(
        *keys, F.col(time).alias("_time"), F.lit(0 if strict else 1).alias("_order"), F.lit(None).cast(kind).alias("_row"),
        F.struct(*left.columns).alias("_left"),
    ).unionByName(found.withColumns({
        "_order": F.lit(1 if strict else 0), "_left": F.lit(None).cast(left.schema),
    })).withColumn("_span", span)
    within = Window.partitionBy(*spanned).orderBy("_time", "_order", "_row").rowsBetween(Window.unboundedPreceding, 0)
    joined = stream.withColumn("_row", F.last("_row", ignorenulls=True).over(within)).where("_left is not null")
    if width:
        last = stream.groupBy(*spanned).agg(F.max("_row").alias("_last"))
        before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        opens = last.select(*spanned, F.last("_last", ignorenulls=True).over(before).alias("_opens"))
        joined = joined.join(opens, spanned).withColumn("_row", F.coalesce("_row", "_opens"))
    attached: list[Column] = [F.col(f"_row.{v}").alias(v) for v in values.values()]
    out = joined.select("_left.*", *attached)
    nothing = [F.lit(None).cast(kind[v].dataType).alias(v) for v in values.values()]
    return out.unionByName(rest.select(*left.columns, *nothing))
