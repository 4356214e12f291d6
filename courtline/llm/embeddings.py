"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them, one vector kept a group.

Equal vectors are one row with a count. The others go to the cell of their nearest centre and, as probes, to every cell
whose boundary is within a margin, so a close pair on two sides of a boundary meets in one of the two cells. Centres
that lie close to each other are merged, so a dense group of near copies is not scattered over many cells. A cell is
cut in blocks; each pair of blocks is one small matrix product. Products give counts of links per vector and one link
per vector it joins to another, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.components import components
from courtline.llm.tables import bound_batches, written

THRESHOLD = 0.95
# Vectors per cell aimed at, centres at most, and vectors whose hash comes first that the centres are fitted on.
CELL_ROWS = 1000
MAX_CENTRES = 4096
FIT_ROWS = 100_000
ROUNDS = 5
# Centres at this cosine or more become one.
MERGE_AT = 0.7
# Distance to a cell's boundary, as a length on the unit sphere, within which a vector is compared in that cell too.
MARGIN = 0.08
BLOCK_ROWS = 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _apart(centres: np.ndarray, limit: float) -> np.ndarray:
    """The centres in order, without those at cosine ``limit`` or more to one before."""
    kept = np.empty((0, centres.shape[1]))
    for c in centres:
        if not len(kept) or (kept @ c).max() < limit:
            kept = np.vstack([kept, c])
    return kept


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, finite and not zero, as double arrays."""
    v = F.col("embedding").cast("array<double>")
    largest = F.array_max(F.transform(v, lambda x: F.abs(F.coalesce(x, F.lit(math.nan)))))
    # NaN is the largest of doubles.
    return vectors.select("vec_id", v.alias("embedding")).where((largest > 0) & (largest < F.lit(math.inf)))


def unit_vector(vectors: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        out = []
        for v in rows:
            # Scaled first, so that no square overflows or vanishes; adding zero makes minus zero zero.
            v = v / np.abs(v).max()
            out.append(v / np.linalg.norm(v) + 0.0)
        return pd.Series(out, dtype=object)

    return of(vectors)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def fit_centres(distinct: DataFrame, rows: int, width: int) -> np.ndarray:
    """Unit centres by Lloyd rounds: Spark sums the vectors of each cell, the driver holds only the centres."""
    k = max(1, min(MAX_CENTRES, round(rows / CELL_ROWS)))
    order = F.xxhash64("rep", F.lit(7))
    sample = distinct.select("unit", order.alias("o"))
    if rows > FIT_ROWS:
        sample = sample.where(F.pmod("o", F.lit(1 << 20)) < math.ceil(FIT_ROWS / rows * (1 << 20)))
    first = sample.orderBy("o").limit(4 * k).collect()
    centres = _apart(np.array([r["unit"] for r in first], dtype=np.float64).reshape(-1, width), MERGE_AT)[:k]
    for _ in range(ROUNDS):
        now = centres

        def sums(frames: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for frame in frames:
                if len(frame):
                    unit = _matrix(frame["unit"])
                    cell = (unit @ now.T).argmax(axis=1)
                    np.add.at(total, cell, unit)
                    count += np.bincount(cell, minlength=len(now))
            at = np.flatnonzero(count)
            yield pd.DataFrame({"cell": at, "total": list(total[at])})

        parts = sample.select("unit").mapInPandas(sums, "cell long, total array<double>")
        wide = parts.groupBy("cell").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
        moved = centres.copy()
        for r in wide.collect():
            total = np.array(r["total"])
            if np.linalg.norm(total) > 0:
                moved[r["cell"]] = total / np.linalg.norm(total)
        centres = _apart(moved, MERGE_AT)
    return centres


def _assign(centres: np.ndarray, margin: float):
    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            unit = _matrix(frame["unit"])
            close = unit @ centres.T
            home = close.argmax(axis=1)
            behind = close.max(axis=1)[:, None] - close
            near = behind <= margin * gaps[home]
            near[np.arange(len(unit)), home] = True
            probes = [np.flatnonzero(row).tolist() for row in near]
            yield pd.DataFrame({
                "rep": frame["rep"], "n": frame["n"], "unit": list(unit), "home": home, "probes": probes,
            })

    return task


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest position reachable, for the rows and then the columns of a link matrix (rows are numbered first)."""
    rows, columns = near.shape
    of_row, of_column = np.arange(rows), np.arange(rows, rows + columns)
    far = rows + columns
    while True:
        column = np.minimum(of_column, np.where(near, of_row[:, None], far).min(axis=0, initial=far))
        row = np.minimum(of_row, np.where(near, column[None, :], far).min(axis=1, initial=far))
        if (row == of_row).all() and (column == of_column).all():
            return row, column
        of_row, of_column = row, column


def _products(threshold: float):
    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks: vectors at home in a cell, against a block of the same or of probes from other cells."""
        cell, i, j = key
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]
        a, b = left["rep"].to_numpy(np.int64), right["rep"].to_numpy(np.int64)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": a[:0], "b": a[:0], "seen": a[:0]})
        near = _matrix(left["unit"]) @ _matrix(right["unit"]).T >= threshold
        near &= a[:, None] != b[None, :]
        home = right["home"].to_numpy()
        # A pair that meets in the cells of both counts in the one with the smaller number.
        for column in np.flatnonzero((home < cell) & near.any(axis=0)):
            for row in np.flatnonzero(near[:, column]):
                if home[column] in left["probes"].iloc[row]:
                    near[row, column] = False
        some, other = near.any(axis=1), near.any(axis=0)
        near, left, right, a, b = near[np.ix_(some, other)], left[some], right[other], a[some], b[other]
        if not len(a):
            return pd.DataFrame({"a": a, "b": a, "seen": a})
        ends = np.concatenate([a, b])
        row, column = _forest(near)
        seen_a, seen_b = near @ right["n"].to_numpy(np.int64), near.T @ left["n"].to_numpy(np.int64)
        if i == j:
            # The same vectors on both sides: both give links, one side counts.
            seen_b = np.zeros(len(b), np.int64)
        return pd.DataFrame({
            "a": np.r_[a, b], "b": np.r_[ends[row], ends[column]], "seen": np.r_[seen_a, seen_b],
        })

    return task


def _links(distinct: DataFrame, width: int, rows: int, threshold: float, margin: float) -> DataFrame:
    """(a, b, seen) over distinct vectors of one width: links that connect them, and copies each links to."""
    centres = fit_centres(distinct, rows, width)
    placed = written(distinct.mapInPandas(
        _assign(centres, margin), "rep long, n long, unit array<double>, home int, probes array<int>"
    ), "placed")
    spread = placed.select("*", F.explode("probes").alias("cell")).withColumn("foreign", F.col("cell") != F.col("home"))
    # At most one row per centre: bounded by MAX_CENTRES.
    sizes = spread.groupBy("cell").agg(
        F.ceil(F.count_if(~F.col("foreign")) / BLOCK_ROWS).cast("int").alias("homes"),
        F.ceil(F.count_if("foreign") / BLOCK_ROWS).cast("int").alias("probed"),
    )
    cut = spread.join(F.broadcast(sizes), "cell").where("homes > 0").withColumn(
        "block",
        F.when(F.col("foreign"), F.col("homes") + F.pmod(F.xxhash64("rep"), F.col("probed")))
        .otherwise(F.pmod(F.xxhash64("rep"), F.col("homes"))).cast("int"),
    )
    below = F.transform(F.sequence(F.lit(0), F.col("block")), lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))
    above = F.transform(
        F.sequence(F.col("block") + 1, F.col("homes") + F.col("probed")),
        lambda x: F.struct(F.col("block").alias("i"), x.alias("j")),
    )
    ends = F.col("homes") + F.col("probed")
    over = F.filter(above, lambda p: p["j"] < ends)
    against = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1), lambda x: F.struct(x.alias("i"), F.col("block").alias("j"))
    )
    dealt = cut.select("*", F.inline(F.when(F.col("foreign"), against).otherwise(F.concat(below, over))))
    return dealt.select("cell", "i", "j", "block", "rep", "n", "unit", "home", "probes").groupBy("cell", "i", "j").applyInPandas(
        _products(threshold), "a long, b long, seen long"
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding; others are ignored).

    Vectors link at a cosine of ``threshold`` or more, in double precision; each is compared in its own cell and in
    cells within ``margin``. Null, zero and non-finite vectors, and rows without an id, link with nothing: n_links 0,
    component_id their own id. Vectors of different lengths never link. Equal vectors link with each other; rows that
    repeat an id are expected to hold equal vectors. An empty table gives no rows.
    """
    bound_batches(vectors)
    fine = usable(vectors).where(F.col("vec_id").isNotNull())
    keyed = written(fine.select("vec_id", unit_vector(F.col("embedding")).alias("unit")), "units")
    distinct = written(
        keyed.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("width", F.size("unit")), "distinct"
    )
    empty = keyed.sparkSession.createDataFrame([], "a long, b long, seen long")
    links = empty
    for r in distinct.groupBy("width").count().collect():
        links = links.unionByName(_links(distinct.where(F.col("width") == r["width"]), r["width"], r["count"], threshold, margin))
    links = written(links, "pairs")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("seen").alias("seen"))
    groups = components(links, "a", "b").withColumnRenamed("node", "rep")
    told = (
        distinct.join(counts, "rep", "left").join(groups, "rep", "left")
        .select("unit", (F.coalesce("seen", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    members = keyed.join(told, "unit").groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    return vectors.select("vec_id").join(members, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
