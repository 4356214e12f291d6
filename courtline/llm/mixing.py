"""Mixing sources to target weights by entropy balancing.

Among all rates per document that give each source its target number of words, and lie between none and ``MOST`` copies,
the ones closest to one copy of everything (in Kullback-Leibler divergence) are exponential tilts of the document's
size: ``min(MOST, exp(tilt * size / mean size of the source))``. The tilt of a source is the root of a convex dual,
found by Newton rounds that Spark sums over a table of (source, size) counts; the step is kept between bounds on the
root. Rates become whole copies by systematic rounding: documents of a source stand in order of size, and copies are
the differences of the rounded running sum of rates. A source's words then differ from its target by no more than about
the size of its largest document, and a few exchanges of single copies close most of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtline.llm.tables import own_columns, unused, written
from courtline.operators.indexing import dense_index

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
ROUNDS = 40
# Documents of one source and size are ranked in this many groups, so that a size most documents share is split.
GROUPS = 64
# Starting points of the rounding; each source uses the one whose words come nearest to its target.
PHASES = 32
# Rounds in which single documents are taken once more or less.
SETTLING = 3


def words_in(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(nameless, name, place, source_size, target) from one row (nameless, name, source_size) per source.

    Sources stand by code point, the nameless one last, and take ``weights`` in turn. The targets share ``share`` of all
    sizes by weight; none is above ``most`` times its source, and what a full source cannot take is shared anew.
    """
    named = dense_index(sizes, ["nameless", "name"], "place")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    caps = F.col("source_size") * float(most)
    placed = written(named.withColumn("weight", cycle).withColumn("cap", caps), "sources")
    total = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(unit)
        row = placed.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        raised = (total - row["taken"]) / row["open"]
        if raised <= unit:
            break
        unit = raised
    target = F.least("cap", F.col("weight") * F.lit(unit))
    return placed.select("nameless", "name", "place", "source_size", target.alias("target"))


def _tilts(counts: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(place, tilt): the root of each source's dual; null where every document is taken ``most`` times or not at all."""
    goal = sources.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))).select("place", "target")
    mean = counts.groupBy("place").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goal.join(mean, "place").select(
        "*", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.lit(False).alias("done"),
    )
    state = written(state, "tilts")
    for _ in range(ROUNDS):
        z = F.col("size") / F.col("mean")
        rate = F.least(F.exp(F.least(F.col("tilt") * z, F.lit(50.0))), F.lit(float(most)))
        words = F.col("n") * F.col("size") * rate
        sums = counts.where("size > 0").join(state.where("not done"), "place").groupBy("place").agg(
            F.sum(words).alias("words"), F.sum(F.when(rate < most, words * z).otherwise(0.0)).alias("slope")
        )
        over = F.col("words") - F.col("target")
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - over / F.col("slope")
        inside = (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        halved = F.when(low.isNull(), high - 2.0 * (F.abs(high) + 1)).when(high.isNull(), low + 2.0 * (F.abs(low) + 1))
        step = F.when(inside, newton).otherwise(halved.otherwise((low + high) / 2))
        near = F.abs(over) <= 1e-9 * F.col("target")
        moved = state.where("not done").join(sums, "place").select(
            "place", "target", "mean", F.when(near, F.col("tilt")).otherwise(step).alias("tilt"), low.alias("low"),
            high.alias("high"), near.alias("done"),
        )
        state = written(state.where("done").unionByName(moved), "tilts")
        if not state.where("not done").limit(1).count():
            break
    # Sums may differ in their last digits from run to run; the rates must not.
    return state.select("place", F.round("tilt", 8).alias("tilt"), "mean")


def copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(doc_id, key, size, source_size, target, copies), one row per row of ``docs`` (doc_id, text, source)."""
    narrow = written(docs.select(
        "doc_id", row_key().alias("key"), F.col("source").isNull().alias("nameless"),
        F.coalesce("source", F.lit("")).alias("name"), words_in(F.col("text")).alias("size"),
    ), "sizes")
    cells = narrow.groupBy("nameless", "name", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("nameless", "name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = written(source_targets(sizes, weights, share, most), "targets")
    counts = written(cells.join(sources, ["nameless", "name"]).select("place", "size", "n"), "counts")
    tilts = _tilts(counts, sources, most)
    tilted = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(most)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(most)).otherwise(tilted)
    before = Window.partitionBy("place").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cell = (
        counts.join(sources.select("place", "target"), "place").join(tilts, "place", "left")
        .withColumn("rate", rate)
        .withColumn("ahead", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(before), F.lit(0.0)))
        .select("place", "size", "rate", "ahead")
    )
    dealt = narrow.join(sources, ["nameless", "name"]).drop("nameless", "name").withColumn(
        "part", F.pmod(F.xxhash64("key"), F.lit(GROUPS))
    )
    own = ["place", "size", "part"]
    smaller = Window.partitionBy("place", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(own).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(*own, F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("skip"))
    within = F.row_number().over(Window.partitionBy(own).orderBy("key", "doc_id"))
    ranked = dealt.withColumn("rank", within).join(parts, own).join(cell, ["place", "size"])
    ranked = written(ranked.select(
        "doc_id", "key", "rank", "place", "size", "source_size", "target", "rate",
        (F.col("ahead") + (F.col("skip") + F.col("rank")) * F.col("rate")).alias("upto"),
    ), "ranked")

    def taken(phase: Column) -> Column:
        upto = F.col("upto") + phase
        return F.least(F.floor(upto + 1e-9) - F.floor(upto - F.col("rate") + 1e-9), F.lit(most))

    phases = [k / PHASES for k in range(PHASES)]
    sums = ranked.groupBy("place", "target").agg(*[
        F.sum(taken(F.lit(p)) * F.col("size")).alias(f"p{k}") for k, p in enumerate(phases)
    ])
    best = F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"p{k}") - F.col("target")).alias("off"), F.lit(p).alias("phase")) for k, p in enumerate(phases)
    ]))
    rounded = ranked.join(sums.select("place", best["phase"].alias("phase")), "place").select(
        "doc_id", "key", "rank", "place", "size", "source_size", "target", taken(F.col("phase")).cast("long").alias("copies")
    )
    return _settled(rounded, most).drop("place", "rank")


def _settled(rows: DataFrame, most: int) -> DataFrame:
    """Take one copy more or less, in each round, of the document of a source that closes most of what is still off.

    Matters for small sources, whose single documents weigh much. Equal rows are told apart by their rank, so one row
    moves, whatever repeats it.
    """
    for _ in range(SETTLING):
        rows = written(rows, "rounded")
        off = F.col("target") - F.sum(F.col("copies") * F.col("size"))
        left = rows.groupBy("place", "target").agg(off.alias("off")).select("place", "off")
        step = F.signum("off").cast("long")
        fits = (F.col("size") > 0) & (F.col("copies") + step).between(0, most)
        gain = F.abs(F.abs("off") - F.col("size"))
        best = rows.join(left, "place").where(fits & (gain < F.abs("off"))).groupBy("place").agg(
            F.min(F.struct(gain.alias("gain"), F.struct("key", "rank").alias("row"), step.alias("step"))).alias("best")
        ).select("place", F.col("best.row").alias("chosen"), "best.step")
        moved = F.when(F.struct("key", "rank") == F.col("chosen"), F.col("step")).otherwise(0)
        rows = rows.join(best, "place", "left").withColumn("copies", F.col("copies") + F.coalesce(moved, F.lit(0))).drop(
            "chosen", "step"
        )
    return rows


def row_key() -> Column:
    """Names a row by its id, source and text, so that rows without an id have a key as well."""
    return F.xxhash64("doc_id", "source", "text")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs`` (doc_id, text, source; others are ignored).

    Null and empty texts have size 0 and nothing taken. Null sources are one source, the last. Repeated rows count each.
    A source without words has target 0. An empty table gives no rows. Runs on the same rows agree.
    """
    return copies(docs, weights, share, most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents that are taken, with their own columns and ``copies``, the times each is to be repeated.

    Documents without words are left out. Rows that repeat an id, source and text all get the larger of their copies.
    A column of ``docs`` that is called copies is replaced.
    """
    told = copies(docs, weights, share, most).where("size > 0").groupBy("key").agg(F.max("copies").alias("copies"))
    key = unused(docs, "_key")
    chosen = written(told.where("copies > 0"), "chosen").withColumnRenamed("key", key)
    own = [c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name.lower() != "copies"]
    return docs.select(*own).withColumn(key, row_key()).join(chosen, key).select(*own, "copies")
