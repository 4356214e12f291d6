"""Cascading name match: equal, then contained, then longest token contained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.functions.text import longest_token


# Characters of the pieces that names are indexed by.
GRAM = 3


def _grams(text: str, size: Column) -> Column:
    """The distinct pieces of ``size`` characters of a column."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, size)))


def containing(keys: DataFrame, candidates: DataFrame, gram: int = GRAM) -> DataFrame:
    """Pairs (key, candidate) where the candidate contains the key, by an inverted index.

    Each candidate is posted, by a number, under its distinct pieces of ``gram`` characters (shorter ones where a key is
    shorter). A key looks up only its rarest piece, and the candidates found there are read and compared with the whole
    key, so what is shuffled grows with the total length of the names. Null and empty keys match nothing.
    """
    looked_up = keys.select("key").where("key <> ''").distinct().withColumn("size", F.least(F.length("key"), F.lit(gram)))
    sizes = F.lit(looked_up.select(F.collect_set("size")).first()[0]).cast("array<int>")  # at most ``gram`` numbers
    numbered = candidates.select("candidate").where("candidate is not null").withColumn("number", F.xxhash64("candidate"))
    pieces = F.flatten(F.transform(sizes, lambda n: _grams("candidate", n)))
    postings = numbered.distinct().select("number", F.explode(pieces).alias("piece"))
    known = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # A key with a piece that no candidate has is contained in none; the lookup by its rarest piece leaves it out.
    own = looked_up.select("key", F.explode(_grams("key", F.col("size"))).alias("piece")).join(known, "piece", "left")
    rarest = own.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
    found = rarest.select("key", F.col("least.piece").alias("piece")).join(postings, "piece").select("key", "number")
    return found.join(numbered, "number").where(F.col("candidate").contains(F.col("key"))).select("key", "candidate")


def _per_key(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("matches"), F.min("candidate").alias("first"))


def match_names(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per name: stage 1-3 (0 unresolved), the key that matched, the number of matches, and
    the match if it is the only one.

    Matches are counted per key before names are attached, so many names sharing one token never
    multiply with the many candidates containing it. Several matches are left to a reviewer; see
    :func:`review_candidates`.
    """
    equal = candidates.select(F.col("candidate").alias("key"), "candidate")
    stages = (
        (1, F.col("name"), lambda keys: _per_key(equal)),
        (2, F.col("name"), lambda keys: _per_key(containing(keys, candidates))),
        (3, longest_token("name"), lambda keys: _per_key(containing(keys, candidates))),
    )
    done, left = [], names.select("name")
    for stage, key, search in stages:
        keyed = left.withColumn("key", key)
        joined = keyed.join(search(keyed.select("key")), "key", "left")
        done.append(joined.filter("matches is not null").withColumn("stage", F.lit(stage)))
        left = joined.filter("matches is null").select("name")
    nothing = left.select(
        F.lit(None).cast("string").alias("key"), "name", F.lit(0).cast("long").alias("matches"),
        F.lit(None).cast("string").alias("first"), F.lit(0).alias("stage"),
    )
    every = reduce(lambda a, b: a.unionByName(b), [*done, nothing])
    return every.select(
        "name", "stage", "key", "matches", F.when(F.col("matches") == 1, F.col("first")).alias("match"),
        (F.col("matches") > 1).alias("ambiguous"),
    )


def review_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of every key that matched more than once: (key, candidate).

    Keyed like ``matched``, so a reviewer joins the two for the names at hand.
    """
    return containing(matched.filter("ambiguous and stage > 1").select("key"), candidates)
