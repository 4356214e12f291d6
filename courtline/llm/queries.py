"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm import decontaminate, embeddings, extraction, language, licenses, mixing, perplexity, periodic, simhash
from courtline.llm import spelling, sql, suffixes, toxicity, urls
from courtline.llm.tables import read


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, sf_dir, "documents"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(read(spark, sf_dir, "documents"))


def op7_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.label_outcomes(read(spark, sf_dir, "labels")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its id ends in words that repeat with a period, as the query asks."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(own: Column) -> Column:
        g, n = F.floor(h / 10), F.size(own)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(
            own, lambda word, i: F.when(i < a, word).otherwise(F.get(own, (a + (i - a) % p).cast("int")))
        ))

    # The words are one element of an array, so that they are cut once and not for every word.
    planted = F.get(F.transform(F.array(words), repeated), F.lit(0))
    chosen = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(chosen, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_planted_runs(read(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("order"), r.start, r.period, r.length)))
    digests = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return digests.select(
        "doc_id", "n_runs", "r.start", "r.length", "r.period",
        F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), spelling.dropped_letter())


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_embedding_groups": op7_embedding_groups,
    "op8_source_mix": op8_source_mix,
    "op9_url_verdicts": op9_url_verdicts,
    "op10_language": op10_language,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_main_text": op13_main_text,
}
ORACLE_SQL: dict[str, str] = {
    "op6_licenses": sql.LICENSES,
    "op9_url_verdicts": sql.URL_VERDICTS,
}
