"""File sources and sinks, and the adapters' own properties."""

import os
import re

import pytest
from pyspark.sql import functions as F

from courtline.sources import files, tables
from courtline.storage import OPEN_PARTITIONS, SORTED_SPLIT, new_path, open_partitions, setting, small_splits
from tests_plan import exchanges, plan


def test_hot_order_gives_one_game(spark):
    """One order with a third of all lines: same result as a full sort."""
    lines = spark.range(0, 3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 500 + 1).cast("long").alias("l_orderkey"),
        (F.col("id") * 17 % 40).alias("l_partkey"), F.when(F.col("id") < 990, 5).otherwise(F.col("id") % 9).cast("long").alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        (F.col("id") * 31 % 997).cast("double").alias("l_extendedprice"),
        F.element_at(F.array(F.lit("R"), F.lit("A"), F.lit("N")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"),
    )
    orders = spark.range(0, 501).select(
        F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("1997-03-01").cast("timestamp_ntz").alias("o_orderdate")
    )
    got = {r.game_id: (r.w_id, r.w_score, r.l_id, r.l_score) for r in tables.build_game_log(lines.repartition(7), orders).collect()}
    want = {}
    by_order = {}
    for r in lines.collect():
        by_order.setdefault(r.l_orderkey, []).append(r)
    for key, rows in by_order.items():
        rows.sort(key=lambda r: (-r.l_extendedprice, r.l_linenumber, r.l_suppkey, r.l_partkey, r.l_quantity, r.l_returnflag))
        other = next((r for r in rows if r.l_suppkey != rows[0].l_suppkey), None)
        if other:
            want[key] = (rows[0].l_suppkey, int(rows[0].l_extendedprice // 1000), other.l_suppkey, int(other.l_extendedprice // 1000))
    assert got == want and 0 in got


def test_season_overwrite_touches_only_its_seasons(spark):
    path = new_path(spark, "seasons")
    df = spark.createDataFrame([(1, 2000), (2, 2001), (3, 2001)], "v int, season int")
    files.write_season_partitions(df, path)
    files.write_season_partitions(df.filter("v = 2"), path)
    assert sorted(tuple(r) for r in files.read_orc(spark, path).select("v", "season").collect()) == [(1, 2000), (2, 2001)]


def test_season_range_skips_absent_seasons(spark):
    path = new_path(spark, "range")
    df = spark.createDataFrame([(1, 2000), (2, 2003)], "v int, season int")
    files.write_season_partitions(df, path, "parquet")
    assert files.read_seasons(spark, path, 1998, 2002).count() == 1


def test_bad_csv_cell_raises(spark):
    path = new_path(spark, "bad")
    spark.createDataFrame([("1",), ("x",)], "v string").coalesce(1).write.option("header", True).csv(path)
    from pyspark.sql.types import IntegerType, StructField, StructType

    with pytest.raises(Exception):
        files.read_csv(spark, path, StructType([StructField("v", IntegerType())])).collect()


def test_single_file(spark):
    path = new_path(spark, "single")
    files.write_csv(spark.range(0, 100).repartition(6), path, single_file=True)
    local = path.removeprefix("file:")
    assert len([f for f in os.listdir(local) if f.startswith("part-")]) == 1


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = (
        tables.game_log(spark, small).filter("season = 2000 and w_score > 90").select("game_id", "w_id")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "PushedFilters: [IsNotNull(w_score), GreaterThan(w_score,90)]" in plan
    assert "season" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "w_fgm" not in plan


def test_tenures_do_not_overlap(spark, small):
    t = tables.tenures(spark, small)
    a, b = t.alias("a"), t.alias("b")
    both = a.join(b, (F.col("a.season") == F.col("b.season")) & (F.col("a.team") == F.col("b.team")) & (F.col("a.first_day") < F.col("b.first_day")))
    assert both.filter("a.last_day >= b.first_day").count() == 0


def _order_lines(spark):
    """Orders of one line, of two suppliers, of one supplier only, of one supplier's many dear lines, and repeated or without keys."""
    lines = [(1, 5, 900.0), (2, 5, 900.0), (2, 6, 800.0), (2, 5, 700.0), (3, 5, 900.0), (3, 5, 800.0), (5, None, 9.0), (5, None, 8.0)]
    lines += [(4, 7, 1000.0 + n) for n in range(40)] + [(4, 8, 3.0), (4, 9, 5.0), (4, 9, 4.0), (6, 7, None), (6, 7, 5.0), (6, 8, 6.0)]
    lines += [(7, 1, 5.0), (7, 1, 5.0), (7, 2, 5.0), (5, 3, 1.0), (None, 1, 2.0), (None, 2, 1.0)]
    lineitem = spark.createDataFrame(
        [(o, s, n % 7 + 1, n * 3 % 11, float(n % 5), p, "RAN"[n % 3]) for n, (o, s, p) in enumerate(lines)],
        "l_orderkey long, l_suppkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string",
    )
    orders = spark.createDataFrame([(k, "1-URGENT", f"{1990 + k}-03-01") for k in (1, 2, 3, 4, 5, 6, 7, 7)], "o_orderkey long, o_orderpriority string, d string")
    return lineitem, orders.select("o_orderkey", "o_orderpriority", F.col("d").cast("timestamp_ntz").alias("o_orderdate"))


@pytest.mark.parametrize("wanted", ["l_orderkey > 0", "l_orderkey = 2", "l_orderkey = 4"])
def test_stored_game_log_is_the_whole_one(spark, wanted):
    """Whether or not there are orders whose two dearest lines are of one supplier."""
    lineitem, orders = _order_lines(spark)
    want = tables.build_game_log(lineitem.where(wanted), orders)
    got = spark.read.parquet(tables.write_game_log(lineitem.where(wanted).repartition(5), orders, new_path(spark, "log"))).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_game_log_shuffles_and_sorts_lines_once(spark):
    """Two shuffles of the lines, and a sort of the wide rows by season for the write, were what spilled."""
    lineitem, orders = _order_lines(spark)
    text = plan(tables.two_dearest(lineitem, orders))
    assert len([keys for keys in exchanges(text) if "l_orderkey" in keys]) == 1 and "l_suppkey" not in "".join(exchanges(text))
    assert re.search(r"WindowGroupLimit.*Partial", text) and text.count("Sort [l_orderkey") == 2


def test_settings_of_a_write_are_put_back(spark):
    names = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    with open_partitions(spark), small_splits(spark):
        assert [spark.conf.get(n) for n in names] == [str(OPEN_PARTITIONS), str(SORTED_SPLIT)]
    assert [spark.conf.get(n) for n in names] == before
    with setting(spark, names[1], "8m"), small_splits(spark):
        assert spark.conf.get(names[1]) == str(8 << 20)


def test_trailing_table_is_built_from_small_splits(spark, monkeypatch):
    """A task's totals per team and day are as many as the rows it reads; whole splits of them spilled."""
    from courtline.catalog import registry

    seen = []

    def kept(session, *_, **__):
        seen.append(session.conf.get("spark.sql.files.maxPartitionBytes"))
        return session.createDataFrame([(1, 1999)], "v int, season int")

    monkeypatch.setattr(registry, "kept_table", kept)
    assert registry.trailing_table(spark, "none").count() == 1 and seen == [str(SORTED_SPLIT)]


def test_orc_statistics_are_totalled_from_small_splits(spark, small, monkeypatch):
    """As the trailing table: totals are as many as the rows a task reads, and whole splits of them spilled."""
    from courtline.catalog import storing
    from courtline.catalog.registry import QUERIES

    name = "spark.sql.files.maxPartitionBytes"
    before, seen, write = spark.conf.get(name), [], files.write_orc

    def written(df, path):
        seen.append(spark.conf.get(name))
        write(df, path)

    monkeypatch.setattr(storing.files, "write_orc", written)
    assert QUERIES["s2_orc_scan"].plan(spark, small).count() > 0
    assert seen == [str(SORTED_SPLIT)] and spark.conf.get(name) == before
