"""Tables that change together."""

import random

import pytest
from pyspark.sql.types import StructType

from courtline.operators import ingest
from courtline.operators.commits import MOST_FOLDERS, Conflict, Store
from courtline.storage import new_path
from tests_plan import stored_cells

A, B = StructType().add("key", "long").add("a", "string"), StructType().add("key", "long").add("b", "integer")


class Crash(Exception):
    pass


def crash():
    raise Crash


@pytest.fixture
def store(spark):
    return Store(spark, new_path(spark, "store"), "key", {"one": A, "two": B}, ranges=4)


def rows(store, table):
    return sorted(tuple(r) for r in store.read(table).collect())


def test_crash_before_the_log_leaves_nothing(spark, store):
    one, two = spark.createDataFrame([(1, "x"), (2, "y")], A), spark.createDataFrame([(1, 5)], B)
    assert rows(store, "one") == [] == rows(store, "two")
    with pytest.raises(Crash):
        store.commit({"one": one, "two": two}, before_log=crash)
    assert rows(store, "one") == [] == rows(store, "two")
    assert store.commit({"one": one, "two": two}) == 1
    with pytest.raises(Crash):
        store.commit({"one": spark.createDataFrame([(2, "z")], A), "two": spark.createDataFrame([(2, 6)], B)}, before_log=crash)
    assert (rows(store, "one"), rows(store, "two")) == ([(1, "x"), (2, "y")], [(1, 5)])


def test_any_sequence_equals_a_dictionary(spark, store):
    rng = random.Random(3)
    want = {}
    for _ in range(6):
        batch = {rng.randrange(30): rng.choice("abc") for _ in range(rng.randrange(9))}
        want |= batch
        store.commit({"one": spark.createDataFrame(list(batch.items()), A)})
        assert rows(store, "one") == sorted(want.items())
    assert rows(store, "two") == []


def test_of_two_at_once_one_counts(spark, store):
    first, second = ({"one": spark.createDataFrame([(k, v)], A)} for k, v in ((1, "first"), (2, "second")))
    lost = 0
    try:
        store.commit(first, before_log=lambda: store.commit(second))
    except Conflict:
        lost = 1
    assert rows(store, "one") in ([(1, "first")], [(2, "second")])
    assert lost == (rows(store, "one") == [(2, "second")])


def test_ranges_without_changes_stay(spark, store):
    store.commit({"one": spark.range(40).selectExpr("id as key", "'old' as a")})
    before = {r.folder for r in store._state()[1]}
    store.commit({"one": spark.createDataFrame([(7, "new")], A)})
    after = {r.folder for r in store._state()[1]}
    assert len(before & after) == 3 and len(after) == 4
    assert store.read("one").where("a = 'new'").count() == 1 and store.read("one").count() == 40
    assert MOST_FOLDERS > 1


def test_ingest_commits_results_and_ledger_together(spark, small):
    cells = stored_cells(spark, small)
    store = ingest.game_store(spark, new_path(spark, "games"))
    with pytest.raises(Crash):
        ingest.ingest_into(store, cells, before_log=crash)
    assert store.read("results").isEmpty() and store.read("ledger").isEmpty()
    ingest.ingest_into(store, cells)
    games, statuses = ingest.process(cells)
    assert store.read("results").exceptAll(games).isEmpty() and store.read("results").count() == games.count()
    assert store.read("ledger").exceptAll(statuses).isEmpty() and store.read("ledger").count() == cells.count()
    version = store.version()
    assert ingest.ingest_into(store, cells) == version
    assert ingest.ingest_into(store, cells, retry=("NotFinal",)) == version + 1
    assert store.read("ledger").count() == cells.count()
