"""SimHash, embeddings and components against brute force."""

import math
import random

import numpy as np
import pytest

from courtline.llm import embeddings, simhash
from courtline.llm.components import components
from tests_llm_brute import fingerprint, groups


def test_simhash_matches_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    prints = {i: fingerprint(t) for i, t in rows}
    expected = groups(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    got = simhash.near_duplicates(documents).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], expected[i]) for i in prints}


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 3])
def test_links_connect_dense_and_sparse_codes(spark, limit):
    rng = random.Random(3)
    near = [0]
    for _ in range(400):
        near.append(near[-1] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    codes = sorted({*near, *(rng.getrandbits(64) for _ in range(300)), (1 << 64) - 1, (1 << 64) - 8})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "code long")
    found = {r.node: r.component for r in components(simhash.fingerprint_links(table, 4, limit), "a", "b").collect()}
    x = np.array(codes, np.uint64)
    order = sorted(signed)
    value = dict(zip(signed, x.tolist(), strict=True))
    expected = groups(order, lambda a, b: (value[a] ^ value[b]).bit_count() <= 4)
    assert {c: found.get(c, c) for c in signed} == expected


def test_bucket_links_in_blocks():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 200)).astype(np.uint64)
    codes = np.unique((base[:, None] ^ flips).ravel())
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    codes = codes[np.argsort(ranks)]
    a, b = simhash.bucket_links(codes, 4)
    assert (np.bitwise_count(a ^ b) <= 64).all() and len(a) == len(codes) - 40


def test_simhash_awkward_rows(awkward):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[6].fingerprint == "0" * 16
    assert by_id[3].component_id == by_id[6].component_id == 2 and by_id[5].component_id == 4 and by_id[8].component_id == 1
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 4, 7]


def test_simhash_empty(make):
    assert simhash.near_duplicates(make([])).collect() == [] and simhash.keep_one(make([])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (None, 3), (5, 4)], "x long, y long")
    got = {r.node: r.component for r in components(links, "x", "y").collect()}
    assert got == dict.fromkeys(range(301), 0)


def cosine_groups(rows, threshold):
    unit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    near = lambda a, b: len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold
    return unit, groups(sorted(unit), near), {a: sum(a != b and near(a, b) for b in unit) for a in unit}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(5)] + [(700, [2 * x for x in rows[1][1]])]
    rows += [(701, None), (702, [0.0] * 16), (703, [float("nan")] + [1.0] * 15), (704, [None] + [1.0] * 15),
             (705, [float("inf")] + [1.0] * 15), (706, []), (707, [1.0, 2.0]), (708, [1.0, 2.1]), (None, rows[0][1])]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, unit string, n int")
    got = embeddings.near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    unit, expected, links = cosine_groups(rows, 0.95)
    for r in got:
        if r.vec_id in unit:
            assert (r.n_links, r.component_id) == (links[r.vec_id], expected[r.vec_id]), r
        elif r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_embeddings_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.15).tolist()) for i in range(150)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, expected, links = cosine_groups(rows, 0.95)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (links[i], expected[i]) for i, _ in rows}


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_texts_that_share_an_id_are_judged_each(make):
    words = lambda seed: " ".join(f"w{(seed * 7919 + k * 104729) % 99991}" for k in range(120))
    copy, one, two = words(1), words(2), words(3)
    docs = make([(1, copy), (2, copy), (2, one), (2, two), (2, two), (3, one), (None, copy), (None, copy), (4, None), (5, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, copy), (2, one), (2, two), (None, copy), (4, None)], key=str
    )
