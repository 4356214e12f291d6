"""Name cascade and substring join against brute force."""

import random

import pytest

from courtline.operators.matching import containing, match_names, review_candidates


def brute(names, candidates):
    out = {}
    for name in names:
        token = max(name.split(" "), key=len)
        for stage, test in ((1, lambda c: c == name), (2, lambda c: name in c), (3, lambda c: token in c)):
            hits = sorted(c for c in candidates if test(c))
            if hits:
                out[name] = (stage, hits)
                break
    return out


def frames(spark, names, candidates):
    return (
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame([(c,) for c in candidates], "candidate string"),
    )


def test_cascade(spark):
    rng = random.Random(8)
    words = ["St.", "Mary", "State", "Tech", "A&M", "(NY)", "North", "Oak", "Iowa", "é"]
    phrase = lambda n: " ".join(rng.sample(words, n))
    names = sorted({phrase(rng.randrange(1, 4)) for _ in range(40)} | {"Zzz"})
    candidates = sorted({phrase(rng.randrange(1, 5)) for _ in range(60)})
    want = brute(names, candidates)
    left, right = frames(spark, names, candidates)
    matched = match_names(left, right)
    table = {r.name: r for r in matched.collect()}
    assert set(table) == set(names)
    for n in names:
        stage, hits = want.get(n, (0, []))
        assert (table[n].stage, table[n].matches, table[n].ambiguous) == (stage, len(hits), len(hits) > 1)
        assert table[n].match == (hits[0] if len(hits) == 1 else None)
    review = {}
    for r in review_candidates(matched, right).collect():
        review.setdefault(r.key, []).append(r.candidate)
    assert {table[n].key: sorted(want[n][1]) for n in names if table[n].ambiguous} == {k: sorted(v) for k, v in review.items()}


def test_shared_token_is_counted_not_multiplied(spark):
    names = [f"{i} University" for i in range(60)]
    candidates = [f"The University {i} of" for i in range(70)]
    left, right = frames(spark, names, candidates)
    got = match_names(left, right)
    assert [tuple(r) for r in got.select("stage", "key", "matches").distinct().collect()] == [(3, "University", 70)]
    assert got.count() == 60 and review_candidates(got, right).count() == 70


def test_containing_is_literal_and_whole(spark):
    keys = spark.createDataFrame([("a.b",), ("x" * 50,), ("b",)], "key string")
    long = "y" * 2000 + "x" * 50
    right = spark.createDataFrame([("axb",), ("a.b",), (long,)], "candidate string")
    got = {(r.key, r.candidate) for r in containing(keys, right).collect()}
    assert got == {("a.b", "a.b"), ("b", "axb"), ("b", "a.b"), ("x" * 50, long)}


@pytest.mark.parametrize("gram", [1, 3, 8])
def test_index_finds_all_that_contain_a_key(spark, gram):
    rng = random.Random(gram)
    word = lambda n: "".join(rng.choice("abé \U0001f600%_(") for _ in range(rng.randint(0, n)))
    keys = [*(word(5) for _ in range(80)), None, "", "zzz"]
    candidates = [*{word(14) for _ in range(120)}, None]
    got = containing(
        spark.createDataFrame([(k,) for k in keys], "key string"),
        spark.createDataFrame([(c,) for c in candidates], "candidate string"), gram,
    )
    assert sorted(map(tuple, got.collect())) == sorted({(k, c) for k in keys for c in candidates if k and c and k in c})
