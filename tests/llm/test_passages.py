"""Repeated passages and benchmark leaks against brute force."""

import collections
import random

import pytest

from courtline.llm import decontaminate, suffixes
from tests_llm_brute import joined, matched_words, shared_words


@pytest.fixture(scope="module")
def overlapping():
    """Texts that share passages, whole, cut short, or with words changed, left out or put in."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passages = [[word() for _ in range(n)] for n in (30, 49, 51, 60, 90, 200)]
    texts = []
    for i in range(70):
        w = [word() for _ in range(rng.randint(0, 80))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            p = p[rng.randint(0, 12):] if rng.random() < 0.3 else list(p)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(p))
                p[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
            w += p + [word() for _ in range(rng.randint(0, 40))]
        texts.append((i // 2 if i > 60 else i, " ".join(w)))
    return texts


def spans_of(texts, frame):
    """The operator's spans by place in ``texts``."""
    import xxhash

    found = collections.defaultdict(set)
    for r in frame.collect():
        found[r.doc_id, r.text_hash].add((r.start_word, r.end_word))
    code = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    return [sorted(found[i, code(t)]) for i, t in texts]


@pytest.mark.parametrize("limit", [20_000, 1])
@pytest.mark.parametrize("spare_first", [False, True])
def test_spans_match_brute_force(make, overlapping, limit, spare_first):
    """Nothing that shares 19 words is missed, nothing that shares fewer than 8 counts, and in between the retained
    suffixes, extended word by word, say what is found."""
    got = spans_of(overlapping, suffixes.repeated_passages(make(overlapping), group_limit=limit, spare_first=spare_first))
    sure, all_ = shared_words(overlapping, 19, spare_first), shared_words(overlapping, 8, spare_first)
    for k, covered in enumerate(matched_words(overlapping, spare_first)):
        assert got[k] == joined(covered, 16, 50)
        assert all(any(a <= x and y <= b for a, b in got[k]) for x, y in joined(sure[k], 16, 50))
        assert all(covered[x] <= all_[k][x] for x in range(len(covered)))
    assert sum(map(len, got)) > 40


def test_edits_inside_a_passage_do_not_break_it(make):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, wanted = [], 0
    for i in range(120):
        passage = [word() for _ in range(rng.randint(56, 120))]
        for copy in range(2):
            own = list(passage)
            if copy:
                for at in rng.sample(range(5, len(own) - 5), len(own) // 40):
                    own[at] = word()
            texts.append((2 * i + copy, " ".join([word() for _ in range(60)] + own + [word() for _ in range(60)])))
        wanted += 1
    got = spans_of(texts, suffixes.repeated_passages(make(texts)))
    assert sum(bool(a) and bool(b) for a, b in zip(got[::2], got[1::2], strict=True)) >= 0.97 * wanted
    halves = ["q" + word() for _ in range(81)]
    other = [*halves[:40], "changed", *halves[41:]]
    pair = [(1, " ".join(halves)), (2, " ".join(other))]
    assert spans_of(pair, suffixes.repeated_passages(make(pair))) == [[(0, 81)], [(0, 81)]]


def test_dropping_leaves_no_repeat(make, overlapping):
    docs = make(overlapping)
    left = suffixes.drop_repeats(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    spans = spans_of(overlapping, suffixes.repeated_passages(docs, spare_first=True))
    cut = [(i, suffixes.without_words(t, own)) for (i, t), own in zip(overlapping, spans, strict=True)]
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(
        (i, t) for (i, t), own in zip(cut, spans, strict=True) if t.split() or not own
    )


def test_texts_that_share_an_id_are_cut_by_their_own_spans(make):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    copy, unique = text(100), text(120)
    left = suffixes.drop_repeats(make([(1, copy), (2, copy), (2, unique), (2, unique), (3, copy)])).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(1, copy), (2, unique), (2, unique)])


def test_passages_awkward_rows(awkward, make):
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_passages(awkward).collect())
    assert got == [(4, 0, 60_000), (5, 0, 60_000)]
    kept = suffixes.drop_repeats(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert suffixes.repeated_passages(make([])).collect() == [] and suffixes.drop_repeats(make([])).collect() == []


ITEMS = [
    (0, "The quick brown fox jumps over the lazy dog while seven tired wizards mix potions in the cellar below us"),
    (1, "Explain, in your own words, why the river bends to the east after heavy rain in early spring of most years."),
    (2, "too short here"), (3, ""), (4, None), (None, "nameless item that still has to be found in any document at all costs today"),
]


def edited(text, rate, rng):
    out = []
    for c in text:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(rng.choice("xyz") if r < 2 * rate / 3 else c)
        if 2 * rate / 3 <= r < rate:
            out.append(rng.choice("xyz"))
    return "".join(out)


def distance(item, text):
    """Least edit distance of the item to any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(9)
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontaminate.best_distance(a, b) == distance(a, b)


def test_leaks_found_and_clean_kept(spark, make):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, code string")
    rng = random.Random(2)
    filler = " ".join("".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(400))
    rows = [
        (1, f"{filler} {ITEMS[0][1]} {filler}"), (2, f"{filler}\n{ITEMS[1][1].upper()}\t{filler}"), (3, filler), (4, None), (5, ""),
        (6, f"{filler} Too  short here {filler}"), (7, "too shorthere"), (8, ITEMS[5][1]), (9, edited(ITEMS[0][1], 0.03, rng)),
        (10, " ".join([filler] * 500 + [ITEMS[1][1]])), (None, ITEMS[0][1]), (1, filler),
        (11, "to shxrthere and"),
    ]
    docs = make(rows)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (6, 2), (7, 2), (8, None), (9, 0), (10, 1), (None, 0)}
    assert got[9, 0] == distance(decontaminate.normal(ITEMS[0][1]).decode(), decontaminate.normal(rows[8][1]).decode())
    assert got[7, 2] == 1
    assert all(d == 0 for k, d in got.items() if k not in ((9, 0), (7, 2)))
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [1, 3, 4, 5, 11]


def with_edits(text, n, rng):
    """The text after ``n`` random deletions, replacements and insertions of a character."""
    chars = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        chars[at : at + (kind != 2)] = [] if kind == 0 else [rng.choice("etaoin")]
    return "".join(chars)


@pytest.mark.parametrize(
    "words, rate", [(w, r) for w in (8, 12, 16, None) for r in (0.05, 0.1, 0.15, 0.2) if (w, r) != (8, 0.2)]
)
def test_leak_recall(documents, spark, small, words, rate):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    items = [(i, " ".join(decontaminate.normal(t).decode().split()[:words])) for i, t in items]
    scanner = decontaminate.Scanner(decontaminate.build_index(items), decontaminate.MAX_EDITS)
    rng = random.Random(4)
    hosts = [r.text for r in documents.select("text").limit(len(items)).collect()]
    texts = [f"{h} {with_edits(t, int(rate * len(t)), rng)} {h}" for h, (_, t) in zip(hosts, items, strict=False)]
    found = {(n, i) for n, i, _ in scanner.scan(texts)}
    assert sum((n, n) in found for n in range(len(texts))) >= 0.9 * len(texts)


def test_short_items_against_the_plain_table():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 7)))) for i in range(40)]
    texts = [" ".join(word() for _ in range(60)) for _ in range(10)]
    texts += [f"{texts[0]} {with_edits(t, int(0.2 * len(t)), rng)} {texts[1]}" for _, t in items]
    texts = [decontaminate.normal(t).decode() for t in texts]
    scanner = decontaminate.Scanner(decontaminate.build_index(items), 0.2)
    wanted = {
        (n, i): d for n, text in enumerate(texts) for i, t in items
        if (d := distance(f" {t} ", f" {text} ")) <= int(0.2 * len(t))
    }
    assert {(n, i): d for n, i, d in scanner.scan(texts)} == wanted


def test_leaks_in_blocks_and_empty(spark, make, monkeypatch):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 120)
    docs = make([(i, t) for i, (_, t) in enumerate(ITEMS)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (5, None)}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []
    assert decontaminate.contaminated(make([]), benchmark).collect() == [] and decontaminate.keep_clean(make([]), benchmark).count() == 0
