"""Licenses, URLs and mixing against brute force, and awkward rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from courtline.llm import licenses, mixing, urls
from check import compare, connect

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op6_licenses", "op9_url_verdicts"])
def test_sql_agrees(name, spark, small):
    ok, note = compare(name, spark, connect(small), small)
    assert ok, note


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    line = "".join(f" {w}" for w in words) + (" " if words else "")
    found = []
    for n, (label, priority, _, pattern) in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<= ){pattern}(?= )", line):
            first = line[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" ") + 1, n, priority, label))
    standing = [
        d for d in found if not any(
            e[0] <= d[0] and e[1] >= d[1] and (e[3] > d[3] or (e[3] == d[3] and (
                e[1] - e[0] > d[1] - d[0] or (e[1] - e[0] == d[1] - d[0] and e[2] < d[2])))) for e in found)
    ]
    starts = [i for i, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})),
        ",".join(sorted({b for _, b in base} | {d[4] for d in standing})), max((d[3] for d in standing), default=0) / 9,
    )


def test_licenses_match_brute_force(make):
    texts = [
        "Licensed under CC BY-NC-SA 4.0; see https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc by cc by\ncc\tby",
        "the GNU General Public License, version 3 or (at your option) any later version", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License",
        "mitlicense gnu-general-public-license-x", "Apache License" + " é" * 5 + " APACHE LICENSE", "All rights reserved. 3-clause BSD license",
        "İ K mit license", "", None, " \t", "Eclipse Public License v 2.0, Mozilla Public License 2.0", "copyleft " * 40,
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ] + [f"x {keyword} {re.sub('[^a-z0-9 ]+', '', pattern)} y" for _, _, keyword, pattern in licenses.rules()]
    rows = list(enumerate(texts))
    got = {r.doc_id: tuple(r)[1:] for r in licenses.detect(make(rows)).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(brute_licenses(t)) if isinstance(got[i], float) else got[i] == brute_licenses(t), t


def test_every_rule_passes_gate_and_keyword():
    gate = re.compile(licenses.GATE)
    for label, _, keyword, pattern in licenses.rules():
        sample = re.sub(r"\.\{1,80\}\?", "abc", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", pattern)))
        sample = re.sub(r"\[(.)[^]]*\]", r"\1", sample.replace("\\d", "2")).replace("?", "")
        assert re.fullmatch(pattern, sample), (pattern, sample)
        assert gate.search(sample) and keyword in sample, (label, keyword, sample)


def test_licenses_awkward_rows(awkward, make):
    got = licenses.detect(awkward).collect()
    assert len(got) == awkward.count() and {r.n_base for r in got} == {0} and {r.labels for r in got} == {""}
    assert next(r.n_words for r in got if r.doc_id == 4) == 60_000
    assert licenses.detect(make([])).collect() == []
    many = licenses.detect(make([(1, "mit license " * 3000)])).first()
    assert (many.n_base, many.first_word, many.last_word, many.n_words) == (3000, 0, 5998, 6000)


def test_url_parts_and_rules(spark):
    cases = {
        "https://WWW.Example.NET/en/x?q#f": ("www.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, None), "http://example.net/": ("example.net", "/", "net/", "block"),
        "http://xexample.net/en/": ("xexample.net", "/en/", "net/", "block"), "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
        "http://a.example.com/de/1": ("a.example.com", "/de/1", "example.com/de/", "block"), "no scheme": ("", "", None, None),
        "x://h?p/q": ("h", "", None, None), "x://h#p": ("h", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None),
        "://": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "http://É.ORG/fr/é": ("É.org", "/fr/é", "org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate([*cases, "http://example.net/"])], "page_id long, url string, host string, n int")
    empty = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in urls.judge(pages, empty).collect()}
    assert len(got) == len(cases) + 1
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")
    assert urls.judge(pages.limit(0), empty).collect() == []


def test_reputation_blocks_bad_hosts_and_shares_with_siblings(spark):
    rows, marks = [], []
    for h, (bad, good) in {"spam.a.com": (30, 0), "one.a.com": (1, 0), "fine.b.com": (0, 30), "mixed.b.com": (3, 27), "bad.c.co.uk": (20, 0)}.items():
        for k in range(bad + good):
            rows.append((len(rows), f"http://{h}/{k}"))
            marks.append((rows[-1][0], int(k < bad)))
    rows += [(1000, "http://new.b.com/"), (1001, None), (None, "http://fine.b.com/"), (3, "http://spam.a.com/0")]
    marks += [(None, 1), (5000, 1), (40, None), (2, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    verdicts = collections.defaultdict(set)
    for r in urls.judge(pages, spark.createDataFrame(marks, "page_id long, bad int")).collect():
        verdicts[r.host].add(r.verdict)
    assert verdicts["spam.a.com"] == verdicts["bad.c.co.uk"] == {"block"}
    assert verdicts["fine.b.com"] == verdicts["mixed.b.com"] == verdicts["new.b.com"] == verdicts[""] == {"allow"}


def fill(sizes, weights, share, most):
    caps, out, left, open_ = [most * s for s in sizes], [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit >= caps[i]}
        for i in full:
            out[i], left = caps[i], left - caps[i]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        open_ -= full
    return out


def test_mix_meets_targets(documents):
    got = mixing.mix(documents).join(documents.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(got) == documents.count()
    sums = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 <= r.taken <= 2 * r.size
        sums[r.source][0] += r.size
        sums[r.source][1] += r.taken
        sums[r.source][2] = r.target
    names = sorted(sums)
    wanted = fill([sums[n][0] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for n, target in zip(names, wanted, strict=True):
        size, taken, told = sums[n]
        assert told == pytest.approx(target) and abs(taken - target) <= 0.02 * target + 5
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got)


def test_mix_awkward_rows(awkward, make):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    assert {r.size for r in got if r.doc_id in (2, 3, 6)} == {0}
    kept = mixing.mixed_documents(awkward)
    assert kept.columns == [c for c in awkward.columns if c != "Copies"] + ["copies"]
    assert mixing.mix(make([])).collect() == [] and mixing.mixed_documents(make([])).collect() == []
    assert {r.target for r in mixing.mix(make([(1, None), (2, "")])).collect()} == {0.0}


def test_mix_order_of_sources_and_hot_cell(make):
    rows = [(i, "a b c d", "en", s) for i, s in enumerate(["b"] * 3000 + ["a"] * 40 + [None] * 40 + ["é"] * 40 + ["Z"] * 40)]
    got = collections.defaultdict(list)
    for r in mixing.mix(make(rows)).collect():
        got[rows[r.doc_id][3]].append(r)
    sizes = [160, 160, 12_000, 160, 160]
    wanted = fill(sizes, [3, 1, 2, 3, 1], 1.5, 2)
    for name, target in zip(["Z", "a", "b", "é", None], wanted, strict=True):
        assert got[name][0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in got[name]) - target) <= 4


def test_equal_rows_do_not_move_together(make):
    """One row that is repeated often must not be taken or left as a whole where single copies close the gap."""
    rows = [(100 * s + k, " ".join(["w"] * (7 + 13 * k + s)), "en", f"s{s:02}") for s in range(12) for k in range(6)]
    rows += [(100 * s + 50, "two words", "en", f"s{s:02}") for s in range(12) for _ in range(60)]
    found = mixing.mix(make(rows)).join(make(rows).select("doc_id", "source").distinct(), "doc_id")
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 4
