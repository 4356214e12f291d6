"""The pipeline's stages against brute force on the same documents."""

import corpus_pipeline
from courtline.llm import decontaminate, language, suffixes
from tests_llm_brute import fingerprint, groups, joined, matched_words


def test_stages_match_brute_force(spark, small, documents):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "repeated_passages", "benchmark_leaks", "mix"]
    rows = {r.doc_id: r for r in documents.collect()}
    network = language.fit(documents)

    def speaks(text):
        found = language.windows_of(language.lowered(text))
        used = (found != 0).sum(axis=1)
        return any(c.isalpha() for c in text) and ((network.probabilities(found) * used[:, None]).sum(0) / used.sum()).max() >= language.MIN_SCORE

    texts = {i: r.text for i, r in rows.items() if speaks(r.text)}
    docs = stages["language"](spark, documents, small)
    assert {r.doc_id: r.text for r in docs.collect()} == texts and docs.columns == documents.columns

    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    docs = stages["near_copies"](spark, docs, small)
    assert {r.doc_id: r.text for r in docs.collect()} == texts and docs.columns == documents.columns

    spans = {i: joined(w, 16, 50) for i, w in zip(texts, matched_words(list(texts.items()), True), strict=True)}
    texts = {i: suffixes.without_words(t, spans[i]) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if t.split() or not spans[i]}
    docs = stages["repeated_passages"](spark, docs, small)
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(x in decontaminate.normal(t) for x in items)}
    docs = stages["benchmark_leaks"](spark, docs, small)
    assert {r.doc_id: r.text for r in docs.collect()} == texts and docs.columns == documents.columns

    mixed = stages["mix"](spark, docs, small)
    assert mixed.columns == [*documents.columns, "copies"]
    got = {r.doc_id: r for r in mixed.collect()}
    assert set(got) <= set(texts) and {r.copies for r in got.values()} <= {1, 2}
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    assert abs(sum(r.copies * size[i] for i, r in got.items()) - 1.5 * sum(size.values())) <= 0.02 * sum(size.values())


def test_run_is_the_chain_of_stages(spark, small, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_tables(spark, make, small):
    docs = make([], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.collect() == []


def test_awkward_rows(spark, awkward, small):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, small)
    assert docs.columns == [c for c in awkward.columns if c != "Copies"] + ["copies"]
