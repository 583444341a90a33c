"""Near duplicates and components against all pairs."""

import random

from tidemark.llm.components import components
from tidemark.llm.near_duplicates import near_duplicate_groups, without_near_duplicates
from tidemark.llm.shingles import shingle_set, words_of


def _roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    whole = [x for x in links if None not in x and x[0] != x[1]]
    assert got == _roots({n for x in whole for n in x}, whole)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _documents(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows = []
    for _ in range(8):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [rows[0]] * 5 + [rows[0].upper(), "", " \t", "one", "ONE", "two", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


def _check(rows, got, words):
    sets = {d: shingle_set(words_of(t), words) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _roots(sets, links)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id]) for r in got)
    return want


def test_groups(spark):
    for words in (2, 5):
        rows = _documents(words)
        docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, bucket string")
        want = _check(rows, near_duplicate_groups(docs, words=words).collect(), words)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, c in want.items() if d == c}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "q w e r t y")]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
