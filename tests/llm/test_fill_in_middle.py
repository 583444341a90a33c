"""Fill-in-middle against a plain version, the automaton's composition against single steps."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.automaton import Automaton, Tree, compose, prefixes
from tidemark.llm.fill_in_middle import MARKS, fill_in_middle, restored


def plain(doc_id, text, marks=MARKS, plain_from=90, spm_below=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    one, two = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    if not text or any(m in text for m in marks) or c % 100 >= plain_from:
        return (doc_id, len(text), "plain", None, None, text)
    pre, mid, suf, (p, s, m) = text[:one], text[one:two], text[two:], marks
    if d % 100 < spm_below:
        return (doc_id, len(text), "spm", one, two - one, s + suf + p + pre + m + mid)
    return (doc_id, len(text), "psm", one, two - one, p + pre + s + suf + m + mid)


def texts(seed, n, letters="ab<PSM>éß€\U0001f600 ", longest=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1 << 16, 7, 300])
def test_fill_in_middle(spark, chunk):
    rows = list(enumerate(texts(chunk, 80))) + list(enumerate(texts(1, 60, "abé\U0001f600<P>"), 100)) + [(200 + i, "<" * i + "P") for i in range(9)]
    rows += [(None, "no id €"), (None, None), (300, None), (301, ""), (302, "twice"), (302, "twice"), (302, "other"), (303, "\U0001f600" * 40_000), (303, "\U0001f600" * 40_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, `a.key` string").repartition(3)
    got = fill_in_middle(docs, chunk=chunk).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted((plain(i, t) for i, t in rows), key=key)
    assert sorted((r.doc_id or -1, r.back) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0), chunk=chunk).count() == 0


def test_other_marks(spark):
    marks = ("<|aa|>", "<|ab|>", "€€")
    rows = list(enumerate(texts(5, 200, "<|ab>€", 30)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle(docs, marks=marks, plain_from=100, spm_below=50, chunk=11).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [plain(i, t, marks, 100, 50) for i, t in rows]


def test_functions_compose():
    machine = Automaton(MARKS)
    data = np.frombuffer("".join(texts(2, 20)).encode() + b"\xff\x80\xe2\x82<\x80P>", np.uint8)

    def steps(state, some):
        n = 0
        for byte in some:
            to = int(machine.steps[state * machine.width + int(byte)])
            state, n = (to >> 1) // machine.width, n + (to & 1)
        return state, n

    for cut in (0, 1, 130, 131, len(data) - 3, len(data)):
        parts = [data[:cut], data[cut:]]
        ends, counts = Tree(machine, data, np.array([cut, len(data) - cut])).whole
        for s in range(machine.size):
            for k in (0, 1):
                assert (ends[k, s], counts[k, s]) == steps(s, parts[k])
        both = compose((ends[:1], counts[:1]), (ends[1:], counts[1:]))
        assert [(int(e), int(c)) for e, c in zip(both[0][0], both[1][0])] == [steps(s, data) for s in range(machine.size)]
    sizes = np.diff([0, 1, 5, 200, 201, 700, len(data)])
    ends, counts = prefixes(*Tree(machine, data, sizes).whole)
    for k, upto in enumerate(np.cumsum(sizes)):
        assert (ends[k, 0], counts[k, 0]) == steps(0, data[:upto])
