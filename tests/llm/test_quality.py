import collections
import random

import numpy as np

from recordlens.llm import quality
from tests.llm.conftest import SF


def plain(text, min_words=10):
    text = text or ""
    words = text.encode().split()
    n = len(words)
    seen = collections.Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    again = [False] * n
    for i in range(n - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            again[i:i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if x.encode().split()]
    longest = longest_runs(words)
    covered = [any(longest[i] >= min_words and i <= j < i + longest[i] for i in range(j + 1))
               for j in range(n)] if n < 400 else None
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), sum(again), max(longest, default=0),
            None if covered is None else sum(covered) / n if n else 0.0)


def longest_runs(words):
    """By dynamic programming over pairs of places."""
    n = len(words)
    ids = np.array([{w: i for i, w in enumerate(words)}[w] for w in words])
    below, out = np.zeros(n + 1, int), [0] * n
    for i in range(n - 1, -1, -1):
        row = np.where(np.arange(n) == i, 0, np.where(ids == ids[i], below[1:] + 1, 0))
        full = np.where(ids == ids[i], below[1:] + 1, 0)
        out[i] = int(row.max(initial=0))
        below = np.r_[full, 0]
    return out


def test_counts_and_repeats_against_plain_python(docs, odd_docs):
    for df in (docs.where("n_chars < 6000"), odd_docs.where("text IS NULL OR length(text) < 9999")):
        found = sorted(quality.repetition(df).collect(), key=str)
        expected = {}
        for r in df.collect():
            expected.setdefault(r.doc_id, []).append(plain(r.text))
        for r in found:
            own = [e for e in expected[r.doc_id] if e[:6] == (
                r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.longest_repeat)]
            assert own, (r, expected[r.doc_id])
            assert own[0][6] is None or abs(own[0][6] - r.covered_fraction) < 1e-9
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_verdicts(spark):
    draw = random.Random(2)
    fresh = [f"w{i}" for i in range(3000)]
    passage = " ".join(fresh[:120])
    long_twice = f"{passage} {' '.join(fresh[200:900])} {passage}"
    short_often = " ".join(f"{' '.join(fresh[i:i + 14])} {' '.join(fresh[i:i + 14])}"
                           for i in range(0, 300, 30)) + " " + " ".join(fresh[1000:1330])
    clean = " ".join(draw.sample(fresh, 500))
    rows = spark.createDataFrame(
        [(1, long_twice), (2, short_often), (3, clean), (4, "short"), (5, "x " * 500)],
        "doc_id long, text string")
    found = {r.doc_id: r for r in quality.repetition(rows).collect()}
    assert {i: (r.base_failed, r.kept) for i, r in found.items()} == {
        1: (False, False), 2: (False, False), 3: (False, True), 4: (True, False),
        5: (True, False)}
    assert found[1].longest_repeat == 120
    assert [tuple(s) for s in found[1].spans] == [(0, 120), (820, 940)]


def test_clean_labelled_documents_stay(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.repetition(docs).join(labels.where("quality = 1"), "doc_id").collect()
    assert all(r.kept for r in good if not r.base_failed)


def test_no_documents(no_docs):
    assert quality.repetition(no_docs).count() == 0
