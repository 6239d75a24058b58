import math
import random
import re
from collections import Counter

import numpy as np

from recordlens.llm import lexical_search as S

SMALL = {"pass_bytes": 400, "block_docs": 7, "tile_items": 3, "tile_terms": 4}


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    by_id = {}
    for item, text in set(items):
        by_id.setdefault(item, []).append(text or "")
    for item, texts in by_id.items():
        asked = terms("\n".join(sorted(set(texts))))
        scored = []
        for doc, c in counted:
            lean = 100 - 25 + 25 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 12 * lean)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=20, parts=3, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((tuple(r) for r in S.rank(df, asked, k, **options).collect()), key=str)
    assert found == brute(docs, items, k)
    return found


def some(seed, n, most):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "ÉTÉ", "中文", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, "".join(w + pick.choice([" ", ", ", "-", "_", "\x7f", "\n"])
                        for w in pick.choices(vocabulary, weights, k=pick.randint(0, most))))
            for i in range(n)]


def test_against_brute_force(spark):
    docs, items = some(1, 300, 50), some(2, 25, 15)
    assert check(spark, docs, items)
    check(spark, docs, items, k=3, **SMALL)
    check(spark, docs, items, k=1, parts=1, **SMALL)


def test_ties_nulls_and_repeats(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)]
    docs += [(None, "same words here"), (7, "same words here"), (7, "same"), (90, None), (91, ""),
             (92, "... !"), (93, "word " * 40_000), (94, "SAME sAmE Words")]
    items = [(1, "same words"), (1, "same words"), (1, "words here"), (2, None), (3, "unknown"),
             (None, "here"), (4, "same same same"), (5, "word")]
    check(spark, docs, items)
    check(spark, docs, items, k=60, **SMALL)
    check(spark, docs, items, k=5, parts=7, **SMALL)


def test_clashing_columns_and_empty_tables(spark, odd_docs, no_docs):
    items = odd_docs.selectExpr("doc_id AS item_id", "text", "'x' AS score", "1 AS rank")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = sorted((tuple(r) for r in S.rank(odd_docs, items).collect()), key=str)
    wanted = brute(rows, rows, 20)
    assert found == wanted
    assert S.rank(no_docs, items).count() == 0 == S.rank(odd_docs, items.limit(0)).count()


def test_sums_stay_exact():
    times = np.array([1, 2, 5 * 10**7, 3])
    items = S.Items([1, 2], None, np.array([0, 1, 1, 1]), np.array([0, 0, 1, 2]), times)
    weights = np.array([20_000, 400, 17])
    made = list(S.tiles(items, weights, tile_terms=2))
    whole = np.zeros((3, 2), np.int64)
    for tile in made:
        assert (tile.weights.sum(0) * S.MOST_IMPACT < 2**53).all()
        whole[tile.terms] += tile.weights.astype(np.int64)
    assert whole.tolist() == [[20_000, 40_000], [0, 400 * 5 * 10**7], [0, 51]]
    assert [t.last for t in made] == [False] * (len(made) - 1) + [True] and len(made) > 2
    assert S.impacts(np.array([1, 10**6]), np.array([0, 10**6]), 1, 10**9).max() < S.MOST_IMPACT
