import random
import re
from collections import Counter

import pytest

from recordlens.llm import collocations as C
from recordlens.llm.scratch import Scratch

SMALL = {"block_bytes": 200, "bucket_bytes": 300}


def lists(rows):
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            yield lang or "und" if lang is None else lang, re.findall(r"[^\x20\x09]+", piece)


def brute(rows, longest=3, shortest=2, least=10, share=50, top=None):
    f, n = Counter(), Counter()
    for lang, words in lists(rows):
        n[lang] += len(words)
        for m in range(1, longest + 1):
            f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    kept = {k: a for k, a in f.items() if shortest <= len(k[1]) and a >= least}

    def inside(p, q):
        return any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))

    found = {}
    for (lang, p), a in kept.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= share * a and inside(p, q)
               for (g, q), b in kept.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((score, a, " ".join(p), left, right))
    out = []
    for lang, rows_ in found.items():
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, x, y, n[lang], s)
                for i, (s, a, p, x, y) in enumerate(rows_[:top], 1)]
    return sorted(out)


def check(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    asked = {k: v for k, v in options.items() if k not in ("fan_out", *SMALL)}
    found = sorted(tuple(r) for r in C.collocations(df, **{**SMALL, **options}).collect())
    assert found == brute(rows, **asked)
    return found


def some_texts(seed, n, words, marks=" , . \n"):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ä", "é", "X'y"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for _ in range(n):
        text = "".join(w + pick.choice([" "] * 8 + [" \t", ", ", ".", "\n", "! "])
                       for w in pick.choices(vocabulary, weights, k=pick.randint(0, 60)))
        out.append((pick.choice(["en", "en", "de", None, ""]), text))
    return out


def test_against_brute_force(spark):
    rows = some_texts(1, 120, 40)
    rows += [("en", "The quick brown fox jumps over the lazy dog. One fox jumps high")] * 15
    rows += [("en", "a b c d e f g h i j k l m n o p q r s t u v")] * 11
    assert check(spark, rows)
    check(spark, rows, top=5)
    check(spark, rows, least=3, share=80, fan_out=2)


@pytest.mark.parametrize("longest, shortest", [(2, 2), (4, 2), (4, 3), (5, 4)])
def test_other_lengths(spark, longest, shortest):
    rows = some_texts(longest, 40, 12) + [("en", "p q r s t u v. x q r s t")] * 12
    check(spark, rows, longest=longest, shortest=shortest, least=4)


def test_repeats_ties_and_hot_words(spark):
    rows = [("en", "x " * 3000), ("en", "a a a a a"), ("en", "a b a b a b"), ("de", "b c. c b")] * 10
    rows += [("en", None), ("en", ""), (None, "k k"), ("en", " ., ")]
    assert check(spark, rows)


def test_odd_tables(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    found = sorted(tuple(r) for r in C.collocations(odd_docs, least=2, **SMALL).collect())
    assert found == brute(rows, least=2)
    assert C.collocations(no_docs).count() == 0


def test_paths_hold_all_edges_once(spark):
    rows = [("en", "a b c d e f g h i j k l m n o. k l m x")] * 4 + [("en", "z a b c")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    scratch = Scratch(spark, "paths")
    counted = C.counts(df, 3, 1, scratch)
    whole, inside = C.paths(counted, 3, scratch)
    found = sorted((" ".join(r.path), r.f) for r in whole.collect())
    assert ("a b c", 7) in found and ("b c d e f g h i j k l", 4) in found  # k l m occurs 8 times
    edges = Counter()
    for path, f in found:
        words = path.split()
        edges.update({" ".join(words[i:i + 3]): f for i in range(len(words) - 2)})
    assert edges == {r.phrase: r.f for r in counted.where("words = 3").collect()}
    assert inside.where("node = 'd e'").count() == 1 and inside.where("node = 'b c'").count() == 0


def test_scores_are_exact(spark):
    pairs = [(10**15 - 1, 10**15 - 1, 10**15 - 1), (999_999_999_999_999, 10**15 - 1, 999_999_999_998_999),
             (3, 7, 9), (123_456_789_012_345, 223_456_789_012_345, 987_654_321_098_765)]
    df = spark.createDataFrame(pairs, "a long, l long, r long")
    found = df.selectExpr("a", "l", "r", C._score("a", "l", "r") + " AS score").collect()
    assert [r.score for r in found] == [1_000_000 * a * a // (x * y) for a, x, y in pairs]


def test_bad_parameters(no_docs):
    for options in ({"shortest": 1}, {"shortest": 4}, {"share": 101}, {"least": 0}):
        with pytest.raises(ValueError):
            C.collocations(no_docs, **options)
