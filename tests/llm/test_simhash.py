import numpy as np
import pytest
import xxhash

from recordlens.llm import queries, simhash
from tests.llm.conftest import SF


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    """prints: (doc, fingerprint) pairs; the least doc reachable, per row."""
    values = sorted({f for _, f in prints})
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    at, least = {f: i for i, f in enumerate(values)}, {}
    for doc, f in prints:
        if doc is not None:
            r = root(at[f])
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f, least.get(root(at[f]))) for doc, f in prints]


def check(df, width):
    found = simhash.near_components(df, width, 3).collect()
    prints = [(r.doc_id, plain_fingerprint(r.text, width)) for r in df.collect()]
    assert sorted([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found], key=str) \
        == sorted(brute_components(prints, 3), key=str)


def test_query_against_brute_force(spark, docs):
    found = queries.op6_simhash_components(spark, SF).collect()
    prints = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in docs.collect()]
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found) == sorted(
        brute_components(prints, 3))
    assert all(len(r.fingerprint) == 16 for r in found)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 3)
    check(odd_docs, 5)
    assert simhash.near_components(no_docs).count() == 0
    assert simhash.deduplicate(odd_docs).columns == odd_docs.columns


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_chains_and_dense_groups(spark, tmp_path, distance):
    """A chain of steps, a dense cloud larger than a short run, and single values."""
    from recordlens.llm.components import components
    from recordlens.llm.scratch import Scratch

    rng, values = np.random.default_rng(distance), set()
    chain = 0x0123456789ABCDEF
    for step in range(40):
        values.add(chain)
        for b in rng.choice(64, distance, replace=False):
            chain ^= 1 << int(b)
    values |= {(0xFFFF0000FFFF0000 ^ (1 << int(a)) ^ (1 << int(b)))
               for a, b in rng.integers(0, 64, (300, 2))}
    values |= {int(v) for v in rng.integers(0, 1 << 63, 300)}
    rows = [(v - (1 << 64) if v >> 63 else v, 7 * i) for i, v in enumerate(sorted(values))]
    prints = spark.createDataFrame(rows, "fp long, rep long")
    n, both = simhash.bit_statistics(prints)
    chosen = simhash.plan(n, both, distance)
    assert sum(t + 1 for _, t in chosen) == distance + 1
    edges = simhash.links(simhash.probes(prints, chosen), distance)
    assert all(r.parent < r.child for r in edges.collect())
    roots = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    expected = brute_components([(r, f & (1 << 64) - 1) for f, r in rows], distance)
    assert {d: roots.get(d, d) for d, _, _ in expected} == {d: c for d, _, c in expected}


def test_unequal_thresholds_are_complete(spark):
    """Two groups with threshold 1 find what four with threshold 0 find."""
    rng = np.random.default_rng(9)
    base = [int(v) for v in rng.integers(0, 1 << 62, 60)]
    values = {v ^ sum(1 << int(b) for b in set(rng.integers(0, 62, k))) for v in base
              for k in range(4)} | set(base)
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(sorted(values))],
                                   "fp long, rep long")
    halves = [(list(range(32)), 1), (list(range(32, 64)), 1)]
    quarters = [(list(range(i, i + 16)), 0) for i in range(0, 64, 16)]
    found = []
    for chosen in (halves, quarters):
        edges = simhash.links(simhash.probes(prints, chosen), 3)
        found.append({n for r in edges.collect() for n in r})
    assert found[0] == found[1]
