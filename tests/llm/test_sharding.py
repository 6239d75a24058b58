import zlib
from math import isqrt

from recordlens.llm import sharding


def plain_walk(x, rows, side, seed):
    while True:
        left, right = divmod(x, side)
        for a, b in sharding.round_keys(seed):
            t = (right * a + b) % sharding.PRIME
            t = (t * t + b) % sharding.PRIME
            left, right = right, (left + t * t % sharding.PRIME) % side
        x = left * side + right
        if x < rows:
            return x


def test_places_against_plain_python(docs):
    rows = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32(r.text.encode()))
                  for r in docs.collect())
    side = isqrt(len(rows) - 1) + 1
    expected = []
    for n, row in enumerate(rows):
        place = plain_walk(n, len(rows), side, 7)
        expected.append((*row, "rows", place % 40, place // 40, None))
    for df in (docs, docs.repartition(5)):
        assert sorted(tuple(r) for r in sharding.shard(df).collect()) == expected


def test_counts_slots_and_odd_rows(odd_docs, no_docs):
    found = sharding.shard(odd_docs, shards=5).collect()
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(found) == odd_docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id in (3, 4)} == {
        (3, 16, 0), (4, 16, 0)}
    assert sharding.shard(no_docs).count() == 0


def test_only_built_in_functions(docs):
    plan = sharding.shard(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
