import hashlib
import random

import numpy as np

from recordlens.llm import suffix_dedup


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        if doc is not None:
            for j in range(len(text) - length + 1):
                w = text[j:j + length]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        if doc is not None:
            for j in range(len(text) - length + 1):
                if first[text[j:j + length]] < doc:
                    gone[j:j + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def check(df):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    found = suffix_dedup.repeated_passages(df).collect()
    expected = brute(rows)
    assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(
        [e[:5] for e in expected], key=str)
    return expected


def test_table(docs):
    check(docs)


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_random_overlaps_and_a_hot_passage(spark):
    """Texts over few letters share runs of every length; one passage is in every third."""
    draw = random.Random(3)
    hot = "".join(draw.choices("abcdefgh", k=160))
    rows = []
    for i in range(240):
        parts = ["".join(draw.choices("ab" if i % 2 else "abcd", k=draw.randint(0, 90)))]
        if i % 3 == 0:
            a = draw.randint(0, 80)
            parts.append(hot[a:a + draw.randint(45, 80)])
        if rows and i % 5 == 0:
            other = draw.choice(rows)[1]
            a = draw.randint(0, len(other))
            parts.append(other[a:a + draw.randint(40, 120)])
        rows.append((draw.randint(-50, 400), "".join(parts)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_cut_documents(docs, odd_docs, no_docs):
    for df in (docs.select("doc_id", "text", "lang", "n_chars"), odd_docs):
        found = suffix_dedup.cut_repeated(df)
        assert found.columns == df.columns
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        kept = [(e[0], e[5].decode(errors="ignore")) for e in brute(rows)
                if e[2] == 0 or e[5].decode(errors="ignore")]
        assert sorted([(r.doc_id, r.text or "") for r in found.collect()], key=str) == sorted(
            kept, key=str)
    assert suffix_dedup.cut_repeated(no_docs).count() == 0
    assert suffix_dedup.repeated_passages(no_docs).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, n, 500) for n in (9, 5, 3)]
    order, agree = suffix_dedup.multikey_order(columns)
    rows = list(zip(*(c[order].tolist() for c in columns)))
    assert rows == sorted(rows)
    for i in range(1, 500):
        same = next((d for d in range(3) if rows[i][d] != rows[i - 1][d]), 3)
        assert agree[i] == same


def test_blocks_are_seamless(monkeypatch):
    """Splitting a text into blocks changes segments, but not what they cover."""
    text = bytes(random.Random(5).choices(b"abcdefghij", k=5000))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    number, place, *_ = suffix_dedup.suffixes([text, b"x" * 30, text[:80]], 50)
    for n, size in ((0, 5000), (2, 80)):
        own = place[number == n]
        starts = sorted(p for a, m in zip(own >> 12, own >> 6 & 63) for p in range(a, a + m + 1))
        assert starts == list(range(size - 49))
    assert not (number == 1).any()


def test_segments_that_agree_in_half_of_their_hash(spark):
    """Same anchor, and the same upper 32 bits of the segment hash, but not the same bytes."""
    texts = ["gdnhukplaepknquwsacqxgvperswmfwlrrpjifsfaxjdfymdxy",
             "clyzohiyuwnjrfathbuqxgvperswmfwerwcekhsracdhnworpz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    _, _, _, key, seg, *_ = suffix_dedup.block_segments(data, np.repeat([0, 1], 50), 50)
    assert key[0] == key[1] and seg[0] >> np.uint64(32) == seg[1] >> np.uint64(32)
    rows = [*enumerate(texts), (2, texts[1])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one bucket, with no bound between them
    try:
        found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [e[2] for e in found] == [0, 0, 50]


def test_windows_of_one_quick_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    """With a quick hash that is the same for all windows, the digests still give exact results."""
    monkeypatch.setattr(suffix_dedup, "_quick",
                        lambda text, at, length: np.zeros(len(at), np.int64))
    draw = random.Random(5)
    shared = "".join(draw.choices("abcdefgh", k=70))
    rows = []
    for i in range(40):
        a = draw.randint(0, 25)
        rows.append((i, "".join(draw.choices("abcdefgh", k=40)) + shared[a:a + draw.randint(40, 70)]
                     + "".join(draw.choices("abcdefgh", k=40))))
    expected = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert any(e[2] for e in expected) and any(not e[2] for e in expected)


def kept_tables(monkeypatch):
    """Gathers the tables that a call writes on its way."""
    tables, keep = {}, suffix_dedup.Scratch.keep

    def gather(self, df, name):
        tables[name] = keep(self, df, name)
        return tables[name]

    monkeypatch.setattr(suffix_dedup.Scratch, "keep", gather)
    monkeypatch.setattr(suffix_dedup.Scratch, "remove", lambda *_: None)
    return tables


def overlapping(n):
    draw = random.Random(8)
    shared = ["".join(draw.choices("abcdefgh", k=90)) for _ in range(6)]
    rows = []
    for i in range(n):
        a, b = draw.randint(0, 30), draw.randint(40, 60)
        rows.append((i, "".join(draw.choices("ijklmnop", k=60)) + draw.choice(shared)[a:a + b]
                     + "".join(draw.choices("ijklmnop", k=60))))
    return rows


def test_an_anchor_of_very_many_documents_opens_few_windows(spark, monkeypatch):
    """Documents have an anchor in common but nothing around it: their windows stay closed."""
    draw = random.Random(11)
    grams = np.frombuffer("".join(draw.choices("abcdefgh", k=20_012)).encode(), np.uint8)
    _, _, anchor, key, *_ = suffix_dedup.block_segments(grams, np.zeros(len(grams), int), 50)
    a = anchor[np.argmin(key)]
    gram = grams[a:a + suffix_dedup.GRAM].tobytes().decode()
    rows = [(i, "".join(draw.choices("abcdefgh", k=60)) + gram
             + "".join(draw.choices("abcdefgh", k=60))) for i in range(5000)]
    tables = kept_tables(monkeypatch)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = suffix_dedup.repeated_passages(
            spark.createDataFrame(rows, "doc_id long, text string"))
        assert found.where("n_removed > 0").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    opened = tables["ranges"].where(f"kind = {suffix_dedup.OPEN}") \
        .selectExpr("coalesce(sum(last - first + 1), 0)").first()[0]
    assert opened < 5000 * 39 * 0.02  # of the windows that hold the anchor


def test_windows_that_follow_each_other_are_one_row(spark, monkeypatch):
    tables = kept_tables(monkeypatch)
    expected = check(spark.createDataFrame(overlapping(300), "doc_id long, text string"))
    windows = sum(n - 49 * spans for _, _, n, spans, *_ in expected)
    held = sum(t.count() for name, t in tables.items() if name.startswith("alike"))
    assert windows > 500 and held < windows


def test_windows_go_in_passes(spark, monkeypatch):
    """With little room for hashes, they are compared in several passes, with the same results."""
    monkeypatch.setattr(suffix_dedup, "PASS_SHARE", 0)
    monkeypatch.setattr(suffix_dedup, "PASS_BYTES", 2_000)
    tables = kept_tables(monkeypatch)
    check(spark.createDataFrame(overlapping(300), "doc_id long, text string").repartition(3))
    for name in ("alike", "repeated"):
        assert sum(t.startswith(name) for t in tables) > 1


def test_an_anchor_of_more_suffixes_than_a_bucket(spark):
    """Bounds cut the anchor; the windows on both sides are still compared."""
    draw = random.Random(4)
    passage = "".join(draw.choices("abcdefgh", k=52))
    rows = [(i, "".join(draw.choices("abcdefgh", k=draw.randint(0, 3))) + passage[i % 3:]
             + "".join(draw.choices("abcdefgh", k=draw.randint(0, 3)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = suffix_dedup.splitters(
        df.selectExpr("doc_id", "0 AS version", "cast(text AS binary) AS text"), 50, 8, len(rows))
    assert len(suffix_dedup._cut_keys(bounds))
    check(df)


def test_packed_integers():
    for values in ([5], [0, 0], [-3, 300, 7], [1 << 40, 3], [-(1 << 63), (1 << 63) - 1]):
        assert suffix_dedup._wide(suffix_dedup._thin(np.array(values))).tolist() == values
    keys = np.array([1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (suffix_dedup._keys(suffix_dedup._short_keys(keys)) == keys >> np.uint64(24)).all()
