import numpy as np

from recordlens.llm import toxicity

SF = "/root/testdata/sf0.1"
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels.where("doc_id % 3 > 0"), CATEGORIES)
    assert [len(v) for v in chain.earlier] == [0, 1]
    rows = toxicity.classify(docs, chain).join(
        labels.where("doc_id % 3 = 0").withColumnsRenamed({"toxic": "label"}), "doc_id").collect()
    hits = sum(r.toxic for r in rows if r.label)
    assert hits >= 0.8 * sum(r.label for r in rows)
    assert sum(r.toxic for r in rows if not r.label) <= 0.02 * len(rows)
    assert sum(r.toxic == bool(r.label) for r in rows) >= 0.96 * len(rows)


def test_bound_on_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels, CATEGORIES, max_labelled=60)
    assert toxicity.classify(docs, chain).count() == docs.count()


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    features = [np.unique(rng.integers(0, 50, 5)).astype(np.int32) for _ in range(400)]
    earlier = rng.random((400, 1))
    label = (earlier[:, 0] > 0.5).astype(float)
    w, v, b = toxicity.fit(features, earlier, label)
    p = toxicity.predict(features, earlier, w, v, b)
    assert v[0] > 0 and ((p > 0.5) == (label > 0)).mean() > 0.9


def test_odd_rows_and_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, 1), (None, 0, 0), (6, 1, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(odd_docs, labels, CATEGORIES)
    found = toxicity.classify(odd_docs, chain)
    assert found.columns == ["doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic"]
    assert found.count() == odd_docs.count()
    assert all(0 <= r.p_toxic <= 1 for r in found.collect())
    assert toxicity.classify(no_docs, chain).count() == 0
    none = toxicity.fit_chain(no_docs, labels.limit(0), CATEGORIES)
    assert not any(r.toxic for r in toxicity.classify(odd_docs, none).collect())


def test_threshold_separates():
    p, label = np.array([0.9, 0.8, 0.3, 0.2]), np.array([1.0, 1, 0, 0])
    assert 0.3 < toxicity.best_threshold(p, label) < 0.8
