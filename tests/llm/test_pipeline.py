import corpus_pipeline as cp
from recordlens.llm import simhash
from tests.llm.conftest import SF
from tests.llm.test_packing import expected_pieces, key
from tests.llm.test_simhash import brute_components, plain_fingerprint
from tests.llm.test_suffix_dedup import brute

NAMES = ["language_id", "simhash_near_dedup", "repeated_passages", "decontamination", "packing"]


def test_stages_against_brute_force(spark, docs, tmp_path):
    assert [name for name, _ in cp.STAGES] == NAMES
    tables = [docs]
    for name, stage in cp.STAGES:
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for df in tables[1:-1]:
        assert df.dtypes == docs.dtypes
    first, known, unlike, cut, clean, packed = ([*df.collect()] for df in tables)
    assert len(known) == len(first)  # all are in a known language

    prints = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in known]
    assert sorted(r.doc_id for r in unlike) == sorted(
        {c for _, _, c in brute_components(prints, 3)})

    kept = {e[0]: e[5].decode(errors="ignore")
            for e in brute([(r.doc_id, r.text.encode()) for r in unlike])}
    assert {r.doc_id: r.text for r in cut} == {i: t for i, t in kept.items() if t}
    assert all(r.n_chars == len(r.text) for r in cut)

    leaked = {r.doc_id for r in cp.decontaminate.contaminated(
        tables[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked and {r.doc_id for r in clean} == {r.doc_id for r in cut} - leaked

    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed]
    assert sorted(found, key=key) == sorted(
        expected_pieces([(r.doc_id, r.text) for r in clean], 4096), key=key)


def test_run_is_the_stages_in_a_row(spark):
    assert {"sequence_id", "offset", "doc_id"} <= set(cp.run(spark, SF).columns)


def test_odd_documents(spark, odd_docs):
    df = odd_docs
    for name, stage in cp.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == odd_docs.columns
    assert simhash.deduplicate(odd_docs.limit(0)).count() == 0
