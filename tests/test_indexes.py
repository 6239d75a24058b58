"""The search index against full scans, and jumps against offsets."""

import pytest
from pyspark.sql import functions as F

from recordlens import (
    browse, diff_records, jump, narrowed, read_dataset, record_filter, write_dataset,
    write_rank_index, write_search_index,
)
from recordlens.operators.search_index import _codes, candidate_blocks, term_slots

TERMS = ["", "a", "é", "zq", "rare-17", "Müller", "100%_x", "_", "%", "日本", "nowhere", "x\x00y",
         '"t":', "rare-1", "common"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Eight files of two sources with a few special words, null payloads and ids."""
    folder = str(tmp_path_factory.mktemp("search") / "diffs")
    word = F.when(F.col("n") % 1000 == 17, F.concat(F.lit("rare-"), F.expr("n div 1000"))) \
        .when(F.col("n") == 2500, "Müller é").when(F.col("n") == 6200, "100%_x 日本") \
        .when(F.col("n") == 7100, "x\x00y").when(F.col("n") == 900, "zq").otherwise("common")
    rows = spark.range(0, 8000, 1, 8).withColumnRenamed("id", "n").select(
        F.when(F.col("n") % 997 != 3, F.format_string("r%05d", "n")).alias("record_id"),
        F.when(F.col("n") < 4000, "s").otherwise("t/u v").alias("source"),
        F.when(F.col("n") % 5 != 1, F.concat(F.lit('{"t":"'), word, F.lit('"}')))
        .cast("binary").alias("record_a"),
        F.when(F.col("n") % 7 != 1, F.lit('{"t":"common"}')).cast("binary").alias("record_b"),
        F.array(F.lit("t")).alias("modified_fields"), F.lit("true").alias("has_diff"))
    write_dataset(rows, folder, ["source"], rebalance=False, cluster_by="record_id")
    return folder


def files_read(df) -> int:
    """Files that the scans of a collected query opened; none where no scan is planned."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in metrics if m.contains("numFiles"))


@pytest.mark.parametrize("rows_per_block", [100, 4096])
def test_same_rows_as_a_full_scan(spark, stored, tmp_path, rows_per_block):
    index = write_search_index(spark, stored, str(tmp_path / "index"), rows_per_block)
    records = read_dataset(spark, stored)
    for term in TERMS:
        condition = record_filter(term)
        found = narrowed(records, index, stored, term).filter(condition)
        assert sorted(map(str, found.collect())) == sorted(
            map(str, records.filter(condition).collect())), term


def test_files_without_the_term_are_not_opened(spark, stored, tmp_path):
    index = write_search_index(spark, stored, str(tmp_path / "index"), 200)
    records = read_dataset(spark, stored)
    everything = records.filter(record_filter("rare-2"))
    assert everything.count() == 1
    everything.collect()
    assert files_read(everything) == 8
    for term, files in (("rare-2", 1), ("Müller", 1), ("zq", 1), ("nowhere", 0)):
        found = narrowed(records, index, stored, term).filter(record_filter(term))
        found.collect()
        assert files_read(found) == files, term


def test_index_moves_with_its_dataset(spark, stored, tmp_path):
    import shutil

    index = write_search_index(spark, stored, str(tmp_path / "index"))
    moved = str(tmp_path / "elsewhere" / "diffs")
    shutil.copytree(stored, moved)
    found = narrowed(read_dataset(spark, moved), index, moved, "Müller")
    assert found.filter(record_filter("Müller")).count() == 1


def test_grams():
    import numpy as np

    data = np.frombuffer(b"abcd", np.uint8)
    assert [len(_codes(data, n)) for n in (1, 2, 3)] == [4, 3, 2]
    assert len(_codes(data[:1], 3)) == 0
    assert term_slots("") == [] and len(term_slots("a")) == len(term_slots("é")) == 1
    assert len(term_slots("abcabcabc")) == 3


def test_no_records_and_only_null_payloads(spark, tmp_path):
    schema = "record_id string, source string, record_a binary, record_b binary"
    empty, nulls = str(tmp_path / "empty"), str(tmp_path / "nulls")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(empty)
    assert write_search_index(spark, empty, str(tmp_path / "i1")).count() == 0
    spark.createDataFrame([(None, None, None, None), ("a", "s", None, bytearray())], schema) \
        .coalesce(1).write.parquet(nulls)
    index = write_search_index(spark, nulls, str(tmp_path / "i2"))
    assert candidate_blocks(index, "").count() == 1
    assert candidate_blocks(index, "a").count() == 0


def test_ids_that_are_numbers(spark, tmp_path):
    folder = str(tmp_path / "numbers")
    spark.range(0, 300, 1, 3).selectExpr(
        "id AS record_id", "cast(concat('word', id) AS binary) AS record_a",
        "cast(null AS binary) AS record_b").write.parquet(folder)
    index = write_search_index(spark, folder, str(tmp_path / "index"), 20)
    for term, n in (("word9", 11), ("word107", 1), ("word", 300)):
        found = narrowed(spark.read.parquet(folder), index, folder, term)
        assert found.filter(record_filter(term)).count() == n


@pytest.fixture(scope="module")
def many(spark):
    """Few sources, lists of fields with nulls, ids with nulls and whole rows repeated."""
    return spark.range(0, 5000, 1, 6).select(
        F.when(F.col("id") % 50 != 0, F.format_string("r%04d", F.col("id") * 7 % 5000))
        .alias("record_id"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("s"), F.expr("least(id % 9, 2)")))
        .alias("source"),
        F.when(F.col("id") % 3 == 0, "true").otherwise("false").alias("has_diff"),
        F.when(F.col("id") % 13 != 0, F.expr("slice(array('c','a','b'), 1, int(id % 4))"))
        .alias("modified_fields"))


@pytest.mark.parametrize("column", [0, 1, 2, 3])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_as_by_offset(spark, many, tmp_path, column, direction):
    path = str(tmp_path / "rank")
    write_rank_index(many, path, column, direction, rows_per_range=600)
    sizes = spark.read.parquet(f"{path}/sizes").collect()
    assert sum(r.n for r in sizes) == 5000 and max(r.n for r in sizes) < 1500
    pages = [dict(start=s, length=n) for s, n in ((0, 10), (595, 40), (2400, 700), (4990, 50),
                                                   (5000, 10), (9000, 5), (7, 0))]
    pages += [dict(start=s, length=60, sources=["s1", "s2"], fields=["a"]) for s in (0, 1500)]
    for page in pages:
        expected = browse(many, order_column=column, direction=direction, **page).collect()
        found = jump(spark, path, column, direction, **page).collect()
        # rows without an id share the last place of their value
        key = lambda r: (r.source, r.has_diff, r.modified_fields) if column else r.record_id
        if all(r.record_id for r in expected + found):
            assert found == expected, page
        else:
            assert len(found) == len(expected), page
            assert [r.record_id for r in found] == [r.record_id for r in expected]
            if column:
                value = ["", "source", "has_diff", "modified_fields"][column]
                assert [r[value] for r in found] == [r[value] for r in expected]
            assert key(found[0]) is not None or column == 0


def test_a_jump_reads_the_ranges_of_its_page(spark, many, tmp_path):
    path = str(tmp_path / "rank")
    write_rank_index(many, path, rows_per_range=500)
    page = jump(spark, path, start=2000, length=10)
    page.collect()
    assert files_read(page) <= 2


def test_jump_in_nothing(spark, many, tmp_path):
    write_rank_index(many.limit(0), str(tmp_path / "rank"))
    assert jump(spark, str(tmp_path / "rank")).collect() == []
