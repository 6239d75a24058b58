import json

import pytest
from pyspark.sql import functions as F

from recordlens import (
    browse, browse_counts, diff_records, record_filter, record_payloads, record_summary,
)


@pytest.fixture(scope="module")
def golden(spark):
    """1,278 changed records: 892 with changed dates, 386 with three changed fields."""
    rows = spark.range(1278).select(
        F.format_string("r%04d", "id").alias("record_id"),
        F.when(F.col("id") < 892, "researchdatabases").otherwise("libguides").alias("source"),
        F.lit('{"dates": 1, "publishers": 1, "publication_information": 1}').alias("record_a"),
        F.when(F.col("id") < 892, '{"dates": 2, "publishers": 1, "publication_information": 1}')
        .otherwise('{"dates": 2, "publishers": 2, "publication_information": 2}')
        .alias("record_b"))
    return diff_records(rows).cache()


@pytest.fixture(scope="module")
def odd(make_collated):
    return diff_records(make_collated([
        ("1", "s", {"t": "50% off_x", "b": 1, "a": 2}, {"t": "50% off_x", "b": 1}),
        ("2", "s", {"t": "50 percent"}, None),
        ("3", None, None, {"z": 1, "t": "Müller"}),
    ])).cache()


@pytest.mark.parametrize("sources,expected", [
    (None, 1278), (["libguides"], 386), (["researchdatabases"], 892),
    (["libguides", "researchdatabases"], 1278), (["unknown"], 0)])
def test_source_filter(golden, sources, expected):
    counts = browse_counts(golden, sources=sources).first()
    assert (counts.records_total, counts.records_filtered) == (1278, expected)


@pytest.mark.parametrize("fields,expected", [
    (["dates"], 1278), (["publishers"], 386), (["unknown"], 0), (["publishers", "dates"], 1278)])
def test_field_filter(golden, fields, expected):
    assert browse_counts(golden, fields=fields).first().records_filtered == expected


def test_filters_combine(golden):
    found = golden.filter(record_filter('"dates": 2', ["libguides"], ["publishers"]))
    assert found.count() == 386


def test_page_and_order(golden):
    page = browse(golden, sources=["libguides"], start=2, length=3)
    assert [r.record_id for r in page.collect()] == ["r0894", "r0895", "r0896"]
    page = browse(golden, order_column=3, length=2).collect()
    assert [(r.record_id, r.modified_fields) for r in page] == [
        ("r0892", "[dates, publication_information, publishers]"),
        ("r0893", "[dates, publication_information, publishers]")]
    assert browse(golden).count() == 10
    plan = browse(golden, order_column=1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_nulls_sort_last_both_ways(odd):
    for direction in ("asc", "desc"):
        page = browse(odd, order_column=1, direction=direction).collect()
        assert page[-1].source is None


@pytest.mark.parametrize("search,expected", [
    ("50%", ["1"]), ("off_x", ["1"]), ("50", ["1", "2"]), ("5_", []), ("OFF", []),
    ("M\\u00fcller", ["3"])])
def test_search_is_literal(odd, search, expected):
    found = browse(odd, search=search).collect()
    assert [r.record_id for r in found] == expected


def test_search_finds_utf8(spark):
    rows = spark.createDataFrame(
        [("1", "s", bytearray('{"t":"é \\"q\\""}'.encode()), None)],
        "record_id string, source string, record_a binary, record_b binary")
    assert browse(diff_records(rows), search="é").count() == 1
    assert browse(diff_records(rows), search='\\"q').count() == 1


def test_record_view(odd):
    row = record_payloads(odd, "1").first()
    assert list(json.loads(row.record_a)) == ["a", "b", "t"]
    assert json.loads(row.record_b) == {"b": 1, "t": "50% off_x"}
    assert record_payloads(odd, "2").first().record_b is None
    assert record_payloads(odd, "none").count() == 0
    summary = record_summary(odd, "1", strict=True).first()
    assert (summary.fields_changed, summary.modified_fields) == (1, ["a"])
    assert (summary.fields_only_in_a, summary.fields_only_in_b) == (["a"], [])
    assert record_summary(odd, "none").count() == 0
    with pytest.raises(ValueError, match="Could not find record in diff matrix"):
        record_summary(odd, "none", strict=True)


def scanned_rows(df):
    """Rows that the scans of an executed query handed on."""
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        rows += leaves.apply(i).metrics().apply("numOutputRows").value()
    return rows


def test_a_lookup_reads_little_of_a_stored_run(spark, tmp_path):
    from recordlens import read_dataset, write_dataset

    n = 40_000
    rows = spark.range(n).selectExpr(
        "sha2(cast(id AS string), 256) AS record_id", "cast(id % 3 AS string) AS source",
        "repeat(sha2(cast(id AS string), 512), 3) AS record_a", "'{}' AS record_b")
    write_dataset(rows, str(tmp_path / "plain"), ["source"])
    write_dataset(rows, str(tmp_path / "sorted"), ["source"], rows_per_group=2000,
                  cluster_by="record_id")
    known = rows.where("source = '0'").first().record_id
    counts = {}
    for name in ("plain", "sorted"):
        found = read_dataset(spark, str(tmp_path / name)).filter(F.col("record_id") == known)
        assert [r.record_id for r in found.collect()] == [known]
        counts[name] = scanned_rows(found)
        unknown = read_dataset(spark, str(tmp_path / name)).filter("record_id = 'ffnone'")
        assert unknown.collect() == []
        counts[name, "unknown"] = scanned_rows(unknown)
    assert counts["sorted"] <= 2000 and counts["sorted", "unknown"] == 0
    assert counts["plain"] >= n // 3
