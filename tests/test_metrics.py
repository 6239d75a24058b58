import json

import pytest

from recordlens import (
    changed_fields, count_cells, diff_records, distinct_sources, field_cells, field_counts,
    field_matrix, field_names, final_records, global_counts, join_matrix, metrics_document,
    metrics_rows, query_matrix, record_flags, source_counts, source_field_counts,
)
from recordlens.columns import final_schema


def pairs(df, *keys):
    return {tuple(r[k] for k in keys): r.n for r in df.collect()}


@pytest.fixture(scope="module")
def cells(diffs):
    return count_cells(diffs).cache()


def test_matrix_values(diffs):
    matrix = field_matrix(diffs)
    assert matrix.columns == [
        "record_id", "source", "has_diff", "a_or_b_missing", "color", "fruit", "number"]
    found = {r.record_id: tuple(r)[2:] for r in matrix.collect()}
    assert found == {"abc123": (1, 0, 1, 0, 0), "def456": (0, 0, 0, 0, 0),
                     "ghi789": (1, 0, 1, 1, 1)}


def test_fields_and_sources(diffs):
    assert field_names(diffs) == ["color", "fruit", "number"]
    assert {r.field for r in changed_fields(diffs).collect()} == {"color", "fruit", "number"}
    assert {r.source for r in distinct_sources(diffs).collect()} == {
        "alma", "dspace", "libguides"}
    assert field_cells(diffs).count() == 4


def test_counts(cells):
    assert global_counts(cells).first().asDict() == {
        "total_records": 3, "total_records_with_diff": 2, "records_with_diff_percent": 66.67}
    assert pairs(source_counts(cells), "source") == {
        ("alma",): 1, ("dspace",): 0, ("libguides",): 1}
    assert pairs(field_counts(cells), "field") == {
        ("color",): 2, ("fruit",): 1, ("number",): 1}
    assert pairs(source_field_counts(cells), "source", "field") == {
        ("alma", "color"): 1, ("libguides", "color"): 1, ("libguides", "fruit"): 1,
        ("libguides", "number"): 1}
    assert pairs(source_field_counts(
            cells, zeros=["color", "fruit", "number"]), "source", "field") == {
        ("alma", "color"): 1, ("alma", "fruit"): 0, ("alma", "number"): 0,
        ("dspace", "color"): 0, ("dspace", "fruit"): 0, ("dspace", "number"): 0,
        ("libguides", "color"): 1, ("libguides", "fruit"): 1, ("libguides", "number"): 1}


def document_rows(cells):
    return {(r.part, r.source, r.field): json.loads(r.metrics)
            for r in metrics_document(cells).collect()}


# fixed values: golden results of the golden inputs
def test_document(cells):
    found = document_rows(cells)
    assert found.pop(("summary", None, None)) == {
        "total_records": 3, "total_records_with_diff": 2, "records_with_diff_percent": 66.67,
        "sources": 3, "fields_with_diffs": 3}
    assert {k: v["count"] for k, v in found.items()} == {
        ("source", "alma", None): 1, ("source", "dspace", None): 0,
        ("source", "libguides", None): 1, ("field", None, "color"): 2,
        ("field", None, "fruit"): 1, ("field", None, "number"): 1,
        ("pair", "alma", "color"): 1, ("pair", "libguides", "color"): 1,
        ("pair", "libguides", "fruit"): 1, ("pair", "libguides", "number"): 1}


def test_null_and_empty_sources_keep_their_own_counts(make_collated):
    one, two = {"v": 1, "z": 1}, {"v": 2, "z": 1}
    diffs = diff_records(make_collated([
        ("1", None, one, two), ("2", None, one, {"v": 1, "z": 2}), ("3", "", one, two),
        ("4", "s", one, two)]))
    found = {k: v["count"] for k, v in document_rows(count_cells(diffs)).items()
             if k[0] != "summary"}
    assert found == {
        ("source", None, None): 2, ("source", "", None): 1, ("source", "s", None): 1,
        ("field", None, "v"): 3, ("field", None, "z"): 1, ("pair", None, "v"): 1,
        ("pair", None, "z"): 1, ("pair", "", "v"): 1, ("pair", "s", "v"): 1}


def test_rows_hold_the_document(cells):
    found = {r.path: r.value for r in metrics_rows(cells).collect()}
    assert len(found) == 3 + 3 + 3 + 2 * 4
    assert found["analysis.by_source.libguides.field_counts.fruit"] == 1.0
    assert found["analysis.by_field.color.count"] == 2.0


def test_missing_sides_count_for_sources_only(make_collated):
    diffs = diff_records(make_collated([
        ("1", "s", {"v": 1}, None), ("2", "s", None, {"v": 1}), ("3", "s", {"v": 1}, {"v": 2})]))
    cells = count_cells(diffs)
    assert pairs(source_counts(cells), "source") == {("s",): 3}
    assert pairs(source_field_counts(cells), "source", "field") == {("s", "v"): 1}
    assert {r.record_id: (r.has_diff, r.a_or_b_missing) for r in record_flags(diffs).collect()} \
        == {"1": (1, 1), "2": (1, 1), "3": (1, 0)}


def test_nothing_changed(make_collated):
    diffs = diff_records(make_collated([("1", "s", {"v": 1}, {"v": 1})]))
    assert field_matrix(diffs).columns == ["record_id", "source", "has_diff", "a_or_b_missing"]
    cells = count_cells(diffs)
    assert source_field_counts(cells).count() == 0
    found = document_rows(cells)
    assert found.pop(("summary", None, None))["fields_with_diffs"] == 0
    assert found == {("source", "s", None): {"count": 0}}


def test_no_records(make_collated):
    cells = count_cells(diff_records(make_collated([])))
    assert global_counts(cells).first().asDict() == {
        "total_records": 0, "total_records_with_diff": 0, "records_with_diff_percent": None}
    assert document_rows(cells)["summary", None, None]["total_records"] == 0


def test_field_named_like_a_fixed_column(make_collated, tmp_path):
    record = {"source": 1, "has_diff": 1, "a.b": 1, "Record_A": 1, "x": 1, "X": 1}
    changed = {name: 2 for name in record}
    diffs = diff_records(make_collated([("1", "s", record, changed)]))
    fields = {"field_source": 1, "field_has_diff": 1, "a.b": 1, "field_Record_A": 1,
              "X": 1, "field_x": 1}
    row = field_matrix(diffs).first().asDict()
    assert row == {
        "record_id": "1", "source": "s", "has_diff": 1, "a_or_b_missing": 0, **fields}
    joined = join_matrix(diffs, field_matrix(diffs)).first().asDict()
    final = final_records(diffs)
    assert joined == final.first().asDict()
    assert {k: final.first()[k] for k in fields} == fields
    final.write.parquet(str(tmp_path / "final"))


def test_records_without_a_stored_list_still_count(spark):
    diffs = spark.createDataFrame(
        [("1", "s", None, None, None, None, "true"), ("2", "s", None, None, None, ["v"], "true")],
        "record_id string, source string, record_a binary, record_b binary, ab_diff string, "
        "modified_fields array<string>, has_diff string")
    assert pairs(source_counts(count_cells(diffs)), "source") == {("s",): 2}
    assert {r.record_id: r.v for r in field_matrix(diffs).collect()} == {"1": 0, "2": 1}


def test_larger_golden(spark):
    """1,278 changed records of two sources, three changed fields."""
    from pyspark.sql import functions as F
    rows = spark.range(1278).select(
        F.col("id").cast("string").alias("record_id"),
        F.when(F.col("id") < 892, "researchdatabases").otherwise("libguides").alias("source"),
        F.lit('{"dates": 1, "publishers": 1, "publication_information": 1}').alias("record_a"),
        F.when(F.col("id") < 892, '{"dates": 2, "publishers": 1, "publication_information": 1}')
        .otherwise('{"dates": 2, "publishers": 2, "publication_information": 2}')
        .alias("record_b"))
    cells = count_cells(diff_records(rows)).cache()
    assert global_counts(cells).first().asDict() == {
        "total_records": 1278, "total_records_with_diff": 1278,
        "records_with_diff_percent": 100.0}
    assert pairs(source_field_counts(cells), "source", "field") == {
        ("researchdatabases", "dates"): 892, ("libguides", "dates"): 386,
        ("libguides", "publishers"): 386, ("libguides", "publication_information"): 386}


# --- final records ---------------------------------------------------------------

def test_final_records(diffs):
    records = final_records(diffs)
    expected = final_schema(["color", "fruit", "number"])
    assert [(f.name, f.dataType) for f in records.schema] == [
        (f.name, f.dataType) for f in expected]
    joined = join_matrix(diffs, field_matrix(diffs)).select(*records.columns)
    assert sorted(map(str, records.collect())) == sorted(map(str, joined.collect()))


def test_query_matrix(diffs):
    found = query_matrix(
        final_records(diffs),
        "SELECT source, color FROM record_diff_matrix WHERE fruit = ?", [1]).collect()
    assert [(r.source, r.color) for r in found] == [("libguides", 1)]
    columns = query_matrix(final_records(diffs), "SELECT * FROM record_diff_matrix").columns
    assert columns == ["record_id", "source", "a_or_b_missing", "color", "fruit", "number"]


def test_matrix_and_records_need_no_shuffle(collated):
    from recordlens import final_records as make
    plan = make(diff_records(collated), ["color"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()
