import datetime

import pytest
from pyspark.sql import functions as F

from recordlens import (
    DatasetCheckError, check_counts, collate, compare_transforms, join_versions, latest_state,
    read_labelled_versions, row_key, run_versions, union_versions, validate,
)
from recordlens.columns import collated_schema

D1, D2 = datetime.date(2024, 10, 1), datetime.date(2024, 10, 2)


def rows(source, ids, record):
    return [(f"{source}:{i}", source, D1, "full", "index", record) for i in ids]


@pytest.fixture(scope="module")
def versions(make_version):
    a = rows("dspace", range(5), {"v": 1}) + rows("alma", range(5), {"v": 1})
    b = [row for row in a if row[0] != "alma:3"]
    return make_version(a), make_version(b)


def test_full_outer_join_keeps_one_sided_rows(versions):
    found = join_versions(*versions).collect()
    assert len(found) == 10
    one_sided = [r for r in found if r.record_b is None]
    assert [(r.record_id, r.source) for r in one_sided] == [("alma:3", "alma")]


def test_coalesced_columns_come_from_a_first(make_version):
    a = make_version([("1", "sa", D1, "full", "index", {"v": 1})])
    b = make_version([("1", "sb", D2, "daily", "delete", {"v": 2}),
                      ("2", "sb", D2, "daily", "index", {"v": 2})])
    found = {r.record_id: r for r in join_versions(a, b).collect()}
    assert (found["1"].source, found["1"].run_date, found["1"].action) == ("sa", D1, "index")
    assert (found["2"].source, found["2"].run_date, found["2"].action) == ("sb", D2, "index")


def test_latest_state_order(make_version):
    df = make_version([
        ("abc", "s", D1, "full", "index", {"v": "only"}),
        ("def", "s", D1, "full", "index", {"v": "old"}),
        ("def", "s", D2, "full", "delete", {"v": "gone"}),
        ("ghi", "s", D1, "full", "index", {"material": "concrete"}),
        ("ghi", "s", D2, "daily", "index", {"material": "stucco"}),
        ("daily-first", "s", D2, "full", "index", {"v": "full"}),
        ("daily-first", "s", D2, "daily", "index", {"v": "daily"}),
        ("delete-first", "s", D2, "full", "index", {"v": 1}),
        ("delete-first", "s", D2, "full", "delete", {"v": 2}),
        ("null-date", "s", None, "daily", "index", {"v": "undated"}),
        ("null-date", "s", D1, "full", "index", {"v": "dated"}),
        ("null-action", "s", D1, "full", None, {"v": 1}),
    ])
    found = {r.record_id: bytes(r.transformed_record).decode()
             for r in latest_state(df).collect()}
    assert found == {
        "abc": '{"v": "only"}', "ghi": '{"material": "stucco"}',
        "daily-first": '{"v": "daily"}', "null-date": '{"v": "dated"}'}


def test_latest_state_matches_brute_force_with_hot_key(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string"))
        .alias("record_id"),
        F.lit("s").alias("source"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") * 7919 % 365).cast("int")).alias("run_date"),
        F.when(F.col("id") % 5 == 0, "full").otherwise("daily").alias("run_type"),
        F.when(F.col("id") % 11 == 0, "delete").otherwise("index").alias("action"),
        F.col("id").cast("string").cast("binary").alias("transformed_record"))
    best = {}
    for r in df.collect():
        key = (-r.run_date.toordinal(), r.run_type, r.action, bytes(r.transformed_record))
        best[r.record_id] = min(best.get(r.record_id, key), key)
    found = {r.record_id: bytes(r.transformed_record) for r in latest_state(df).collect()}
    assert found == {k: v[3] for k, v in best.items() if v[2] != "delete"}


def test_hot_ids_are_reduced_before_the_shuffle(versions):
    plan = latest_state(versions[0])._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index("Partial"), plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan and exchange < partial


def test_collate_shuffles_each_side_once(spark, versions):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = collate(*versions)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_collate_schema_and_pairs(make_version):
    a = make_version([("1", "s", D1, "full", "index", {"v": "old a"}),
                      ("1", "s", D2, "full", "index", {"v": "new a"}),
                      ("2", "s", D1, "full", "index", {"v": 1}),
                      ("2", "s", D2, "full", "delete", {"v": 1})])
    b = make_version([("1", "s", D1, "full", "index", {"v": "old b"}),
                      ("1", "s", D2, "full", "index", {"v": "new b"}),
                      ("2", "s", D1, "full", "index", {"v": 1})])
    found = collate(a, b)
    assert [(f.name, f.dataType) for f in found.schema] == [
        (f.name, f.dataType) for f in collated_schema()]
    assert [(r.record_id, bytes(r.record_a), bytes(r.record_b)) for r in found.collect()] == [
        ("1", b'{"v": "new a"}', b'{"v": "new b"}')]


def test_null_ids_do_not_join(make_version):
    a = make_version([(None, "s", D1, "full", "index", {"v": 1})] * 3)
    b = make_version([(None, "s", D1, "full", "index", {"v": 1})])
    assert collate(a, b).count() == 2
    assert collate(a, b, drop_null_ids=True).count() == 0
    assert check_counts(collate(a, b)).first().duplicate_ids == 1


def test_row_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    assert df.select(row_key(["x", "y"])).distinct().count() == 2


# --- checks --------------------------------------------------------------------

def test_valid_dataset_passes(collated):
    validate(collated)


@pytest.mark.parametrize("data,message", [
    ([], "does not contain any records"),
    ([("1", "s", {"v": 1}, None)], r"record column\(s\) \['record_a', 'record_b'\]"),
    ([("1", "s", {"v": 1}, {"v": 1})] * 2, "duplicate 'record_id' records"),
])
def test_invalid_datasets_raise(make_collated, data, message):
    with pytest.raises(DatasetCheckError, match=message):
        validate(make_collated(data))


# --- two versions of a transform -----------------------------------------------

def transform(expression):
    def apply(df):
        return df.select(
            F.col("n").cast("string").alias("record_id"), F.lit("s").alias("source"),
            F.lit(D1).alias("run_date"), F.lit("full").alias("run_type"),
            F.lit("index").alias("action"),
            F.expr(expression).cast("string").cast("binary").alias("transformed_record"))
    return apply


def test_run_versions_lenient_and_strict(spark):
    inputs = spark.createDataFrame([(0,), (1,), (2,)], "n int")
    good, bad = transform("n + 1"), transform("try_divide(10, n)")
    run = run_versions(inputs, good, bad, strict=False)
    assert (run.a.count(), run.b.count()) == (3, 2)
    assert [(r.version, r.record_id) for r in run.rejects.collect()] == [("b", "0")]
    assert run_versions(inputs, good, good).b.count() == 3
    with pytest.raises(ValueError, match="Version b failed to complete successfully on record 0"):
        run_versions(inputs, good, bad)
    assert union_versions({"a": run.a, "b": run.b}).count() == 5


def test_each_transform_runs_once(spark, tmp_path):
    import pyspark.sql.functions as F
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(n):
        calls.add(1)
        return str(n) if n else None

    def apply(inputs):
        return transform("n")(inputs).withColumn(
            "transformed_record", counted("record_id").cast("binary"))

    inputs = spark.createDataFrame([(i,) for i in range(10)], "n int")
    run = run_versions(inputs, apply, apply, strict=False)
    assert (run.a.count(), run.b.count(), run.rejects.count()) == (10, 10, 0)
    assert calls.value == 20


def test_row_keys_of_different_values_differ(spark):
    rows = spark.createDataFrame([("x|y", "z"), ("x", "y|z"), ("x", None)], "a string, b string")
    assert rows.select(row_key(["a", "b"]).alias("k")).distinct().count() == 3


def test_compare_transforms(spark, tmp_path):
    inputs = spark.createDataFrame([(0,), (1,), (2,)], "n int")

    def numbered(expression):
        return transform(f"to_json(named_struct('v', {expression}))")

    result = compare_transforms(inputs, numbered("n"), numbered("n div 2 * 2"), str(tmp_path),
                                wide=True)
    assert {r.record_id: r.v for r in result.records.collect()} == {"0": 0, "1": 1, "2": 0}
    labelled = read_labelled_versions(spark, str(tmp_path))
    assert {tuple(r) for r in labelled.groupBy("version").count().collect()} == {
        ("a", 3), ("b", 3)}
    with pytest.raises(Exception, match="failed to complete successfully"):
        compare_transforms(inputs, numbered("n"), transform("try_divide(1, n)"),
                           str(tmp_path / "strict"))
    lenient = compare_transforms(
        inputs, numbered("n"), transform("try_divide(1, n)"), str(tmp_path / "lenient"),
        strict=False)
    assert {r.record_id: r.a_or_b_missing for r in lenient.records.collect()} == {
        "0": 1, "1": 0, "2": 0}
    assert spark.read.parquet(str(tmp_path / "lenient" / "rejects")).count() == 1
