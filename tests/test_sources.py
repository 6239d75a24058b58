import datetime
import json

import pytest
from pyspark.sql import functions as F

from recordlens import (
    collate, count_cells, dataset_files, diff_records, extracted_files, input_manifest,
    list_files, listed_files, load_run, metrics_document, parse_filenames, read_dataset, read_history, read_manifest,
    read_run_documents, read_run_inputs, read_version, requested_sources, run_diff, save_run,
    since_last_full, write_bucketed, write_dataset, write_manifest,
)
from recordlens.functions.filenames import version_label
from recordlens.operators.checks import DatasetCheckError
from recordlens.session import scratch_dir, shuffle_partitions

NAME = "source-2024-01-01-full-extracted-records-to-index"
D1 = datetime.date(2024, 10, 1)


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "path string")


@pytest.mark.parametrize("path,index", [
    (f"s3://bucket/source/{NAME}.xml", None), (f"s3://bucket/source/{NAME}_01.xml", "01"),
    (f"{NAME}.xml", None)])
def test_filename_parts(spark, path, index):
    row = parse_filenames(paths(spark, path)).first()
    assert tuple(row) == (path, "source", "2024-01-01", "full", "extracted", "index", index, "xml")


def test_invalid_filename(spark):
    with pytest.raises(Exception, match="Provided S3 URI and filename is invalid: invalid"):
        parse_filenames(paths(spark, "x/invalid")).collect()
    rows = parse_filenames(paths(spark, "x/invalid", f"{NAME}.xml"), strict=False).collect()
    assert [r.source for r in rows] == [None, "source"]


def test_version_label(spark):
    df = paths(spark, "/runs/1/transformed/a/f.json", "s3://x/transformed/b/f.json")
    assert [r[0] for r in df.select(version_label(F.col("path"))).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="Transformed filepath is invalid: invalid"):
        paths(spark, "invalid").select(version_label(F.col("path"))).collect()
    assert paths(spark, "invalid").select(version_label(F.col("path"), False)).first()[0] is None


def extract(source, date, kind, part=""):
    return f"{source}/{source}-{date}-{kind}-extracted-records-to-index{part}.xml"


def test_since_last_full(spark):
    files = paths(
        spark,
        extract("alma", "2024-01-01", "full"), extract("alma", "2024-03-01", "full", "_02"),
        extract("alma", "2024-03-01", "full", "_01"), extract("alma", "2024-02-28", "daily"),
        extract("alma", "2024-03-01", "daily"), extract("alma", "2024-03-05", "daily"),
        extract("dspace", "2024-03-05", "daily"),
        extract("libguides", "2023-01-01", "full"), "alma/", "alma/other-2024-03-09-daily-x.xml")
    found = [r.path for r in input_manifest(files, ["libguides", "dspace", "alma"]).collect()]
    assert found == [
        extract("libguides", "2023-01-01", "full"),
        extract("alma", "2024-03-01", "full", "_01"), extract("alma", "2024-03-01", "full", "_02"),
        extract("alma", "2024-03-01", "daily"), extract("alma", "2024-03-05", "daily")]
    assert [r.path for r in input_manifest(files, "libguides, dspace,alma,alma").collect()] == found
    assert {r.source for r in input_manifest(files).collect()} == {"alma", "libguides"}
    per_source = since_last_full(extracted_files(files).withColumn(
        "source", F.substring_index("path", "/", 1)))
    assert per_source.count() == 5


def test_sources_match_by_prefix(spark):
    files = requested_sources(paths(spark, "gis/x", "gisogm/x"), ["gis", "gisogm"])
    assert {(r.path, r.source) for r in files.collect()} == {
        ("gis/x", "gis"), ("gisogm/x", "gis"), ("gisogm/x", "gisogm")}


def test_manifest_list_and_csv(spark, tmp_path):
    rows = read_manifest(spark, " a.xml, b.xml ,c.xml").orderBy("position").collect()
    assert [r.path for r in rows] == ["a.xml", "b.xml", "c.xml"]
    target = str(tmp_path / "manifest.csv")
    names = [f"f{i:05d}.xml" for i in range(5000)]
    write_manifest(paths(spark, *reversed(names)).repartition(7), target, ["path"])
    rows = read_manifest(spark, target).orderBy("position").collect()
    assert [r.path for r in rows] == names
    single = tmp_path / "single.csv"
    single.write_text("z.xml,ignored\na.xml,ignored\n")
    rows = read_manifest(spark, str(single)).orderBy("position").collect()
    assert [r.path for r in rows] == ["z.xml", "a.xml"]


def test_listing(spark, tmp_path):
    folder = tmp_path / "alma"
    folder.mkdir()
    (folder / f"{NAME}.xml").write_text("x")
    (folder / "notes.txt").write_text("x")
    (folder / "_hidden").mkdir()
    (folder / "_hidden" / ".empty").write_text("")
    with pytest.raises(ValueError, match="not a pattern"):
        list_files(spark, f"{tmp_path}/*")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        files = list_files(spark, root)
        assert {r.key for r in files.collect()} == {
            f"alma/{NAME}.xml", "alma/notes.txt", "alma/_hidden/.empty"}
        assert extracted_files(files).first().path.endswith(f"alma/{NAME}.xml")
        assert input_manifest(files, ["alma"]).count() == 1
        assert input_manifest(files, ["dspace"], key="key").count() == 0


def test_listing_schemes(spark):
    from recordlens.sources.manifests import _client_address

    assert _client_address("s3a://bucket/a b") == "s3://bucket/a b"
    assert _client_address("/data/x") == "/data/x"
    with pytest.raises(ValueError, match="give an inventory"):
        list_files(spark, "wasbs://container/x")


def test_files_of_an_inventory(spark):
    table = spark.createDataFrame(
        [("s3a://b/x/alma/1.xml", 5), ("s3a://b/x/alma/1.xml", 6), ("s3a://b/x/", 0), (None, 1),
         ("s3a://b/xy/2.xml", 1), ("s3a://b/x/%_/3.xml", None)], "key string, size long")
    for root in ("s3a://b/x", "s3a://b/x/"):
        assert sorted(map(tuple, listed_files(table, root, "key").collect())) == [
            ("s3a://b/x/%_/3.xml", "%_/3.xml"), ("s3a://b/x/alma/1.xml", "alma/1.xml")]
    assert listed_files(table, "s3a://b/%", "key").count() == 0
    assert listed_files(table, path="key").count() == 3


def test_columns_for_given_fields_only(spark, make_version, tmp_path, monkeypatch):
    from recordlens.plans import run_diff as plan

    def no_names(*_):
        raise AssertionError("names were collected")

    monkeypatch.setattr(plan, "name_list", no_names)
    sides = [make_version([(f"x{i}", "s", D1, "full", "index", {f"f{i}": n, "t": n * (i % 2)})
                           for i in range(50)]) for n in (1, 2)]
    result = run_diff(*sides, str(tmp_path / "run"), fields=["t", "f7", "none", "source"])
    assert result.matrix.columns[-4:] == ["t", "f7", "none", "field_source"]
    sums = result.matrix.groupBy().sum("t", "f7", "none", "field_source").first()
    assert tuple(sums) == (25, 1, 0, 0)
    again = load_run(spark, str(tmp_path / "run"), fields=["f7"]).records
    assert [r.record_id for r in again.filter("f7 = 1").collect()] == ["x7"]
    assert "f8" not in again.columns


def test_partitioned_write(spark, tmp_path):
    target = str(tmp_path / "out")
    df = spark.createDataFrame(
        [("apple", "red"), ("banana", "yellow")], "fruit string, color string")
    write_dataset(df, target, ["fruit"])
    folders = {r.path.split("/")[-2] for r in dataset_files(spark, target).collect()}
    assert folders == {"fruit=apple", "fruit=banana"}
    # a second write replaces the partitions it touches and keeps the others
    write_dataset(spark.createDataFrame([("apple", "green")], df.schema), target, ["fruit"],
                  rebalance=True)
    assert {tuple(r) for r in read_dataset(spark, target).select("fruit", "color").collect()} == {
        ("apple", "green"), ("banana", "yellow")}
    write_dataset(df.limit(1), str(tmp_path / "plain"))
    write_dataset(df, str(tmp_path / "plain"))
    assert read_dataset(spark, str(tmp_path / "plain")).count() == 2


def test_rows_per_file_and_group(spark, tmp_path):
    import pyarrow.parquet as pq
    target = str(tmp_path / "out")
    write_dataset(spark.range(250).coalesce(1), target, max_rows_per_file=100, rows_per_group=40)
    found = sorted(r.path.removeprefix("file:") for r in dataset_files(spark, target).collect())
    sizes = [pq.ParquetFile(f).metadata for f in found]
    assert sorted(m.num_rows for m in sizes) == [50, 100, 100]
    assert max(m.row_group(i).num_rows for m in sizes for i in range(m.num_row_groups)) <= 40


def test_partition_values_stay_text(spark, tmp_path):
    target = str(tmp_path / "v")
    df = spark.createDataFrame(
        [("1", "0123", D1, "full", "index", bytearray(b"{}"))],
        "record_id string, source string, run_date date, run_type string, action string, "
        "transformed_record binary")
    write_dataset(df, target, ["source", "run_date"])
    row = read_version(spark, target).first()
    assert (row.source, row.run_date) == ("0123", D1)


def test_run_history(spark, diffs, tmp_path):
    history = str(tmp_path / "history")
    metrics = metrics_document(count_cells(diffs))
    for stamp in ("2024-11-07_03-56-22", "2024-10-17_14-01-18"):
        save_run(history, metrics, stamp, "note", paths(spark, "x.xml", "y.xml"), {"records": "r"})
    rows = read_history(spark, history).collect()
    stamps = [r.run_timestamp for r in rows]
    assert stamps == sorted(stamps) and len(set(stamps)) == 2
    assert rows[0].datasets == {"records": "r"}
    summary = [r for r in rows if r.part == "summary"]
    assert [json.loads(r.metrics)["total_records"] for r in summary] == [3, 3]
    assert read_run_inputs(spark, history).count() == 4


def test_run_documents(spark, tmp_path):
    for stamp in ("2024-11-07_03-56-22", "2024-10-17_14-01-18"):
        folder = tmp_path / "runs" / stamp
        folder.mkdir(parents=True)
        (folder / "run.json").write_text(json.dumps(
            {"run_timestamp": stamp, "metrics": {"summary": {"total_records": 3}}}, indent=2))
    rows = read_run_documents(spark, f"{tmp_path}/runs/*/run.json").collect()
    assert [r.run_timestamp for r in rows] == ["2024-10-17_14-01-18", "2024-11-07_03-56-22"]
    assert rows[0].metrics.summary.total_records == 3


def test_scratch_dir_uses_the_shared_setting(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(f"{shared}/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_whole_run(spark, make_version, tmp_path):
    a = make_version([
        (str(i), f"s{i % 3}", D1, "full", "index", {"n": i, "t": "x"}) for i in range(30)])
    b = make_version([
        (str(i), f"s{i % 3}", D1, "full", "index", {"n": i // 2 * 2, "t": "x"})
        for i in range(28)])
    result = run_diff(a, b, str(tmp_path / "run"), wide=True)
    expected = {str(i): "true" if i % 2 or i >= 28 else "false" for i in range(30)}
    assert {r.record_id: r.has_diff for r in result.records.collect()} == expected
    assert sum(r.n for r in result.matrix.groupBy("n").count().withColumnRenamed("count", "c")
               .collect() if r.n) == 1
    assert result.matrix.filter("n = 1").count() == 14
    summary = json.loads(result.metrics.where("part = 'summary'").first().metrics)
    assert (summary["total_records"], summary["total_records_with_diff"]) == (30, 16)
    load_run(spark, str(tmp_path / "run"), view="records")
    assert spark.sql("SELECT count(*) FROM records WHERE a_or_b_missing = 1").first()[0] == 2
    # a second run into the same folder takes the first one's place
    again = run_diff(a, a, str(tmp_path / "run"), write_records=True, rebalance=True)
    assert again.records.columns == [
        c for c in result.records.columns if c != "n"] and again.records.count() == 30
    loaded = load_run(spark, str(tmp_path / "run"))
    assert sorted(map(str, loaded.records.collect())) == sorted(map(str, again.records.collect()))


def test_whole_run_with_other_column_names(spark, make_version, tmp_path):
    from recordlens import Columns, browse, query_matrix
    names = {"record_id": "item", "source": "origin", "run_date": "day", "run_type": "mode",
             "action": "verb", "transformed_record": "body"}
    cols = Columns(id="item", source="origin", run_date="day", run_type="mode", action="verb",
                   payload="body", record_a="left", record_b="right", document="delta",
                   fields="touched", has_diff="changed", missing="one_sided")
    sides = [make_version([(str(i), "s", D1, "full", "index", {"n": i % m}) for i in range(9)])
             .withColumnsRenamed(names) for m in (2, 3)]
    result = run_diff(*sides, str(tmp_path / "run"), wide=True, cols=cols)
    assert set(result.records.columns) == {
        "item", "origin", "left", "right", "delta", "touched", "changed", "one_sided", "n"}
    assert [tuple(r) for r in browse(result.records, fields=["n"], length=1, cols=cols).collect()] \
        == [("2", "s", "true", "[n]")]
    found = query_matrix(result.records, "SELECT sum(n) AS n FROM record_diff_matrix", cols=cols)
    assert found.first().n == sum(i % 2 != i % 3 for i in range(9))


def test_bucketed_versions_collate_without_shuffle(spark, make_version, tmp_path):
    sides = []
    for name, step in (("a", 1), ("b", 2)):
        version = make_version([
            (str(i), "s", D1, "full", "index", {"n": i // step}) for i in range(40)] * 2)
        sides.append(write_bucketed(version, f"version_{name}", 4, path=str(tmp_path / name)))
    try:
        found = collate(*sides)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 40
    finally:
        for name in "ab":
            spark.sql(f"DROP TABLE version_{name}")


def test_shuffle_partitions_grow_with_the_input():
    assert [shuffle_partitions(n) for n in (1, 2**40, 10**14)] == [200, 2048, 186_265]


def test_empty_run_raises(make_version, tmp_path):
    empty = make_version([])
    with pytest.raises(DatasetCheckError, match="does not contain any records"):
        run_diff(empty, empty, str(tmp_path / "run"))


def test_one_python_step_in_the_diff(make_version):
    side = make_version([("1", "s", D1, "full", "index", {"v": 1})])
    plan = diff_records(collate(side, side))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_failed_run_leaves_the_one_before(spark, make_version, tmp_path):
    rows = [(str(i), "s", D1, "full", "index", {"n": i}) for i in range(4)]
    place = str(tmp_path / "run")
    run_diff(make_version(rows), make_version(rows[:3]), place)
    before = sorted(map(str, load_run(spark, place).records.collect()))
    with pytest.raises(DatasetCheckError):
        run_diff(make_version([]), make_version([]), place)
    loaded = load_run(spark, place)
    assert sorted(map(str, loaded.records.collect())) == before
    summary = json.loads(loaded.metrics.where("part = 'summary'").first().metrics)
    assert summary["total_records"] == 4


def test_run_with_very_many_fields_and_odd_sources(spark, make_version, tmp_path):
    wide = [{f"f{i}": v for i in range(20_000)} for v in (1, 2)]
    sources = ("s", "", None)
    a, b = (make_version([(str(i), s, D1, "full", "index", record if i == 0 else {"n": n})
                          for i, s in enumerate(sources)]) for n, record in enumerate(wide))
    place = str(tmp_path / "run")
    run_diff(a, b, place)
    result = load_run(spark, place)
    assert {r.record_id: r.source for r in result.records.collect()} == {
        str(i): s for i, s in enumerate(sources)}
    assert result.metrics.where("part = 'field'").count() == 20_001
    assert {(r.source, json.loads(r.metrics)["count"])
            for r in result.metrics.where("part = 'source'").collect()} == {
        (s, 1) for s in sources}
    save_run(str(tmp_path / "history"), result.metrics, "2024-11-07_03-56-22")
    assert read_history(spark, str(tmp_path / "history")).count() == result.metrics.count()


def test_hot_id_is_reduced_before_bucketing(make_version, tmp_path, spark):
    version = make_version([("hot", "s", D1, "full", "index", {"n": i}) for i in range(50)])
    try:
        assert write_bucketed(version, "version_hot", 2, path=str(tmp_path / "h")).count() == 1
    finally:
        spark.sql("DROP TABLE version_hot")
