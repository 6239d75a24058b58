"""Runs published at once, runs that break off, and their order."""

import os
from datetime import date

import pytest

from recordlens import load_run, published_runs, read_history, read_run_inputs, run_diff, save_run
from recordlens.plans import run_diff as plan
from recordlens.sources import runs

D1 = date(2024, 10, 1)


@pytest.fixture
def sides(make_version):
    def version(title):
        return make_version([("x", "s", D1, "full", "index", {"title": title})])
    return version


def numbered(spark, output):
    rows = published_runs(spark, output).orderBy("number", "run").collect()
    return [(r.number, r.run) for r in rows]


def test_nothing_published(spark, tmp_path):
    assert published_runs(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="No such published run"):
        load_run(spark, str(tmp_path))


def test_numbers_follow_each_other(spark, tmp_path):
    for run in "cab":
        runs.publish_run(spark, str(tmp_path), run)
    assert numbered(spark, str(tmp_path)) == [(0, "c"), (1, "a"), (2, "b")]


def test_names_of_digits_stay_as_they_are(spark, tmp_path):
    for run in ("007", "1e5"):
        runs.publish_run(spark, str(tmp_path), run)
    assert numbered(spark, str(tmp_path)) == [(0, "007"), (1, "1e5")]


def test_runs_that_take_the_same_number_are_both_kept(spark, tmp_path, monkeypatch):
    """The second looks for the last number before the first has published."""
    before = published_runs(spark, str(tmp_path))
    for run in ("b", "a"):
        monkeypatch.setattr(runs, "published_runs", lambda spark, output: before)
        runs.publish_run(spark, str(tmp_path), run)
    monkeypatch.undo()
    assert numbered(spark, str(tmp_path)) == [(0, "a"), (0, "b")]
    runs.publish_run(spark, str(tmp_path), "later")
    assert numbered(spark, str(tmp_path))[-1] == (1, "later")


def test_commit_that_breaks_off_is_not_seen(spark, tmp_path):
    runs.publish_run(spark, str(tmp_path), "whole")
    os.makedirs(tmp_path / "commits" / "number=7" / "run=broken" / "_temporary" / "0")
    assert numbered(spark, str(tmp_path)) == [(0, "whole")]


def test_run_that_breaks_off_before_its_commit(spark, sides, tmp_path, monkeypatch):
    output = str(tmp_path / "out")
    run_diff(sides("a"), sides("b"), output)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(plan, "publish_run", lost)
    with pytest.raises(RuntimeError, match="lost"):
        run_diff(sides("a"), sides("a"), output)
    monkeypatch.undo()
    assert len(os.listdir(f"{output}/runs")) == 2
    assert [r.has_diff for r in load_run(spark, output).records.collect()] == ["true"]


def test_each_run_by_its_name(spark, sides, tmp_path):
    output = str(tmp_path / "out")
    run_diff(sides("a"), sides("b"), output)
    run_diff(sides("a"), sides("a"), output)
    (_, first), (_, second) = numbered(spark, output)
    for name, flag in ((first, "true"), (second, "false"), (None, "false")):
        assert load_run(spark, output, run=name).records.first().has_diff == flag
    with pytest.raises(ValueError, match="No such published run"):
        load_run(spark, output, run="none")


def test_inputs_of_a_save_that_broke_off_are_left_out(spark, sides, tmp_path):
    history = str(tmp_path / "history")
    result = run_diff(sides("a"), sides("b"), str(tmp_path / "out"))
    paths = spark.createDataFrame([("x.xml",)], "path string")
    save_run(history, result.metrics, "2024-11-07_03-56-22", inputs=paths)
    paths.selectExpr("'2024-11-08_03-56-22' AS run_timestamp", "path") \
        .write.parquet(f"{history}/inputs/entry=save-lost")
    assert [r.run_timestamp for r in read_run_inputs(spark, history).collect()] == [
        "2024-11-07_03-56-22"]
    assert read_history(spark, history).columns == [
        "run_timestamp", "run_message", "datasets", "part", "source", "field", "metrics"]


def test_no_commits_need_no_python(spark, tmp_path):
    """An output without commits is found empty without a Python worker."""
    none = published_runs(spark, str(tmp_path / "none"))
    assert "ExistingRDD" not in none._jdf.queryExecution().executedPlan().toString()
    assert none.count() == 0 and none.agg({"number": "max"}).first()[0] is None
    assert [f.simpleString() for f in none.schema] == [
        "number:bigint", "run:string", "published_at:timestamp"]
