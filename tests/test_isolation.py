import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordlens import (
    Isolated, VersionFailed, compare_transforms, load_run, read_failures, run_versions,
)
from tests.test_collate import transform


def records(numbers):
    n = len(numbers)
    return pa.table({
        "record_id": [str(x) for x in numbers], "source": ["s"] * n,
        "run_date": pa.array(["2024-01-01"] * n).cast(pa.date32()), "run_type": ["full"] * n,
        "action": ["index"] * n,
        "transformed_record": pa.array([b'{"v":%d}' % x for x in numbers], pa.binary())})


def isolated(spark, bad=(), **options):
    calls = spark.sparkContext.accumulator(0)
    made = records

    def work(rows):
        calls.add(1)
        numbers = rows["n"].to_pylist()
        for n in numbers:
            if n in bad:
                raise KeyError(f"no {n}")
        return made(numbers)

    return Isolated(work, part=F.expr("n div 10"), row=F.col("n"), **options), calls


@pytest.fixture
def numbers(spark):
    return spark.range(100).select(F.col("id").cast("int").alias("n")).coalesce(2)


def test_failing_rows_are_found_by_halving(spark, numbers):
    good, _ = isolated(spark)
    bad, _ = isolated(spark, {0, 7, 33, 34, 99}, rows_per_call=16)
    run = run_versions(numbers, good, bad, strict=False)
    assert run.a.count() == 100
    assert {int(r.record_id) for r in run.b.collect()} == {*range(100)} - {0, 7, 33, 34, 99}
    found = sorted(tuple(r) for r in run.failures.collect())
    assert found == sorted(("b", str(n // 10), str(n), f"KeyError: 'no {n}'")
                           for n in (0, 7, 33, 34, 99))
    assert run.rejects.count() == 0 and run.b.columns == run.a.columns


def test_strict_mode_counts_the_parts(spark, numbers):
    good, _ = isolated(spark)
    bad, _ = isolated(spark, {0, 7, 33, 99})
    with pytest.raises(VersionFailed, match="3 / 20 parts failed to complete successfully."):
        run_versions(numbers, good, bad)
    assert run_versions(numbers, good, isolated(spark)[0]).failures.count() == 0


def test_calls(spark, numbers):
    """One call per piece where nothing fails; by row, one per row in any case."""
    good, calls = isolated(spark)
    run = run_versions(numbers, good, good)
    assert (run.a.count(), run.b.count(), calls.value) == (100, 100, 20)

    by_row = spark.sparkContext.accumulator(0)
    made = records

    def work(row):
        by_row.add(1)
        if row["n"] % 7 == 0:
            return None
        if row["n"] % 9 == 0:
            return {"source": 1 / 0}
        return made([row["n"]] * 2).to_pylist()

    run = run_versions(numbers, good, Isolated(work, by_row=True, row=F.col("n")), strict=False)
    failed = [n for n in range(100) if n % 9 == 0 and n % 7]
    assert by_row.value == 100
    assert run.b.count() == 2 * sum(1 for n in range(100) if n % 7 and n % 9)
    assert sorted(int(r.row) for r in run.failures.collect()) == failed
    assert {r.message for r in run.failures.collect()} == {"ZeroDivisionError: division by zero"}


def test_results_that_do_not_fit_are_errors(spark, numbers):
    made = records

    def work(rows):
        out = made(rows["n"].to_pylist())
        return out.drop_columns(["source"]) if 5 in rows["n"].to_pylist() else out

    good, _ = isolated(spark)
    run = run_versions(numbers, good, Isolated(work, row=F.col("n")), strict=False)
    assert [(r.row, r.part) for r in run.failures.collect()] == [("5", "")]
    assert run.b.count() == 99


def test_rejects_and_failures_side_by_side(spark, numbers):
    bad, _ = isolated(spark, {3})
    run = run_versions(numbers, transform("try_divide(10, n)"), bad, strict=False)
    assert [(r.version, r.record_id) for r in run.rejects.collect()] == [("a", "0")]
    assert [(r.version, r.row) for r in run.failures.collect()] == [("b", "3")]
    empty = run_versions(numbers.limit(0), bad, bad)
    assert (empty.a.count(), empty.failures.count()) == (0, 0)


def test_a_comparison_stores_each_version_once(spark, numbers, tmp_path):
    bad, _ = isolated(spark, {3, 50})
    out = str(tmp_path / "out")
    scratch = set((tmp_path / "..").resolve().rglob("staged-*"))
    result = compare_transforms(numbers, isolated(spark)[0], bad, out, strict=False)
    missing = [r.record_id for r in result.records.filter("a_or_b_missing = 1").collect()]
    assert sorted(missing) == ["3", "50"] and result.records.count() == 100
    assert sorted(r.row for r in read_failures(spark, out).collect()) == ["3", "50"]
    assert sorted(p.name for p in (tmp_path / "out/transformed").iterdir()) == ["a", "b"]
    stored = {v: spark.read.parquet(f"{out}/transformed/{v}/dataset").count() for v in "ab"}
    assert stored == {"a": 100, "b": 100}  # the failed rows' errors are among them
    assert set((tmp_path / "..").resolve().rglob("staged-*")) == scratch
    assert load_run(spark, out).records.count() == 100
