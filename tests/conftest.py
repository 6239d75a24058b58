import datetime
import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from recordlens.columns import collated_schema, version_schema  # noqa: E402

DAY = datetime.date(2024, 10, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("recordlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def payload(record):
    return None if record is None else bytearray(json.dumps(record).encode())


@pytest.fixture(scope="session")
def make_collated(spark):
    def make(rows):
        """rows: (id, source, record A, record B)"""
        return spark.createDataFrame(
            [(None, i, s, DAY, "full", "index", payload(a), payload(b))
             for i, s, a, b in rows], collated_schema())
    return make


@pytest.fixture(scope="session")
def make_version(spark):
    def make(rows):
        """rows: (id, source, date, run type, action, record)"""
        return spark.createDataFrame(
            [(i, s, d, t, x, payload(r)) for i, s, d, t, x, r in rows], version_schema())
    return make


# fixed values: golden inputs
@pytest.fixture(scope="session")
def collated(make_collated):
    return make_collated([
        ("abc123", "alma",
         {"material": "concrete", "color": "green", "number": 42},
         {"material": "concrete", "color": "red", "number": 42}),
        ("def456", "dspace",
         {"material": "concrete", "color": "blue", "number": 101},
         {"material": "concrete", "color": "blue", "number": 101}),
        ("ghi789", "libguides",
         {"material": "concrete", "color": "purple", "number": 13, "fruit": "apple"},
         {"material": "concrete", "color": "brown", "number": 99}),
    ])


@pytest.fixture(scope="session")
def diffs(collated):
    from recordlens import diff_records
    return diff_records(collated).cache()
