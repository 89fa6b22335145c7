import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from careledger import Params, fixture_tables  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.sql.maxPlanStringLength", "2000000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return fixture_tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def params():
    return Params(
        start=date(1997, 1, 1),
        end=date(1997, 12, 31),
        as_of=date(2001, 8, 2),
        platform_payer="PLATFORM",
        flagged_regions=frozenset({"NATION_0", "NATION_5", "NATION_10"}),
    )


@pytest.fixture(scope="session")
def bag():
    """The rows of a frame as a sorted list, for comparing bags."""

    def rows(df, columns=None):
        names = sorted(columns or df.columns)
        return sorted(tuple(map(repr, row)) for row in df.select(*[f"`{n}`" for n in names]).collect())

    return rows
