import os

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from waymill.sources import opl


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def objects(spark):
    """Objects from lines of text, numbered in their order."""

    def make(text, src=0):
        lines = [x.strip() for x in text.strip().splitlines() if x.strip()]
        rows = spark.createDataFrame(list(enumerate(lines)), "_seq long, value string")
        return opl.parse(rows.select("value", F.col("_seq")), src)

    return make


@pytest.fixture(scope="session")
def ids():
    """n1, w2, ... of a DataFrame's rows, sorted; deleted ones and versions on demand."""

    def names(df, version=False):
        rows = df.select("type", "id", "version" if version else "id").collect()
        return sorted(f"{r[0]}{r[1]}" + (f"v{r[2]}" if version else "") for r in rows)

    return names
