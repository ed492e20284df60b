import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    rows = [
        (100.0, 1, "East", "A", "2024-01-15", "  Alice  ", 10.5),
        (200.0, 2, "West", "B", "2024-02-20", "Bob", -5.0),
        (300.0, 3, "East", "A", "2024-03-10", "Charlie", 30.0),
        (400.0, 4, "West", "B", "2024-04-05", "Diana", 0.0),
        (500.0, 5, "East", "C", "2024-05-25", "Eve", 15.5),
    ]
    df = spark.createDataFrame(rows, "Sales double, Quantity bigint, Region string, Category string, d string, Name string, Profit double")
    return df.withColumn("Date", df.d.cast("timestamp")).drop("d")


@pytest.fixture(scope="session")
def sales_nulls(spark):
    rows = [(100.0, "East", 1.0), (None, None, 2.0), (300.0, "East", float("nan")), (None, "West", 4.0), (500.0, None, 5.0)]
    return spark.createDataFrame(rows, "Sales double, Region string, Value double")


@pytest.fixture(scope="session")
def sales_empty(spark):
    return spark.createDataFrame([], "Sales double, Region string, At timestamp")
