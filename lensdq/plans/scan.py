"""Table scans: the six dimensions of many tables, with results small enough to keep on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensdq.operators import dimensions as dim
from lensdq.operators.longform import full_row_counts


@dataclass
class Scan:
    """Results of scanning some tables; every frame has one row per table, column or dimension.

    ``columns`` (table_name, dimension, column_name, score), ``sizes`` (table_name, row_count,
    column_count, duplicate_rows), ``dimensions`` (table_name, dimension, score, status).
    """

    columns: DataFrame
    sizes: DataFrame
    dimensions: DataFrame

    def overall(self) -> DataFrame:
        return dim.overall_scores(self.dimensions, ["table_name"])

    def recommendations(self) -> DataFrame:
        return dim.recommendations(self.dimensions, self.columns, ["table_name"])

    def scorecard(self) -> DataFrame:
        return dim.scorecard(self.dimensions, self.recommendations(), self.sizes)

    def wide(self) -> DataFrame:
        """One row per table: size, six scores, overall score and status."""
        scores = self.dimensions.groupBy("table_name").pivot("dimension", list(dim.DIMENSION_WEIGHTS)).agg(F.max("score"))
        return (
            self.sizes.drop("duplicate_rows")
            .join(scores, "table_name")
            .join(self.overall(), "table_name")
        )

    def history_rows(self) -> DataFrame:
        """``wide`` with the status of every dimension (<dimension>_status), as the scan history keeps it."""
        status = self.dimensions.select("table_name", F.concat(F.col("dimension"), F.lit("_status")).alias("dimension"), "status")
        names = [f"{d}_status" for d in dim.DIMENSION_WEIGHTS]
        return self.wide().join(status.groupBy("table_name").pivot("dimension", names).agg(F.max("status")), "table_name")


def scan_tables(tables: dict[str, DataFrame], as_of: str, max_flag_length: int = 1) -> Scan:
    """Scan each table with one fused aggregate plus one duplicate-row grouping.

    Only scores come back to the driver: one number per column and dimension.
    """
    spark = next(iter(tables.values())).sparkSession
    columns, sizes = [], []
    for name, df in tables.items():
        columns += [
            (name, r["dimension"], r["column_name"], r["score"])
            for r in dim.column_scores(df, as_of, max_flag_length).collect()
        ]
        rows = full_row_counts(df).first()
        sizes.append((name, rows["row_count"], len(df.columns), rows["duplicate_rows"]))
    column_frame = spark.createDataFrame(
        columns, "table_name string, dimension string, column_name string, score double"
    )
    size_frame = spark.createDataFrame(
        sizes, "table_name string, row_count bigint, column_count bigint, duplicate_rows bigint"
    )
    unique = size_frame.select(
        "table_name", F.round(100 - dim.percent(F.col("duplicate_rows"), F.col("row_count")), 2).alias("score")
    )
    return Scan(column_frame, size_frame, dim.dimension_scores(column_frame, unique, ["table_name"]))


def scan_table(df: DataFrame, table_name: str, as_of: str) -> DataFrame:
    return scan_tables({table_name: df}, as_of).wide()
