"""Readers: delimited, fixed-width, JSON, XML, Parquet, folders, warehouse tables, listings, previews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensdq.functions.columns import quoted

SEPARATORS = [",", "\t", "|", ";"]
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*){0,2}$")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", **options) -> DataFrame:
    """Header csv; without a schema Spark infers types in one extra pass."""
    reader = spark.read.option("header", True).option("sep", sep).options(**options)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def json_tables(df: DataFrame) -> dict[str, DataFrame]:
    """One table per list of records in a JSON object; an object without lists is one flat table."""
    lists = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    ]
    if not lists:
        return {"data": flatten(df)}
    return {n: flatten(df.select(F.explode(quoted(n)).alias("r")).select("r.*")) for n in lists}


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns."""
    out = []

    def walk(prefix: str, path: str, fields) -> None:
        for f in fields:
            name, ref = f"{prefix}{f.name}", f"{path}{quoted(f.name)}"
            if isinstance(f.dataType, T.StructType):
                walk(f"{name}.", f"{ref}.", f.dataType.fields)
            else:
                out.append(F.col(ref).alias(name))

    walk("", "", df.schema.fields)
    return df.select(*out)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", row_tag)
    return reader.schema(schema).xml(path) if schema is not None else reader.xml(path)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The first separator that splits the header line into more than one column."""
    first = spark.read.text(path).first()
    line = first["value"] if first else ""
    return next((s for s in SEPARATORS if s in line), ",")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep=sniff_separator(spark, path))


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]]) -> DataFrame:
    """Trimmed text columns cut at declared (name, start, width); start counts from 1."""
    line = spark.read.text(path)
    return line.select(*[F.trim(F.substring("value", start, width)).alias(name) for name, start, width in fields])


READERS = {"csv": read_csv, "tsv": read_tsv, "parquet": read_parquet, "json": read_json, "txt": read_delimited}


def read_folder(spark: SparkSession, paths: list[str], row_tag: str = "row", layouts: dict[str, list[tuple[str, int, int]]] | None = None) -> dict[str, DataFrame]:
    """One table per data file or data directory, named after its stem; the ending picks the reader.

    XML entries hold one record per ``row_tag``; an entry whose stem has a layout is fixed-width
    text, whatever its ending.
    """
    tables = {}
    for path in paths:
        stem, _, ending = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
        if stem in (layouts or {}):
            tables[stem] = read_fixed_width(spark, path, layouts[stem])
        elif ending.lower() == "xml":
            tables[stem] = read_xml(spark, path, row_tag)
        elif ending.lower() in READERS:
            tables[stem] = READERS[ending.lower()](spark, path)
    return tables


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder on any file system Spark can reach."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().toString()) for s in system.listStatus(hadoop))


def warehouse_options(url: str, table: str | None = None, query: str | None = None, **extra: str) -> dict[str, str]:
    """JDBC options for a checked table name or a verbatim query; no row limit is added."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table and query")
    if table is not None and not IDENTIFIER.match(table):
        raise ValueError(f"not a plain identifier: {table!r}")
    return {"url": url, **({"dbtable": table} if table is not None else {"query": query}), **extra}


def read_warehouse(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, **extra: str) -> DataFrame:
    """Filters, columns and limits applied later are pushed into the warehouse by Spark's JDBC source.

    Pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel.
    """
    return spark.read.format("jdbc").options(**warehouse_options(url, table, query, **extra)).load()


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.database or "", t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "database string, table_name string, table_type string, is_temporary boolean")


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Row count, column count and column list of one table."""
    cols = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), F.lit(cols).alias("columns")
    )


def preview(df: DataFrame, n: int = 5, order: list[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
