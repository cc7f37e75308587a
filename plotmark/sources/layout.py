"""Delimited text read through a column dictionary."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Data types a column dictionary may name.
LAYOUT_TYPES = {
    "str": T.StringType(),
    "object": T.StringType(),
    "string": T.StringType(),
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "double": T.DoubleType(),
    "int": T.LongType(),
    "int64": T.LongType(),
    "long": T.LongType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
}


def schema_from_layout(layout: DataFrame, table: str) -> T.StructType:
    """Full file schema of one table, in file order.

    ``layout`` has one row per column: ``table_name``, ``position`` (0-based),
    ``field_name``, ``data_type``. A dictionary is at most a few hundred rows.
    """
    rows = (
        layout.filter(F.col("table_name") == table)
        .orderBy("position")
        .select("position", "field_name", "data_type")
        .collect()
    )
    if not rows:
        raise ValueError(f"no layout rows for table {table!r}")
    if [r.position for r in rows] != list(range(len(rows))):
        raise ValueError(f"layout of {table!r} must list every position once, from 0")
    return T.StructType([T.StructField(r.field_name, LAYOUT_TYPES[r.data_type]) for r in rows])


def pick_ordinals(schema: T.StructType, ordinals: Iterable[int]) -> list[str]:
    return [schema.fields[i].name for i in ordinals]


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    *,
    columns: Sequence[str] | None = None,
    sep: str = "|",
    header: bool = False,
    encoding: str = "ISO-8859-1",
    quote: str | None = None,
    row_cap: int | None = None,
    file_column: str | None = None,
    reject_column: str | None = None,
) -> DataFrame:
    """Read delimited files with a declared schema.

    Quoting is off unless ``quote`` is given, so a stray quote mark in a record is
    plain text. Only ``columns`` are parsed (CSV column pruning).

    A record with too many or too few fields, or a field of the wrong type, keeps what could be
    read. With ``reject_column`` its whole text is in that column, which is null for good
    records. The number of fields is always checked, a field's type where a query reads it.
    ``row_cap`` takes any rows, as files have no order.
    """
    if reject_column:
        schema = T.StructType([*schema, T.StructField(reject_column, T.StringType())])
        columns = [*(columns or schema.names[:-1]), reject_column]
    reader = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("encoding", encoding)
        .option("quote", quote or "")
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", not header)
    )
    if reject_column:
        reader = reader.option("columnNameOfCorruptRecord", reject_column).option("columnPruning", False)
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.csv(paths)
    selected = [F.col(f"`{c}`") for c in (columns or schema.names)]
    if file_column:
        selected.append(F.col("_metadata.file_name").alias(file_column))
    df = nan_to_null(df.select(*selected))
    return df if row_cap is None else df.limit(row_cap)


def union_csv(spark: SparkSession, pattern: str, schema: T.StructType, file_column: str = "source_file") -> DataFrame:
    """All CSV files of a folder that share one header, each row with its file name."""
    return read_delimited(
        spark, pattern, schema, sep=",", header=True, encoding="UTF-8", quote='"', file_column=file_column
    )


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columnar input."""
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the source files; aggregates must skip it (rule Q2)."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        *[
            F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))).alias(c) if c in floats else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast a list of columns; text that is no number becomes null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()})


def valid_points(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows with a usable longitude and latitude."""
    return df.filter(F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90))


def ring_bbox(ring: Column) -> dict[str, Column]:
    """Bounding box of a polygon ring, ``array<struct<x,y>>``."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {
        "min_x": F.array_min(xs),
        "min_y": F.array_min(ys),
        "max_x": F.array_max(xs),
        "max_y": F.array_max(ys),
    }
