"""Registry of the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from blockloom.sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Columns in the portable types results are compared in: bigint, double (6 digits), string, boolean."""
    def portable(field: T.StructField):
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.TimestampType):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        if isinstance(kind, T.DateType):
            return F.date_format(column, "yyyy-MM-dd")
        if isinstance(kind, T.IntegralType):
            return column.cast("bigint")
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            return F.round(column.cast("double"), 6)
        if isinstance(kind, T.ArrayType):
            return F.array_join(column.cast("array<string>"), ",")
        return column

    return df.select(*[portable(f).alias(f.name) for f in df.schema.fields])


def query(key: str):
    """Register a function of the derived tables under a key."""
    def register(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(Fixtures(spark, sf_dir)))

        QUERIES[key] = run
        return build

    return register
