"""Where models' rows come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Model
from ..errors import QueryError


class ParquetTables:
    """One Parquet file or folder a table, ``{folder}/{table}.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._read = spark, folder.rstrip("/"), {}

    def frame(self, table: str) -> DataFrame:
        if table not in self._read:  # reading looks up files and schema; a query often needs a table again
            self._read[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._read[table]


class FrameTables:
    """Given DataFrames by table name: views, derived tables, other formats."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], rest: ParquetTables | None = None):
        self.spark, self.frames, self.rest = spark, frames, rest

    def frame(self, table: str) -> DataFrame:
        if table in self.frames:
            return self.frames[table]
        if self.rest is None:
            raise QueryError(f"no table {table}")
        return self.rest.frame(table)


def scan(tables, model: Model) -> DataFrame:
    """A model's rows under its logical names; Catalyst prunes what a query does not use."""
    from pyspark.sql import functions as F

    frame = tables.frame(model.table)
    missing = [f.column for f in model.fields.values() if f.column not in frame.columns]
    if missing:
        raise QueryError(f"table {model.table} has no column {', '.join(missing)}")
    return frame.select(*[F.col(f"`{f.column}`").alias(f.name) for f in model.fields.values()])
