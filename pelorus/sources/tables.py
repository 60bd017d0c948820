"""Parquet, CSV and JSON tables: views over files, appends, cursors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

#: Tables of the driver's data folders.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def register(spark: SparkSession, folder: str, tables: list[str] = TABLES) -> None:
    """Temp views of a folder's Parquet tables; filters and columns reach the scans."""
    for t in tables:
        scan(spark, folder, t).createOrReplaceTempView(t)


def read_file(spark: SparkSession, path: str, form: str = "csv", **options: str) -> DataFrame:
    """COPY FROM: csv (with header), json, parquet or text."""
    defaults = {"header": "true", "inferSchema": "true"} if form == "csv" else {}
    return spark.read.options(**(defaults | options)).format(form).load(path)


def write_file(df: DataFrame, path: str, form: str = "csv", mode: str = "error", **options: str) -> None:
    """COPY TO."""
    defaults = {"header": "true"} if form == "csv" else {}
    df.write.mode(mode).options(**(defaults | options)).format(form).save(path)


class Portal:
    """A result fetched a few rows at a time; one partition is held at once."""

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self._rows: Iterator[Row] = df.toLocalIterator()
        self.suspended = True

    def fetch(self, max_rows: int = 0) -> list[Row]:
        """The next ``max_rows`` rows, or all that are left for 0."""
        out: list[Row] = []
        for row in self._rows:
            out.append(row)
            if max_rows and len(out) == max_rows:
                return out
        self.suspended = False
        return out
