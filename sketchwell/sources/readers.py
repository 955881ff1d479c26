"""Scans, sinks and run configurations."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; zoneless times are read as instants of the session's zone."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.withColumns({f.name: F.col(f.name).cast("timestamp") for f in found.schema if isinstance(f.dataType, T.TimestampNTZType)})


def csv_column(spark: SparkSession, path: str, column: int, header: bool = True, limit: int | None = None) -> DataFrame:
    """(x): one numeric column of a CSV file by its place; the others are not parsed. Quoted fields are read as such."""
    names = spark.read.option("header", header).csv(path).columns
    schema = T.StructType([T.StructField(n, T.DoubleType() if i == column else T.StringType()) for i, n in enumerate(names)])
    found = spark.read.schema(schema).option("header", header).csv(path).select(F.col(f"`{names[column]}`").alias("x"))
    return found if limit is None else found.limit(limit)


def grouped_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(data): one array of numbers a line, written `[a,b,..]`, in quotes if it has commas."""
    lines = spark.read.schema("data string").option("header", header).option("sep", "\x01").csv(path)
    return lines.select(F.from_json(F.regexp_replace("data", '"', ""), "array<double>").alias("data"))


def results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several result files with one header each."""
    return spark.read.option("header", True).option("inferSchema", True).csv(paths)


def write_results(df: DataFrame, path: str, stamp: bool = False) -> str:
    """CSV with a header; with stamp the seconds since 1970 end the name. Returns the path."""
    path = f"{path}_{int(time.time())}" if stamp else path
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


@dataclass
class RunConfig:
    """A JSON run configuration."""

    values: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> RunConfig:
        return cls(json.loads(Path(path).read_text()))

    @classmethod
    def parse(cls, text: str) -> RunConfig:
        return cls(json.loads(text))

    def get(self, key: str, *default):
        if key not in self.values and not default:
            raise KeyError(key)
        return self.values.get(key, *default)
