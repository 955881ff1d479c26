"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows handed to one call of a batch function.
ROWS_PER_CALL = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a folder of this machine, which only a local session may use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("/tmp/checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage in the shared folder of spark.checkpoint.dir."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remainder(doc_id: Column, of: int = 5) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def place(*columns: str) -> Column:
    """A whole number from 0 to 2 ** 63 - 1 that looks drawn at random for each different row of columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def place_limit(wanted: int, of: int) -> int:
    """The greatest place up to which about `wanted` of so many rows lie, and all if there are no more; over 0 for any table."""
    return 2**63 - 1 if of <= wanted else max(1, wanted * 2**63 // of)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list]]) -> DataFrame:
    """df with `fields` computed from the columns `inputs`, in Arrow batches.

    make() is called once a task and gives a function of Python lists, one per input, that returns
    one list per field. Columns of df that have a field's name are replaced.
    """
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    source = [f"_in{i}" for i in range(len(inputs))]
    wide = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(s) for c, s in zip(inputs, source, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_CALL):
                batch = whole.slice(start, ROWS_PER_CALL)
                found = compute(*[batch.column(len(kept) + i).to_pylist() for i in range(len(source))])
                columns = [batch.column(i) for i in range(len(kept))]
                columns += [pa.array(v, t) for v, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return wide.mapInArrow(run, schema)
