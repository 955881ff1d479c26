"""Generated metrics, by closed forms of a row's number or seeded random columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Draws of a gamma number, each of which is accepted with a chance of over 0.95.
TRIES = 16


def gaussian(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.randn(seed).alias("x"))


def uniform(spark: SparkSession, n: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """n evenly spaced values, both ends included."""
    return spark.range(n).select("id", (F.lit(lo) + F.col("id") * ((hi - lo) / max(1, n - 1))).alias("x"))


def integers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", F.col("id").cast("double").alias("x"))


def discrete(spark: SparkSession, n: int, cardinality: int) -> DataFrame:
    return spark.range(n).select("id", discrete_number(F.col("id"), cardinality).alias("x"))


def pareto(spark: SparkSession, n: int, shape: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (F.pow(1 - F.rand(seed), -1.0 / shape) - 1).alias("x"))


def drawn(row: Column, seed: int, *more: Column | int) -> Column:
    """A uniform number in (0, 1] from a hash of the row, so that a row is the same whenever it is made again."""
    rest = [F.lit(m) if isinstance(m, int) else m for m in more]
    return (F.pmod(F.xxhash64(F.lit(seed), row, *rest), F.lit(2**53)) + 1) / F.lit(2.0**53)


def normal_number(row: Column, seed: int, *more: Column | int) -> Column:
    return F.sqrt(-2 * F.log(drawn(row, seed, *more, 0))) * F.cos(2 * pi * drawn(row, seed, *more, 1))


def pareto_number(row: Column, shape: float, seed: int) -> Column:
    return F.pow(drawn(row, seed), -1.0 / shape) - 1


def exponential_number(row: Column, scale: float, seed: int) -> Column:
    return -scale * F.log(drawn(row, seed))


def gamma_number(row: Column, shape: float, seed: int) -> Column:
    """Gamma of any shape: a cube of a shifted normal, the first of TRIES that is accepted, lowered by a power of a uniform number."""
    d = shape + 1 - 1 / 3
    c = 1 / (9 * d) ** 0.5

    def trial(k):
        z = normal_number(row, seed, k)
        v = F.pow(1 + c * z, 3)
        accepted = (v > 0) & (F.log(drawn(row, seed, k, 2)) < z * z / 2 + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        return F.when(accepted, d * v)

    first = F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES)), trial), lambda x: x.isNotNull())
    return F.get(first, F.lit(0)) * F.pow(drawn(row, seed, 0, 3), 1 / shape)


def discrete_number(row: Column, cardinality: int) -> Column:
    return (row % cardinality) / (cardinality - 1)


def gamma(spark: SparkSession, n: int, shape: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", gamma_number(F.col("id"), shape, seed).alias("x"))


def exponential(spark: SparkSession, n: int, scale: float = 1.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (-scale * F.log(1 - F.rand(seed))).alias("x"))


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def with_outliers(df: DataFrame, row_id: str, x: str, share: float, scale: float, distance: float) -> DataFrame:
    """df and, behind it, a transformed copy of its first share of rows; ids are dense from 0."""
    n = df.agg((F.max(row_id) + 1).alias("_n"))
    first = df.join(F.broadcast(n), F.col(row_id) < F.floor(F.lit(share) * F.col("_n"))).drop("_n")
    return df.unionByName(first.withColumn(x, F.col(x) * scale + distance))


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, to multiply a load."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def nearest_ten_minutes(ts: Column) -> Column:
    """The nearest ten-minute mark; halves go to the even mark."""
    minutes = F.unix_micros(ts) / F.lit(600_000_000)
    return F.timestamp_micros((F.bround(minutes, 0) * F.lit(600_000_000)).cast("long"))
