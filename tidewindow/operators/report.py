"""Statistics over the log and its window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Dtype


def sensors(entries: DataFrame) -> DataFrame:
    return entries.select("sensor_id").distinct().orderBy("sensor_id")


def block_bytes(rows, config: Config):
    """Serialized size of a block: header, timestamps, vectors, scales, payloads, checksum.  Column or number in, same out."""
    each = 8 + config.dim * (1 if config.dtype == Dtype.INT8 else 4) + (4 if config.dtype == Dtype.INT8 else 0) + config.payload_size
    return rows * each + 44


def hot_bytes(entries: DataFrame, config: Config) -> DataFrame:
    """(sensor_id, hot_bytes): what a ring of the sensor takes, however full."""
    return sensors(entries).withColumn("hot_bytes", F.lit(config.ring_capacity * config.row_bytes).cast("long"))


def totals(entries: DataFrame, capacity: int, ring_bytes: int) -> DataFrame:
    """One row: sensors, appends, overwritten entries, bytes of rings."""
    per = entries.groupBy("sensor_id").agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("sensor_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_appends"),
        F.coalesce(F.sum(F.greatest(F.lit(0).cast("long"), F.col("n") - capacity)), F.lit(0)).alias("total_overwritten"), (F.count("*") * ring_bytes).alias("hot_bytes"),
    )


def percentiles(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """p50, p95, p99, p999 and the largest: the value at rank floor((n - 1) q), from 0."""
    keys = [by] if by else []
    values = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))  # equal values fold before the sort
    order = Window.partitionBy(*keys).orderBy(column)
    run = values.withColumn("__upto", F.sum("__n").over(order)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    at = lambda q: F.min(F.when(F.col("__upto") > F.floor((F.col("__all") - 1) * F.lit(q)), F.col(column)))
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999, "largest": 1.0}
    return run.groupBy(*keys).agg(*[at(q).alias(n) for n, q in names.items()])


def growth(df: DataFrame, value: str, order: str, baseline: float) -> DataFrame:
    """Percent change of value against a baseline."""
    return df.orderBy(order).withColumn("growth_pct", (F.col(value) - baseline) / baseline * 100)


def means(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """The mean of each column (nulls left out) as mean_<column>; partial sums before the shuffle."""
    return df.groupBy(*([by] if by else [])).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
