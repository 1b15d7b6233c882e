"""Centroids of hot windows and distances from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Metric
from ..functions import cosine_distance, euclidean

#: Dimensions up to which each has an aggregate of its own; beyond, elements become rows.
WIDE = 128


def centroids(hot: DataFrame, dim: int) -> DataFrame:
    """(sensor_id, rows, centroid): element-wise means of unnormalised vectors; partial sums before the shuffle."""
    if dim <= WIDE:
        sums = [F.avg(F.col("vec")[i].cast("double")).alias(f"m{i}") for i in range(dim)]
        out = hot.groupBy("sensor_id").agg(F.count("*").alias("rows"), *sums)
        return out.select("sensor_id", "rows", F.array(*[f"m{i}" for i in range(dim)]).alias("centroid"))
    each = hot.select("sensor_id", F.posexplode("vec").alias("pos", "x")).groupBy("sensor_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return each.groupBy("sensor_id").agg(F.max("n").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def distance(a: Column, b: Column, metric: Metric) -> Column:
    """1 - cosine (1 for a zero vector), or the square root of the squared euclidean distance."""
    return F.round(cosine_distance(a, b) if metric == Metric.COSINE else euclidean(a, b), 6)


def detect(candidates: DataFrame, hot: DataFrame, dim: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """candidates(sensor_id, cid, vec, threshold) -> (sensor_id, cid, distance, is_anomaly).

    A sensor with no hot row has no distance and no anomaly.  The centroids, a row per sensor, join on the sensor.
    """
    both = candidates.join(centroids(hot, dim), "sensor_id", "left")
    d = distance(F.col("centroid"), F.col("vec"), metric)
    return both.withColumn("distance", F.when(F.col("centroid").isNotNull(), d)).select(
        "sensor_id", "cid", "distance", F.coalesce((F.col("distance") > F.col("threshold")).cast("int"), F.lit(0)).alias("is_anomaly")
    )


def rolling(entries: DataFrame, dim: int, capacity: int, threshold: float, metric: Metric = Metric.COSINE, window_ms: int | None = None) -> DataFrame:
    """Detect, then append: each row against the centroid of the window before it.

    (sensor_id, seq, distance, is_anomaly); where the window is empty there is nothing to differ from.  The window is
    the capacity rows before; with window_ms, as after a pass that follows every append: of those rows, the ones from the
    first no older than window_ms before the latest (0 leaves none).  No earlier pass can have taken more: what drove
    it out is still among those rows, or they are all later.  One window over one sort; a row holds at most capacity
    others at a time.
    """
    before = Window.partitionBy("sensor_id").orderBy("seq").rowsBetween(-capacity, -1)
    if window_ms is None and dim <= WIDE:
        means = [F.avg(F.col("vec")[i].cast("double")).over(before).alias(f"m{i}") for i in range(dim)]
        rows = entries.select("sensor_id", "seq", "vec", F.count("*").over(before).alias("n"), *means).withColumn("centroid", F.array(*[f"m{i}" for i in range(dim)]))
    else:
        rows = entries.select("sensor_id", "seq", "vec", F.collect_list(F.struct("ts", "vec")).over(before).alias("w"))
        if window_ms is not None:
            cutoff = F.array_max(F.transform("w", lambda x: x["ts"])) - window_ms
            first = F.greatest(F.array_position(F.transform("w", lambda x: x["ts"] >= F.col("cutoff")), True), F.lit(1)).cast("int")
            kept = F.slice("w", F.col("first"), F.size("w") - F.col("first") + 1) if window_ms else F.slice("w", 1, 0)
            rows = rows.withColumn("cutoff", cutoff).withColumn("first", first).withColumn("w", kept)
        mean = lambda i: F.aggregate("w", F.lit(0.0), lambda s, x: s + x["vec"][i].cast("double")) / F.col("n")
        rows = rows.withColumn("n", F.size("w")).withColumn("centroid", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), mean)))
    d = F.when(F.col("n") > 0, distance(F.col("centroid"), F.col("vec"), metric))
    return rows.withColumn("distance", d).select("sensor_id", "seq", "distance", F.coalesce((F.col("distance") > threshold).cast("int"), F.lit(0)).alias("is_anomaly"))
