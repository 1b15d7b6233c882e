"""Exact nearest neighbours and time ranges over hot rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Metric
from ..functions import cosine, euclidean_sq, int8_cosine, int8_euclidean_sq, norm, quantize
from ..functions.vectors import literal

#: Decimals at which scores are compared; ties go to the earlier arrival.
DECIMALS = 6
#: Bytes of queries that are broadcast together, and in all; cells of a matrix of scores.
BATCH, MOST, CELLS = 16 << 20, 256 << 20, 1 << 21


def score(rows: DataFrame, target: Column, metric: Metric) -> Column:
    """Cosine similarity (larger is nearer) or squared euclidean distance; INT8 rows compare with a quantized target."""
    if "vec" in rows.columns:
        s = cosine(F.col("vec"), target, F.col("norm") if "norm" in rows.columns else None) if metric == Metric.COSINE else euclidean_sq(F.col("vec"), target)
    else:
        q = quantize(target)
        f = int8_cosine if metric == Metric.COSINE else int8_euclidean_sq
        s = f(F.col("q8"), F.col("scale"), F.col("norm"), q["q8"], q["scale"], norm(target).cast("float"))
    s = F.round(s, DECIMALS)
    return F.when(~F.isnan(s), s)


def best_first(metric: Metric) -> list[Column]:
    return [F.desc_nulls_last("score") if metric == Metric.COSINE else F.asc_nulls_last("score"), F.asc("seq")]


def nearest(hot: DataFrame, sensor_id: str, target: Sequence[float], n: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """(ts, seq, score), best first: a filter that reaches the scan, a projection, and TakeOrderedAndProject."""
    rows = hot.filter(F.col("sensor_id") == sensor_id)
    return rows.select("ts", "seq", score(rows, literal(target), metric).alias("score")).orderBy(*best_first(metric)).limit(n)


def nearest_each(hot: DataFrame, queries: DataFrame, n: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """queries(qid, sensor_id, target) -> (qid, sensor_id, ts, seq, score, rank), in stock functions.

    An equi-join on the sensor; row_number() <= n is limited before the shuffle.
    """
    pairs = hot.join(queries.select("qid", "sensor_id", "target"), "sensor_id")
    scored = pairs.select("qid", "sensor_id", "ts", "seq", score(hot, F.col("target"), metric).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid", "sensor_id").orderBy(*best_first(metric)))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def nearest_batch(hot: DataFrame, queries: DataFrame, n: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """As nearest_each, by matrix products over Arrow batches, for float and for INT8 rows.

    Queries are broadcast BATCH bytes at a time, MOST bytes in all; more of them are joined instead.  A task keeps the
    n best of each query over all its rows, so at most n rows per query and task are shuffled.
    """
    asked = queries.select("qid", "sensor_id", "target")
    size = asked.agg(F.sum(F.size("target") * 8 + F.octet_length("sensor_id") + 16)).first()[0] or 0
    if size > MOST:
        return nearest_each(hot, queries, n, metric)
    int8 = "vec" not in hot.columns
    if int8:
        asked = asked.select("qid", "sensor_id", "target", quantize(F.col("target")).alias("q")).select("qid", "sensor_id", F.col("q.q8").alias("target"), F.col("q.scale").alias("scale"), norm(F.col("target")).cast("float").alias("norm"))
    wanted = asked.toArrow()
    step = max(1, wanted.num_rows * BATCH // max(1, size))
    parts = [_batch(hot.sparkSession, hot, wanted.slice(i, step), n, metric, int8) for i in range(0, max(1, wanted.num_rows), step)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("qid", "sensor_id").orderBy(*best_first(metric)))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class _Side:
    """Vectors of one side: as they are, or INT8 codes with what scales their products (scale, and norm as given)."""

    def __init__(self, matrix: np.ndarray, scale: np.ndarray | None, norms: np.ndarray | None):
        self.matrix = matrix
        self.scale = np.ones(len(matrix)) if scale is None else scale.astype(np.float64)
        self.norms = np.sqrt((matrix * matrix).sum(1)) if norms is None else norms.astype(np.float64)

    def take(self, at) -> _Side:
        return _Side(self.matrix[at], self.scale[at], self.norms[at])


def _keys(q: _Side, x: _Side, metric: Metric) -> np.ndarray:
    """Smaller is nearer: minus the cosine, or the squared distance."""
    dots = q.matrix @ x.matrix.T
    if metric == Metric.COSINE:
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right = (np.where((s.norms > 0) & (s.scale > 0), s.scale / s.norms, 0) for s in (q, x))
        dots *= -left[:, None]
        dots *= right
        return dots
    dots *= -2 * q.scale[:, None]
    dots *= x.scale
    dots += (q.norms * q.norms)[:, None]
    dots += x.norms * x.norms
    return np.maximum(dots, 0, out=dots)


def _best(keys: np.ndarray, ts: np.ndarray, seq: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The n best columns of each row, rounded, ties to the earlier seq; missing ones have an infinite key."""
    rows = len(keys)
    if keys.shape[1] > n:  # whatever may tie with the n-th after rounding stays in
        worst = np.partition(keys, n - 1, axis=1)[:, n - 1]
        r, c = np.nonzero(keys <= worst[:, None] + 2 * 10.0**-DECIMALS)
    else:
        r, c = (a.ravel() for a in np.indices(keys.shape))
    key = np.round(keys[r, c], DECIMALS)
    order = np.lexsort((seq[c], key, r))
    r, c, key = r[order], c[order], key[order]
    place = np.arange(len(r)) - np.searchsorted(r, np.arange(rows))[r]
    ok = place < n
    out = np.full((rows, n), np.inf), np.zeros((rows, n), np.int64), np.zeros((rows, n), np.int64)
    for a, v in zip(out, (key, ts[c], seq[c])):
        a[r[ok], place[ok]] = v[ok]
    return out


def _batch(spark, hot: DataFrame, wanted: pa.Table, n: int, metric: Metric, int8: bool) -> DataFrame:
    column = lambda name: wanted.column(name).to_numpy() if int8 else None
    side = _Side(_matrix(wanted.column("target").combine_chunks()), column("scale"), column("norm"))
    of: dict[str, list[int]] = {}
    for i, s in enumerate(wanted.column("sensor_id").to_pylist()):
        of.setdefault(s, []).append(i)
    shared = spark.sparkContext.broadcast((side, wanted.column("qid").to_numpy(), {s: np.array(i) for s, i in of.items()}))

    def run(batches):
        targets, ids, by = shared.value
        best: dict[str, tuple[np.ndarray, ...]] = {}
        asked: dict[str, _Side] = {}
        for b in batches:
            codes = b.column(0).dictionary_encode()
            number, ts, seq = codes.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            rows = _Side(_matrix(b.column(3)), b.column(4).to_numpy() if int8 else None, b.column(5).to_numpy() if int8 else None)
            for code, sensor in enumerate(codes.dictionary.to_pylist()):
                if sensor not in by:
                    continue
                at = np.flatnonzero(number == code)
                q, x = asked.setdefault(sensor, targets.take(by[sensor])), rows.take(at) if len(at) < len(number) else rows
                step = max(1, CELLS // max(1, len(at)))
                found = [_best(_keys(q.take(slice(i, i + step)), x, metric), ts[at], seq[at], n) for i in range(0, len(q.norms), step)]
                new = tuple(np.concatenate(c) for c in zip(*found))
                if sensor in best:
                    both = [np.concatenate(c, axis=1) for c in zip(best[sensor], new)]
                    order = np.lexsort((both[2], both[0]), axis=1)[:, :n]
                    new = tuple(np.take_along_axis(c, order, 1) for c in both)
                best[sensor] = new
        for sensor, (key, ts, seq) in best.items():
            r, c = np.nonzero(np.isfinite(key))
            score = (-key if metric == Metric.COSINE else key)[r, c] + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(ids[by[sensor]][r]), pa.array([sensor] * len(r), pa.string()), pa.array(ts[r, c]), pa.array(seq[r, c]), pa.array(score)], ["qid", "sensor_id", "ts", "seq", "score"])

    columns = ["q8", "scale", "norm"] if int8 else ["vec"]
    return hot.select("sensor_id", "ts", "seq", *columns).mapInArrow(run, "qid long, sensor_id string, ts long, seq long, score double")


def in_range(hot: DataFrame, sensor_id: str, t_start: int, t_end: int, limit: int) -> DataFrame:
    """(ts, seq, vec), the first limit rows of the closed range in arrival order."""
    return hot.filter((F.col("sensor_id") == sensor_id) & F.col("ts").between(t_start, t_end)).orderBy("seq").limit(limit).select("ts", "seq", "vec")


def range_flags(hot: DataFrame, sensor_id: str, t_start: int, t_end: int, limit: int) -> DataFrame:
    """(truncated, limited, matching): whether the range begins before the oldest hot row, and whether limit cuts it."""
    rows = hot.filter(F.col("sensor_id") == sensor_id)
    hit = F.count(F.when(F.col("ts").between(t_start, t_end), 1))
    return rows.agg(F.coalesce(F.lit(t_start) < F.min("ts"), F.lit(False)).alias("truncated"), (hit > limit).alias("limited"), hit.alias("matching"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of truth's first k seqs that found's first k hold; both (qid, rank, seq)."""
    top = lambda df, name: df.filter(F.col("rank") <= k).groupBy("qid").agg(F.collect_list("seq").alias(name))
    both = top(truth, "want").join(top(found, "have"), "qid", "left")
    return both.select("qid", (F.size(F.array_intersect("want", F.coalesce("have", F.array().cast("array<long>")))) / F.lit(k)).alias("recall"))
