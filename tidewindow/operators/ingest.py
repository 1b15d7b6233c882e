"""From raw rows to entries: validation, norms, quantization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, Dtype, valid_sensor_id, valid_vector
from ..functions import dequantize, norm, quantize


def entries(rows: DataFrame, config: Config) -> DataFrame:
    """rows(sensor_id, seq, ts, vec[, payload]) with norm (of the vector as given) and, for INT8, q8 and scale in place
    of vec.  Invalid rows raise when the plan runs.  Projections only: no shuffle."""
    ok = valid_sensor_id(F.col("sensor_id")) & valid_vector(F.col("vec"), config.dim)
    payload = F.col("payload") if "payload" in rows.columns else F.lit(None).cast("binary")
    if config.payload_size:
        ok = ok & (payload.isNull() | (F.octet_length(payload) == config.payload_size))
    else:
        payload = F.lit(None).cast("binary")
    vec = F.when(ok, F.col("vec")).otherwise(F.raise_error(F.lit("invalid sensor id, vector or payload")).cast("array<float>")).cast("array<float>")
    out = rows.select("sensor_id", F.col("seq").cast("long"), F.col("ts").cast("long"), vec.alias("vec"), payload.alias("payload")).withColumn("norm", norm(F.col("vec")).cast("float"))
    if config.dtype == Dtype.INT8:
        out = out.withColumn("__q", quantize(F.col("vec"))).select("sensor_id", "seq", "ts", "payload", "norm", F.col("__q.q8").alias("q8"), F.col("__q.scale").alias("scale"))
    return out


def with_vectors(df: DataFrame) -> DataFrame:
    """With vec, dequantized where rows hold INT8."""
    return df if "vec" in df.columns else df.withColumn("vec", dequantize(F.col("q8"), F.col("scale")))
