"""Membership of the hot window, in arrival order.

Of each sensor the last `capacity` arrivals are candidates; from the first of them whose ts is not older than
the newest candidate's minus the window, everything is hot.  An old row behind a fresh one stays.

Only row_number() <= capacity touches order, which Spark limits before the shuffle (WindowGroupLimit), so no more than
capacity rows of a sensor leave a task, whatever share of the log a sensor has.  The log itself is classified by
a join with one row of bounds per sensor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_arrivals(entries: DataFrame, capacity: int) -> DataFrame:
    """The capacity rows of largest seq of each sensor."""
    newest = Window.partitionBy("sensor_id").orderBy(F.desc("seq"))
    return entries.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= capacity).drop("__rank")


def bounds(entries: DataFrame, capacity: int, window_ms: int | None) -> DataFrame:
    """(sensor_id, clamp, first_live, max_ts, total): rows before clamp are overwritten, rows before first_live evicted.

    window_ms None: no pass; 0: a pass that evicts everything; otherwise one time-window pass at the end.
    """
    kept = last_arrivals(entries.select("sensor_id", "seq", "ts"), capacity)
    kept = kept.withColumn("max_ts", F.max("ts").over(Window.partitionBy("sensor_id")))
    if window_ms is None:
        live: Column = F.min("seq")
    elif window_ms == 0:
        live = F.max("seq") + 1
    else:
        live = F.min(F.when(F.col("ts") >= F.col("max_ts") - window_ms, F.col("seq")))
    return kept.groupBy("sensor_id").agg(F.min("seq").alias("clamp"), live.alias("first_live"), F.max("max_ts").alias("max_ts"))


def status(entries: DataFrame, capacity: int, window_ms: int | None) -> DataFrame:
    """entries with status: hot, evicted or overwritten."""
    b = bounds(entries, capacity, window_ms).select("sensor_id", "clamp", "first_live")
    s = F.when(F.col("seq") < F.col("clamp"), "overwritten").when(F.col("seq") < F.col("first_live"), "evicted").otherwise("hot")
    return entries.join(b, "sensor_id").withColumn("status", s).drop("clamp", "first_live")


def hot(entries: DataFrame, capacity: int, window_ms: int | None) -> DataFrame:
    """Only the hot rows; no join: at most capacity rows of a sensor are looked at."""
    kept = last_arrivals(entries, capacity)
    if window_ms is None:
        return kept
    if window_ms == 0:
        return kept.filter(F.lit(False))
    sensor = Window.partitionBy("sensor_id")
    kept = kept.withColumn("__max", F.max("ts").over(sensor))
    kept = kept.withColumn("__first", F.min(F.when(F.col("ts") >= F.col("__max") - window_ms, F.col("seq"))).over(sensor))
    return kept.filter(F.col("seq") >= F.col("__first")).drop("__max", "__first")


def overwrites(entries: DataFrame, capacity: int) -> DataFrame:
    """(sensor_id, appended, overwritten) without evictions."""
    return entries.groupBy("sensor_id").agg(F.count("*").alias("appended")).withColumn("overwritten", F.greatest(F.lit(0).cast("long"), F.col("appended") - capacity))


def eviction_blocks(entries: DataFrame, capacity: int, window_ms: int) -> DataFrame:
    """(sensor_id, rows, t_start, t_end, first_seq, last_seq): the block that one pass evicts, with true bounds."""
    return (
        status(entries, capacity, window_ms).filter("status = 'evicted'").groupBy("sensor_id")
        .agg(F.count("*").alias("rows"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    )


def replay(entries: DataFrame, passes: list[tuple[int, int]], capacity: int) -> DataFrame:
    """status after several passes, each (after how many arrivals of a sensor, window_ms); passes come in order.

    The recurrence is sequential in a sensor, so each sensor replays its own (seq, ts) pairs, no vectors; only one
    number per sensor comes back and joins the log.
    """
    import numpy as np
    import pandas as pd

    def tail_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        ts, seq, tail, lost = pdf["ts"].to_numpy(), pdf["seq"].to_numpy(), 0, np.zeros(len(pdf), dtype=bool)
        for head, w in passes:
            head = min(head, len(ts))
            begin = max(tail, head - capacity)
            lost[tail:begin] = True
            snap = ts[begin:head]
            if not len(snap):
                continue
            fresh = np.flatnonzero(snap >= snap.max() - w) if w else np.zeros(0, np.int64)
            tail = begin + (int(fresh[0]) if len(fresh) else len(snap))
        begin = max(tail, len(ts) - capacity)
        lost[tail:begin] = True
        state = np.where(lost, "overwritten", np.where(np.arange(len(ts)) < begin, "evicted", "hot"))
        return pd.DataFrame({"sensor_id": pdf["sensor_id"], "seq": seq, "status": state})

    states = entries.select("sensor_id", "seq", "ts").groupBy("sensor_id").applyInPandas(tail_of, "sensor_id string, seq long, status string")
    return entries.join(states, ["sensor_id", "seq"])
