"""The window as keyed state of a stream.

Per sensor the state is a map from arrival number to row and a pair (head, tail), never more than capacity rows.  Each
micro-batch appends its rows in order of seq, then makes one pass; what it evicts is the operator's output, for a
cold tier.  Late rows are accepted: the frontier is the newest row of the sensor's own window, not a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.cold import Backend

OUTPUT = "sensor_id string, seq long, ts long, vec array<float>, event string, hot_rows long, lost_rows long"


class Ring(StatefulProcessor):
    def __init__(self, capacity: int, window_ms: int):
        self.capacity, self.window_ms = capacity, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "at long", "seq long, ts long, vec array<float>")
        self.ends = handle.getValueState("ends", "head long, tail long, lost long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        head, tail, lost = self.ends.get() if self.ends.exists() else (0, 0, 0)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, ts, vec in zip(batch["seq"], batch["ts"], batch["vec"]):
            if head - tail >= self.capacity and self.rows.containsKey((head - self.capacity,)):
                self.rows.removeKey((head - self.capacity,))
                lost += 1
            self.rows.updateValue((head,), (int(seq), int(ts), [float(x) for x in vec]))
            head += 1
        begin = max(tail, head - self.capacity)
        hot = {i: self.rows.getValue((i,)) for i in range(begin, head)}
        cutoff = max(v[1] for v in hot.values()) - self.window_ms
        first = head if self.window_ms == 0 else next(i for i in range(begin, head) if hot[i][1] >= cutoff)
        out = []
        for i in range(begin, first):
            seq, ts, vec = hot[i]
            out.append((key[0], seq, ts, list(vec), "evicted", head - first, lost))
            self.rows.removeKey((i,))
        self.ends.update((head, first, lost))
        out.append((key[0], None, None, None, "pass", head - first, lost))
        frame = pd.DataFrame(out, columns=["sensor_id", "seq", "ts", "vec", "event", "hot_rows", "lost_rows"])
        yield frame.astype({"seq": "Int64", "ts": "Int64"})

    def close(self) -> None:
        pass


def ring(stream: DataFrame, capacity: int, window_ms: int) -> DataFrame:
    """A stream (sensor_id, seq, ts, vec) to OUTPUT: an 'evicted' row for each evicted one, a 'pass' row for each
    sensor and micro-batch.  Needs the RocksDB state store."""
    return stream.groupBy("sensor_id").transformWithStateInPandas(Ring(capacity, window_ms), OUTPUT, "Update", "None")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def to_backend(df: DataFrame, batch: int, backend: Backend) -> None:
    """What a micro-batch evicted, as a block per sensor whose id is the batch: tried again, it replaces itself."""
    pos = (F.row_number().over(Window.partitionBy("sensor_id").orderBy("seq")) - 1).alias("pos")
    backend.write_blocks(df.filter("event = 'evicted'").select("sensor_id", F.lit(batch).cast("long").alias("block_id"), pos, "seq", "ts", "vec"))


def run_over_files(spark, path: str, schema: str, capacity: int, window_ms: int, checkpoint: str, out: str, files_per_batch: int = 1, backend: Backend | None = None):
    """Reads the Parquet files of path as micro-batches until they end, and writes the output to out, a folder per batch.

    A batch that is tried again overwrites its own folder, and its own blocks in backend, so the cold side sees each
    eviction once.  Files are taken in order of their time.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def put(df: DataFrame, batch: int) -> None:
        df.persist()
        if backend is not None:
            to_backend(df, batch, backend)
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        df.unpersist()

    query = ring(stream, capacity, window_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
