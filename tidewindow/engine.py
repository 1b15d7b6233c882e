"""The engine: one schema, many sensors, a hot window, a cold tier, counters.

A driver-side object over plans.  Appended rows wait in a small buffer or come as DataFrames; they become tables in the
scratch folder.  The driver holds one small record per sensor (head, tail, counters), never rows of a DataFrame.

A thread makes an eviction pass every eviction_interval_ms if rows came since the last; a lock keeps calls apart.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config, Metric, check_sensor_id
from .errors import Code, EngineError
from .operators import anomaly, report, search
from .operators.ingest import entries as to_entries
from .operators.ingest import with_vectors
from .runtime import Scratch
from .sources.cold import Backend, NullBackend, ParquetBackend, rehydrated

ROW = "sensor_id string, seq long, ts long, vec array<float>, payload binary"


class MetricsSink:
    """Override what is wanted."""

    def on_append(self, sensor_id: str, latency_ns: int) -> None: ...
    def on_query(self, sensor_id: str, latency_ns: int) -> None: ...
    def on_anomaly_detected(self, sensor_id: str, distance: float) -> None: ...
    def on_overwrite(self, sensor_id: str, count: int) -> None: ...
    def on_eviction(self, sensor_id: str, rows: int, size: int) -> None: ...
    def on_flush_error(self, sensor_id: str, code: int) -> None: ...
    def on_corruption(self, sensor_id: str) -> None: ...
    def on_warning(self, sensor_id: str, code: int) -> None: ...


@dataclass
class _Sensor:
    head: int = 0
    tail: int = 0
    overwrites: int = 0
    next_block: int = 0
    allocated: bool = False


@dataclass
class Result:
    rows: list
    warning: Code = Code.OK
    limited: bool = False


@dataclass
class _Counters:
    total_appends: int = 0
    total_queries: int = 0
    total_anomaly_checks: int = 0
    total_evictions: int = 0
    total_dropped_sensors: int = 0
    flush_errors_total: int = 0
    dropped_overwrites: int = 0
    last_flush_unix_ms: int = 0


def _alone(f):
    @wraps(f)
    def run(self, *args, **options):
        with self._lock:
            return f(self, *args, **options)

    return run


#: Tables that the log may consist of before it is written anew.
PIECES = 16


@dataclass
class Engine:
    spark: SparkSession
    config: Config
    backend: Backend
    sink: MetricsSink = field(default_factory=MetricsSink)

    def __post_init__(self) -> None:
        self.sensors: dict[str, _Sensor] = {}
        self.counters, self.closed = _Counters(), False
        self._buffer: list[tuple] = []
        self._log: DataFrame | None = None
        self._pieces: list[DataFrame] = []
        self._scratch = Scratch(self.spark, "engine")
        self._lock, self._stop, self._fresh = threading.RLock(), threading.Event(), False
        self._timer = threading.Thread(target=self._keep_evicting, name="eviction", daemon=True)
        self._timer.start()

    def _keep_evicting(self) -> None:
        while not self._stop.wait(self.config.eviction_interval_ms / 1000):
            with self._lock:
                if self._fresh and not self.closed:
                    try:
                        self._evict(self.config.window_ms)
                    except Exception:  # noqa: BLE001  counted and told to the sink where it is a flush error; the next pass tries again
                        pass

    # -- life

    @classmethod
    def create(cls, spark: SparkSession, config: Config, cold_path: str | None = None, sink: MetricsSink | None = None, backend: Backend | None = None) -> Engine:
        config = config.resolved()
        backend = backend or (ParquetBackend(spark, cold_path) if cold_path else NullBackend())
        if (old := backend.read_metadata()) is not None:
            known = Config(**old).resolved()
            if not config.same_schema(known):
                raise EngineError(Code.INVALID_ARG, "schema differs from what is stored")
            config = replace(config, uuid=known.uuid)
        backend.write_metadata(config.as_dict())
        out = cls(spark, config, backend, sink or MetricsSink())
        for sensor, n in backend.next_block_ids().items():
            out.sensors[sensor] = _Sensor(next_block=n)
        return out

    @classmethod
    def open(cls, spark: SparkSession, cold_path: str, sink: MetricsSink | None = None, now_ms: int | None = None) -> Engine:
        backend = ParquetBackend(spark, cold_path)
        stored = backend.read_metadata()
        if stored is None:
            raise EngineError(Code.IO, "no metadata")
        out = cls.create(spark, Config(**stored), sink=sink, backend=backend)
        if out.config.recover_hot_window and (cold := backend.rows(skip_corrupt=True)) is not None:
            now = int(time.time() * 1000) if now_ms is None else now_ms
            fresh = rehydrated(cold, now, out.config.window_ms, out.config.ring_capacity)
            order = Window.partitionBy("sensor_id").orderBy("seq")
            fresh = out._scratch.save(fresh.withColumn("seq", F.row_number().over(order).cast("long") - 1).drop("block_id", "pos"), "rehydrated")
            out._extend(fresh)
            for r in fresh.groupBy("sensor_id").count().collect():
                out.sensors[r.sensor_id].head, out.sensors[r.sensor_id].allocated = r["count"], True
        return out

    def close(self, flush: bool = False) -> None:
        with self._lock:
            if self.closed:
                return
            if flush:
                self.flush()
            self.closed = True
            self._stop.set()
        self._timer.join()
        self._scratch.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- ingest

    def _open(self) -> None:
        if self.closed:
            raise EngineError(Code.CLOSED)

    def _register(self, sensor_id: str) -> _Sensor:
        if sensor_id not in self.sensors:
            if self.config.max_sensors and len(self.sensors) >= self.config.max_sensors:
                raise EngineError(Code.CAPACITY, "max_sensors")
            self.sensors[sensor_id] = _Sensor()
        s = self.sensors[sensor_id]
        s.allocated = True
        return s

    def _advance(self, sensor_id: str, s: _Sensor, n: int, tell: bool = True) -> None:
        lost = max(0, n - max(0, self.config.ring_capacity - (s.head - s.tail)))
        s.head, s.overwrites = s.head + n, s.overwrites + lost
        self.counters.total_appends += n
        self._fresh = self._fresh or n > 0
        if lost and tell:
            self.sink.on_overwrite(sensor_id, lost)

    def _checked(self, vec: Sequence[float] | None, payload: bytes | None) -> list[float]:
        if vec is None or not len(vec):
            raise EngineError(Code.INVALID_ARG, "vector")
        if len(vec) != self.config.dim:
            raise EngineError(Code.DIM_MISMATCH)
        if any(x != x or abs(x) == float("inf") for x in vec) or (payload is not None and self.config.payload_size and len(payload) != self.config.payload_size):
            raise EngineError(Code.INVALID_ARG, "vector or payload")
        return [float(x) for x in vec]

    @_alone
    def preallocate_sensor(self, sensor_id: str) -> None:
        check_sensor_id(sensor_id)
        self._open()
        self._register(sensor_id)

    @_alone
    def append(self, sensor_id: str, ts: int, vec: Sequence[float], payload: bytes | None = None) -> None:
        began = time.perf_counter_ns()
        if vec is None or not len(vec):
            raise EngineError(Code.INVALID_ARG, "vector")
        check_sensor_id(sensor_id)
        self._open()
        values = self._checked(vec, payload)
        s = self._register(sensor_id)
        self._buffer.append((sensor_id, s.head, int(ts), values, payload if self.config.payload_size else None))
        self._advance(sensor_id, s, 1)
        self.sink.on_append(sensor_id, time.perf_counter_ns() - began)
        if len(self._buffer) >= 50_000:
            self._settle()

    @_alone
    def append_batch(self, sensor_id: str, ts: Sequence[int], vecs: Sequence[Sequence[float]], payloads: Sequence[bytes] | None = None) -> None:
        """All rows or, where one is not valid, none.  The sink is not told."""
        check_sensor_id(sensor_id)
        self._open()
        if not len(ts):
            return
        if len(vecs) != len(ts) or (payloads is not None and len(payloads) != len(ts)):
            raise EngineError(Code.INVALID_ARG, "lengths")
        payloads = payloads if payloads is not None else [None] * len(ts)
        values = [self._checked(v, p) for v, p in zip(vecs, payloads)]
        s = self._register(sensor_id)
        self._buffer += [(sensor_id, s.head + i, int(t), v, p if self.config.payload_size else None) for i, (t, v, p) in enumerate(zip(ts, values, payloads))]
        self._advance(sensor_id, s, len(values), tell=False)
        if len(self._buffer) >= 50_000:
            self._settle()

    @_alone
    def append_frame(self, rows: DataFrame) -> None:
        """rows(sensor_id, seq, ts, vec[, payload]) of any size; seq orders them, numbers are given anew."""
        self._open()
        self._settle()
        counts = {r.sensor_id: r["count"] for r in rows.groupBy("sensor_id").count().collect()}
        fresh = [s for s in counts if s not in self.sensors]
        if self.config.max_sensors and len(self.sensors) + len(fresh) > self.config.max_sensors:
            raise EngineError(Code.CAPACITY, "max_sensors")
        heads = self.spark.createDataFrame([(s, self.sensors[s].head if s in self.sensors else 0) for s in counts], "sensor_id string, __head long")
        order = Window.partitionBy("sensor_id").orderBy("seq")
        numbered = rows.withColumn("seq", F.row_number().over(order).cast("long") - 1).join(heads, "sensor_id", "left")
        self._extend(to_entries(numbered.withColumn("seq", F.col("seq") + F.coalesce("__head", F.lit(0))).drop("__head"), self.config))
        for s, n in counts.items():
            self._advance(s, self._register(s), n)
            self.sink.on_append(s, 0)

    def _extend(self, new: DataFrame) -> None:
        """The log is a union of written tables; every PIECES of them become one, of what is still hot."""
        piece = new if hasattr(new, "_scratch_path") else self._scratch.save(new, "piece")
        self._pieces.append(piece)
        self._log = piece if self._log is None else self._log.unionByName(piece)
        if len(self._pieces) > PIECES:
            self._compact()

    def _compact(self) -> None:
        if self._log is None:
            return
        old, hot = self._pieces, self._scratch.save(self._hot(), "log")
        self._log, self._pieces = hot, [hot]
        self._scratch.drop(*old)

    def _settle(self) -> None:
        if self._buffer:
            rows, self._buffer = self._buffer, []
            self._extend(self._scratch.save(to_entries(self.spark.createDataFrame(rows, ROW), self.config), "rows"))

    # -- the window

    def _hot(self, sensor_id: str | None = None) -> DataFrame:
        """Rows in [max(tail, head - capacity), head) of each sensor: a join with one number per sensor."""
        self._settle()
        if self._log is None:
            return to_entries(self.spark.createDataFrame([], ROW), self.config)
        begins = [(k, max(s.tail, s.head - self.config.ring_capacity)) for k, s in self.sensors.items() if sensor_id in (None, k)]
        if sensor_id is not None:  # one sensor: literals that reach the scan
            return self._log.filter((F.col("sensor_id") == sensor_id) & (F.col("seq") >= begins[0][1]))
        b = self.spark.createDataFrame(begins, "sensor_id string, __begin long")
        return self._log.join(b, "sensor_id").filter(F.col("seq") >= F.col("__begin")).drop("__begin")

    def _known(self, sensor_id: str, dim: int | None, args_ok: bool) -> _Sensor:
        check_sensor_id(sensor_id)
        self._open()
        if dim is not None and dim != self.config.dim:
            raise EngineError(Code.DIM_MISMATCH)
        if not args_ok:
            raise EngineError(Code.INVALID_ARG)
        if sensor_id not in self.sensors:
            raise EngineError(Code.NOT_FOUND, sensor_id)
        return self.sensors[sensor_id]

    def _warn(self, sensor_id: str, code: Code) -> Code:
        if code:
            self.sink.on_warning(sensor_id, code)
        return code

    @_alone
    def query_nearest_n(self, sensor_id: str, target: Sequence[float], n: int) -> Result:
        began = time.perf_counter_ns()
        s = self._known(sensor_id, len(target), n > 0)
        if not s.allocated or s.head == max(s.tail, 0):
            return Result([], self._warn(sensor_id, Code.PARTIAL_RESULT))
        rows = [(r.ts, r.score) for r in search.nearest(self._hot(sensor_id), sensor_id, target, n, self.config.metric).collect()]
        self.counters.total_queries += 1
        self.sink.on_query(sensor_id, time.perf_counter_ns() - began)
        return Result(rows, self._warn(sensor_id, Code.PARTIAL_RESULT if len(rows) < n else Code.OK))

    @_alone
    def query_range(self, sensor_id: str, t_start: int, t_end: int, limit: int) -> Result:
        s = self._known(sensor_id, None, limit > 0 and t_end >= t_start)
        if not s.allocated:
            return Result([])
        hot = with_vectors(self._hot(sensor_id))
        flags = search.range_flags(hot, sensor_id, t_start, t_end, limit).first()
        rows = [(r.ts, list(r.vec)) for r in search.in_range(hot, sensor_id, t_start, t_end, limit).collect()]
        self.counters.total_queries += 1
        return Result(rows, self._warn(sensor_id, Code.RANGE_TRUNCATED if flags.truncated else Code.OK), bool(flags.limited))

    @_alone
    def detect_anomaly(self, sensor_id: str, vec: Sequence[float], threshold: float) -> bool:
        s = self._known(sensor_id, len(vec), threshold >= 0)
        if not s.allocated:
            return False
        self.counters.total_anomaly_checks += 1
        hot = with_vectors(self._hot(sensor_id))
        one = self.spark.createDataFrame([(sensor_id, 0, [float(x) for x in vec], float(threshold))], "sensor_id string, cid long, vec array<float>, threshold double")
        r = anomaly.detect(one, hot, self.config.dim, self.config.metric).first()
        if r.is_anomaly:
            self.sink.on_anomaly_detected(sensor_id, r.distance)
        return bool(r.is_anomaly)

    def _evict(self, window_ms: int) -> None:
        """One pass over all sensors.  Blocks are written first; only then do tails advance."""
        self._fresh = False
        hot = self._hot()
        mx = Window.partitionBy("sensor_id")
        cut = F.max("seq") + 1 if window_ms == 0 else F.min(F.when(F.col("ts") >= F.col("__max") - window_ms, F.col("seq")))
        first = hot.select("sensor_id", "seq", "ts").withColumn("__max", F.max("ts").over(mx)).groupBy("sensor_id").agg(cut.alias("__first"))  # vectors stay where they are
        gone = self._scratch.save(hot.join(first, "sensor_id").filter(F.col("seq") < F.col("__first")), "evicted")
        per = gone.groupBy("sensor_id").agg(F.count("*").alias("n"), F.max("__first").alias("first")).collect()
        if not per:
            self._scratch.drop(gone)
            return
        ids = self.spark.createDataFrame([(r.sensor_id, self.sensors[r.sensor_id].next_block) for r in per], "sensor_id string, block_id long")
        pos = (F.row_number().over(Window.partitionBy("sensor_id").orderBy("seq")) - 1).alias("pos")
        try:
            self.backend.write_blocks(gone.drop("__first").join(ids, "sensor_id").select("*", pos))
        except EngineError as e:
            self.counters.flush_errors_total += 1
            for r in per:
                self.sink.on_flush_error(r.sensor_id, e.code)
            raise
        for r in per:
            s = self.sensors[r.sensor_id]
            s.tail, s.next_block = r.first, s.next_block + 1
            self.counters.total_evictions += 1
            self.sink.on_eviction(r.sensor_id, r.n, report.block_bytes(r.n, self.config))
        self._scratch.drop(gone)
        self._compact()  # what is no longer hot leaves the log

    @_alone
    def maintain_sliding_window(self, window_ms: int) -> None:
        self._open()
        if window_ms < 0:
            raise EngineError(Code.INVALID_ARG, "window_ms")
        self.config = replace(self.config, window_ms=window_ms)
        self.backend.write_metadata(self.config.as_dict())
        self._evict(window_ms)

    @_alone
    def flush(self) -> None:
        self._open()
        self._evict(0)
        self.backend.flush()
        self.counters.last_flush_unix_ms = int(time.time() * 1000)

    @_alone
    def drop_sensor(self, sensor_id: str) -> None:
        check_sensor_id(sensor_id)
        self._open()
        if sensor_id not in self.sensors:
            raise EngineError(Code.NOT_FOUND, sensor_id)
        self._settle()
        self.counters.dropped_overwrites += self.sensors.pop(sensor_id).overwrites
        self.counters.total_dropped_sensors += 1
        self._compact()  # the join with the sensors left drops its rows
        self.backend.delete_sensor(sensor_id)

    # -- reports; they work after close, too

    def list_sensors(self, limit: int | None = None) -> list[str]:
        return sorted(self.sensors)[:limit]

    @_alone
    def get_stats(self) -> dict:
        c = self.counters
        lost = sum(s.overwrites for s in self.sensors.values()) + c.dropped_overwrites
        return {
            "uuid": self.config.uuid, "abi_version": self.config.api_version, "sensor_count": len(self.sensors), "sensor_cap": self.config.max_sensors, "total_appends": c.total_appends,
            "total_queries": c.total_queries, "total_anomaly_checks": c.total_anomaly_checks, "total_evictions": c.total_evictions, "total_dropped_sensors": c.total_dropped_sensors,
            "total_overwrite_events": lost, "total_overwritten_entries": lost, "hot_bytes": sum(s.allocated for s in self.sensors.values()) * self.config.ring_capacity * self.config.row_bytes,
            "cold_bytes": self.backend.bytes_estimate(), "flush_errors_total": c.flush_errors_total, "last_flush_unix_ms": c.last_flush_unix_ms,
        }

    @_alone
    def hot_rows(self) -> DataFrame:
        return with_vectors(self._hot())


def version_string() -> str:
    return "0.1.0"


__all__ = ["Engine", "Metric", "MetricsSink", "Result", "version_string"]
