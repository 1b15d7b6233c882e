"""Queries that run an engine with its cold tier, the codecs and the stream, each with DuckDB SQL for the same result.

One engine over all of embeddings: rings of RING rows, appended as one frame, one pass of WINDOW_MS, then a flush.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Dtype, valid_sensor_id, valid_vector
from ..engine import Engine
from ..errors import TEXTS, EngineError, error_string
from ..operators import report, search
from ..runtime import Scratch, ship
from ..sources import codec, vectorfiles
from ..sources.cold import ParquetBackend
from .catalog import CAPACITY, COS, DIM, I8, WINDOW_MS, E, embeddings, query

RING = 64
#: Rows with their place from the end, and whether they were overwritten, evicted or still hot at the pass.
RINGS = f""", c AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS back, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) - 1 AS arrival FROM e),
m AS (SELECT sensor_id, max(ts) AS mx FROM c WHERE back <= {RING} GROUP BY 1),
f AS (SELECT sensor_id, min(seq) AS first FROM c JOIN m USING (sensor_id) WHERE back <= {RING} AND ts >= mx - {WINDOW_MS} GROUP BY 1),
s AS (SELECT c.*, CASE WHEN back > {RING} THEN 'overwritten' WHEN seq < first THEN 'evicted' ELSE 'hot' END AS status FROM c JOIN f USING (sensor_id))"""


def _rows(spark, sf: str) -> DataFrame:
    return embeddings(spark, sf).select("sensor_id", "seq", "ts", "vec")


def _config(**more) -> Config:
    return Config(DIM, ring_capacity=RING, window_ms=WINDOW_MS, eviction_interval_ms=3_600_000, **more)


def _ran(spark, sf: str, name: str, flush: bool = True, **more) -> tuple[Engine, Scratch]:
    """An engine that has taken embeddings in, passed once and flushed; its cold tier lies in the scratch folder."""
    ship(spark)
    scratch = Scratch(spark, name)
    e = Engine.create(spark, _config(**more), f"{scratch.path}/cold")
    e.append_frame(_rows(spark, sf))
    e.maintain_sliding_window(WINDOW_MS)
    if flush:
        e.flush()
    return e, scratch


def _blocks(cold: DataFrame) -> DataFrame:
    return cold.groupBy("sensor_id", "block_id").agg(F.count("*").alias("rows"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"))


_BLOCKS = "SELECT sensor_id, CASE WHEN status = 'evicted' THEN 0 WHEN sensor_id IN (SELECT sensor_id FROM s WHERE status = 'evicted') THEN 1 ELSE 0 END AS block_id, * EXCLUDE (sensor_id) FROM s WHERE status <> 'overwritten'"


@query(E + RINGS + " SELECT sensor_id, 0 AS block_id, count(*) AS rows, min(ts) AS t_start, max(ts) AS t_end FROM s WHERE status = 'evicted' GROUP BY 1")
def cold_blocks_after_pass(spark, sf):
    e, _ = _ran(spark, sf, "cold", flush=False)
    e.close()
    return _blocks(e.backend.rows())


@query(E + RINGS + f", b AS ({_BLOCKS}) SELECT sensor_id, block_id, count(*) AS rows, min(ts) AS t_start, max(ts) AS t_end FROM b GROUP BY 1, 2")
def cold_blocks_after_flush(spark, sf):
    e, _ = _ran(spark, sf, "flushed")
    e.close()
    return _blocks(e.backend.rows())


@query(E + RINGS + f", b AS ({_BLOCKS}) SELECT sensor_id, block_id, row_number() OVER (PARTITION BY sensor_id, block_id ORDER BY seq) - 1 AS pos, arrival AS seq, ts, round(list_sum(v), 5) AS total FROM b")
def cold_rows(spark, sf):
    """Every row of the tier, as it is read back."""
    e, _ = _ran(spark, sf, "rows")
    e.close()
    add = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.backend.rows().select("sensor_id", "block_id", "pos", "seq", "ts", F.round(add, 5).alias("total"))


@query(E + RINGS + f", b AS ({_BLOCKS}) SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, arrival AS seq, ts FROM b WHERE sensor_id = '3' AND block_id = 0")
def cold_read_block(spark, sf):
    e, _ = _ran(spark, sf, "block")
    e.close()
    return e.backend.read_block("3", 0).select("pos", "seq", "ts")


@query(E + RINGS + f", b AS ({_BLOCKS}) SELECT DISTINCT sensor_id, block_id FROM b")
def cold_list_blocks(spark, sf):
    """What the tier's listings of sensors and of their blocks say."""
    e, _ = _ran(spark, sf, "listed")
    e.close()
    return spark.createDataFrame([(s, b) for s in e.backend.list_sensors() for b in e.backend.list_blocks(s)], "sensor_id string, block_id long")


@query(E + RINGS + " SELECT sensor_id, count(*) AS rows FROM s WHERE status <> 'overwritten' AND sensor_id <> '4' GROUP BY 1")
def cold_after_drop(spark, sf):
    """The tier after a sensor was dropped."""
    e, _ = _ran(spark, sf, "dropped")
    e.drop_sensor("4")
    e.close()
    return e.backend.rows().groupBy("sensor_id").agg(F.count("*").alias("rows"))


@query(f"SELECT {DIM}::BIGINT AS dim, 0::BIGINT AS dtype, 0::BIGINT AS metric, 0::BIGINT AS payload_size, {RING}::BIGINT AS ring_capacity, {WINDOW_MS}::BIGINT AS window_ms, false AS recover_hot_window, true AS same_uuid")
def cold_metadata(spark, sf):
    """Metadata written by one engine and read by the next, which keeps its identity."""
    e, scratch = _ran(spark, sf, "metadata", flush=False)
    e.close()
    again = Engine.open(spark, f"{scratch.path}/cold")
    again.close()
    c = again.backend.read_metadata()
    fields = ["dim", "dtype", "metric", "payload_size", "ring_capacity", "window_ms"]
    row = [*[int(c[f]) for f in fields], bool(c["recover_hot_window"]), again.config.uuid == e.config.uuid]
    return spark.createDataFrame([row], ", ".join(f"{f} long" for f in fields) + ", recover_hot_window boolean, same_uuid boolean")


@query(f"SELECT true AS grows, 0::BIGINT AS empty_bytes, {DIM}::BIGINT AS dim")
def cold_bytes_estimate(spark, sf):
    """Nothing before the first block; at least a byte a number of the last ones after."""
    scratch = Scratch(spark, "bytes")
    empty = ParquetBackend(spark, f"{scratch.path}/cold").bytes_estimate()
    e, _ = _ran(spark, sf, "bytes", flush=False)
    one = e.backend.bytes_estimate()
    e.flush()
    e.close()
    return spark.createDataFrame([(0 < one < e.backend.bytes_estimate(), empty, DIM)], "grows boolean, empty_bytes long, dim long")


@query(E + RINGS + f", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS again FROM s WHERE status <> 'overwritten' AND ts >= 45000 - {WINDOW_MS}) SELECT sensor_id, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) - 1 AS seq, ts FROM k WHERE again <= {RING}")
def reopened_window(spark, sf):
    """The hot window that an engine finds when it opens the tier again, 45 s after the epoch."""
    e, scratch = _ran(spark, sf, "reopened", recover_hot_window=True)
    e.close()
    again = Engine.open(spark, f"{scratch.path}/cold", now_ms=45_000)
    found = scratch.save(again.hot_rows().select("sensor_id", "seq", "ts"))
    again.close()
    return found


@query(E + RINGS + f""" SELECT count(DISTINCT sensor_id) - 1 AS sensor_count, count(*) AS total_appends, count(*) FILTER (status = 'overwritten') AS total_overwritten_entries,
(count(DISTINCT sensor_id) - 1) * {RING} * (8 + {DIM} * 4 + 4) AS hot_bytes, 1::BIGINT AS total_dropped_sensors, count(DISTINCT sensor_id) FILTER (status = 'evicted') + count(DISTINCT sensor_id) FILTER (status = 'hot') AS total_evictions, 0::BIGINT AS flush_errors_total FROM s""")
def engine_run_stats(spark, sf):
    """Counters of a run with overwrites, a pass, a flush and a drop."""
    e, _ = _ran(spark, sf, "stats")
    e.drop_sensor("4")
    e.close()
    names = ["sensor_count", "total_appends", "total_overwritten_entries", "hot_bytes", "total_dropped_sensors", "total_evictions", "flush_errors_total"]
    stats = e.get_stats()
    return spark.createDataFrame([[int(stats[n]) for n in names]], ", ".join(f"{n} long" for n in names))


@query(E + f""", r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS i, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS back FROM e WHERE sensor_id IN ('1', '2'))
SELECT sensor_id, i - 1 AS seq, ts, round(v[1], 6) AS v1 FROM r WHERE back <= {RING}""")
def append_and_batch(spark, sf):
    """Two sensors appended by hand, one row by row and one as a batch; what is hot then."""
    rows = _rows(spark, sf).filter("sensor_id IN ('1', '2')").orderBy("seq").toArrow().to_pylist()
    e = Engine.create(spark, _config())
    for r in rows:
        if r["sensor_id"] == "1":
            e.append("1", r["ts"], r["vec"])
    two = [r for r in rows if r["sensor_id"] == "2"]
    e.append_batch("2", [r["ts"] for r in two], [r["vec"] for r in two])
    scratch = Scratch(spark, "appended")
    out = scratch.save(e.hot_rows().select("sensor_id", "seq", "ts", F.round(F.col("vec")[0].cast("double"), 6).alias("v1")))
    e.close()
    return out


def _code(f, *args) -> int:
    try:
        f(*args)
    except EngineError as e:
        return int(e.code)
    return 0


@query("SELECT * FROM (VALUES ('preallocated', 0), ('beyond_max_sensors', -8), ('unknown_sensor', -2), ('wrong_dim', -3), ('empty_vector', -1), ('bad_sensor_id', -1), ('long_sensor_id', -1), ('after_close', -7), ('other_schema', -1), ('no_metadata', -4)) t(case_name, code)")
def life_cycle_codes(spark, sf):
    """The code of each refusal: caps, unknown sensors, dimensions, ids, use after close, schema drift, nothing to open."""
    scratch = Scratch(spark, "codes")
    e = Engine.create(spark, _config(max_sensors=1), f"{scratch.path}/cold")
    v = [0.0] * DIM
    found = [
        ("preallocated", _code(e.preallocate_sensor, "a")), ("beyond_max_sensors", _code(e.append, "b", 0, v)), ("unknown_sensor", _code(e.query_nearest_n, "zz", v, 1)),
        ("wrong_dim", _code(e.append, "a", 0, v[1:])), ("empty_vector", _code(e.append, "a", 0, [])), ("bad_sensor_id", _code(e.append, "a\x01", 0, v)), ("long_sensor_id", _code(e.append, "x" * 257, 0, v)),
    ]
    e.close()
    found += [("after_close", _code(e.append, "a", 0, v)), ("other_schema", _code(Engine.create, spark, Config(DIM + 1, ring_capacity=RING), f"{scratch.path}/cold")), ("no_metadata", _code(Engine.open, spark, f"{scratch.path}/none"))]
    return spark.createDataFrame(found, "case_name string, code int")


@query("SELECT 65536::BIGINT AS ring_capacity, 600000::BIGINT AS window_ms, 60000::BIGINT AS eviction_interval_ms, 0::BIGINT AS dtype, 0::BIGINT AS metric, 0::BIGINT AS max_sensors, 0::BIGINT AS payload_size")
def config_defaults(spark, sf):
    c = Config(DIM).resolved()
    names = ["ring_capacity", "window_ms", "eviction_interval_ms", "dtype", "metric", "max_sensors", "payload_size"]
    return spark.createDataFrame([[int(getattr(c, n)) for n in names]], ", ".join(f"{n} long" for n in names))


@query("SELECT * FROM (VALUES " + ", ".join(f"({int(c)}, '{t}')" for c, t in TEXTS.items()) + ", (12345, 'unknown')) t(code, message)")
def error_texts(spark, sf):
    return spark.createDataFrame([(int(c), error_string(int(c))) for c in [*TEXTS, 12345]], "code int, message string")


@query("SELECT doc_id, coalesce(octet_length(encode(text)) BETWEEN 1 AND 256 AND NOT contains(text, chr(1)), false) AS valid FROM documents")
def sensor_id_validation(spark, sf):
    """The rule for sensor ids on whole texts, many of them too long."""
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", valid_sensor_id(F.col("text")).alias("valid"))


@query("SELECT vec_id, false AS valid_63, len(embedding) = 64 AS valid_64, false AS valid_nan FROM embeddings")
def vector_validation(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    spoiled = F.transform("embedding", lambda x, i: F.when(i == 3, float("nan")).otherwise(x).cast("float"))
    return rows.select("vec_id", valid_vector(F.col("embedding"), 63).alias("valid_63"), valid_vector(F.col("embedding"), 64).alias("valid_64"), valid_vector(spoiled, 64).alias("valid_nan"))


@query(E + " SELECT sensor_id, 0 AS block_id, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) - 1 AS pos, ts, round(list_sum(v), 5) AS total FROM e")
def block_codec_rows(spark, sf):
    """Every sensor's rows as one binary block, decoded again."""
    ship(spark)
    pos = F.row_number().over(Window.partitionBy("sensor_id").orderBy("seq")) - 1
    blocks = codec.export_blocks(_rows(spark, sf).select("sensor_id", F.lit(0).cast("long").alias("block_id"), pos.alias("pos"), "ts", "vec"))
    add = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return codec.import_blocks(blocks).select("sensor_id", "block_id", "pos", "ts", F.round(add, 5).alias("total"))


@query(I8 + " SELECT sensor_id, count(*) AS rows, (44 + count(*) * (8 + 64 + 4 + 8))::BIGINT AS bytes, sum(list_sum(q))::BIGINT AS q_sum, round(sum(scale::DOUBLE), 5) AS scales, count(*) AS payloads FROM i GROUP BY 1")
def block_codec_int8(spark, sf):
    """The same with INT8 vectors and payloads of eight bytes; sizes, and columns taken out one by one."""
    ship(spark)
    pos = F.row_number().over(Window.partitionBy("sensor_id").orderBy("seq")) - 1
    payload = F.substring(F.sha2(F.col("seq").cast("string"), 256), 1, 8).cast("binary")
    rows = embeddings(spark, sf, Dtype.INT8).select("sensor_id", F.lit(0).cast("long").alias("block_id"), pos.alias("pos"), "ts", "q8", "scale", payload.alias("payload"), "seq")
    blocks = Scratch(spark, "int8").save(codec.export_blocks(rows))
    back = codec.import_blocks(blocks, ["q8", "scale", "payload"])
    wide = F.aggregate("q8", F.lit(0).cast("long"), lambda a, x: a + x)
    per = back.groupBy("sensor_id").agg(F.count("*").alias("rows"), F.sum(wide).alias("q_sum"), F.round(F.sum(F.col("scale").cast("double")), 5).alias("scales"), F.count(F.when(F.length("payload") == 8, 1)).alias("payloads"))
    return per.join(blocks.select("sensor_id", F.length("data").cast("long").alias("bytes")), "sensor_id").select("sensor_id", "rows", "bytes", "q_sum", "scales", "payloads")


@query(f"SELECT 59::BIGINT AS bytes, {DIM}::BIGINT AS dim, {RING}::BIGINT AS ring_capacity, {WINDOW_MS}::BIGINT AS window_ms, true AS same")
def metadata_codec(spark, sf):
    c = _config().resolved()
    data = codec.encode_metadata(c)
    d = codec.decode_metadata(data)
    return spark.createDataFrame([(len(data), d.dim, d.ring_capacity, d.window_ms, d == c)], "bytes long, dim long, ring_capacity long, window_ms long, same boolean")


@query("SELECT vec_id AS row, round(list_sum(embedding::DOUBLE[]), 5) AS total, label::BIGINT AS label FROM embeddings")
def vector_files(spark, sf):
    """embeddings as one fbin file and labels as one ibin file, read back and joined by row."""
    import numpy as np

    ship(spark)
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toArrow()
    scratch = Scratch(spark, "files")
    backend = ParquetBackend(spark, scratch.path)  # for its file system
    vectors = t.column("embedding").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    for name, data in (("a.fbin", vectorfiles.pack(vectors)), ("a.ibin", vectorfiles.pack(np.array(t.column("label"), dtype="<i4").reshape(-1, 1), "<i4"))):
        backend.put(name, data)
    add = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    labels = vectorfiles.read(spark, f"{scratch.path}/a.ibin", integers=True).select("row", F.col("values")[0].cast("long").alias("label"))
    return vectorfiles.read(spark, f"{scratch.path}/a.fbin").select("row", F.round(add, 5).alias("total")).join(labels, "row")


@query(E + f", q AS (SELECT * FROM n WHERE seq = 0) SELECT a.ts, a.seq, {COS.replace('::FLOAT', '')} AS score FROM n a, q b WHERE a.sensor_id = b.sensor_id ORDER BY score DESC, a.seq LIMIT 100")
def exact_top_100(spark, sf):
    rows = embeddings(spark, sf).drop("norm")
    q = rows.filter("seq = 0").first()
    return search.nearest(rows, q.sensor_id, q.vec, 100)


@query("SELECT event_type, round(avg(value), 6) AS mean_value, round(avg(event_id), 6) AS mean_event_id FROM events GROUP BY 1")
def mean_report(spark, sf):
    out = report.means(spark.read.parquet(f"{sf}/events.parquet"), ["value", "event_id"], "event_type")
    return out.select("event_type", F.round("mean_value", 6).alias("mean_value"), F.round("mean_event_id", 6).alias("mean_event_id"))


@query(E + " SELECT sensor_id, count(*) AS rows, (count(*) - 40.0) / 40.0 * 100 AS growth_pct FROM e GROUP BY 1")
def growth_report(spark, sf):
    per = embeddings(spark, sf).groupBy("sensor_id").agg(F.count("*").alias("rows"))
    return report.growth(per, "rows", "sensor_id", 40.0)


BATCHES = 8


def _replay_sql() -> str:
    """streaming_ring in SQL: micro-batch k has the rows whose seq modulo BATCHES is k - 1; a pass after each."""
    sql = E + f", a AS (SELECT *, seq % {BATCHES} + 1 AS batch FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY batch, seq) - 1 AS i FROM a), t0 AS (SELECT DISTINCT sensor_id, 0::BIGINT AS tail, 0::BIGINT AS head, 0::BIGINT AS lost, 0::BIGINT AS evicted FROM g)"
    for k in range(1, BATCHES + 1):
        sql += f""", h{k} AS (SELECT t.sensor_id, t.tail, t.lost, t.evicted, t.head AS old, t.head + count(g.i) AS head, greatest(t.tail, t.head + count(g.i) - {CAPACITY}) AS begin FROM t{k - 1} t LEFT JOIN g ON g.sensor_id = t.sensor_id AND g.batch = {k} GROUP BY t.sensor_id, t.tail, t.lost, t.evicted, t.head),
m{k} AS (SELECT h.sensor_id, max(g.ts) AS mx FROM h{k} h JOIN g ON g.sensor_id = h.sensor_id AND g.i >= h.begin AND g.i < h.head GROUP BY 1),
p{k} AS (SELECT h.sensor_id, min(g.i) AS first FROM h{k} h JOIN m{k} m USING (sensor_id) JOIN g ON g.sensor_id = h.sensor_id AND g.i >= h.begin AND g.i < h.head AND g.ts >= m.mx - {WINDOW_MS} GROUP BY 1),
t{k} AS (SELECT h.sensor_id, CASE WHEN h.head > h.old THEN coalesce(p.first, h.head) ELSE h.tail END AS tail, h.head, CASE WHEN h.head > h.old THEN h.lost + h.begin - h.tail ELSE h.lost END AS lost,
  CASE WHEN h.head > h.old THEN h.evicted + coalesce(p.first, h.head) - h.begin ELSE h.evicted END AS evicted FROM h{k} h LEFT JOIN p{k} p USING (sensor_id))"""
    return sql + f" SELECT sensor_id, head - tail AS hot_rows, lost AS lost_rows, evicted AS evicted_rows FROM t{BATCHES}"


def _streamed(spark, sf: str, with_backend: bool) -> tuple[DataFrame, ParquetBackend]:
    from ..streaming.ring import run_over_files

    ship(spark)
    scratch = Scratch(spark, "ring")
    backend = ParquetBackend(spark, f"{scratch.path}/cold")
    rows = _rows(spark, sf)
    for k in range(BATCHES):  # a file for each micro-batch, in order of their times
        scratch.spark.createDataFrame(rows.filter(F.col("seq") % BATCHES == k).toArrow(), rows.schema).coalesce(1).write.mode("append").parquet(f"{scratch.path}/stream")
    schema = "sensor_id string, seq long, ts long, vec array<float>"
    out = run_over_files(spark, f"{scratch.path}/stream", schema, CAPACITY, WINDOW_MS, f"{scratch.path}/checkpoint", f"{scratch.path}/out", backend=backend if with_backend else None)
    return out, backend


@query(_replay_sql())
def streaming_ring(spark, sf):
    """embeddings as a stream of BATCHES micro-batches through the keyed window; what it keeps, loses and evicts, per sensor."""
    out, _ = _streamed(spark, sf, False)
    last = F.row_number().over(Window.partitionBy("sensor_id").orderBy(F.desc("batch")))
    ends = out.filter("event = 'pass'").withColumn("r", last).filter("r = 1").select("sensor_id", "hot_rows", "lost_rows")
    gone = out.filter("event = 'evicted'").groupBy("sensor_id").agg(F.count("*").alias("evicted_rows"))
    return ends.join(gone, "sensor_id", "left").select("sensor_id", "hot_rows", "lost_rows", F.coalesce("evicted_rows", F.lit(0)).alias("evicted_rows"))


@query("SELECT sensor_id, evicted_rows AS cold_rows FROM (" + _replay_sql() + ") WHERE evicted_rows > 0")
def streaming_to_cold(spark, sf):
    """The same stream with a cold tier: its rows per sensor."""
    _, backend = _streamed(spark, sf, True)
    return backend.rows().groupBy("sensor_id").agg(F.count("*").alias("cold_rows"))


@query(E + RINGS + " SELECT 'on_eviction' AS event, sensor_id, sum((status = 'evicted')::INT)::BIGINT AS n FROM s GROUP BY 2 HAVING n > 0 UNION ALL SELECT 'on_overwrite', sensor_id, sum((status = 'overwritten')::INT)::BIGINT AS n FROM s GROUP BY 2 HAVING n > 0")
def sink_events(spark, sf):
    """What a sink hears of a frame's overwrites and of the pass."""
    from ..engine import MetricsSink

    heard: list[tuple[str, str, int]] = []

    class Sink(MetricsSink):
        def on_overwrite(self, sensor_id, count):
            heard.append(("on_overwrite", sensor_id, count))

        def on_eviction(self, sensor_id, rows, size):
            heard.append(("on_eviction", sensor_id, rows))

    e = Engine.create(spark, _config(), sink=Sink())
    e.append_frame(_rows(spark, sf))
    e.maintain_sliding_window(WINDOW_MS)
    e.close()
    return spark.createDataFrame(heard, "event string, sensor_id string, n long")
