"""Queries over the embeddings and events tables, each with DuckDB SQL that defines the same result.

embeddings: sensor = label, seq = vec_id, a row every 100 ms, but every 7th is 15 s late.  events: sensor = user, seq =
event_id, vec = (value, props.k).  Full tables throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Dtype, Metric
from ..functions import dequantize, euclidean_sq_by_norms, norm, quantize
from ..functions.vectors import literal
from ..operators import anomaly, report, search, window
from ..operators.ingest import entries
from ..runtime import ship

DIM, CAPACITY, WINDOW_MS, TOP = 64, 32, 20_000, 10
COSINE, EUCLIDEAN = Metric.COSINE, Metric.EUCLIDEAN
queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
oracles: dict[str, str] = {}


def embeddings(spark: SparkSession, sf_dir: str, dtype: Dtype = Dtype.FLOAT32) -> DataFrame:
    late = F.when(F.col("vec_id") % 7 == 0, 15000).otherwise(0)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("label").cast("string").alias("sensor_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 100 - late).alias("ts"), F.col("embedding").alias("vec")
    )
    return entries(rows, Config(DIM, dtype=dtype))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts in whole milliseconds, rounded down."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    vec = F.array(F.col("value").cast("float"), F.get_json_object("props", "$.k").cast("float"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("sensor_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), vec.alias("vec")
    )


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th row is a query."""
    return embeddings(spark, sf_dir).filter(F.col("seq") % 100 == 0).select(F.col("seq").alias("qid"), "sensor_id", F.col("vec").alias("target"))


def query(sql: str | None):
    def add(f):
        queries[f.__name__] = f
        if sql:
            oracles[f.__name__] = sql
        return f

    return add


E = """WITH e AS (SELECT label::VARCHAR AS sensor_id, vec_id AS seq, vec_id * 100 - CASE WHEN vec_id % 7 = 0 THEN 15000 ELSE 0 END AS ts, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)"""
V = """WITH e AS (SELECT user_id::VARCHAR AS sensor_id, event_id AS seq, epoch_us(ts) // 1000 AS ts, [value::FLOAT::DOUBLE, json_extract_string(props, '$.k')::FLOAT::DOUBLE] AS v FROM events)"""
HOT = f""", c AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS back FROM e),
m AS (SELECT sensor_id, max(ts) AS mx FROM c WHERE back <= {CAPACITY} GROUP BY 1),
f AS (SELECT sensor_id, min(seq) AS first FROM c JOIN m USING (sensor_id) WHERE back <= {CAPACITY} AND ts >= mx - {WINDOW_MS} GROUP BY 1),
s AS (SELECT c.*, CASE WHEN back > {CAPACITY} THEN 'overwritten' WHEN seq < first THEN 'evicted' ELSE 'hot' END AS status FROM c JOIN f USING (sensor_id))"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
COS = "round(CASE WHEN a.norm > 0 AND b.norm > 0 THEN " + DOT.format(a="a.v", b="b.v") + " / (a.norm::FLOAT * b.norm) ELSE 0 END, 6)"


@query(E + " SELECT sensor_id, seq, round(norm, 6) AS norm FROM n")
def vector_norms(spark, sf):
    return embeddings(spark, sf).select("sensor_id", "seq", F.round(norm(F.col("vec")), 6).alias("norm"))


@query(E + f", q AS (SELECT * FROM n WHERE seq = 0) SELECT a.ts, a.seq, {COS.replace('::FLOAT', '')} AS score FROM n a, q b WHERE a.sensor_id = b.sensor_id ORDER BY score DESC, a.seq LIMIT {TOP}")
def knn_cosine(spark, sf):
    rows = embeddings(spark, sf).drop("norm")
    q = rows.filter("seq = 0").first()
    return search.nearest(rows, q.sensor_id, q.vec, TOP)


@query(E + f", q AS (SELECT * FROM n WHERE seq = 0) SELECT a.ts, a.seq, round({SQ.format(a='a.v', b='b.v')}, 6) AS score FROM n a, q b WHERE a.sensor_id = b.sensor_id ORDER BY score, a.seq LIMIT {TOP}")
def knn_euclidean_sq(spark, sf):
    rows = embeddings(spark, sf)
    q = rows.filter("seq = 0").first()
    return search.nearest(rows, q.sensor_id, q.vec, TOP, EUCLIDEAN)


_EACH = """, p AS (SELECT b.seq AS qid, a.sensor_id, a.ts, a.seq, {score} AS score FROM n a JOIN n b USING (sensor_id) WHERE b.seq % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, sensor_id ORDER BY score {way}, seq) AS rank FROM p) WHERE rank <= 10"""


@query(E + _EACH.format(score=COS.replace("::FLOAT", ""), way="DESC"))
def knn_batch_per_sensor(spark, sf):
    ship(spark)
    return search.nearest_batch(embeddings(spark, sf), _probes(spark, sf), TOP)


@query(E + _EACH.format(score=f"round({SQ.format(a='a.v', b='b.v')}, 6)", way=""))
def knn_batch_euclidean(spark, sf):
    return search.nearest_each(embeddings(spark, sf), _probes(spark, sf), TOP, EUCLIDEAN)


@query(E + f" SELECT a.sensor_id, a.seq, round(greatest(0, a.norm * a.norm + b.norm * b.norm - 2 * {DOT.format(a='a.v', b='b.v')}), 6) AS distance_sq FROM n a, n b WHERE b.seq = 1")
def euclidean_by_norms(spark, sf):
    rows = embeddings(spark, sf)
    q = literal(rows.filter("seq = 1").first().vec)
    return rows.select("sensor_id", "seq", F.round(euclidean_sq_by_norms(F.col("vec"), q, norm(F.col("vec")), norm(q)), 6).alias("distance_sq"))


I8 = """WITH r AS (SELECT label::VARCHAR AS sensor_id, vec_id AS seq, vec_id * 100 - CASE WHEN vec_id % 7 = 0 THEN 15000 ELSE 0 END AS ts, embedding AS v,
  list_max(list_transform(embedding, lambda x: abs(x)))::FLOAT AS mx, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))::FLOAT AS norm FROM embeddings),
n AS (SELECT *, CASE WHEN mx > 0 THEN (mx / 127::FLOAT)::FLOAT ELSE 0 END AS scale, CASE WHEN mx > 0 THEN (127::FLOAT / mx)::FLOAT ELSE 0 END AS inv FROM r),
i AS (SELECT *, list_transform(v, lambda x: greatest(-127, least(127, round((x * inv)::FLOAT)::INT))) AS q FROM n)"""
I8DOT = "list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1]::INT * p[2]::INT))"


@query(I8 + " SELECT sensor_id, seq, list_sum(q)::BIGINT AS q_sum, list_sum(list_transform(q, lambda x: x * x))::BIGINT AS q_squares, round(scale::DOUBLE, 9) AS scale FROM i")
def int8_quantize(spark, sf):
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    wide = F.transform("q8", lambda x: x.cast("long"))
    return embeddings(spark, sf, Dtype.INT8).select("sensor_id", "seq", add(wide).alias("q_sum"), add(F.transform(wide, lambda x: x * x)).alias("q_squares"), F.round(F.col("scale").cast("double"), 9).alias("scale"))


_I8 = """, p AS (SELECT b.seq AS qid, a.sensor_id, a.ts, a.seq, {score} AS score FROM i a JOIN i b USING (sensor_id) WHERE b.seq % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, sensor_id ORDER BY score {way}, seq) AS rank FROM p) WHERE rank <= 10"""
I8COS = f"round({I8DOT} * a.scale::DOUBLE * b.scale::DOUBLE / (a.norm::DOUBLE * b.norm::DOUBLE), 6)"
I8SQ = f"round(greatest(0, a.norm::DOUBLE * a.norm::DOUBLE + b.norm::DOUBLE * b.norm::DOUBLE - 2 * {I8DOT} * a.scale::DOUBLE * b.scale::DOUBLE), 6)"


@query(I8 + _I8.format(score=I8COS, way="DESC"))
def knn_int8_cosine(spark, sf):
    ship(spark)
    return search.nearest_batch(embeddings(spark, sf, Dtype.INT8), _probes(spark, sf), TOP)


@query(I8 + _I8.format(score=I8SQ, way=""))
def knn_int8_euclidean_sq(spark, sf):
    ship(spark)
    return search.nearest_batch(embeddings(spark, sf, Dtype.INT8), _probes(spark, sf), TOP, EUCLIDEAN)


@query(
    I8 + f""", x AS (SELECT b.seq AS qid, a.seq, {I8COS} AS s8, round({DOT.format(a='a.v::DOUBLE[]', b='b.v::DOUBLE[]')} / (a.norm::DOUBLE * b.norm::DOUBLE), 6) AS s32 FROM i a JOIN i b USING (sensor_id) WHERE b.seq % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s8 DESC, seq) AS r8, row_number() OVER (PARTITION BY qid ORDER BY s32 DESC, seq) AS r32 FROM x)
SELECT qid, count(*) FILTER (r8 <= 10 AND r32 <= 10) / 10 AS recall FROM k GROUP BY qid"""
)
def int8_recall_at_10(spark, sf):
    return search.recall(knn_int8_cosine(spark, sf), search.nearest_each(embeddings(spark, sf).withColumn("norm", F.col("norm").cast("double")), _probes(spark, sf), TOP), TOP)


@query(I8 + " SELECT sensor_id, seq, round(list_max(list_transform(list_zip(v, q), lambda p: abs(p[1]::DOUBLE - p[2]::INT * scale::DOUBLE))), 6) AS worst FROM i")
def int8_max_reconstruction_error(spark, sf):
    rows = embeddings(spark, sf).withColumn("z", quantize(F.col("vec")))
    worst = F.array_max(F.zip_with("vec", "z.q8", lambda x, q: F.abs(x.cast("double") - q.cast("int") * F.col("z.scale").cast("double"))))
    return rows.select("sensor_id", "seq", F.round(worst, 6).alias("worst"))


@query(E + HOT + " SELECT sensor_id, seq, ts, status FROM s")
def hot_window_status(spark, sf):
    return window.status(embeddings(spark, sf), CAPACITY, WINDOW_MS).select("sensor_id", "seq", "ts", "status")


@query(E + HOT + " SELECT sensor_id, seq, ts FROM s WHERE status = 'hot'")
def hot_window_out_of_order(spark, sf):
    return window.hot(embeddings(spark, sf), CAPACITY, WINDOW_MS).select("sensor_id", "seq", "ts")


@query(V + HOT + " SELECT sensor_id, seq, ts, status FROM s")
def hot_window_events(spark, sf):
    return window.status(events(spark, sf), CAPACITY, WINDOW_MS).select("sensor_id", "seq", "ts", "status")


@query(V + HOT + f" SELECT sensor_id, seq, ts FROM c WHERE back <= {CAPACITY}")
def capacity_window(spark, sf):
    return window.last_arrivals(events(spark, sf), CAPACITY).select("sensor_id", "seq", "ts")


@query(V + f" SELECT sensor_id, count(*) AS appended, greatest(0, count(*) - {CAPACITY}) AS overwritten FROM e GROUP BY 1")
def overwrite_counts(spark, sf):
    return window.overwrites(events(spark, sf), CAPACITY)


@query(V + HOT + " SELECT sensor_id, seq, CASE WHEN status = 'overwritten' THEN status ELSE 'evicted' END AS status FROM s")
def evict_all(spark, sf):
    return window.status(events(spark, sf), CAPACITY, 0).select("sensor_id", "seq", "status")


_PASSES = [(20, WINDOW_MS), (60, 0), (80, 3_600_000_000)]


@query(
    V + f""", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY sensor_id) AS n FROM e),
h1 AS (SELECT *, greatest(0, least(20, n) - {CAPACITY}) AS b1 FROM k), m1 AS (SELECT sensor_id, max(ts) AS mx FROM h1 WHERE i >= b1 AND i < 20 GROUP BY 1),
t1 AS (SELECT h1.sensor_id, min(i) AS tail1 FROM h1 JOIN m1 USING (sensor_id) WHERE i >= b1 AND i < 20 AND ts >= mx - {WINDOW_MS} GROUP BY 1),
h2 AS (SELECT h1.*, tail1, greatest(tail1, least(60, n) - {CAPACITY}) AS b2, least(60, n) AS tail2 FROM h1 JOIN t1 USING (sensor_id)),
h3 AS (SELECT *, greatest(tail2, least(80, n) - {CAPACITY}) AS b3, greatest(greatest(tail2, least(80, n) - {CAPACITY}), n - {CAPACITY}) AS b4 FROM h2)
SELECT sensor_id, seq, CASE WHEN i < b1 THEN 'overwritten' WHEN i < tail1 THEN 'evicted' WHEN i < b2 THEN 'overwritten' WHEN i < tail2 THEN 'evicted' WHEN i < b3 THEN 'overwritten' WHEN i < b4 THEN 'overwritten' ELSE 'hot' END AS status FROM h3"""
)
def eviction_replay(spark, sf):
    ship(spark)
    return window.replay(events(spark, sf), _PASSES, CAPACITY).select("sensor_id", "seq", "status")


@query(E + HOT + " SELECT sensor_id, count(*) AS rows, min(ts) AS t_start, max(ts) AS t_end, min(seq) AS first_seq, max(seq) AS last_seq FROM s WHERE status = 'evicted' GROUP BY 1")
def eviction_blocks(spark, sf):
    return window.eviction_blocks(embeddings(spark, sf), CAPACITY, WINDOW_MS)


@query(E + " SELECT ts, seq, round(v[1], 6) AS v1, round(list_sum(v), 6) AS total FROM e WHERE sensor_id = '3' AND ts BETWEEN 5000 AND 30000 ORDER BY seq LIMIT 20")
def query_range(spark, sf):
    add = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return search.in_range(embeddings(spark, sf), "3", 5000, 30_000, 20).select("ts", "seq", F.round(F.col("vec")[0].cast("double"), 6).alias("v1"), F.round(add, 6).alias("total"))


@query(E + HOT + " SELECT 0 < min(ts) AS truncated, count(*) FILTER (ts BETWEEN 0 AND 30000) > 5 AS limited, count(*) FILTER (ts BETWEEN 0 AND 30000) AS matching FROM s WHERE status = 'hot' AND sensor_id = '3'")
def range_truncated_flag(spark, sf):
    return search.range_flags(window.hot(embeddings(spark, sf), CAPACITY, WINDOW_MS), "3", 0, 30_000, 5)


_CENTROID = ", x AS (SELECT sensor_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM s WHERE status = 'hot'), g AS (SELECT sensor_id, pos, avg(x) AS m FROM x GROUP BY 1, 2), z AS (SELECT sensor_id, list(m ORDER BY pos) AS c FROM g GROUP BY 1)"


@query(E + HOT + _CENTROID + " SELECT sensor_id, pos::INT AS pos, round(m, 6) AS mean FROM g")
def sensor_centroids(spark, sf):
    c = anomaly.centroids(window.hot(embeddings(spark, sf), CAPACITY, WINDOW_MS), DIM)
    return c.select("sensor_id", F.posexplode("centroid").alias("p", "m")).select("sensor_id", (F.col("p") + 1).alias("pos"), F.round("m", 6).alias("mean"))


def _candidates(df: DataFrame, threshold: float) -> DataFrame:
    return df.select("sensor_id", F.col("seq").alias("cid"), "vec", F.lit(threshold).alias("threshold"))


_NORM = "sqrt(list_sum(list_transform({x}, lambda x: x * x)))"


@query(
    E + HOT + _CENTROID + f", d AS (SELECT e.sensor_id, e.seq AS cid, round(1 - CASE WHEN {_NORM.format(x='c')} > 0 AND {_NORM.format(x='v')} > 0 THEN {DOT.format(a='c', b='v')} / ({_NORM.format(x='c')} * {_NORM.format(x='v')}) ELSE 0 END, 6) AS distance FROM e JOIN z USING (sensor_id))"
    " SELECT *, (distance > 0.5)::INT AS is_anomaly FROM d"
)
def anomaly_cosine(spark, sf):
    rows = embeddings(spark, sf)
    return anomaly.detect(_candidates(rows, 0.5), window.hot(rows, CAPACITY, WINDOW_MS), DIM)


@query(V + HOT + _CENTROID + f", d AS (SELECT e.sensor_id, e.seq AS cid, round(sqrt({SQ.format(a='c', b='v')}), 6) AS distance FROM e JOIN z USING (sensor_id)) SELECT *, (distance > 100)::INT AS is_anomaly FROM d")
def anomaly_euclidean(spark, sf):
    rows = events(spark, sf)
    return anomaly.detect(_candidates(rows, 100.0), window.hot(rows, CAPACITY, WINDOW_MS), 2, EUCLIDEAN)


@query(
    V + f""", w AS (SELECT *, avg(v[1]) OVER b AS m1, avg(v[2]) OVER b AS m2 FROM e WINDOW b AS (PARTITION BY sensor_id ORDER BY seq ROWS BETWEEN {CAPACITY} PRECEDING AND 1 PRECEDING)),
d AS (SELECT sensor_id, seq, round(sqrt((m1 - v[1]) * (m1 - v[1]) + (m2 - v[2]) * (m2 - v[2])), 6) AS distance FROM w) SELECT *, coalesce((distance > 100)::INT, 0) AS is_anomaly FROM d"""
)
def rolling_anomaly(spark, sf):
    return anomaly.rolling(events(spark, sf), 2, CAPACITY, 100.0, EUCLIDEAN)


@query(
    E + f""", r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS pos, max(ts) OVER (PARTITION BY sensor_id ORDER BY seq ROWS BETWEEN {CAPACITY} PRECEDING AND 1 PRECEDING) AS latest FROM e),
p AS (SELECT r.sensor_id, r.seq, q.pos, q.v, min(CASE WHEN q.ts >= r.latest - {WINDOW_MS} THEN q.pos END) OVER (PARTITION BY r.sensor_id, r.seq) AS tail FROM r JOIN r AS q ON r.sensor_id = q.sensor_id AND q.pos BETWEEN r.pos - {CAPACITY} AND r.pos - 1),
m AS (SELECT sensor_id, seq, i, avg(v[i]) AS m FROM (SELECT *, unnest(range(1, {DIM + 1})) AS i FROM p WHERE pos >= tail) GROUP BY ALL),
c AS (SELECT sensor_id, seq, sqrt(sum((m - r.v[i]) * (m - r.v[i]))) AS d FROM m JOIN r USING (sensor_id, seq) GROUP BY 1, 2)
SELECT sensor_id, seq, round(d, 6) AS distance, coalesce((round(d, 6) > 1.1)::INT, 0) AS is_anomaly FROM r LEFT JOIN c USING (sensor_id, seq)"""
)
def rolling_anomaly_timed(spark, sf):
    return anomaly.rolling(embeddings(spark, sf), DIM, CAPACITY, 1.1, EUCLIDEAN, WINDOW_MS)


@query(E + f" SELECT sensor_id, seq, ts FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS back FROM e WHERE ts >= 40000 - {WINDOW_MS}) WHERE back <= {CAPACITY}")
def rehydrate_window(spark, sf):
    from ..sources.cold import rehydrated

    return rehydrated(embeddings(spark, sf), 40_000, WINDOW_MS, CAPACITY).select("sensor_id", "seq", "ts")


@query(E + " SELECT sensor_id, count(*) AS rows FROM e WHERE sensor_id <> '4' GROUP BY 1")
def drop_sensor(spark, sf):
    gone = spark.createDataFrame([("4",)], "sensor_id string")
    return embeddings(spark, sf).join(gone, "sensor_id", "left_anti").groupBy("sensor_id").agg(F.count("*").alias("rows"))


@query(V + " SELECT DISTINCT sensor_id FROM e")
def list_sensors(spark, sf):
    return report.sensors(events(spark, sf))


@query(V + f", k AS (SELECT sensor_id, count(*) AS n FROM e GROUP BY 1) SELECT count(*) AS sensor_count, sum(n)::BIGINT AS total_appends, sum(greatest(0, n - {CAPACITY}))::BIGINT AS total_overwritten, count(*) * {CAPACITY} * 20 AS hot_bytes FROM k")
def engine_stats(spark, sf):
    return report.totals(events(spark, sf), CAPACITY, CAPACITY * Config(2).row_bytes)


@query(V + " SELECT DISTINCT sensor_id, (64 * (8 + 2 * 4 + 4))::BIGINT AS hot_bytes FROM e")
def hot_bytes(spark, sf):
    return report.hot_bytes(events(spark, sf), Config(2, ring_capacity=64))


@query(V + " SELECT sensor_id, count(*) AS rows, 40 + count(*) * 8 + count(*) * 2 * 4 + 4 AS block_bytes, 40 + count(*) * 8 + count(*) * 2 + count(*) * 4 + 4 AS int8_bytes FROM e GROUP BY 1")
def block_sizes(spark, sf):
    per = events(spark, sf).groupBy("sensor_id").agg(F.count("*").alias("rows"))
    return per.select("sensor_id", "rows", report.block_bytes(F.col("rows"), Config(2)).alias("block_bytes"), report.block_bytes(F.col("rows"), Config(2, dtype=Dtype.INT8)).alias("int8_bytes"))


@query(
    """WITH RECURSIVE t AS (SELECT range::BIGINT AS b, range::BIGINT AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM t WHERE k = 8)
SELECT event_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(event_type, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM events, tab"""
)
def crc32_rows(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.crc32("event_type").alias("crc"))


@query(
    V.replace("events)", "events WHERE value IS NOT NULL)") + """, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) FILTER (i >= floor((n - 1) * 0.5)) AS p50, min(value) FILTER (i >= floor((n - 1) * 0.95)) AS p95, min(value) FILTER (i >= floor((n - 1) * 0.99)) AS p99, min(value) FILTER (i >= floor((n - 1) * 0.999)) AS p999, max(value) AS largest FROM r GROUP BY 1"""
)
def latency_percentiles(spark, sf):
    return report.percentiles(spark.read.parquet(f"{sf}/events.parquet"), "value", "event_type")


@query(E + HOT + " SELECT sensor_id, seq, ts, CASE WHEN status = 'hot' THEN 'hot' ELSE 'cold' END AS tier FROM s WHERE status <> 'overwritten' AND ts BETWEEN 10000 AND 45000")
def range_hot_and_cold(spark, sf):
    """An extension: the range filter over both tiers."""
    rows = window.status(embeddings(spark, sf), CAPACITY, WINDOW_MS).filter("status <> 'overwritten' AND ts BETWEEN 10000 AND 45000")
    return rows.select("sensor_id", "seq", "ts", F.when(F.col("status") == "hot", "hot").otherwise("cold").alias("tier"))


@query(I8 + " SELECT sensor_id, seq, round(list_sum(list_transform(q, lambda x: (x::FLOAT * scale)::DOUBLE)), 6) AS total FROM i")
def int8_dequantize(spark, sf):
    rows = embeddings(spark, sf, Dtype.INT8).withColumn("vec", dequantize(F.col("q8"), F.col("scale")))
    return rows.select("sensor_id", "seq", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of the hot window of the first row's sensor."""
    rows = embeddings(spark, sf_dir)
    q = rows.filter("seq = 0").first()
    return search.nearest(window.hot(rows, CAPACITY, WINDOW_MS), q.sensor_id, q.vec, TOP)
