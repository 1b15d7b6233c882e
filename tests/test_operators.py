import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewindow import functions as V
from tidewindow.config import Config, Dtype, Metric
from tidewindow.errors import EngineError
from tidewindow.operators import anomaly, report, search, window
from tidewindow.operators.ingest import entries
from tidewindow.sources import codec, vectorfiles

ROW = "sensor_id string, seq long, ts long, vec array<float>"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def vec(*v):
    return F.array(*[F.lit(float(x)).cast("float") for x in v])


def test_kernels(spark):
    z = vec(0, 0, 0)
    assert one(spark, V.cosine(vec(1, 0, 0), vec(1, 1, 0))) == pytest.approx(0.5**0.5) and one(spark, V.cosine(z, vec(3, 4, 0))) == 0
    assert one(spark, V.cosine(vec(float("nan"), 1, 1), vec(3, 4, 0))) == 0 and one(spark, V.euclidean_sq(z, vec(3, 4, 0))) == 25 and one(spark, V.euclidean(z, vec(3, 4, 0))) == 5
    q = one(spark, V.quantize(vec(5, -5, 0, 2.5)))
    assert q.q8 == [127, -127, 0, 64] and q.scale == pytest.approx(5 / 127) and one(spark, V.quantize(z)).scale == 0 and one(spark, F.crc32(F.lit("123456789"))) == 3421780262


def slow_status(ts, cap, w):
    begin = max(0, len(ts) - cap)
    snap = ts[begin:]
    first = len(ts) if w == 0 else begin if w is None else begin + next(i for i, t in enumerate(snap) if t >= max(snap) - w)
    return ["overwritten" if i < begin else "evicted" if i < first else "hot" for i in range(len(ts))]


@pytest.mark.parametrize("w", [None, 0, 1, 50, 10**6])
def test_window_against_plain_loop(spark, w):
    rng = np.random.default_rng(3)
    logs = {f"s{i}": rng.integers(0, 200, n).tolist() for i, n in enumerate([1, 5, 16, 17, 90])} | {"edge": [100, 150]}
    df = spark.createDataFrame([(s, i, t, [1.0]) for s, ts in logs.items() for i, t in enumerate(ts)], ROW)
    got = {(r.sensor_id, r.seq): r.status for r in window.status(df, 16, w).collect()}
    want = {(s, i): x for s, ts in logs.items() for i, x in enumerate(slow_status(ts, 16, w))}
    assert got == want
    assert {(r.sensor_id, r.seq) for r in window.hot(df, 16, w).collect()} == {k for k, x in want.items() if x == "hot"}
    replayed = {(r.sensor_id, r.seq): r.status for r in window.replay(df, [] if w is None else [(10**9, w)], 16).collect()}
    assert replayed == want


@pytest.mark.parametrize("w", [None, 0, 7, 60, 10**6])
@pytest.mark.parametrize("dim", [2, 130])
def test_rolling_against_plain_loop(spark, w, dim):
    """A ring that evicts its stale prefix after every append, row by row."""
    rng, cap, rows, want = np.random.default_rng(6), 8, [], {}
    for sensor, n in (("a", 1), ("b", 40), ("c", 90)):
        ring, tail = [], 0
        for i in range(n):
            ts, v = int(i * 5 + rng.integers(-30, 30)), rng.normal(size=dim).astype("float32")
            hot = [x for _, x in ring[max(tail, len(ring) - cap) :]]
            d = None if not hot else float(np.sqrt(((np.mean(hot, axis=0, dtype=float) - v) ** 2).sum()))
            want[sensor, i] = (d, int(d is not None and d > 2))
            rows.append((sensor, i, ts, v.tolist()))
            ring.append((ts, v))
            tail = max(tail, len(ring) - cap)
            if w is not None:
                latest = max(t for t, _ in ring[tail:])
                while tail < len(ring) and (w == 0 or ring[tail][0] < latest - w):
                    tail += 1
    got = {(r.sensor_id, r.seq): (r.distance, r.is_anomaly) for r in anomaly.rolling(spark.createDataFrame(rows, ROW).repartition(3), dim, cap, 2.0, Metric.EUCLIDEAN, w).collect()}
    assert got == {k: (d if d is None else pytest.approx(d, abs=2e-6), x) for k, (d, x) in want.items()}


def test_plans_limit_before_the_shuffle(spark):
    df = spark.createDataFrame([("s", 0, 0, [1.0])], ROW)
    plan = window.last_arrivals(df, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") and "Partial" in plan
    assert "TakeOrderedAndProject" in search.nearest(df, "s", [1.0], 3)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", list(Metric))
def test_batch_agrees_with_each(spark, metric):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"s{i % 3}", i, i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 8)).astype("float32"))] + [("s0", 500, 0, [0.0] * 8)], ROW)
    asked = spark.createDataFrame([(i, f"s{i % 4}", x.tolist()) for i, x in enumerate(rng.normal(size=(9, 8)).astype("float32"))], "qid long, sensor_id string, target array<float>")
    tied = rows.unionByName(rows.selectExpr("sensor_id", "seq + 1000 AS seq", "ts", "vec")).repartition(3)
    for dtype in Dtype:
        kept = entries(tied, Config(8, dtype=dtype))
        kept = kept if dtype == Dtype.INT8 else kept.drop("norm")
        a, b = ({(r.qid, r.rank): (r.seq, round(r.score, 5)) for r in f(kept, asked, 5, metric).collect()} for f in (search.nearest_each, search.nearest_batch))
        assert a == b and len(a) == 7 * 5


def test_ingest_rejects(spark):
    bad = [("", 0, 0, [1.0]), ("a\x01", 0, 0, [1.0]), ("s", 0, 0, [1.0, 2.0]), ("s", 0, 0, [float("inf")]), ("x" * 257, 0, 0, [1.0])]
    for row in bad:
        with pytest.raises(Exception, match="invalid"):
            entries(spark.createDataFrame([row], ROW), Config(1)).collect()
    r = entries(spark.createDataFrame([("s", 0, 0, [3.0, 4.0])], ROW), Config(2, dtype=Dtype.INT8)).first()
    assert r.norm == 5 and r.q8 == [95, 127]


def test_codec_and_files(spark, tmp_path):
    ts = np.array([5, 3, 9])
    for b in (codec.Block(ts, np.ones((3, 4), "f4")), codec.Block(ts, np.ones((3, 4), "i1"), np.ones(3, "f4"), np.zeros((3, 2), np.uint8))):
        data = codec.encode(b)
        back = codec.decode(data)
        assert (back.timestamps == ts).all() and (back.vectors == b.vectors).all() and codec.peek(data)["t_end"] == 9
        for broken in (data[:-1], b"x" + data[1:], data[:50] + bytes([data[50] ^ 1]) + data[51:]):
            with pytest.raises(EngineError):
                codec.decode(broken)
    assert report.block_bytes(100, Config(128)) == 52044 and report.block_bytes(100, Config(128, dtype=Dtype.INT8, payload_size=16)) == 15644 and report.block_bytes(0, Config(1)) == 44
    assert len(codec.encode(codec.Block(np.arange(100), np.zeros((100, 128), "f4")))) == 52044 and zlib.crc32(b"123456789") == 0xCBF43926
    c = Config(32, metric=Metric.EUCLIDEAN, ring_capacity=512, window_ms=300_000).resolved()
    assert codec.decode_metadata(codec.encode_metadata(c)) == c and len(codec.encode_metadata(c)) == 59
    m = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.fbin").write_bytes(vectorfiles.pack(m))
    assert [r["values"] for r in vectorfiles.read(spark, str(tmp_path / "a.fbin")).orderBy("row").collect()] == m.tolist()


def test_block_reader(spark):
    rng = np.random.default_rng(2)
    blocks = [
        ("a", 0, codec.encode(codec.Block(np.array([5, 3]), rng.normal(size=(2, 3)).astype("f4")))),
        ("a", 1, codec.encode(codec.Block(np.array([9]), np.array([[1, -2, 3]], "i1"), np.array([0.5], "f4"), np.array([[7, 8]], np.uint8)))),
        ("b", 0, b"not a block"), ("b", 1, None),
    ]
    df = spark.createDataFrame(blocks, "sensor_id string, block_id long, data binary")
    rows = codec.import_blocks(df, ["vec", "q8", "scale", "payload", "ts"], skip_corrupt=True).orderBy("block_id", "pos").collect()
    assert [(r.ts, r.q8, r.scale, r.payload) for r in rows] == [(5, None, None, None), (3, None, None, None), (9, [1, -2, 3], 0.5, bytearray(b"\x07\x08"))]
    assert rows[2].vec == [0.5, -1.0, 1.5] and codec.import_blocks(df, ["ts"], skip_corrupt=True).columns == ["sensor_id", "block_id", "pos", "ts"]
    with pytest.raises(Exception, match="corruption"):
        codec.import_blocks(df).collect()
    with pytest.raises(ValueError):
        codec.import_blocks(df, ["other"])
    back = codec.export_blocks(codec.import_blocks(df, ["ts", "q8", "scale", "payload"], skip_corrupt=True).filter("q8 IS NOT NULL"))
    assert bytes(back.first().data) == blocks[1][2]


def test_stream_agrees_with_a_plain_loop(spark, tmp_path):
    """Late rows, a sensor that rests, and passes after every micro-batch."""
    import random

    from tidewindow.streaming.ring import run_over_files

    rng, cap, window = random.Random(3), 8, 50
    batches = [[(s, k * 100 + i, k * 40 + rng.randrange(-80, 40)) for s in ("a", "b", "c") if rng.random() < 0.8 for i in range(rng.choice([1, 4, 12]))] for k in range(5)]
    hot, lost, gone = {}, {}, {}
    for b in batches:
        for s in sorted({x[0] for x in b}):
            ring = hot.setdefault(s, [])
            ring += [x[1:] for x in b if x[0] == s]
            over = max(0, len(ring) - cap)
            lost[s] = lost.get(s, 0) + over
            del ring[:over]
            newest = max(t for _, t in ring)
            keep = next(i for i, (_, t) in enumerate(ring) if t >= newest - window)
            gone.setdefault(s, []).extend(x for x, _ in ring[:keep])
            del ring[:keep]
        spark.createDataFrame([(*x, [1.0]) for x in b], "sensor_id string, seq long, ts long, vec array<float>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = run_over_files(spark, f"{tmp_path}/in", "sensor_id string, seq long, ts long, vec array<float>", cap, window, f"{tmp_path}/check", f"{tmp_path}/out").collect()
    for s in hot:
        last = max((r for r in out if r.sensor_id == s and r.event == "pass"), key=lambda r: r.batch)
        assert (last.hot_rows, last.lost_rows) == (len(hot[s]), lost[s]) and sorted(r.seq for r in out if r.sensor_id == s and r.event == "evicted") == sorted(gone[s])
