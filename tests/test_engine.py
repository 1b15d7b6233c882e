"""The engine against golden cases of its contract."""

import time

import pytest

from tidewindow.cli import Shell
from tidewindow.config import Config, Dtype, Metric
from tidewindow.engine import Engine, MetricsSink
from tidewindow.errors import Code, EngineError, error_string, is_error, is_warning
from tidewindow.sources.cold import NullBackend


def make(spark, dim=4, **options):
    return Engine.create(spark, Config(dim, **options))


def fill(e, sensor, rows):
    e.append_batch(sensor, [t for t, _ in rows], [v for _, v in rows])


def code_of(f, *args):
    with pytest.raises(EngineError) as e:
        f(*args)
    return e.value.code


def test_codes():
    assert error_string(0) == "ok" and error_string(-123) == "unknown" and is_error(-1) and is_warning(2) and not is_warning(0)


@pytest.mark.parametrize("bad", [{"dim": 0}, {"dim": 65537}, {"payload_size": 4097}, {"dtype": 2}, {"metric": 2}, {"ring_capacity": 32}, {"ring_capacity": 65}, {"window_ms": -1}, {"eviction_interval_ms": 50}, {"api_version": 2}])
def test_invalid_configs(bad):
    assert code_of(Config(**({"dim": 4} | bad)).resolved) == Code.INVALID_ARG


def test_defaults_and_ring_sizes():
    c = Config(4).resolved()
    assert (c.ring_capacity, c.window_ms, c.eviction_interval_ms) == (65536, 600_000, 60_000) and c.ring_capacity * c.row_bytes == 1835008
    assert 64 * Config(4).row_bytes == 1792 and 64 * Config(4, payload_size=16).row_bytes == 2816


def test_nearest(spark):
    with make(spark) as e:
        fill(e, "s", list(enumerate([(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0.9, 0.1, 0, 0), (0.5, 0.5, 0.5, 0.5)])))
        r = e.query_nearest_n("s", (1, 0, 0, 0), 3)
        assert [t for t, _ in r.rows][:2] == [0, 4] and r.rows[0][1] == 1.0 and r.rows[1][1] == pytest.approx(0.993884) and r.warning == Code.OK
        assert e.query_nearest_n("s", (1, 0, 0, 0), 10).warning == Code.PARTIAL_RESULT
        e.preallocate_sensor("empty")
        assert e.query_nearest_n("empty", (1, 0, 0, 0), 5).rows == []
        assert code_of(e.query_nearest_n, "who", (1, 0, 0, 0), 5) == Code.NOT_FOUND
        assert code_of(e.query_nearest_n, "s", (1, 0), 5) == Code.DIM_MISMATCH
        assert code_of(e.query_nearest_n, "s", (1, 0, 0, 0), 0) == Code.INVALID_ARG
        assert e.get_stats()["total_queries"] == 2


def test_wrap_range_and_stats(spark):
    with make(spark, ring_capacity=64) as e:
        rows = [(i, (i, 1, i % 7, i % 11)) for i in range(100)]
        fill(e, "s", rows)
        got = [t for t, _ in e.query_nearest_n("s", rows[99][1], 3).rows]
        assert got[0] == 99 and all(36 <= t <= 99 for t in got)
        r = e.query_range("s", 0, 99, 100)
        assert r.warning == Code.RANGE_TRUNCATED and len(r.rows) == 64 and not r.limited
        assert e.query_range("s", 50, 60, 4).limited and code_of(e.query_range, "s", 5, 4, 1) == Code.INVALID_ARG


def test_anomalies(spark):
    with make(spark) as e:
        fill(e, "s", [(i, (1 + 0.01 * i, 0, 0, 0)) for i in range(50)])
        assert not e.detect_anomaly("s", (1.5, 0, 0, 0), 0.5) and e.detect_anomaly("s", (0, 1, 0, 0), 0.5)
    with make(spark, dim=2, metric=Metric.EUCLIDEAN) as e:
        fill(e, "s", [(i, (0.1 * (i - 10), 0.1 * (i - 10))) for i in range(20)])
        assert not e.detect_anomaly("s", (0.05, 0.05), 1.0) and e.detect_anomaly("s", (50, 50), 1.0)


def test_maintain_and_prefix_eviction(spark):
    seen = []

    class Sink(MetricsSink):
        def on_eviction(self, sensor_id, rows, size):
            seen.append(rows)

    with Engine.create(spark, Config(1, ring_capacity=128), sink=Sink()) as e:
        fill(e, "s", [(10 * i, (i,)) for i in range(100)])
        e.maintain_sliding_window(200)
        left = sorted(r.ts for r in e.hot_rows().collect())
        assert len(left) == 21 and left[0] == 790 and seen == [79] and e.get_stats()["total_evictions"] == 1
        fill(e, "late", [(0, (1,)), (1000, (1,)), (5, (1,)), (900, (1,))])
        e.maintain_sliding_window(100)
        assert [r.ts for r in e.hot_rows().filter("sensor_id = 'late'").orderBy("seq").collect()] == [1000, 5, 900]
        e.maintain_sliding_window(0)
        assert e.hot_rows().count() == 0 and code_of(e.maintain_sliding_window, -1) == Code.INVALID_ARG


def test_overwrites_drop_and_caps(spark):
    with make(spark, dim=1, ring_capacity=64, max_sensors=2) as e:
        fill(e, "s", [(i, (1,)) for i in range(200)])
        assert e.get_stats()["total_overwritten_entries"] == 136
        e.drop_sensor("s")
        assert e.get_stats()["total_overwritten_entries"] == 136 and e.list_sensors() == [] and code_of(e.drop_sensor, "s") == Code.NOT_FOUND
        fill(e, "t", [(i, (1,)) for i in range(100)])
        assert e.get_stats()["total_overwritten_entries"] == 172
        e.preallocate_sensor("u")
        assert code_of(e.preallocate_sensor, "v") == Code.CAPACITY


def test_bad_appends(spark):
    e = make(spark, dim=2)
    assert code_of(e.append, "", 0, (1, 2)) == Code.INVALID_ARG and code_of(e.append, "a\x01", 0, (1, 2)) == Code.INVALID_ARG
    assert code_of(e.append, "x" * 257, 0, (1, 2)) == Code.INVALID_ARG and code_of(e.append, "s", 0, (1,)) == Code.DIM_MISMATCH
    assert code_of(e.append, "s", 0, (1, float("nan"))) == Code.INVALID_ARG and code_of(e.append, "s", 0, ()) == Code.INVALID_ARG
    e.append("x" * 256, 0, (1, 2))
    e.append_batch("s", [], [])
    e.close()
    e.close()
    assert code_of(e.append, "s", 0, (1, 2)) == Code.CLOSED and e.get_stats()["total_appends"] == 1


def test_persistence(spark, tmp_path):
    path = str(tmp_path / "cold")
    first = Engine.create(spark, Config(4, ring_capacity=64, window_ms=86_400_000, recover_hot_window=True), path)
    now = 1_700_000_000_000
    for s in ("sA", "sB"):
        fill(first, s, [(now + i, (i, 1, 2, 3)) for i in range(5)])
    first.flush()
    assert first.backend.list_sensors() == ["sA", "sB"] and first.backend.list_blocks("sA") == [0] and first.backend.bytes_estimate() > 0
    assert [r.ts - now for r in first.backend.read_block("sA", 0).collect()] == list(range(5)) and code_of(first.backend.read_block, "sA", 9) == Code.NOT_FOUND
    first.close()
    again = Engine.open(spark, path, now_ms=now + 10)
    assert again.config.uuid == first.config.uuid and again.list_sensors() == ["sA", "sB"] and len(again.query_nearest_n("sA", (1, 1, 2, 3), 10).rows) == 5
    again.drop_sensor("sA")
    again.append("sB", now + 9, (9, 9, 9, 9))
    again.flush()
    assert again.backend.list_blocks("sB") == [0, 1]
    again.close()
    old = Engine.open(spark, path, now_ms=now + 10 * 86_400_000)
    assert old.list_sensors() == ["sB"] and old.query_nearest_n("sB", (1, 1, 2, 3), 10).rows == []
    with pytest.raises(EngineError):
        Engine.create(spark, Config(5, ring_capacity=64), path)
    with pytest.raises(EngineError):
        Engine.open(spark, str(tmp_path / "none"))


def test_int8_is_close(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.uniform(-1, 1, (50, 64)).astype("float32"))]
    q = rng.uniform(-1, 1, 64).tolist()
    out = []
    for kind in Dtype:
        with make(spark, dim=64, dtype=kind) as e:
            fill(e, "s", rows)
            out.append(e.query_nearest_n("s", q, 5).rows)
            assert len(e.query_range("s", 0, 9, 100).rows) == 10 and not e.detect_anomaly("s", q, 2.0)
    assert out[0][0][0] == out[1][0][0] and all(abs(a[1] - b[1]) < 0.03 for a, b in zip(*out))


def test_append_frame(spark):
    with make(spark, dim=1, ring_capacity=64) as e:
        e.append("s", 0, (1,))
        e.append_frame(spark.createDataFrame([("s", 7, 5, [2.0]), ("s", 3, 4, [3.0]), ("t", 1, 1, [1.0])], "sensor_id string, seq long, ts long, vec array<float>"))
        assert [(r.seq, r.ts) for r in e.hot_rows().filter("sensor_id = 's'").orderBy("seq").collect()] == [(0, 0), (1, 4), (2, 5)] and e.list_sensors() == ["s", "t"]


class Ears(MetricsSink):
    def __init__(self):
        self.heard = []

    def on_append(self, sensor_id, latency_ns):
        self.heard.append(("append", sensor_id))

    def on_query(self, sensor_id, latency_ns):
        self.heard.append(("query", sensor_id))

    def on_anomaly_detected(self, sensor_id, distance):
        self.heard.append(("anomaly", sensor_id))

    def on_overwrite(self, sensor_id, count):
        self.heard.append(("overwrite", count))

    def on_eviction(self, sensor_id, rows, size):
        self.heard.append(("eviction", rows))

    def on_flush_error(self, sensor_id, code):
        self.heard.append(("flush_error", int(code)))

    def on_warning(self, sensor_id, code):
        self.heard.append(("warning", int(code)))


def test_sinks_hear(spark):
    ears = Ears()
    with Engine.create(spark, Config(1, ring_capacity=64), sink=ears) as e:
        e.append("s", 0, (1,))
        e.append_batch("s", range(70), [(1,)] * 70)  # a batch is not told
        assert ears.heard == [("append", "s")] and e.get_stats()["total_overwritten_entries"] == 7
        e.append("s", 99, (1,))
        assert ears.heard[1:] == [("overwrite", 1), ("append", "s")]
        e.query_nearest_n("s", (1,), 100)
        e.detect_anomaly("s", (-1,), 0.5)
        assert sorted(ears.heard[3:]) == [("anomaly", "s"), ("query", "s"), ("warning", 2)]


def test_a_batch_is_all_or_nothing(spark):
    with make(spark, dim=2) as e:
        e.append("s", 0, (1, 2))
        for bad in ([(1, 2), (1, float("nan"))], [(1, 2), (1,)], [(1, 2)]):
            assert code_of(e.append_batch, "s", [1, 2], bad) in (Code.INVALID_ARG, Code.DIM_MISMATCH)
        assert e.get_stats()["total_appends"] == 1 and e.hot_rows().count() == 1


class Broken(NullBackend):
    def __init__(self):
        self.fail, self.written, self.flushed = True, [], 0

    def write_blocks(self, rows):
        if self.fail:
            raise EngineError(Code.IO, "disk")
        self.written.append(rows.count())

    def flush(self):
        self.flushed += 1


def test_backends_of_ones_own(spark):
    ears, backend = Ears(), Broken()
    with Engine.create(spark, Config(1, ring_capacity=64), sink=ears, backend=backend) as e:
        e.append_batch("s", [0, 1, 1000], [(1,)] * 3)
        assert code_of(e.maintain_sliding_window, 100) == Code.IO and ears.heard == [("flush_error", -4)]
        assert e.hot_rows().count() == 3 and e.get_stats()["flush_errors_total"] == 1  # nothing is forgotten that was not written
        backend.fail = False
        e.maintain_sliding_window(100)
        e.flush()
        assert backend.written == [2, 1] and backend.flushed == 1 and e.hot_rows().count() == 0
    null = NullBackend()
    assert null.list_sensors() == null.list_blocks("s") == [] and null.read_metadata() is None and null.bytes_estimate() == 0 and null.rows() is None
    assert code_of(null.read_block, "s", 0) == Code.NOT_FOUND and null.write_metadata({}) is None and null.delete_sensor("s") is None


def test_the_timer_evicts(spark):
    with make(spark, dim=1, ring_capacity=128, window_ms=100, eviction_interval_ms=300) as e:
        e.append_batch("s", [*range(50), 1000], [(1,)] * 51)
        began = time.time()
        while e.get_stats()["total_evictions"] == 0 and time.time() - began < 60:
            time.sleep(0.2)
        assert [r.ts for r in e.hot_rows().collect()] == [1000]
        timer = e._timer
    assert not timer.is_alive()


def test_corrupt_blocks(spark, tmp_path):
    path = str(tmp_path / "cold")
    e = Engine.create(spark, Config(1, ring_capacity=64, window_ms=1000, recover_hot_window=True), path)
    for t in (10, 20, 30):
        e.append("s", t, (t,))
        e.flush()
    e.close()
    (part,) = (tmp_path / "cold/blocks/sensor_id=s/block_id=1").glob("*.parquet")
    part.write_bytes(b"PAR1 this is no table PAR1")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert code_of(e.backend.read_block, "s", 1) == Code.CORRUPTION and e.backend.read_block("s", 2).count() == 1
    with Engine.open(spark, path, now_ms=40) as again:
        assert sorted(r.ts for r in again.hot_rows().collect()) == [10, 30] and again.backend.list_blocks("s") == [0, 1, 2]


def test_many_pieces_become_one(spark):
    with make(spark, dim=1, ring_capacity=64) as e:
        for i in range(20):
            e.append("s", i, (i,))
            e._settle()
        assert len(e._pieces) < 18 and sorted(r.ts for r in e.hot_rows().collect()) == list(range(20))


def test_shell_transcript(spark):
    said = []
    lines = """create dim=4
# a comment

create dim=5
append s1 100 1,0,0,0
append s1 200 0.9,0.1,0,0
append s1 300 0,1,0,0
query s1 1,0,0,0 n=3
range s1 100 200
anomaly s1 0,1,0,0 t=0.4
anomaly s1 0.95,0.05,0,0 t=0.5
append s1 1
query who 1,0,0,0
nonsense
maintain 100
list
drop s1
list
close
list
quit
append s1 400 1,1,1,1"""
    Shell(spark, said.append).run(lines.split("\n"))
    assert said[1:] == [
        "engine created (dim=4)", "already have an engine: close it first", "ok", "ok", "ok", "  ts=100  score=1.000000", "  ts=200  score=0.993884", "  ts=300  score=0.000000",
        "  ts=100  vec=[1.0000,0.0000,0.0000,0.0000]", "  ts=200  vec=[0.9000,0.1000,0.0000,0.0000]", "anomaly", "normal", "usage: append SENSOR TS x,y,...", "error: not found: who",
        "unknown command: nonsense", "ok", "  s1", "1 sensor(s)", "ok", "0 sensor(s)", "ok", "no engine: create one first",
    ]
