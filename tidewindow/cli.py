"""A line-oriented shell over an engine: create, preallocate, append, query, range, anomaly, drop, list, stats,
maintain, flush, close, help, quit."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from .config import Config, Dtype, Metric
from .engine import Engine, version_string
from .errors import EngineError

USAGE = {
    "create": "create dim=N [dtype=f32|int8] [metric=cosine|euclidean] [capacity=N] [window=MS] [interval=MS] [max=N] [path=DIR]", "preallocate": "preallocate SENSOR", "append": "append SENSOR TS x,y,...",
    "query": "query SENSOR x,y,... [n=5]", "range": "range SENSOR T0 T1 [max=10]", "anomaly": "anomaly SENSOR x,y,... [t=0.5]", "drop": "drop SENSOR", "list": "list", "stats": "stats",
    "maintain": "maintain MS", "flush": "flush", "close": "close", "help": "help", "quit": "quit",
}


class Shell:
    def __init__(self, spark: SparkSession, say: Callable[[str], None] = print):
        self.spark, self.say, self.engine = spark, say, None

    def run(self, lines: Iterable[str]) -> None:
        self.say(f"tidewindow {version_string()} (type help for commands)")
        for line in lines:
            words = line.split()
            if not words or words[0].startswith("#"):
                continue
            if words[0] in ("quit", "exit"):
                break
            try:
                self._do(words[0], [w for w in words[1:] if "=" not in w], dict(w.split("=", 1) for w in words[1:] if "=" in w))
            except EngineError as e:
                self.say(f"error: {e}")
            except (ValueError, IndexError, KeyError):
                self.say(f"usage: {USAGE.get(words[0], 'help')}")

    def _do(self, name: str, args: list[str], options: dict[str, str]) -> None:
        vec = lambda s: [float(x) for x in s.split(",")]
        if name == "help":
            for u in USAGE.values():
                self.say(f"  {u}")
            return
        if name == "create":
            if self.engine is not None:
                self.say("already have an engine: close it first")
                return
            kinds = {"f32": Dtype.FLOAT32, "int8": Dtype.INT8}
            c = Config(
                int(options["dim"]), dtype=kinds[options.get("dtype", "f32")], metric=Metric[options.get("metric", "cosine").upper()], ring_capacity=int(options.get("capacity", 0)),
                window_ms=int(options.get("window", 0)), eviction_interval_ms=int(options.get("interval", 0)), max_sensors=int(options.get("max", 0)),
            )
            self.engine = Engine.create(self.spark, c, options.get("path"))
            self.say(f"engine created (dim={c.dim})")
            return
        if name not in USAGE:
            self.say(f"unknown command: {name}")
            return
        if self.engine is None:
            self.say("no engine: create one first")
            return
        e = self.engine
        if name == "query":
            for ts, score in e.query_nearest_n(args[0], vec(args[1]), int(options.get("n", 5))).rows:
                self.say(f"  ts={ts}  score={score:.6f}")
        elif name == "range":
            for ts, v in e.query_range(args[0], int(args[1]), int(args[2]), int(options.get("max", 10))).rows:
                self.say(f"  ts={ts}  vec=[{','.join(f'{x:.4f}' for x in v)}]")
        elif name == "anomaly":
            self.say("anomaly" if e.detect_anomaly(args[0], vec(args[1]), float(options.get("t", 0.5))) else "normal")
        elif name == "list":
            for s in e.list_sensors():
                self.say(f"  {s}")
            self.say(f"{len(e.sensors)} sensor(s)")
        elif name == "stats":
            for k, v in e.get_stats().items():
                self.say(f"{k + ':':<27} {v}")
        else:
            {
                "preallocate": lambda: e.preallocate_sensor(args[0]), "append": lambda: e.append(args[0], int(args[1]), vec(args[2])), "drop": lambda: e.drop_sensor(args[0]),
                "maintain": lambda: e.maintain_sliding_window(int(args[0])), "flush": e.flush, "close": e.close,
            }[name]()
            if name == "close":
                self.engine = None
            self.say("ok")


def main() -> None:
    Shell(SparkSession.builder.appName("tidewindow").getOrCreate()).run(sys.stdin)


if __name__ == "__main__":
    main()
