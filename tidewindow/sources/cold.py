"""The cold tier: evicted blocks as Parquet, and the engine's metadata beside them.

Rows carry (sensor_id, block_id, pos) and lie in folders by sensor, sorted by block and time, so reads prune folders
and skip row groups.  A block is written before the window forgets it; writing a block again replaces it.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import Code, EngineError


class Backend(ABC):
    """What an engine needs of a cold tier."""

    @abstractmethod
    def write_blocks(self, rows: DataFrame) -> None:
        """rows(sensor_id, block_id, pos, ...)."""

    @abstractmethod
    def read_block(self, sensor_id: str, block_id: int) -> DataFrame: ...

    @abstractmethod
    def list_blocks(self, sensor_id: str) -> list[int]: ...

    @abstractmethod
    def list_sensors(self) -> list[str]: ...

    @abstractmethod
    def delete_sensor(self, sensor_id: str) -> None: ...

    @abstractmethod
    def write_metadata(self, data: dict) -> None: ...

    @abstractmethod
    def read_metadata(self) -> dict | None: ...

    def flush(self) -> None:
        """Writes are committed by their jobs; nothing is buffered."""

    def bytes_estimate(self) -> int:
        return 0

    def rows(self, skip_corrupt: bool = False) -> DataFrame | None:
        return None

    def next_block_ids(self) -> dict[str, int]:
        return {}


class NullBackend(Backend):
    """Stores nothing and finds nothing."""

    def write_blocks(self, rows: DataFrame) -> None:
        pass

    def read_block(self, sensor_id: str, block_id: int) -> DataFrame:
        raise EngineError(Code.NOT_FOUND, f"{sensor_id}/{block_id}")

    def list_blocks(self, sensor_id: str) -> list[int]:
        return []

    def list_sensors(self) -> list[str]:
        return []

    def delete_sensor(self, sensor_id: str) -> None:
        pass

    def write_metadata(self, data: dict) -> None:
        pass

    def read_metadata(self) -> dict | None:
        return None


class ParquetBackend(Backend):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = lambda rel: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}" if rel else self.path)
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, rel: str) -> bool:
        return self._fs.exists(self._p(rel))

    def write_blocks(self, rows: DataFrame) -> None:
        keys = ["sensor_id", "block_id"]
        try:
            if not self._exists("schema.json"):
                self._write("schema.json", StructType([f for f in rows.schema if f.name not in keys] + [StructField("sensor_id", StringType()), StructField("block_id", StringType())]).json())
            rows.repartition(*keys).sortWithinPartitions(*keys, "pos").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.path}/blocks")
        except Exception as e:
            raise EngineError(Code.IO, str(e)[:300]) from e

    def rows(self, skip_corrupt: bool = False) -> DataFrame | None:
        """All blocks; with skip_corrupt those that cannot be read are left out."""
        if not self._exists("blocks") or self._fs.getContentSummary(self._p("blocks")).getFileCount() < 2:
            return None
        inferred = self.spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
        self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        try:
            reader = self.spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
            if skip_corrupt:  # a broken footer must not decide the schema either
                known = self._schema()
                reader = reader.schema(known) if known is not None else reader
            return reader.parquet(f"{self.path}/blocks").withColumn("block_id", F.col("block_id").cast("long"))
        finally:
            self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", inferred)

    def _schema(self):
        return StructType.fromJson(json.loads(self._text("schema.json"))) if self._exists("schema.json") else None

    def _text(self, rel: str) -> str:
        return self.spark.read.text(f"{self.path}/{rel}", wholetext=True).first()[0]

    def put(self, rel: str, data: bytes) -> None:
        """A file beside the blocks."""
        out = self._fs.create(self._p(rel), True)
        out.write(bytearray(data))
        out.close()

    def _write(self, rel: str, text: str) -> None:
        self.put(rel, text.encode())

    def read_block(self, sensor_id: str, block_id: int) -> DataFrame:
        """Its rows in order; NOT_FOUND for no such block, CORRUPTION for one that cannot be read."""
        rel = f"blocks/sensor_id={self._escaped(sensor_id)}/block_id={block_id}"
        if not self._exists(rel):
            raise EngineError(Code.NOT_FOUND, f"{sensor_id}/{block_id}")
        try:
            rows = self.rows().filter((F.col("sensor_id") == sensor_id) & (F.col("block_id") == block_id)).orderBy("pos")
            rows.agg(*[F.count(c) for c in rows.columns]).collect()  # every column chunk is read once
        except Exception as e:
            raise EngineError(Code.CORRUPTION, f"{sensor_id}/{block_id}") from e
        return rows

    def _folders(self, rel: str, key: str) -> list[str]:
        """Values of a partition column, from folder names alone."""
        if not self._exists(rel):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._p(rel)) if x.isDirectory()]
        return sorted(self._jvm_paths.unescapePathName(n.split("=", 1)[1]) for n in names if n.startswith(f"{key}="))

    @property
    def _jvm_paths(self):
        return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils

    def _escaped(self, sensor_id: str) -> str:
        return self._jvm_paths.escapePathName(sensor_id)

    def list_blocks(self, sensor_id: str) -> list[int]:
        return sorted(map(int, self._folders(f"blocks/sensor_id={self._escaped(sensor_id)}", "block_id")))

    def list_sensors(self) -> list[str]:
        return self._folders("blocks", "sensor_id")

    def next_block_ids(self) -> dict[str, int]:
        return {s: max(self.list_blocks(s), default=-1) + 1 for s in self.list_sensors()}

    def delete_sensor(self, sensor_id: str) -> None:
        self._fs.delete(self._p(f"blocks/sensor_id={self._escaped(sensor_id)}"), True)

    def write_metadata(self, data: dict) -> None:
        self._write("engine.json", json.dumps(data, sort_keys=True))

    def read_metadata(self) -> dict | None:
        if not self._exists("engine.json"):
            return None
        try:
            return json.loads(self._text("engine.json"))
        except (ValueError, TypeError) as e:
            raise EngineError(Code.CORRUPTION, "metadata") from e

    def bytes_estimate(self) -> int:
        return self._fs.getContentSummary(self._p("blocks")).getLength() if self._exists("blocks") else 0


def rehydrated(cold: DataFrame, now_ms: int, window_ms: int, capacity: int) -> DataFrame:
    """Rows of the cold tier no older than the window at now_ms, the last capacity of each sensor, in their order."""
    from ..operators.window import last_arrivals

    return last_arrivals(cold.filter(F.col("ts") >= now_ms - window_ms), capacity)
