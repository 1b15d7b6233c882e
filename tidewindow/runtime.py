"""What every entry point needs from a session: shipped code, settings, scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    folder = Path(tempfile.mkdtemp(prefix="tidewindow-"))
    archive = folder / "tidewindow_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, str(Path(ROOT.name) / p.relative_to(ROOT)))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local master, as in tests, gets one of
    our own where that is unset; elsewhere no machine's own folder would do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewindow.scratch", None)
    if not base:
        if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewindow-scratch-")
        spark.conf.set("tidewindow.scratch", base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    Written rather than checkpoint()ed: one pass, columnar and compressed, and the next join reads a
    plain scan, which lets adaptive execution split skewed partitions on both sides.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears what is left
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settings(spark: SparkSession) -> None:
    """Session settings that the operators count on: small Arrow batches for long texts, and Bloom filters
    of fixed size (8 MB) in front of joins that pick some rows out of a large scan."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "16MB",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "8GB",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    ship(spark)
