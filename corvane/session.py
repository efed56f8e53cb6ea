"""Sending the package to the executors, and folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch from which the next row begins another, unless the session sets its own.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let the Python workers of this application import the package, once; the driver's file server hands out one small archive."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        # texts may be long: a batch of rows for a worker ends at some MB, whatever its number of rows
        if spark.conf.get(_BATCH, None) in (None, "-1", str(2**31 - 1), str(2**63 - 1)):
            spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def init(threads: int | None = None, memory_mb: int | None = None, log_level: str = "WARN", log_dir: str | None = None, **options) -> SparkSession:
    """A session with an engine's usual settings as Spark's: threads of a local master, memory of the driver, log level, a folder for event logs.

    ``options`` are Spark's own by name, with _ for the dots. A session that lives already keeps what cannot change.
    """
    builder = SparkSession.builder.appName("corvane")
    if threads is not None:
        builder = builder.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", str(threads))
    if memory_mb is not None:
        builder = builder.config("spark.driver.memory", f"{memory_mb}m")
    if log_dir is not None:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    for name, value in options.items():
        builder = builder.config(name.replace("_", "."), str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return ship(spark)


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; it is deleted when the driver ends.

    Where the session names none (local tests), the context's checkpoint folder is used, or one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/corvane-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it, if the session still lives."""
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone: its owner clears the shared folder
        pass
