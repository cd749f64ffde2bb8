"""Session settings, the shared scratch folder, and the package on the workers.

Intermediate tables (range-positioned rows, replay state, streaming change logs) are written below the
folder that ``spark.checkpoint.dir`` names, so they outlive any executor.  Only in a single-process
session whose settings name none (unit tests) is a folder of our own chosen.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Python stages receive whole list columns; keep Arrow batches small enough for wide vectors
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # and for long texts
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # late rows are counted over the progress of all micro-batches
    "spark.sql.streaming.numRecentProgressUpdates": "100000",
}
# shuffle files of a query that has been written out are of no more use
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
INPUT_BYTES = 2 << 20           # of stored tables per shuffle partition
MOST_PARTITIONS = 10_000
_shipped: set[str] = set()


def local_session(cpus: str = "*", app: str = "tidewatch", memory: str = "20g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Pin the runtime settings the operators rely on (UTC above all); shuffles start with as many partitions as the
    tables in ``folder`` ask for, so that a task's share does not grow with them."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if folder is not None:
        _size_shuffles(spark, folder)
    ship(spark)
    return spark


def _size_shuffles(spark: SparkSession, folder: str) -> None:
    """Adaptive execution merges what turns out to be small; a larger setting of the session stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = min(MOST_PARTITIONS, -(-size // INPUT_BYTES))
    if wanted > max(int(spark.conf.get(x, None) or 0) for x in ("spark.sql.shuffle.partitions", INITIAL)):
        spark.conf.set(INITIAL, str(wanted))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, which import the functions of Python stages by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch.zip")     # read by this process only
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"tidewatch-{spark.sparkContext.applicationId}")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
