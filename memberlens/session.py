"""Session settings and lineage cutting."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on. All of them can be changed on a live session.
RUNTIME_CONF = {
    # Timestamps are wall-clock values without a zone; one fixed zone keeps day arithmetic exact.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when the aggregation above it then needs
    # its own exchange: that exchange carries partial aggregates, not raw rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows dealt by member can be joined by member and date without another exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The JVM interprets methods above this size; Spark then falls back to smaller generated ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Monthly sinks replace only the months they write.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


RECORDS_PER_FILE = 5_000_000
ROW_GROUP_BYTES = 8 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("memberlens")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a private one only on a single machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _private:
        _private[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _private[application]


_private: dict[str, str] = {}


def stage_path(spark: SparkSession) -> str:
    """A new path in the folder of this application, which can be removed as a whole when it has ended."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, fine: bool = False, spread: bool = False) -> DataFrame:
    """Write `df` as a table below the checkpoint folder and read it back from there.

    Used where one result feeds many jobs (stage outputs, inputs of iterative
    fits): a lost executor re-reads files instead of recomputing the plan, and
    readers still profit from column pruning and filter pushdown. `fine` writes small row
    groups: for stages and inputs of fits, which are then read in many tasks however few files
    they were written to. Rows are not exchanged for that: dealing them round robin sorts
    and sends every one of them. `spread` does that nevertheless, for the narrow points of fits
    that spend seconds of arithmetic on a megabyte.
    """
    if spread:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path = stage_path(df.sparkSession)
    writer = df.write.option("maxRecordsPerFile", RECORDS_PER_FILE)
    if fine:
        writer = writer.option("parquet.block.size", ROW_GROUP_BYTES)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(run: Callable, items: Iterable, at_once: int = 4) -> list:
    """Submit independent fits together; each is a sequence of small jobs that leaves executors idle."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, items))


BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store an aggregated side of a join and have it broadcast if it has at most `rows` rows; else Spark chooses the join."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def shipped(module: str) -> None:
    """Send the module's functions along with tasks, so that Python workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
