"""Session settings, scratch space and size checks shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest number of rows the library will ever hint as a broadcast side.
BROADCAST_ROWS = 200_000
#: Largest size on disk of such a side; in memory it is a few times as much.
BROADCAST_BYTES = 16 << 20


def local_session(app: str = "panelwright", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost together with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = os.path.join(tempfile.gettempdir(), "panelwright-checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/panelwright/{label}-{uuid.uuid4().hex}"


def frozen(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and continue from the copy.

    Used where later steps must see one and the same row placement (range
    blocks), or where a loop would otherwise grow the plan.  Unlike an RDD
    checkpoint the rows are computed only once and stay columnar.
    """
    path = scratch_path(df.sparkSession, "frozen")
    df.write.parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    copy._scratch_path = path
    return copy


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own readers see them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discard(*copies: DataFrame) -> None:
    """Delete frozen tables that nothing reads any more, such as those of earlier rounds of a loop."""
    for copy in copies:
        if path := getattr(copy, "_scratch_path", None):
            system, place = _place(copy.sparkSession, path)
            system.delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of the shared folder, once the results built on them are written."""
    system, place = _place(spark, f"{shared_dir(spark).rstrip('/')}/panelwright")
    system.delete(place, True)


def stored_bytes(copy: DataFrame) -> int:
    """Size on disk of a frozen table."""
    system, place = _place(copy.sparkSession, copy._scratch_path)
    return system.getContentSummary(place).getLength()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A derived lookup table, broadcast only if its rows and bytes allow it.

    The table is written once, so the check and the join share one computation,
    and a large fact table on the other side need not be shuffled.  Beyond the
    limit the join runs as a shuffle join, where adaptive execution splits the
    skewed partitions of the larger side.
    """
    table = frozen(df)
    small = stored_bytes(table) <= BROADCAST_BYTES and table.count() <= limit
    return F.broadcast(table) if small else table
