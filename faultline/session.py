"""Session helpers: checkpoint folder, size checks, dense numbering."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side is only ever hinted as broadcast when its rows are proven to stay under this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

#: Most rows of an input that one task widens and parses.
PIECE_ROWS = 50_000

_MID_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared work folder: `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder; on a cluster a machine-local folder
    would be lost together with the executor that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="faultline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder so lost executors do not replay its lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it from there.

    Like `cut`, but later steps read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with its scheme, as Spark's readers and writers take it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified path and the path in it, for tasks that read and write single files."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].strip("/")
    store, base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return store, base.rstrip("/")


def hinted(df: DataFrame) -> DataFrame:
    """A materialised `df` with the hint to broadcast it, if it is proven to be small enough."""
    held = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_LIMIT_BYTES else df


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """Use all cores for an input that arrives in fewer pieces than there are cores (small files).

    With its number of `rows` given, pieces are bounded as well: a compact file of short rows is split by its
    bytes into a few, and a task's time and memory would grow with the file.
    """
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PIECE_ROWS))
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def dense_number(df: DataFrame, order_by: list[str], out: str) -> DataFrame:
    """Number rows 0..n-1 in a total order without a single-partition window.

    The rows are range-sorted and checkpointed, so every partition knows its local positions; only the
    per-partition row counts (one row per partition) pass through the offset window.
    """
    placed = cut(df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _MID_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = F.broadcast(
        sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )  # one row per shuffle partition
    local = F.col("_mid").bitwiseAND(F.lit((1 << _MID_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, F.col("_offset") + local)
        .drop("_mid", "_part", "_offset")
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="faultline-")) / here.name
        sc.addPyFile(shutil.make_archive(str(target), "zip", here.parent, here.name))
        _shipped.add(sc.applicationId)
    return spark


def local_session(cpus: str = "8", name: str = "faultline") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
