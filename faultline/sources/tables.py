"""Stored tables: review-queue snapshots, knowledge base, audit log, file manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import neardup


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Newest complete snapshot version below `path`."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return None
    done = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(name.split("=")[1]))
    return max(done, default=None)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    v = latest_version(spark, path)
    return None if v is None else spark.read.parquet(f"{path}/version={v}")


def write_snapshot(df: DataFrame, path: str) -> int:
    """Write the next version. The version being read is never touched; a reader switches to the new one
    only when it is complete."""
    spark = df.sparkSession
    v = (latest_version(spark, path) or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={v}")
    return v


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _fs(spark, path)
    return fs.exists(folder)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_kb(entries: DataFrame, path: str) -> None:
    """Replace the modules present in `entries`; other modules stay."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)


def append_kb(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("module").parquet(path)


def loaded_modules(spark: SparkSession, path: str) -> DataFrame:
    return read_kb(spark, path).select("module").distinct()


def append_message_index(rows: DataFrame, path: str) -> None:
    """Add the messages of knowledge-base rows to the stored index, those that are not in it yet.

    The index is partitioned by length band, so that a search reads the bands in reach only.
    """
    spark = rows.sparkSession
    fresh = neardup.message_index(rows, codes=False)
    if table_exists(spark, path):
        fresh = fresh.join(read_message_index(spark, path).select("_t", "_band", "_msg"), ["_t", "_band", "_msg"], "left_anti")
    fresh.repartition("_band").write.mode("append").partitionBy("_band").parquet(path)


def read_message_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(neardup.INDEX_COLUMNS).parquet(path)


def append_audit(entry: DataFrame, path: str, batch_id: int | str) -> None:
    """Append an audit row under its batch; the same batch written again replaces itself."""
    entry.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def audit_scan(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.AUDIT.fields])
