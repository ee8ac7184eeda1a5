"""Structured Streaming jobs: every sink is keyed by batch, so a replayed batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators import audit, code_index, kb as kb_ops, neardup
from faultline.session import spread
from faultline.sources import tables


def read_log_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", max_files: int = 16, **options: str) -> DataFrame:
    """Log files as they arrive, at most `max_files` per batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).options(**options).load(folder)


def _start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def stream_triage(stream: DataFrame, run: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], out: str, leaders: str, checkpoint: str, audit_path: str | None = None, module: str = "Unknown", run_ts: str = "") -> StreamingQuery:
    """Run a batch job on every arriving batch; optionally one audit row per batch.

    `run` gets the batch and the leaders of earlier batches, and gives results and new leaders. Leaders are
    stored by batch and a batch sees only those before it, so a replayed batch does the same again.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, spread(batch, batch.count())
        kind = f"{neardup.LEADER_COLUMNS}, batch_id bigint"
        known = spark.read.schema(kind).parquet(leaders) if tables.table_exists(spark, leaders) else spark.createDataFrame([], kind)
        results, found = run(batch, known.filter(F.col("batch_id") < batch_id).drop("batch_id"))
        _replace_batch(found, leaders, batch_id)
        _replace_batch(results, out, batch_id)
        if audit_path:
            done = batch.sparkSession.read.parquet(out).filter(F.col("batch_id") == batch_id)
            entry = audit.audit_entry(done, F.count_if("Requires_Review"), f"batch_{batch_id}", module, run_ts, 0.0)
            tables.append_audit(entry, audit_path, batch_id)

    return _start(stream, checkpoint, each)


def stream_audit(results: DataFrame, path: str, checkpoint: str, module: str, run_ts: str) -> StreamingQuery:
    """One audit row per arriving batch of results."""
    def each(batch: DataFrame, batch_id: int) -> None:
        entry = audit.audit_entry(batch, F.count_if("Requires_Review"), f"batch_{batch_id}", module, run_ts, 0.0)
        tables.append_audit(entry, path, batch_id)

    return _start(results, checkpoint, each)


def stream_kb_append(stream: DataFrame, kb_path: str, checkpoint: str) -> StreamingQuery:
    """Append new entries from arriving files, checked against the stored table each time.

    The table itself is the state: a restart or a replayed batch finds its own entries and adds nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, spread(batch, batch.count())
        if tables.table_exists(spark, kb_path):
            fresh = kb_ops.kb_append(tables.read_kb(spark, kb_path), batch)
        else:
            fresh = kb_ops.kb_build(batch)
        tables.append_kb(fresh, kb_path)

    return _start(stream, checkpoint, each)


def index_incremental(files: DataFrame, chunks_path: str, manifest_path: str, indexed_at: str) -> None:
    """Index new and changed files; chunks of changed files are replaced, the rest is kept.

    Both tables are snapshots: readers keep the old version until the new one is complete.
    """
    spark = files.sparkSession
    manifest = tables.read_snapshot(spark, manifest_path)
    stored = tables.read_snapshot(spark, chunks_path)
    todo = files if manifest is None else code_index.files_to_index(files, manifest)
    fresh = code_index.code_chunks(todo)
    done = code_index.new_manifest(todo, fresh, indexed_at)
    if manifest is not None:
        fresh = code_index.replace_chunks(stored, todo, fresh)
        done = manifest.join(todo.select("file_path"), "file_path", "left_anti").unionByName(done)
    tables.write_snapshot(fresh, chunks_path)
    tables.write_snapshot(done, manifest_path)
