"""Queries: files in and out, composite jobs, streams. They write below the shared folder, a new one per run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import embedding
from faultline.operators import audit, code_index, review
from faultline.plans import q_review  # noqa: F401  its checks are used here
from faultline.plans import triage as jobs
from faultline.plans.q_code import _CHUNKS
from faultline.plans.q_kb import _KB, embedded_kb
from faultline.plans.q_text import RUN_TS, raw_log
from faultline.plans.registry import CHECKS, query
from faultline.plans.standins import view, with_views
from faultline.schemas import CLASS_LABELS
from faultline.session import PIECE_ROWS, cut, shared_folder
from faultline.sources import files, tables
from faultline.streaming import jobs as streams

MODULE = "Payment"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def tidy_log(spark: SparkSession, sf: str) -> DataFrame:
    return raw_log(spark, sf).withColumnRenamed(" MACHINE_NAME ", "MACHINE_NAME")


# an empty cell reads as missing
@query("scan_exceptions", with_views("log") + "SELECT event_id AS LOG_SEQ_NO, nullif(payload, '') AS EVENT_INFORMATION, sev AS SEVERITY, machine AS MACHINE_NAME, proc AS PRCS_NAME, logtime AS LOGTIME FROM log")
def _(spark, sf):
    folder = scratch(spark, "log") + ".csv"
    log = tidy_log(spark, sf)
    files.write_csv(log, folder)
    return files.scan_exceptions(spark, folder, log.schema)


@query("scan_kv_blocks", with_views("log") + "SELECT CAST(event_id AS STRING) AS id, logtime AS time, machine AS host, CASE WHEN k % 2 = 0 THEN typ END AS type FROM log")
def _(spark, sf):
    folder = scratch(spark, "kv") + ".txt"
    lines = F.concat_ws(
        "\n", F.concat(F.lit("id: old"), F.col("k")), F.concat(F.lit("id:"), F.col("event_id")), F.concat(F.lit(" time : "), F.col("logtime")), F.lit("no separator here"),
        F.concat(F.lit("host:  "), F.col("machine"), F.lit(" ")), F.when(F.col("k") % 2 == 0, F.concat(F.lit("type: "), F.col("typ"))))
    view(spark, sf, "log").select(lines.alias("value")).write.option("lineSep", "\n\n").text(folder)
    return files.scan_exceptions(spark, folder, "id string, time string, host string, type string")


@query("scan_kb", with_views("kbfile") + "SELECT * REPLACE (nullif(EVENT_INFORMATION, '') AS EVENT_INFORMATION, nullif(Resolution, '') AS Resolution) FROM kbfile")
def _(spark, sf):
    folder = scratch(spark, "kb")
    rows = view(spark, sf, "kbfile")
    files.write_csv(rows, folder)
    return files.scan_kb(spark, folder, rows.schema)


@query("scan_code", with_views("code") + "SELECT file_path, content FROM code")
def _(spark, sf):
    """Documents written out as source files, one each, and read back."""
    folder = scratch(spark, "tree")
    uri = folder if ":" in folder else f"file://{folder}"

    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)  # the shared folder, wherever it is
        made = set()
        for r in rows:
            target = f"{base}/{r.file_path}"
            parent = target.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(target) as out:
                out.write(r.content.encode("utf-8"))

    view(spark, sf, "code").select("file_path", "content").foreachPartition(put)
    return files.scan_code(spark, folder).select("file_path", "content")


@query("write_results", with_views("results") + "SELECT Exception_ID, Resolution, Confidence_Score, 'r1' AS run_id FROM results")
def _(spark, sf):
    folder = scratch(spark, "results")
    rows = view(spark, sf, "results").select("Exception_ID", "Resolution", "Confidence_Score")
    files.write_results(rows, folder, "r0")
    files.write_results(rows, folder, "r1")
    files.write_results(rows, folder, "r1")
    return spark.read.parquet(folder).filter(F.col("run_id") == "r1")


@query("write_results_csv", with_views("results") + "SELECT Exception_ID, Resolution, CAST(Confidence_Score AS VARCHAR) AS Confidence_Score, 'r1' AS run_id FROM results")
def _(spark, sf):
    folder = scratch(spark, "results")
    rows = view(spark, sf, "results").select("Exception_ID", "Resolution", "Confidence_Score")
    for _ in range(2):  # a run written again replaces itself
        files.write_results(rows, folder, "r1", "csv")
    return spark.read.option("header", True).option("escape", '"').csv(folder)


@query("module_extract", with_views("exc") + "SELECT Exception_ID, Module, Exception_Type FROM exc WHERE Module = 'Payment'")
def _(spark, sf):
    folder = scratch(spark, "extract")
    files.module_extract(view(spark, sf, "exc").select("Exception_ID", "Module", "Exception_Type"), MODULE, folder)
    return files.scan_csv(spark, folder, "Exception_ID string, Module string, Exception_Type string", multi_line=False)


@query("write_json_text", CHECKS["summary_json"])
def _(spark, sf):
    folder = scratch(spark, "summary")
    files.write_json_text(audit.summary_json(view(spark, sf, "results"), MODULE, RUN_TS), folder)
    return spark.read.text(folder).withColumnRenamed("value", "summary")


@query("results_numbered", with_views("results") + "SELECT Exception_ID, row_ord, CASE WHEN Requires_Review THEN 'YES' ELSE 'NO' END AS Requires_Review, row_number() OVER (ORDER BY row_ord) AS Row FROM results")
def _(spark, sf):
    shown = view(spark, sf, "results").select("Exception_ID", "row_ord", "Requires_Review")
    return review.results_display(shown, ["row_ord"])


@query("review_page_after", with_views("queue") + "SELECT review_id FROM queue WHERE review_id > (SELECT review_id FROM queue ORDER BY review_id LIMIT 1 OFFSET 19) ORDER BY review_id LIMIT 20")
def _(spark, sf):
    queue = view(spark, sf, "queue")
    last = queue.orderBy("review_id").limit(20).agg(F.max("review_id")).first()[0]
    return review.review_page_after(queue, last, 20).select("review_id")


@query("review_snapshot", with_views("queue") + "SELECT review_id, 'Completed' AS Review_Status FROM queue")
def _(spark, sf):
    folder = scratch(spark, "queue")
    tables.write_snapshot(view(spark, sf, "queue").select("review_id", "Review_Status"), folder)
    tables.write_snapshot(tables.read_snapshot(spark, folder).withColumn("Review_Status", F.lit("Completed")), folder)
    return tables.read_snapshot(spark, folder)


@query("audit_scan", with_views("audit") + "SELECT * FROM audit")
def _(spark, sf):
    folder = scratch(spark, "audit")
    rows = view(spark, sf, "audit")
    tables.append_audit(rows, folder, 1)
    tables.append_audit(rows, folder, 1)
    return tables.audit_scan(spark, folder)


@query("triage")
def _(spark, sf):
    """With recorded answers, and labels for one exception in three."""
    kb, embedder = embedded_kb(spark, sf)
    answers = view(spark, sf, "answers").select("row_ord", "raw_answer")
    label = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, CLASS_LABELS)), (F.col("row_ord") % len(CLASS_LABELS) + 1).cast("int")), F.lit(" "))
    labels = answers.filter(F.col("row_ord") % 3 == 0).select("row_ord", label.alias("label"))
    return jobs.triage(tidy_log(spark, sf), cut(kb), embedder, MODULE, RUN_TS, answers=answers, labels=labels)


@query("score_with_callable", with_views("exc") + """SELECT row_ord, Exception_Message, '{"Resolution": "PURGE", "Confidence": ' || (len(Exception_Message) % 100) || '}' AS raw_answer,
CAST(NULL AS STRING) AS error FROM exc""")
def _(spark, sf):
    def short(prompts: list[str]) -> list[str]:
        return ['{"Resolution": "PURGE", "Confidence": %d}' % (len(p) % 100) for p in prompts]

    return jobs.score_with_callable(view(spark, sf, "exc").select("row_ord", "Exception_Message"), short, "Exception_Message")


@query("code_analysis")
def _(spark, sf):
    source = view(spark, sf, "code")
    embedder = embedding.TermEmbedder.fit(code_index.code_chunks(source), "content")
    chunks = code_index.indexed(source, embedder)
    said = view(spark, sf, "answers").select(F.col("row_ord").cast("string").alias("Exception_ID"), "raw_answer")
    exc = view(spark, sf, "exc").select("Exception_ID", "Exception_Type", "Exception_Message", "Stack_Trace")
    return jobs.code_analysis(exc, source.select("file_path", "file_ord"), chunks, embedder, answers=said)


def arrive(rows: DataFrame, folder: str, batches: int = 2) -> int:
    """Write rows as files of bounded size; returns how many of them make one of the given number of batches."""
    each = -(-rows.count() // (batches * PIECE_ROWS)) or 1
    rows.repartition(batches * each).write.parquet(folder)
    return each


@query("stream_triage")
def _(spark, sf):
    """The log arrives as files and is triaged batch by batch."""
    arriving, out, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    log = tidy_log(spark, sf)
    each = arrive(log, arriving)
    kb, embedder = embedded_kb(spark, sf)
    kb = cut(kb)
    stream = streams.read_log_stream(spark, arriving, log.schema, max_files=each)
    answers = view(spark, sf, "answers").select("row_ord", "raw_answer")

    def run(batch: DataFrame, leaders: DataFrame) -> tuple[DataFrame, DataFrame]:
        return jobs.triage_batch(batch, leaders, kb, embedder, MODULE, RUN_TS, answers=answers)

    streams.stream_triage(stream, run, out, scratch(spark, "leaders"), state).awaitTermination()
    return spark.read.parquet(out)


@query("stream_kb_append", _KB + "SELECT module, signature, resolution FROM ak")
def _(spark, sf):
    arriving, out, state = scratch(spark, "in"), scratch(spark, "kb"), scratch(spark, "state")
    rows = view(spark, sf, "kbfile")
    each = arrive(rows, arriving)
    streams.stream_kb_append(streams.read_log_stream(spark, arriving, rows.schema, max_files=each), out, state).awaitTermination()
    return tables.read_kb(spark, out).select("module", "signature", "resolution")


@query("stream_audit", with_views("results") + f"""SELECT '{MODULE}' AS Module, count(*) FILTER (Resolution = 'PURGE') AS Purge_Count, count(*) FILTER (Resolution = 'REPROCESS') AS Reprocess_Count,
count(*) FILTER (Resolution = 'INVESTIGATE') AS Investigate_Count FROM results""")
def _(spark, sf):
    arriving, out, state = scratch(spark, "in"), scratch(spark, "audit"), scratch(spark, "state")
    rows = view(spark, sf, "results").select("Exception_ID", "Resolution", "Confidence_Score", "Requires_Review")
    rows.repartition(3).write.parquet(arriving)
    streams.stream_audit(streams.read_log_stream(spark, arriving, rows.schema, max_files=1), out, state, MODULE, RUN_TS).awaitTermination()
    return audit.audit_by_module(tables.audit_scan(spark, out))


@query("index_incremental", "WITH " + _CHUNKS.rstrip() + ", " + with_views("manifest")[5:] + """SELECT c.file_path, c.mtime + CASE WHEN m.file_path IS NULL THEN 0 ELSE 100 END AS mtime,
CASE WHEN m.file_path IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-02-02 00:00:00' END AS indexed_at, k.n AS chunks
FROM code c LEFT JOIN manifest m ON m.file_path = c.file_path JOIN (SELECT file_path, count(*) AS n FROM ck GROUP BY 1) k ON k.file_path = c.file_path""")
def _(spark, sf):
    """Index all files, then again with a later time stamp on those the earlier manifest knows."""
    chunk_path, manifest_path = scratch(spark, "chunks"), scratch(spark, "manifest")
    source = view(spark, sf, "code")
    streams.index_incremental(source, chunk_path, manifest_path, "2024-02-01 00:00:00")
    known = view(spark, sf, "manifest").select("file_path", F.lit(1).alias("_known"))
    touched = source.join(known, "file_path", "left").withColumn("mtime", F.col("mtime") + F.coalesce("_known", F.lit(0)) * 100).drop("_known")
    streams.index_incremental(touched, chunk_path, manifest_path, "2024-02-02 00:00:00")
    return tables.read_snapshot(spark, manifest_path).select("file_path", "mtime", "indexed_at", "chunks")
