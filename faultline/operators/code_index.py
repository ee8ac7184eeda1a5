"""Source-file chunks, incremental indexing, and joins of stack frames to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text, traces
from faultline.functions.text import SPACE, let
from faultline.operators import vectors
from faultline.operators.grouping import first_per
from faultline.session import cut, saved

# --- fixed values: where a chunk ends -------------------------------------------------------------
CHUNK_LINES = 100
BOUNDARY = rf"^{SPACE}*(\}}|end|End Sub|End Function)"
# --- end of fixed values --------------------------------------------------------------------------
#: Longest window of a path that is looked up.
GRAM = 64


def chunk_array(content: Column, overlap: int = 0) -> Column:
    """Chunks of a text as ARRAY<STRUCT<line_start, line_end, content>>, blank chunks left out.

    A chunk ends at a boundary line or after 100 lines. Each file is cut inside its own row: boundary
    lines give segments, long segments are cut every 100 lines; nothing is shuffled.
    """
    def cut_up(lines: Column) -> Column:
        total = F.size(lines)
        closing = F.transform(lines, lambda s, i: F.when(s.rlike(BOUNDARY), i + 1))
        ends = F.array_distinct(F.concat(F.array_compact(closing), F.array(total)))
        return let(ends, lambda e: between(lines, e))

    def between(lines: Column, ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e: e + 1))
        pieces = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda g: F.transform(
            F.sequence(g["s"], g["e"], F.lit(CHUNK_LINES)),
            lambda p: F.struct(
                F.greatest(F.lit(1), p - overlap).alias("line_start"),
                F.least(p + (CHUNK_LINES - 1), g["e"]).alias("line_end"),
            ),
        )))
        filled = F.transform(pieces, lambda p: F.struct(
            p["line_start"].alias("line_start"), p["line_end"].alias("line_end"),
            F.array_join(F.slice(lines, p["line_start"], p["line_end"] - p["line_start"] + 1), "\n").alias("content"),
        ))
        return F.filter(filled, lambda c: c["content"].rlike(f"[^{SPACE[1:-1]}]"))

    return let(F.split(content, "\n"), cut_up)


def code_chunks(files: DataFrame, overlap: int = 0) -> DataFrame:
    """One row per chunk of `files` (file_path, content, ...); empty files give none."""
    rest = [c for c in files.columns if c != "content"]
    return text.unroll(files, rest, chunk_array(F.col("content"), overlap), "chunk_index", "c").select(
        *rest, "chunk_index", F.col("c.line_start").alias("line_start"), F.col("c.line_end").alias("line_end"), F.col("c.content").alias("content")
    )


def files_to_index(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new, or changed since they were indexed."""
    f, m = files.alias("f"), manifest.alias("m")
    return f.join(m, (F.col("f.file_path") == F.col("m.file_path")) & (F.col("f.mtime") <= F.col("m.mtime")), "left_anti")


def index_report(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Found, skipped, indexed, updated and failed (empty) files of an indexing run."""
    known = manifest.select("file_path", F.col("mtime").alias("_known"))
    rows = files.join(known, "file_path", "left")
    current = F.col("_known").isNotNull() & (F.col("mtime") <= F.col("_known"))
    empty = text.strip(text.text("content")) == ""
    return rows.agg(
        F.count(F.lit(1)).alias("total_files_found"),
        F.count_if(~current & ~empty).alias("files_indexed"),
        F.count_if(current).alias("files_skipped"),
        F.count_if(~current & ~empty & F.col("_known").isNotNull()).alias("files_updated"),
        F.count_if(~current & empty).alias("errors"),
    )


def new_manifest(files: DataFrame, chunks: DataFrame, indexed_at: str) -> DataFrame:
    counts = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"))
    return files.join(counts, "file_path").select(
        "file_path", "mtime", F.lit(indexed_at).alias("indexed_at"), "chunks", F.length("content").cast("bigint").alias("size_bytes")
    )


def repo_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("indexed_files"), F.sum("chunks").alias("total_chunks"), F.max("indexed_at").alias("last_indexed")
    )


def replace_chunks(stored: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored chunks with those of changed files replaced, none left behind."""
    return stored.join(changed.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh)


def exploded_frames(df: DataFrame, trace: str = "Stack_Trace", compat: bool = False) -> DataFrame:
    """One row per unique frame of every trace, `frame_no` in order."""
    rest = [c for c in df.columns if c != trace]
    frames = traces.unique_frames(traces.stack_frames(trace, compat))
    return text.unroll(df, rest, frames, "frame_no", "f").select(*rest, "frame_no", "f.*")


def _windows(c: Column, n: int) -> Column:
    """Distinct character windows of length `n`."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))


def frame_to_file(frames: DataFrame, files: DataFrame) -> DataFrame:
    """(frame_path, file_path): the first indexed file whose path contains the frame's path.

    `files` carries `file_ord`, the order of the index. Case does not count, `\\` equals `/`. A frame path
    inside a file path shares all its character windows with it. Windows are as long as the largest power of two that fits
    in the frame path, so each covers at least half of it, and folders that all files share tell little less than
    the whole. A frame path that is one window has its answer among the windows' first files; any other looks only at files holding its
    rarest window, and a window no file has means no match.
    """
    paths = frames.select(F.col("file_path").alias("frame_path")).filter(text.text("file_path") != "").distinct()
    needle = F.lower(F.replace("frame_path", F.lit("\\"), F.lit("/")))
    paths = paths.withColumn("_needle", needle)
    paths = cut(paths.withColumn("_n", F.least(F.pow(F.lit(2), F.floor(F.log2(F.length("_needle").cast("double") + 1e-6))).cast("int"), F.lit(GRAM))))
    hay = files.select("file_path", "file_ord", F.lower("file_path").alias("_hay"))
    sizes = sorted(r[0] for r in paths.select("_n").distinct().collect())  # at most log2(GRAM) + 1 numbers
    grams = F.concat(F.array().cast("array<string>"), *[F.when(F.length("_hay") >= n, _windows(F.col("_hay"), n)).otherwise(F.array().cast("array<string>")) for n in sizes])
    file_grams = text.unroll(hay, ["file_path", "file_ord", "_hay"], grams, "_at", "gram").drop("_at")
    mine = paths.select("frame_path", "_needle", F.size(_windows_of("_needle", "_n")).alias("n_grams"), F.explode(_windows_of("_needle", "_n")).alias("gram"))
    asked = mine.select("gram").distinct()
    spread = file_grams.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("file_ord", "file_path")).alias("_first"))
    known = cut(mine.join(spread, "gram"))
    whole = known.filter(F.col("gram") == F.col("_needle")).select("frame_path", F.col("_first.file_path").alias("file_path"))
    pick = known.filter(F.col("gram") != F.col("_needle")).groupBy("frame_path", "_needle", "n_grams").agg(
        F.count(F.lit(1)).alias("n_known"), F.min(F.struct("files", "gram")).alias("_rarest")
    ).filter(F.col("n_known") == F.col("n_grams"))
    pick = pick.select("frame_path", "_needle", F.col("_rarest.gram").alias("gram"))
    hits = pick.join(file_grams, "gram").filter(F.col("_hay").contains(F.col("_needle")))
    return whole.unionByName(hits.groupBy("frame_path").agg(F.min(F.struct("file_ord", "file_path")).alias("_first")).select(
        "frame_path", F.col("_first.file_path").alias("file_path")
    ))


def _windows_of(c: str, n: str) -> Column:
    """Distinct windows of a per-row length."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - F.col(n) + 1), lambda i: F.substring(F.col(c), i, F.col(n))))


def line_to_chunk(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk holding a line of a file, or the file's first chunk when none does.

    `wanted` = (file_path, line_number). Chunks are looked up by file and hundred of lines: a chunk of at
    most 100 lines touches two hundreds, so no line meets all chunks of its file.
    """
    asked = wanted.select("file_path", "line_number").distinct()
    slim = chunks.select("file_path", "chunk_index", "line_start", "line_end")
    by_hundred = slim.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line_start") / CHUNK_LINES), F.floor(F.col("line_end") / CHUNK_LINES))))
    keyed = asked.withColumn("_b", F.floor(F.col("line_number") / CHUNK_LINES))
    inside = keyed.join(by_hundred, ["file_path", "_b"]).filter(F.col("line_number").between(F.col("line_start"), F.col("line_end")))
    direct = inside.groupBy("file_path", "line_number").agg(F.min("chunk_index").alias("_hit"))
    first = slim.groupBy("file_path").agg(F.min("chunk_index").alias("_first"))
    on = (F.col("a.file_path") == F.col("d.file_path")) & F.col("a.line_number").eqNullSafe(F.col("d.line_number"))
    found = asked.alias("a").join(direct.alias("d"), on, "left").select("a.file_path", "a.line_number", "_hit")
    picked = found.join(first, "file_path").select("file_path", "line_number", F.coalesce("_hit", "_first").alias("chunk_index"))
    return picked.join(chunks, ["file_path", "chunk_index"])


def direct_snippets(frames: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks hit by the frames of each exception, in frame order."""
    paths = frame_to_file(frames, files).withColumnRenamed("file_path", "hit_path")
    located = frames.withColumnRenamed("file_path", "frame_path").join(paths, "frame_path").select(
        "Exception_ID", "frame_no", "hit_path", F.col("line_number").alias("target_line")
    )
    place = located.select(F.col("hit_path").alias("file_path"), F.col("target_line").alias("line_number"))
    chunk = line_to_chunk(place, chunks).select("file_path", F.col("line_number").alias("_line"), "chunk_index", "line_start", "line_end", "content")
    on = (F.col("hit_path") == F.col("file_path")) & F.col("target_line").eqNullSafe(F.col("_line"))
    return located.join(chunk, on).drop("hit_path", "_line")


def snippets(direct: DataFrame, semantic: DataFrame, k: int = 5) -> DataFrame:
    """Direct hits first, then vector hits, at most `k` per exception.

    `semantic` = (Exception_ID, rank, file_path, chunk_index, line_start, line_end, content). A chunk found
    both ways appears twice.
    """
    d = direct.select(
        "Exception_ID", F.lit("direct").alias("match_type"), F.col("frame_no").cast("bigint").alias("_o"), "file_path", "chunk_index", "line_start", "line_end", "content", "target_line"
    )
    n_direct = d.groupBy("Exception_ID").agg(F.count(F.lit(1)).alias("_have"))
    s = semantic.join(n_direct, "Exception_ID", "left").filter(F.col("rank") <= k - F.coalesce("_have", F.lit(0))).select(
        "Exception_ID", F.lit("semantic").alias("match_type"), F.col("rank").cast("bigint").alias("_o"), "file_path", "chunk_index", "line_start", "line_end", "content",
        F.lit(None).cast("int").alias("target_line"),
    )
    return first_per(d.unionByName(s), ["Exception_ID"], ["match_type", "_o"], k, rank="snippet_no").drop("_o")


def retrieved(exceptions: DataFrame, files: DataFrame, chunks: DataFrame, embedder, k: int = 5, trace: str = "Stack_Trace") -> tuple[DataFrame, DataFrame]:
    """(exceptions with `trace_id`, snippets by `trace_id`): one retrieval per distinct trace.

    Traces repeat far more often than they differ. Each distinct one is parsed once; those whose frames give fewer than `k` chunks
    are searched by vector over all chunks (with `kb_id` and `embedding`, from `indexed`). Null counts as an empty trace.
    """
    keyed = exceptions.withColumn("trace_id", F.sha2(text.text(trace), 256))
    distinct = saved(keyed.groupBy("trace_id").agg(F.first(text.text(trace)).alias("_trace")))
    frames = saved(exploded_frames(distinct.select(F.col("trace_id").alias("Exception_ID"), "_trace"), "_trace"))
    direct = cut(direct_snippets(frames, files, chunks.drop("embedding", "kb_id")))
    have = direct.groupBy(F.col("Exception_ID").alias("trace_id")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    wanted = embedder.transform(distinct.join(have, "trace_id", "left_anti"), "_trace", "vec").select(F.col("trace_id").alias("q_id"), "vec")
    hits = vectors.code_topk(saved(wanted), chunks.select("kb_id", "embedding"), k).select("q_id", "kb_id", "rank")
    semantic = hits.join(chunks.drop("embedding"), "kb_id").withColumnRenamed("q_id", "Exception_ID")
    found = cut(snippets(direct, semantic, k)).withColumnRenamed("Exception_ID", "trace_id")
    return keyed, found


def indexed(files: DataFrame, embedder, overlap: int = 0) -> DataFrame:
    """Chunks with vectors (column `embedding`) and an id per chunk."""
    chunks = code_chunks(files, overlap).withColumn("kb_id", F.concat(F.col("file_path"), F.lit("__chunk_"), F.col("chunk_index").cast("string")))
    return cut(embedder.transform(chunks, "content", "embedding"))
