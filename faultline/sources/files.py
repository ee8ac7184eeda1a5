"""Files in and out: exception logs, key-value logs, knowledge-base files, source trees, reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import SPACE, let, once, strip
from faultline.schemas import CODE_EXTENSIONS, SKIPPED_FOLDERS
from faultline.session import opened, qualified, saved, spread

#: Most rows of a CSV file that is written.
FILE_ROWS = 50_000
#: Folders that a task lists, files and bytes that a task reads; names and bytes it hands on at a time.
FOLDERS, FILES, PIECE_BYTES = 1000, 5000, 1 << 26
LISTED, BATCH_BYTES = 10_000, 1 << 24


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header and quoted JSON cells (`""` escapes).

    With `multi_line`, cells may hold line breaks and a file is read by one task; without it, large files are
    split. Either way the rows are spread over all cores.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    return spread((reader.schema(schema) if schema else reader).csv(path))


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON, one object a line (files are split), or with `multi_line` one array or object a file."""
    reader = spark.read.option("multiLine", multi_line)
    return spread((reader.schema(schema) if schema else reader).json(path))


def scan_kv_blocks(spark: SparkSession, path: str, keys: list[str] | None = None, whole_files: bool = False, line_end: str = "\n") -> DataFrame:
    """Text log of `key: value` lines in blocks separated by blank lines: one row per block.

    `keys` become columns; without them there is one column `fields`, a map of all keys. A repeated key keeps
    its last value. Files are split at blank lines so large ones are read in parallel; `line_end` is
    "\\r\\n" for large files with such ends. `whole_files` reads each file as one text in one task: for small
    files with mixed line ends or blanks in the separator lines.
    """
    if whole_files:
        blocks = spark.read.text(path, wholetext=True).select(
            F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[\t\x0b\f \x{a0}]*(?=\n)")).alias("value")
        )
    else:
        blocks = spark.read.text(path, lineSep=line_end * 2)
        if line_end != "\n":
            blocks = blocks.select(F.replace("value", F.lit(line_end), F.lit("\n")).alias("value"))
    lines = F.filter(F.split("value", "\n"), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(
        strip(F.substring_index(s, ":", 1)).alias("k"), strip(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("v"), ))

    def last(pairs):
        return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))

    rows = once(blocks.select(let(pairs, last).alias("_p")), "m", F.map_from_entries("_p")).select("m").filter(F.size("m") > 0)
    return rows.select(*[F.col("m")[k].alias(k) for k in keys]) if keys else rows.select(F.col("m").alias("fields"))


def scan_exceptions(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Exception log by file extension: csv, json or txt; a text log takes its columns from the schema's names."""
    if path.endswith(".csv"):
        return scan_csv(spark, path, schema)
    if path.endswith(".json"):
        return scan_json(spark, path, schema)
    if path.endswith(".txt"):
        named = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return scan_kv_blocks(spark, path, named.names if named else None)
    raise ValueError(f"Unsupported file format: {path}")


def scan_kb(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return scan_csv(spark, path, schema)


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    left_out = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
    return left_out and not (folder and name.startswith(("_common_metadata", "_metadata")))


def _list(root: str):
    """What stands in each of the given folders below `root`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}"))
                for start in range(0, len(found), LISTED):
                    rows = []
                    for x in found[start : start + LISTED]:
                        below = x.type == fs.FileType.Directory
                        if (below or x.type == fs.FileType.File) and not _hidden(x.base_name, below) and not (below and x.base_name in SKIPPED_FOLDERS):
                            rows.append((f"{folder}/{x.base_name}" if folder else x.base_name, below, (x.mtime_ns or 0) // 1_000_000, x.size or 0))
                    columns = [list(c) for c in zip(*rows)] or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["file_path", "folder", "modified", "size"])

    return run


def _read(root: str):
    """The named files below `root` with their content, a bounded number of bytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)

        def batch_of(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], ["file_path", "modified", "content"])

        rows, held = [], 0
        for batch in batches:
            for path, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{path}") as file:
                    content = file.read()
                if rows and held + len(content) > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
                rows.append((path, modified, content))
                held += len(content)
        if rows:
            yield batch_of(rows)

    return run


def _wanted(file_path: Column) -> Column:
    """Paths of source files that stand in no skipped folder."""
    parts = F.split(file_path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skip = F.array(*[F.lit(s) for s in SKIPPED_FOLDERS])
    return F.lower(_extension(file_path)).isin(*CODE_EXTENSIONS) & ~F.arrays_overlap(folders, skip)


def _extension(file_path: Column) -> Column:
    return F.regexp_extract(file_path, r"[^/](\.[^./]+)$", 1)


def _code_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, mtime, content) of the source files below the folder `root` (qualified).

    Tasks list the folders, level by level, and read the files, both by their names in a table: no file passes the driver.
    """
    parallel = spark.sparkContext.defaultParallelism
    folders, found = spark.range(1).select(F.lit("").alias("file_path")), []
    while n := folders.count():
        listed = saved(folders.repartition(min(n, max(parallel, -(-n // FOLDERS)))).mapInArrow(_list(root), "file_path string, folder boolean, modified bigint, size bigint"))
        found.append(listed.filter(~F.col("folder") & _wanted(F.col("file_path"))))
        folders = listed.filter("folder").select("file_path")
    files = reduce(DataFrame.unionByName, found)
    n, held = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = max(parallel, -(-n // FILES), -(-held // PIECE_BYTES))
    rows = files.select("file_path", "modified").repartition(pieces).mapInArrow(_read(root), "file_path string, modified bigint, content binary")
    return rows.select("file_path", (F.col("modified") / 1000.0).alias("mtime"), "content")


def _listed_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """As `_code_files`, by Spark's own reader, whose driver holds all names: for stores that only Spark opens, and for patterns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.withColumn("_plain", F.regexp_replace("path", "^[a-z]+:/*", "/")).withColumn("_base", F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/"))
    named = named.withColumn("file_path", F.expr("substring(_plain, length(_base) + 2)"))
    return named.filter(_wanted(F.col("file_path"))).select("file_path", F.col("modificationTime").cast("double").alias("mtime"), "content", "_plain")


def scan_code(spark: SparkSession, root: str) -> DataFrame:
    """Source files under `root`: file_path (relative), full_path, file_extension, mtime, content.

    Bytes that are not UTF-8 are dropped, line ends become `\\n`, empty files are left out.
    """
    top = qualified(spark, root)
    try:
        store, base = opened(top)
        in_tasks = store.get_file_info(base or "/").type == fs.FileType.Directory
    except (OSError, pa.ArrowException):
        in_tasks = False
    if in_tasks:
        base = F.regexp_replace(F.lit(top.rstrip("/")), "^[a-z]+:/*", "/")
        kept = _code_files(spark, top).withColumn("_plain", F.concat_ws("/", F.rtrim(base, F.lit("/")), "file_path"))
    else:
        kept = _listed_by_spark(spark, root)
    text = F.regexp_replace(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")), "\r\n?", "\n")
    out = kept.select(
        "file_path", F.col("_plain").alias("full_path"), _extension(F.col("file_path")).alias("file_extension"), "mtime", text.alias("content"))
    return out.filter(F.col("content").rlike(f"[^{SPACE[1:-1]}]"))


def write_results(results: DataFrame, folder: str, run_id: str, fmt: str = "parquet") -> None:
    """Results of one run below `folder`, one sub-folder per run; writing a run again replaces it."""
    writer = results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        _csv(writer).csv(folder)
    else:
        writer.parquet(folder)


def write_csv(df: DataFrame, folder: str, rows: int = FILE_ROWS) -> None:
    """Files of at most `rows` rows: with line breaks inside cells, a file can't be split and is one task's."""
    _csv(df.write.mode("overwrite").option("maxRecordsPerFile", rows)).csv(folder)


def _csv(writer: DataFrameWriter) -> DataFrameWriter:
    """Header, doubled quotes, blanks at the ends of a cell kept."""
    return writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def module_extract(results: DataFrame, module: str, folder: str) -> None:
    write_csv(results.filter(F.col("Module") == module), folder)


def write_json_text(one_column: DataFrame, folder: str) -> None:
    one_column.write.mode("overwrite").text(folder)
