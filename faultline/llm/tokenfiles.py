"""Files of token ids in a canonical, length-limited Huffman code.

The texts are dealt out by ranges of doc_id and encoded once; ids are counted over all of them, and one code is
made from the counts (package-merge, at most `LIMIT` bits). A file holds the ids of a run of documents: code
lengths, ids and lengths of the documents, and blocks of `BLOCK` ids with the bit offset at which each one
begins. Blocks are decoded independently and side by side, by a table over the next `LIMIT` bits.

A file is a binary value in a table in the shared folder, so that Spark's writer commits it and a lost executor
leaves no half-written file. Each file can be read alone, knows its place (`start`: ids before it), and has
at most about `FILE` ids (one longer document makes a larger file).

Defined results: a null text is empty and has the end id alone; documents go by ascending id, null ids last,
equal ids by text; repeated rows are written as often as they stand; an empty table makes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline.llm.subwords import subwords
from faultline.session import shared_folder

LIMIT = 18
BLOCK = 1024
FILE = 500_000
END = 0
#: Characters encoded together.
CHUNK = 4_000_000

_MAGIC = b"HUFIDS1\0"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits for each symbol (0: it doesn't occur), optimal among codes of at most `limit` bits.

    Package-merge: level by level, the sorted symbols are merged with pairs of the level below; then, from the
    top, the cheapest 2n - 2 items are unfolded. A symbol's length is the number of levels that use it.
    """
    some = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(some) < 2:
        lengths[some] = 1
        return lengths
    some = some[np.argsort(counts[some], kind="stable")]
    leaves = counts[some].astype(np.float64)
    items, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        items = both[order]
        kinds.append(order < len(leaves))
    take, used = 2 * len(leaves) - 2, np.zeros(len(leaves) + 1, np.int64)
    for leaf in reversed(kinds):
        n = int(leaf[:take].sum())
        used[n] += 1  # the n rarest symbols are used once more
        take = 2 * (take - n)
    lengths[some] = np.cumsum(used[::-1])[::-1][1:]
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then symbol, each one more than the last, shifted where the length grows."""
    out = np.zeros(len(lengths), np.uint64)
    some = np.flatnonzero(lengths)
    some = some[np.lexsort((some, lengths[some]))]
    size = lengths[some].astype(np.int64)
    top = int(size.max(initial=1))
    spans = np.concatenate([[0], np.cumsum(1 << (top - size))[:-1]]) if len(some) else size
    out[some] = (spans >> (top - size)).astype(np.uint64)
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids (big-endian words of 32), and the offset at which each block begins."""
    size = lengths[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    end, at = int(at[-1]), at[:-1]
    wide = code[ids] << (64 - (at & 31) - size).astype(np.uint64)
    words = np.zeros(end // 32 + 2, np.int64)
    if len(ids):
        for k, half in ((0, wide >> np.uint64(32)), (1, wide & np.uint64(0xFFFFFFFF))):
            part = np.bincount((at >> 5) + k, weights=half.astype(np.float64))  # bits never meet, so sums are exact
            words[: len(part)] += part.astype(np.int64)
    return words.astype(">u4").tobytes(), at[::BLOCK]


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every value of the next bits (as many as the longest code has)."""
    some = np.flatnonzero(lengths)
    some = some[np.lexsort((some, lengths[some]))]
    top = int(lengths.max(initial=1))
    times = 1 << (top - lengths[some].astype(np.int64))
    symbols, sizes = np.zeros(1 << top, np.uint16), np.ones(1 << top, np.int64)
    symbols[: times.sum()] = np.repeat(some, times)
    sizes[: times.sum()] = np.repeat(lengths[some], times)
    return symbols, sizes


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids: one id of every block at each step."""
    symbols, sizes = table
    top = len(symbols).bit_length() - 1
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    pairs = ((words[:-1] << np.uint64(32)) | words[1:]).view(np.uint64)
    at = checkpoints.astype(np.int64)
    out = np.zeros((BLOCK, len(at)), np.uint16)
    mask = np.uint64((1 << top) - 1)
    tail = n - BLOCK * (len(at) - 1)
    for k in range(min(BLOCK, n)):
        if k == tail:  # the last block is shorter
            at = at[:-1]
            if not len(at):
                break
        value = (pairs[at >> 5] >> (64 - top - (at & 31)).astype(np.uint64)) & mask
        out[k, : len(at)] = symbols[value]
        at = at + sizes[value]
    return out.T.ravel()[:n]


def image(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, start: int, lengths: np.ndarray, code: np.ndarray) -> bytes:
    """A file: magic; documents, ids, blocks, start; then sized sections: code lengths, document ids, null flags, counts, checkpoints, bits."""
    bits, checkpoints = pack(ids, lengths, code)
    sections = [
        zlib.compress(lengths.tobytes()), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        counts.astype("<u4").tobytes(), checkpoints.astype("<u4").tobytes(), bits]
    return b"".join([_MAGIC, struct.pack("<4Q", len(doc_ids), len(ids), len(checkpoints), start), *(struct.pack("<Q", len(s)) + s for s in sections)])


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def read_image(data: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(start, document ids, their counts, all ids) of a file."""
    if data[:8] != _MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, n_ids, _, start = struct.unpack_from("<4Q", data, 8)
    at, sections = 40, []
    for _ in range(6):
        (size,) = struct.unpack_from("<Q", data, at)
        sections.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    if sections[0] not in _tables:
        _tables.clear()
        _tables[sections[0]] = decoding_table(np.frombuffer(zlib.decompress(sections[0]), np.uint8))
    doc_ids = [None if gone else int(d) for d, gone in zip(np.frombuffer(sections[1], "<i8"), sections[2])]
    ids = unpack(sections[5], np.frombuffer(sections[4], "<u4"), n_ids, _tables[sections[0]])
    counts = np.frombuffer(sections[3], "<u4").astype(np.int64)
    assert len(counts) == n_docs
    return start, doc_ids, counts, ids


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Runs of documents in order, written to the shared folder: part, run, doc_ids, counts, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = subwords(path).encode
        end, number = END.to_bytes(2, "little"), 0
        doc_ids, done, held, texts, chars, part = [], [], 0, [], 0, None

        def close():
            nonlocal number, doc_ids, done, held
            sizes = np.array([len(x) // 2 for x in done], np.int32)
            row = [[part], [number], [doc_ids], [sizes.tobytes()], [b"".join(done)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            number, doc_ids, done, held = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["part", "run", "doc_ids", "counts", "ids"])

        def flush():
            nonlocal texts, chars, held
            for (doc_id, _), ids in zip(texts, encode([t for _, t in texts])):
                if held and held + len(ids) // 2 > FILE:
                    yield close()
                doc_ids.append(doc_id)
                done.append(ids + end)
                held += len(ids) // 2 + 1
            texts, chars = [], 0

        for batch in batches:
            for p, doc_id, text in zip(*(batch.column(c) for c in ("part", "doc_id", "text"))):
                part = p.as_py()
                texts.append((doc_id.as_py(), text.as_py() or ""))
                chars += len(texts[-1][1])
                if chars > CHUNK:
                    yield from flush()
        yield from flush()
        if done:
            yield close()

    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(order[0], F.xxhash64("text")).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    out = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    kind = "part int, run int, doc_ids array<bigint>, counts binary, ids binary"
    rows.mapInArrow(run, kind).write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(kind).parquet(out)


def count_ids(runs: DataFrame, size: int = 1 << 16) -> np.ndarray:
    """How often each id stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_py(), np.uint16), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in runs.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> str:
    """Writes all documents and returns the folder: rows (start, n_ids, image), one per file."""
    runs = encoded(docs, tokenizer)
    lengths = code_lengths(count_ids(runs))
    shared = docs.sparkSession.sparkContext.broadcast((lengths, codes(lengths)))
    sizes = runs.select("part", "run", (F.octet_length("ids") / 2).cast("long").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_in", inside).join(parts, "part").select("part", "run", (F.col("_before") + F.col("_in")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, code = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, counts, ids, start = (batch.column(c)[k].as_py() for c in ("doc_ids", "counts", "ids", "start"))
                ids = np.frombuffer(ids, np.uint16)
                made = image(doc_ids, np.frombuffer(counts, np.int32), ids, start, lengths, code)
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([len(ids)]), pa.array([made], pa.binary())], ["start", "n_ids", "image"])

    path = path or f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    placed = runs.join(F.broadcast(starts), ["part", "run"]) if starts.count() <= 1_000_000 else runs.join(starts, ["part", "run"])
    placed.mapInArrow(run, "start long, n_ids long, image binary").write.option("compression", "none").parquet(path)
    return path


def read_files(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, and ids (16-bit, binary) or, with `digest_only`, ids_crc32 of the 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("image"):
                start, doc_ids, counts, ids = read_image(data.as_py())
                begin = np.concatenate([[0], np.cumsum(counts)])
                if digest_only:
                    wide = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.int64())
                else:
                    last = pa.array([ids[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + begin[:-1]), pa.array(counts), last], ["doc_id", "start", "n_tokens", "v"])

    rows = spark.read.schema("start long, n_ids long, image binary").parquet(path).select("image")
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, v {'long' if digest_only else 'binary'}").withColumnRenamed("v", "ids_crc32" if digest_only else "ids")
