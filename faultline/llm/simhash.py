"""Near-duplicate groups by SimHash: exact comparison of tiles of fingerprints.

A fingerprint has a bit set where more than half of the hashes of the text's shingles have it set. Equal
fingerprints are collapsed first. The distinct ones are laid out in tiles of equal population counts, counted
separately for each quarter of the 64 bits. Two fingerprints that differ in r bits have counts that
differ by at most r in sum, so tile pairs beyond that are skipped and all others are compared whole, with an
exclusive-or of one tile against the other and a bit count. No link is lost, and nothing is probed by chance.

Each tile pair reports a spanning forest of its links, not all pairs, so that a large group of copies costs
no more than its size; components are found by alternating star contraction over those links.

Defined results: a null text is empty; texts without words have fingerprint zero and link like any other;
repeated rows share a fingerprint; a component's id is its smallest doc_id, null ids aside (null if there
is no other); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import key_of_row, sized_join
from faultline.session import saved

#: Fingerprints in a tile; larger cells are cut by hash.
TILE = 2048
#: Parts that a large component is divided into where its rows meet its representative.
PARTS = 64
#: Shingles hashed before their bits are counted.
CHUNK = 200_000

_digest = partial(xxhash.xxh64_digest, seed=42)


def shingle_digests(text: str | None, size: int) -> bytes:
    """The 8-byte digests of all word shingles, joined."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return _digest(b" ".join(words)) if words else b""
    return b"".join(map(_digest, map(b" ".join, zip(*(words[i:] for i in range(size))))))


def majority(digests: list[bytes]) -> np.ndarray:
    """Big-endian fingerprints (uint64) of texts from the digests of their shingles; no shingle gives zero.

    Bits are summed as bytes, eight to a machine word, in runs of 255 that cannot overflow.
    """
    counts = np.array([len(d) // 8 for d in digests])
    out = np.zeros((len(digests), 64), bool)
    some = np.flatnonzero(counts)
    if len(some):
        n = counts[some]
        lanes = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64).view(np.uint64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        runs = (n + 254) // 255
        at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.concatenate([[0], np.cumsum(runs)[:-1]]), runs))
        sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).astype(np.int64)
        sums = np.add.reduceat(sums, np.concatenate([[0], np.cumsum(runs)[:-1]]), axis=0)
        out[some] = 2 * sums > n[:, None]
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, `_key_id`, `_key_text` and `fp` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, waiting, held = [], [], 0
            for text in batch.column("text"):
                waiting.append(shingle_digests(text.as_py(), size))
                held += len(waiting[-1]) // 8
                if held >= CHUNK:
                    parts.append(majority(waiting))
                    waiting, held = [], 0
            parts.append(majority(waiting))
            fp = np.concatenate(parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key_id"), batch.column("_key_text"), pa.array(fp)], ["doc_id", "_key_id", "_key_text", "fp"])

    rows = docs.select("doc_id", "text").withColumns(key_of_row())
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, _key_id string, _key_text long, fp long")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 linked by (i, j), the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links within `radius` between tiles a and b (None: within a), as (node, root)."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, 2_000_000 // max(1, len(other)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ other[None, :]) <= radius)
        i, j = i + at, j + shift
        if b is None:
            i, j = i[i < j], j[i < j]
        if len(i) > len(nodes):  # many links: keep a forest of this block only
            root = _forest(i, j, len(nodes))
            i = np.flatnonzero(root != np.arange(len(nodes)))
            j = root[i]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return nodes[:0], nodes[:0]
    root = _forest(i, j, len(nodes))
    i = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[i], nodes[root[i]]


def tiles(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints packed into tiles: cell (the four counts), tile, fps."""
    count = lambda q: F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)))
    cells = nodes.select("fp", *[count(q).cast("int").alias(f"c{q}") for q in range(4)])
    held = cells.groupBy("c0", "c1", "c2", "c3").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_parts"))
    cells = cells.join(F.broadcast(held), ["c0", "c1", "c2", "c3"])  # at most 17^4 cells
    return cells.withColumn("tile", F.pmod(F.xxhash64("fp"), "_parts").cast("int")).groupBy("c0", "c1", "c2", "c3", "tile").agg(F.collect_list("fp").alias("fps"))


def _steps(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of counts within the radius; of each and its opposite only one, and the zero."""
    span = range(-radius, radius + 1)
    return [s for w in span for x in span for y in span for z in span if sum(map(abs, s := (w, x, y, z))) <= radius and s >= (0, 0, 0, 0)]


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) with the same components as all links between the fingerprints `fp` of `nodes`."""
    packed = saved(tiles(nodes))
    names = [f"c{q}" for q in range(4)]
    reach = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in _steps(radius)])
    left = packed.select(*[F.col(n).alias(f"o{n}") for n in names], F.col("tile").alias("ta"), F.col("fps").alias("a"), F.explode(reach).alias("d"))
    left = left.select("ta", "a", *[(F.col(f"o{n}") + F.col(f"d.{n}")).alias(n) for n in names], (F.greatest(*[F.abs(f"d.{n}") for n in names]) == 0).alias("same"))
    pairs = left.where(" and ".join(f"{n} between 0 and 16" for n in names)).join(packed.select(*names, F.col("tile").alias("tb"), F.col("fps").alias("b")), names)
    pairs = pairs.where("not same or ta <= tb").select("a", F.when(~(F.col("same") & (F.col("ta") == F.col("tb"))), F.col("b")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda x: np.asarray(x.values).view(np.uint64)
        for batch in batches:
            found_a, found_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = tile_links(flat(a), flat(b) if b.is_valid else None, radius)
                found_a.append(x)
                found_b.append(y)
            out = [pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)]
            yield pa.RecordBatch.from_arrays(out, ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node that can be reached.

    Alternating large and small stars; each round is written to the shared folder, and the rounds end when
    the edges stay as they are.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or mark == (now["n"], now["s"]):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (now["n"], now["s"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = saved(small.distinct())


def grouped(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """All rows as doc_id, `_key_id`, `_key_text`, fp, root (a fingerprint naming the component), component_id."""
    rows = saved(fingerprints(docs, size))
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("_low")))
    found = saved(links(nodes, radius))
    roots = components(found)
    roots = saved(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = named.select("fp", "root").join(named.groupBy("root").agg(F.min("_low").alias("_name")), "root")
    whole = saved(nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("_name", "_low").alias("component_id")))
    return rows.join(whole, "fp")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    out = grouped(docs, size, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest id stays, once.

    Null ids come last; rows of equal id are ordered by a digest of the text, and of wholly repeated rows one stays.
    """
    rows = saved(grouped(docs, size, radius).select("root", "doc_id", "_key_id", "_key_text"))
    keys = rows.groupBy("_key_id", "_key_text").agg(F.count(F.lit(1)).alias("_times"), F.first("root").alias("root"), F.first("doc_id").alias("doc_id"))
    keys = saved(keys)
    best = keys.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key_text"), F.col("_key_id"))).alias("_best")).where("_n > 1")
    # a component may hold a third of the keys: its one best row meets them in several parts
    best = best.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parted = keys.withColumn("_part", F.pmod(F.xxhash64("_key_id", "_key_text"), F.lit(PARTS)).cast("int"))
    later = parted.join(best, ["root", "_part"]).where("not (_key_id = _best._key_id and _key_text = _best._key_text)").select("_key_id", "_key_text")
    later = saved(later)
    twice = saved(keys.where("_times > 1").join(later, ["_key_id", "_key_text"], "left_anti").select("_key_id", "_key_text"))
    if twice.isEmpty():
        return sized_join(docs, later, "left_anti")
    once = sized_join(docs, twice, "left_semi").withColumns(key_of_row()).dropDuplicates(["_key_id", "_key_text"]).select(*docs.columns)
    return sized_join(docs, later.unionByName(twice), "left_anti").select(*docs.columns).unionByName(once)
