"""Benchmark passages in documents, found through a positional inverted index.

The index is a table in the shared folder. Each row is a segment of some documents and holds their
postings: for every term (a 64-bit digest) the ascending positions at which it stands. Segments are bounded by
their number of words, however long or many the documents, so lists of frequent terms are spread over all
segments and no list is ever gathered in one place.

A phrase is looked up from its rarest term over all segments: the positions of that term, less the term's
place in the phrase, are candidate starts; the next rarest term's list, adjusted by its own place, is intersected
with them, and so on. What is left stands there word for word. Proximity looks for all terms of a phrase, in any
order, within a span that exceeds the phrase by at most the slop.

The benchmark is the query side. It is read in blocks of at most `BLOCK` words, each sent to the tasks; with
more blocks the hits are carried along from one to the next.

Defined results: a null or empty text has no words; items without words have no window; repeated items count
once; a null item id is the empty text in `items`; repeated documents each get a row; an empty benchmark
hits nothing. Only `doc_id`, `text`, `item_id` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Memo, key_of_row, sized_join
from faultline.session import saved

#: Words of a segment; a longer document is a segment of its own.
SEGMENT = 400_000
#: Words of benchmark text in a block.
BLOCK = 1_000_000
WINDOW = 13

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _terms() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


_SEGMENT = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("key_ids", pa.list_(pa.string())), ("key_texts", pa.list_(pa.int64())),
    ("starts", pa.binary()), ("terms", pa.binary()), ("offsets", pa.binary()), ("positions", pa.binary())])
_SEGMENT_SQL = "doc_ids array<bigint>, key_ids array<string>, key_texts array<bigint>, starts binary, terms binary, offsets binary, positions binary"


def segment(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms in ascending order, where each one's postings begin (and end), and the postings."""
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    return ranked[first], np.append(first, len(ranked)).astype(np.int32), order.astype(np.int32)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of all documents, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _terms()

        def close():
            tokens = np.concatenate(tokens_of) if tokens_of else np.empty(0, np.uint64)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens_of])]).astype(np.int32)
            terms, offsets, positions = segment(tokens)
            row = [[x] for x in (ids, keys, digests, starts.tobytes(), terms.tobytes(), offsets.tobytes(), positions.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(row, _SEGMENT)], schema=_SEGMENT)

        ids, keys, digests, tokens_of, held = [], [], [], [], 0
        for batch in batches:
            for doc_id, key, digest, text in zip(*(batch.column(c) for c in ("doc_id", "_key_id", "_key_text", "text"))):
                found = words(text.as_py())
                if held and held + len(found) > SEGMENT:
                    yield close()
                    ids, keys, digests, tokens_of, held = [], [], [], [], 0
                ids.append(doc_id.as_py())
                keys.append(key.as_py())
                digests.append(digest.as_py())
                tokens_of.append(np.fromiter(map(memo.__getitem__, found), np.uint64, len(found)))
                held += len(found)
            memo.trim()
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(key_of_row())
    return saved(rows.mapInArrow(run, _SEGMENT_SQL))


@dataclass
class Phrases:
    """Distinct phrases of a block of items: per length a matrix of term digests, and the items of each phrase."""

    terms: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]
    vocabulary: np.ndarray
    counts: np.ndarray | None = None  # of the vocabulary, over the whole index

    def plan(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vocabulary for each phrase, and the order of its terms from the rarest."""
        at = np.searchsorted(self.vocabulary, self.terms[length])
        return at, np.argsort(self.counts[at], axis=1, kind="stable")


def phrases(items, window: int | None = WINDOW) -> Phrases:
    """`items`: (item_id, text). Every `window` consecutive words, or all words of a shorter item (window None: always all)."""
    found: dict[tuple, set] = {}
    memo = _terms()
    for item, text in items:
        w = [memo[x] for x in words(text)]
        size = min(window or len(w), len(w))
        for i in range(len(w) - size + 1 if size else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    by: dict[int, list[tuple]] = {}
    for p in sorted(found):
        by.setdefault(len(p), []).append(p)
    terms = {n: np.array(p, np.uint64).reshape(len(p), n) for n, p in by.items()}
    vocabulary = np.unique(np.concatenate([t.ravel() for t in terms.values()])) if terms else np.empty(0, np.uint64)
    return Phrases(terms, {n: [sorted(found[x]) for x in p] for n, p in by.items()}, vocabulary)


def blocks(benchmark: DataFrame, window: int | None = WINDOW) -> Iterator[Phrases]:
    """The benchmark's phrases, a bounded number of words at a time."""
    some, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        some.append((row["item_id"], row["text"]))
        held += len(row["text"] or "") // 2
        if held > BLOCK:
            yield phrases(some, window)
            some, held = [], 0
    if some:
        yield phrases(some, window)


def count_terms(index: DataFrame, block: Phrases) -> Phrases:
    """Fills in how often each term of the block stands in the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for t, o in zip(batch.column("terms"), batch.column("offsets")):
                terms, offsets = np.frombuffer(t.as_py(), np.uint64), np.frombuffer(o.as_py(), np.int32)
                at, there = _look_up(terms, shared.value)
                total[there] += np.diff(offsets)[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    rows = index.select("terms", "offsets").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    block.counts = np.zeros(len(block.vocabulary), np.int64)
    for r in rows:
        block.counts[r["term"]] = r["n"]
    return block


def _look_up(sorted_terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted term, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_terms, wanted), max(0, len(sorted_terms) - 1))
    return at, (sorted_terms[at] == wanted if len(sorted_terms) else np.zeros(len(wanted), bool))


class Segment:
    """One segment, ready for intersections."""

    def __init__(self, starts: bytes, terms: bytes, offsets: bytes, positions: bytes):
        self.starts = np.frombuffer(starts, np.int32).astype(np.int64)
        self.terms, self.offsets = np.frombuffer(terms, np.uint64), np.frombuffer(offsets, np.int32).astype(np.int64)
        self.positions = np.frombuffer(positions, np.int32).astype(np.int64)
        self.size = len(self.positions)
        self.lists = np.repeat(np.arange(len(self.terms)), np.diff(self.offsets)) * (self.size + 1) + self.positions if self.size else self.positions

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def stands(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the term's list holds the position."""
        key = term * (self.size + 1) + position
        at = np.minimum(np.searchsorted(self.lists, key), self.size - 1)
        return (self.lists[at] == key) & (position >= 0) & (position < self.size)

    def exact(self, block: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, phrase numbers, starts) of all occurrences, in bounded portions."""
        if not self.size:
            return
        place, there = _look_up(self.terms, block.vocabulary)
        for length in block.terms:
            at, order = block.plan(length)
            whole = np.flatnonzero(there[at].all(axis=1))
            if not len(whole):
                continue
            term, order = place[at[whole]], order[whole]
            row = np.arange(len(whole))
            rarest = term[row, order[:, 0]]
            held = self.offsets[rarest + 1] - self.offsets[rarest]
            edges = np.searchsorted(np.cumsum(held), np.arange(0, held.sum(), 500_000), side="right")
            for a, b in zip(edges, np.append(edges[1:], len(whole))):
                n = held[a:b]
                p = np.repeat(row[a:b], n)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = self.positions[self.offsets[rarest[p]] + within] - order[p, 0]
                for k in range(1, length):
                    if not len(p):
                        break
                    column = order[p, k]
                    good = self.stands(term[p, column], start + column)
                    p, start = p[good], start[good]
                if length == 1:
                    good = start >= 0
                    p, start = p[good], start[good]
                one_doc = self.doc_of(start) == self.doc_of(start + length - 1)
                yield length, whole[p[one_doc]], start[one_doc]

    def near(self, block: Phrases, slop: int) -> Iterator[tuple[int, int, int, int]]:
        """(length, phrase number, first, last position) where all terms stand within length + slop words, once for each place of the rarest term."""
        place, there = _look_up(self.terms, block.vocabulary)
        for length in block.terms:
            at, order = block.plan(length)
            for i in np.flatnonzero(there[at].all(axis=1)):
                need = np.unique(place[at[i]], return_counts=True)
                rare = place[at[i, order[i, 0]]]
                lists = [self.positions[self.offsets[t] : self.offsets[t + 1]] for t in need[0]]
                for p in self.positions[self.offsets[rare] : self.offsets[rare + 1]]:
                    doc = self.doc_of(np.array([p]))[0]
                    lo, hi = max(self.starts[doc], p - length - slop + 1), min(self.starts[doc + 1], p + length + slop)
                    inside = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists]
                    best = _tightest(inside, need[1])
                    if best and best[1] - best[0] < length + slop:
                        yield length, int(i), int(best[0]), int(best[1])


def _tightest(lists: list[np.ndarray], need: np.ndarray) -> tuple[int, int] | None:
    """Narrowest span with at least the needed number of positions of each list."""
    if any(len(x) < n for x, n in zip(lists, need)):
        return None
    merged = sorted((int(p), k) for k, x in enumerate(lists) for p in x)
    have, short, left, best = [0] * len(lists), len(lists), 0, None
    for p, k in merged:
        have[k] += 1
        short -= have[k] == need[k]
        while not short:
            first, j = merged[left]
            if best is None or p - first < best[1] - best[0]:
                best = (first, p)
            have[j] -= 1
            short += have[j] < need[j]
            left += 1
    return best


_STATE = _SEGMENT_SQL + ", hit binary, items array<array<string>>"


def _carry(index: DataFrame, block: Phrases) -> DataFrame:
    """Adds the block's hits to the segments: `hit` a bit per word, `items` the items of each document."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                seg = Segment(*(row.column(c)[0].as_py() for c in ("starts", "terms", "offsets", "positions")))
                change = np.zeros(seg.size + 1, np.int64)
                items = [set(x) for x in row.column("items")[0].as_py()]
                for length, phrase, start in seg.exact(shared.value):
                    np.add.at(change, start, 1)
                    np.add.at(change, start + length, -1)
                    for d, p in set(zip(seg.doc_of(start).tolist(), phrase.tolist())):
                        items[d].update(shared.value.items[length][p])
                hit = np.cumsum(change[:-1]) > 0
                before = np.unpackbits(np.frombuffer(row.column("hit")[0].as_py(), np.uint8), count=seg.size).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:-2], pa.array([np.packbits(hit | before).tobytes()], pa.binary()), pa.array([[sorted(x) for x in items]], pa.list_(pa.list_(pa.string())))],
                    names=row.schema.names)

    return index.mapInArrow(run, _STATE)


def contamination(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, `_key_id`, `_key_text`, n_words, n_hit (words inside occurring windows), items, contaminated."""
    nothing = F.expr("cast(repeat(chr(0), cast(ceil(octet_length(positions) / 32) as int)) as binary)")
    rows = index.withColumns({"hit": nothing, "items": F.expr("transform(doc_ids, x -> cast(array() as array<string>))")})
    for block in blocks(benchmark, window):
        rows = _carry(rows, count_terms(index, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, keys, digests, starts, hit, items = (batch.column(c)[k] for c in ("doc_ids", "key_ids", "key_texts", "starts", "hit", "items"))
                starts = np.frombuffer(starts.as_py(), np.int32).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(np.unpackbits(np.frombuffer(hit.as_py(), np.uint8), count=starts[-1]))])
                yield pa.RecordBatch.from_arrays(
                    [ids.values, keys.values, digests.values, pa.array(np.diff(starts)), pa.array(np.diff(upto[starts]).astype(np.int64)), items.values],
                    ["doc_id", "_key_id", "_key_text", "n_words", "n_hit", "items"])

    out = rows.select("doc_ids", "key_ids", "key_texts", "starts", "hit", "items").mapInArrow(run, "doc_id long, _key_id string, _key_text long, n_words long, n_hit long, items array<string>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def occurrences(index: DataFrame, queries: DataFrame, slop: int | None = None) -> DataFrame:
    """All places of whole items of `queries` (item_id, text): item_id, doc_id, start and n_words of the span.

    Exact phrases, or with `slop` all words of the item, in any order, within that many further words.
    """
    parts = []
    for block in blocks(queries, None):
        shared = index.sparkSession.sparkContext.broadcast(count_terms(index, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    seg, out = Segment(*(batch.column(c)[k].as_py() for c in ("starts", "terms", "offsets", "positions"))), []
                    ids = batch.column("doc_ids")[k].as_py()
                    if slop is None:
                        spans = ((n, p, s, s + n - 1) for n, ps, ss in seg.exact(shared.value) for p, s in zip(ps.tolist(), ss.tolist()))
                    else:
                        spans = iter(set(seg.near(shared.value, slop)))
                    for n, p, a, b in spans:
                        d = int(seg.doc_of(np.array([a]))[0])
                        out += [(item, ids[d], a - int(seg.starts[d]), b - a + 1) for item in shared.value.items[n][p]]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["item_id", "doc_id", "start", "n_words"])

        parts.append(index.mapInArrow(run, "item_id string, doc_id long, start long, n_words long"))
    if not parts:
        return index.sparkSession.sql("select '' item_id, 0L doc_id, 0L start, 0L n_words where false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated."""
    bad = contamination(build_index(docs), benchmark, window).where("contaminated").select("_key_id", "_key_text").distinct()
    return sized_join(docs, saved(bad), "left_anti")
