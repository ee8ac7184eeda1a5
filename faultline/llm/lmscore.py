"""Log-probability of texts under a causal self-attention model over subword ids, joined with corpus counts.

Words are runs without ASCII white space, lower-cased in A-Z; a text ends with one end token. A word's subword
ids come from a public tokenizer. The model reads a text's ids in overlapping windows with masked
attention and scores every id once, with up to a window of context: a class of the next id by attention, the id within
its class by corpus counts, and after each id whether the word ends there. This gives every possible word a
probability, given its class k (the one of its first id). Counted words are joined to it by absolute discounting,

    P(word) = P(k | before) (max(c - D, 0) + D V_k P(subwords | before, k)) / N_k,

with c, V_k and N_k (distinct and all words of the class) counted over all training texts: attention tells which
words to expect, the corpus how frequent they are, and words that were never counted are left to the model.

Counts are exact for every word: blocks of documents keep their distinct words as sorted 64-bit digests, and
meet, slice by slice of the digests, to be summed; each block gets its words' sums back. No table of words is
ever sent whole.

All training texts fit the model: classes of ids come from the ids beside them in the whole corpus; the attention
weights begin at a short fit on the driver (about `SAMPLE` texts), and from there every partition of the corpus goes once
through all its training ids, in windows that don't overlap. What the partitions have learnt is averaged: an id's vector by how often they met it,
other weights by how many ids they have seen.

Defined results: a null text is empty and has the end token alone; repeated rows count each time; with no
training text all counts are 0 and the model is untrained (uniform classes), N = 0; an empty table gives no rows.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.subwords import release, subwords
from faultline.llm.words import bounded
from faultline.session import saved

SAMPLE = 1200
#: Ids of the tokenizer are below the end symbol.
END = 50257
CLASSES, WIDTH = 48, 16
WINDOW, STRIDE = 32, 24
#: Windows of a round of the first fit, rounds, windows in a batch; rate at the first fit's begin and end, and in the pass over the corpus.
ROUND, ROUNDS, BATCH = 6000, 6, 100
RATES, CORPUS_BATCH = (0.02, 0.005), 200
#: Buckets of the ids on one side, and ids counted into them together.
NEAR, BESIDE = 64, 1 << 20
DISCOUNT = 0.75
#: Words in a block of documents (a longer text is a block of its own), and windows scored together.
BLOCK, TOGETHER = 400_000, 250

_F = np.float32


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _free() -> None:
    """Gives back what making blocks has left in this process."""
    release()
    gc.collect()
    pa.default_memory_pool().release_unused()


# ---- blocks and counts -------------------------------------------------------------------------------------------

_BLOCK_SQL = "block long, doc_ids array<bigint>, train binary, lengths binary, words binary, digests binary, counts binary, sizes binary, ids binary"


def blocks(docs: DataFrame, train: Column, tokenizer: str) -> DataFrame:
    """Documents in blocks: word numbers of all texts; digest, count in training texts and subword ids of each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = subwords(tokenizer)
        number = TaskContext.get().partitionId() << 32
        doc_ids, flags, lengths, words = [], [], [], []

        def close():
            nonlocal number, doc_ids, flags, lengths, words
            place: dict[bytes, int] = defaultdict(count().__next__)
            of = np.fromiter(map(place.__getitem__, words), np.uint32, len(words))
            distinct = list(place)
            digests = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
            order = np.argsort(digests)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            of = rank[of] if len(of) else of
            used = np.repeat(np.array(flags, bool), lengths)
            counts = np.bincount(of[used], minlength=len(distinct)).astype(np.uint32)
            ids = known.words([distinct[i] for i in order])
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 2
            row = [number, doc_ids, np.array(flags, bool).tobytes(), np.array(lengths, np.uint32).tobytes(), of.tobytes(), digests[order].tobytes(), counts.tobytes(), sizes.tobytes(), b"".join(ids)]
            kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 7
            number, doc_ids, flags, lengths, words = number + 1, [], [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in _BLOCK_SQL.split(", ")])

        for batch in batches:
            for doc_id, flag, text in zip(*(batch.column(c) for c in ("doc_id", "_train", "text"))):
                found = words_of(text.as_py())
                if words and len(words) + len(found) > BLOCK:
                    yield close()
                doc_ids.append(doc_id.as_py())
                flags.append(bool(flag.as_py()))
                lengths.append(len(found))
                words += found
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("_train"))
    return saved(rows.mapInArrow(run, _BLOCK_SQL))


@dataclass
class Totals:
    words: int  # N, with the ends
    distinct: int  # V, with the end
    ends: int
    by_id: np.ndarray  # 3 x (END + 1): how many distinct words an id begins, continues and ends


def word_totals(made: DataFrame) -> tuple[DataFrame, Totals]:
    """(block, slices of corpus counts in the order of the block's digests), and the totals of the corpus."""
    spark = made.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), made.count())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _free()
        edges = ((np.arange(1, slices, dtype=object) << 64) // slices).astype(np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                digests = np.frombuffer(batch.column("digests")[k].as_py(), np.uint64)
                counts, sizes, ids = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("counts", np.uint32), ("sizes", np.uint32), ("ids", np.uint16)))
                begin = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                at = [0, *np.searchsorted(digests, edges).tolist(), len(digests)]
                some = [i for i in range(slices) if at[i] < at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(some), pa.int64()),
                     pa.array([digests[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()), *(pa.array([x[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()) for x in (counts, sizes)),
                     pa.array([ids[begin[at[i]] : begin[at[i + 1]]].tobytes() for i in some], pa.binary())],
                    ["slice", "block", "digests", "counts", "sizes", "ids"])

    def total(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("digests")]
        of, some, place = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        sizes, ids = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("sizes", np.uint32), ("ids", np.uint16)))
        sums = np.bincount(place, weights=np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]), minlength=len(of)).astype(np.int64)
        end = np.cumsum([len(p) for p in parts])
        own = [sums[place[b - len(p) : b]].tobytes() for p, b in zip(parts, end)]
        n, v, z = [0] * len(parts), [b""] * len(parts), [b""] * len(parts)
        begin = (np.cumsum(sizes.astype(np.int64)) - sizes)[some[sums > 0]]
        size = sizes[some[sums > 0]].astype(np.int64)
        words = ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        n[0], v[0], z[0] = int(sums.sum()), words.tobytes(), size.astype(np.uint32).tobytes()  # the distinct words' ids
        return pa.table({"block": table.column("block"), "slice": table.column("slice"), "sums": pa.array(own, pa.binary()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.binary()), "z": pa.array(z, pa.binary())})

    pieces = made.select("block", "digests", "counts", "sizes", "ids").mapInArrow(cut, "slice int, block long, digests binary, counts binary, sizes binary, ids binary")
    summed = saved(pieces.groupBy("slice").applyInArrow(total, "block long, slice int, sums binary, n long, v binary, z binary"))

    def ids_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((3, END + 1), np.int64)
        for batch in batches:
            for v, z in zip(batch.column("v"), batch.column("z")):
                ids, sizes = np.frombuffer(v.as_py(), np.uint16), np.frombuffer(z.as_py(), np.uint32).astype(np.int64)
                last = np.cumsum(sizes) - 1
                for i, x in enumerate((ids[last - sizes + 1], ids, ids[last])):
                    seen[i] += np.bincount(x, minlength=END + 1)
        seen[1] -= seen[0]
        kind, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(seen[kind, at])], ["kind", "id", "n"])

    n = summed.agg(F.sum("n")).first()[0]
    by_id = np.zeros((3, END + 1), np.int64)
    for r in summed.select("v", "z").mapInArrow(ids_in, "kind long, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect():
        by_id[r["kind"], r["id"]] = r["n"]

    def ends_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(np.frombuffer(x.as_py(), bool).sum()) for batch in batches for x in batch.column("train"))
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    ends = made.select("train").mapInArrow(ends_in, "n long").agg(F.sum("n")).first()[0] or 0
    ordered = summed.groupBy("block").agg(F.expr("transform(array_sort(collect_list(struct(slice, sums))), x -> x.sums)").alias("sums"))
    return ordered, Totals((n or 0) + ends, int(by_id[0].sum()) + (ends > 0), ends, by_id)


def id_counts(made: DataFrame, by_id: np.ndarray) -> np.ndarray:
    """4 x (END + 1), over all training texts: how many distinct words an id begins, continues and ends (`by_id`), and how many words it begins.

    The model stands in for rare words, so its ids are counted once for a word of the corpus, however frequent it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(END + 1, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                counts, sizes, ids = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("counts", np.uint32), ("sizes", np.uint32), ("ids", np.uint16)))
                total += np.bincount(ids[np.cumsum(sizes.astype(np.int64)) - sizes], weights=counts, minlength=END + 1).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    words = np.zeros(END + 1, np.int64)
    for r in made.select("counts", "sizes", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        words[r["id"]] = r["n"]
    return np.stack([*by_id, words])


# ---- the model ---------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Attention weights, classes of ids, and log-probabilities of ids within classes and of word ends."""

    p: dict[str, np.ndarray]
    classes: np.ndarray
    within: np.ndarray  # 2 x ids: beginning, continuing
    stop: np.ndarray  # log-probability that the word ends after the id
    go: np.ndarray
    held: np.ndarray  # words of each class in the training texts: all, and distinct

    def tables(self) -> dict[str, np.ndarray]:
        """Keys, values, scaled queries and vectors side by side, by id and by place."""
        make = lambda e: np.concatenate([e @ self.p["k"], e @ self.p["v"], e @ self.p["q"] * _F(1 / np.sqrt(WIDTH)), e], axis=1)
        return {"all": make(self.p["e"]), "allp": make(self.p["e_at"])}


def _tame(x: np.ndarray) -> bool:
    """Whether sums of exponents stay well inside the numbers of 32 bits without taking each row's maximum off."""
    return not x.size or (x.max() < 60 and x.min() > -60)


_MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(_F)


def _new_params(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[-2])).astype(_F)
    return {
        "e": (rng.normal(size=(END + 1, WIDTH)) * 0.3).astype(_F), "e_at": (rng.normal(size=(WINDOW, WIDTH)) * 0.1).astype(_F),
        "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH),
        "o0": np.zeros((WIDTH, CLASSES + 1), _F), "o1": np.zeros((WIDTH, CLASSES), _F), "b0": np.zeros(CLASSES + 1, _F), "b1": np.zeros(CLASSES, _F)}


def _softmax(x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Over the last axis, in place."""
    tame = _tame(x)
    if mask is not None:
        x += mask.astype(x.dtype, copy=False)
    if not tame:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= _row_sums(x)
    return x


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the (short) last axis, by a product with ones."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


def _step(p: dict[str, np.ndarray], ids: np.ndarray, kinds: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients for windows: ids, kind (0 begins a word, 1 continues, -1 none), class and weight of the next id."""
    x = p["e"][ids] + p["e_at"][None, : ids.shape[1]]
    flat, scale = lambda z: z.reshape(-1, WIDTH), x.dtype.type(1 / np.sqrt(WIDTH))
    q, k, v = ((flat(x) @ p[c]).reshape(x.shape) for c in "qkv")
    q *= scale
    a = _softmax(q @ k.transpose(0, 2, 1), _MASK)
    h = x + a @ v
    g = {n: np.zeros_like(w) for n, w in p.items() if n != "e"}
    hidden, dh, loss, n = flat(h), np.zeros_like(flat(h)), 0.0, max(1, int((kinds >= 0).sum()))
    for kind in (0, 1):
        at = np.flatnonzero(kinds.ravel() == kind)
        y = _softmax(hidden[at] @ p[f"o{kind}"] + p[f"b{kind}"])
        rows, to = np.arange(len(y)), target.ravel()[at]
        loss -= float(np.log(y[rows, to] + 1e-9).sum())
        y[rows, to] -= 1
        y *= (weight.ravel()[at] / n)[:, None].astype(y.dtype)
        g[f"o{kind}"], g[f"b{kind}"] = hidden[at].T @ y, y.sum(axis=0)
        dh[at] = y @ p[f"o{kind}"].T
    dh = dh.reshape(h.shape)
    ds = dh @ v.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
    ds *= a
    dq, dk, dv = ds @ k * scale, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh
    for name, d in (("q", dq), ("k", dk), ("v", dv)):
        g[name] = flat(x).T @ flat(d)
        dh = dh + (flat(d) @ p[name].T).reshape(dh.shape)
    g["e_at"][: ids.shape[1]] = dh.sum(axis=0)
    used, place = np.unique(ids, return_inverse=True)
    cell = (place.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
    g["e"] = (used, np.bincount(cell, weights=dh.ravel(), minlength=len(used) * WIDTH).reshape(-1, WIDTH).astype(_F))
    return loss / n, g


class _Fit:
    """Weights being fitted, by steps of Adam; an id's vector takes part in the steps that meet it."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = {k: v.copy() for k, v in p.items()}, 0
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}

    def step(self, ids: np.ndarray, kinds: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        self.t += 1
        _, g = _step(self.p, ids, kinds, target, weight)
        for name, w in self.p.items():
            m = self.m[name]
            if name == "e":
                used, d = g["e"]
                m[0][used] = one = 0.9 * m[0][used] + 0.1 * d
                m[1][used] = two = 0.99 * m[1][used] + 0.01 * d * d
                w[used] -= _F(rate) * one / (np.sqrt(two) + _F(1e-6))
            else:
                m[0] = 0.9 * m[0] + 0.1 * g[name]
                m[1] = 0.99 * m[1] + 0.01 * g[name] ** 2
                w -= (rate * (m[0] / (1 - 0.9**self.t)) / (np.sqrt(m[1] / (1 - 0.99**self.t)) + 1e-6)).astype(_F)


def _beside(flat: np.ndarray, kinds: np.ndarray, out: np.ndarray, seed: int = 3) -> None:
    """Adds texts laid end to end to (END + 1) x (2 NEAR + 1): signed counts of the hashed ids before and after each id, and how often it stands."""
    rng = np.random.default_rng(seed)
    bucket, sign = rng.integers(0, NEAR, END + 1).astype(np.int32), (rng.integers(0, 2, END + 1) * 2 - 1).astype(np.int8)
    every = np.flatnonzero(kinds >= 0)
    for a in range(0, len(every), BESIDE):
        at = every[a : a + BESIDE]
        before, after = flat[at - 1].astype(np.int32), flat[at].astype(np.int32)
        for k, (of, other) in enumerate(((after, before), (before, after))):
            out[:, NEAR * k : NEAR * (k + 1)] += np.bincount(of * NEAR + bucket[other], weights=sign[other], minlength=(END + 1) * NEAR).reshape(-1, NEAR)
        out[:, -1] += np.bincount(after, minlength=END + 1)
    out[END, -1] += (kinds < 0).sum()


def _cluster(beside: np.ndarray) -> np.ndarray:
    """Classes of ids by the ids around them: k-means over hashed neighbours (of `_beside`). Unseen ids share the last class."""
    near, count = beside[:, :-1].astype(_F), beside[:, -1]
    out = np.full(END + 1, CLASSES - 1)
    out[END] = CLASSES
    seen = np.flatnonzero(count[:END])
    if not len(seen):
        return out
    x = near[seen] / np.maximum(np.linalg.norm(near[seen], axis=1, keepdims=True), 1e-6)
    weight = np.sqrt(count[seen])
    centre = x[np.argsort(-count[seen], kind="stable")[: CLASSES - 1]]
    for _ in range(8):
        of = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, of, x * weight[:, None])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(length > 0, sums / np.maximum(length, 1e-9), centre)
    out[seen] = of
    return out


def _inner_weight(counts: np.ndarray) -> np.ndarray:
    """Weight of the ids inside a word, by its first id: they matter for rare words, so the less the more often the id's words stand on average."""
    return (3 / np.sqrt(np.maximum(1, counts[3]) / np.maximum(1, counts[0]))).astype(_F)


def train(texts: list[str | None], counts: np.ndarray, by_first: np.ndarray, tokenizer: str, seed: int = 3, beside: np.ndarray | None = None) -> Model:
    """The model from which `fit_corpus` goes on: attention is fitted on `texts`; `counts` (of id_counts), `by_first` and `beside` come from the whole corpus."""
    rng = np.random.default_rng(seed)
    known = subwords(tokenizer)
    rows, kinds, weights = [], [], []
    inner = _inner_weight(counts)
    for text in sorted(t or "" for t in texts):
        words = words_of(text)
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, known.words(distinct)))
        parts = [np.frombuffer(ids[w], np.uint16) for w in words]
        weights.append(np.concatenate([[0], *[np.where(np.arange(len(x)), inner[x[0]], 1) for x in parts], [1]]))
        rows.append(np.concatenate([[END], *parts, [END]]).astype(np.int64))
        kinds.append(np.concatenate([[-1], *[np.minimum(np.arange(len(x)), 1) for x in parts], [0]]).astype(np.int64))
    classes = _cluster(np.zeros((END + 1, 2 * NEAR + 1)) if beside is None else beside)
    fit = _Fit(_new_params(seed))
    sizes = np.array([max(1, len(r) - 1) for r in rows], float)
    for rnd in range(ROUNDS if rows else 0):
        pick = rng.choice(len(rows), ROUND, p=sizes / sizes.sum())
        for a in range(0, ROUND, BATCH):
            ids = np.full((BATCH, WINDOW), END)
            kind, target, weight = np.full((BATCH, WINDOW), -1), np.zeros((BATCH, WINDOW), np.int64), np.zeros((BATCH, WINDOW), _F)
            for j, i in enumerate(pick[a : a + BATCH]):
                r, k = rows[i], kinds[i]
                s = int(rng.integers(0, max(1, len(r) - WINDOW)))
                n = min(WINDOW, len(r) - 1 - s)
                ids[j, :n], kind[j, :n], target[j, :n] = r[s : s + n], k[s + 1 : s + 1 + n], classes[r[s + 1 : s + 1 + n]]
                weight[j, :n] = weights[i][s + 1 : s + 1 + n]
            fit.step(ids, kind, target, weight, RATES[0] + (RATES[1] - RATES[0]) * rnd / max(1, ROUNDS - 1))
    smooth = counts[:2] + 0.05
    smooth[:, END] = 1
    within = np.stack([np.log(s / np.bincount(classes, weights=s, minlength=CLASSES + 1)[classes]) for s in smooth]).astype(_F)
    ended = (counts[2] + 0.5) / (counts[0] + counts[1] + 1)
    held = np.stack([np.bincount(classes, weights=x, minlength=CLASSES + 1) for x in (counts[3], by_first)])
    return Model(fit.p, classes, within, np.log(ended).astype(_F), np.log1p(-ended).astype(_F), held)


def id_scores(model: Model, tables: dict[str, np.ndarray], ids: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probabilities of each id's class and of the id in it, for many texts laid end to end; each text is END, its ids, END, and its first END scores 0."""
    out = np.zeros(len(ids), _F)
    begin = np.flatnonzero(kinds < 0)
    length = np.diff(np.append(begin, len(ids))) - 1  # ids to be scored
    n = np.maximum(1, -(-np.maximum(0, length - WINDOW) // STRIDE) + 1)
    which = np.repeat(np.arange(len(begin)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    first = begin[which] + start  # of the window's inputs
    new = np.where(start > 0, WINDOW - STRIDE, 0)  # inputs before this were scored by the window before
    live = np.minimum(WINDOW, length[which] - start)
    p, wide, wide_at = model.p, tables["all"], tables["allp"]
    for lead in (0, WINDOW - STRIDE):  # first windows score all their places, further ones only the new
        group = np.flatnonzero(new == lead)
        at = np.arange(WINDOW)
        for a in range(0, len(group), TOGETHER):
            some = group[a : a + TOGETHER]
            place = np.minimum(first[some][:, None] + at, len(ids) - 2)
            x = wide[ids[place]]
            x += wide_at
            k, v, q, e = (x[:, lead if i > 1 else 0 :, WIDTH * i : WIDTH * (i + 1)] for i in range(4))
            s = q @ k.transpose(0, 2, 1)
            tame = _tame(s)
            s += _MASK[lead:]
            if not tame:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            mixed = s @ v
            mixed /= _row_sums(s)
            mixed += e
            told = np.where(at[lead:] < live[some][:, None], kinds[place[:, lead:] + 1], -1).ravel()
            mixed, to = mixed.reshape(-1, WIDTH), place[:, lead:].ravel() + 1
            for kind in (0, 1):
                rows = np.flatnonzero(told == kind)
                if not len(rows):
                    continue
                y = mixed[rows] @ p[f"o{kind}"]
                y += p[f"b{kind}"]
                if not _tame(y):
                    y -= y.max(axis=1, keepdims=True)
                right = y[np.arange(len(rows)), model.classes[ids[to[rows]]]]
                np.exp(y, out=y)
                out[to[rows]] = right - np.log(_row_sums(y)[:, 0])
    return out, np.where(kinds < 0, 0, model.within[np.maximum(kinds, 0), ids])


def _laid_out(lengths: np.ndarray, words: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids and kinds of all texts end to end (END first and last of each), each text's first place and its ids, each inner id's place, place in its word and size of its word's ids."""
    docs = len(lengths)
    doc_of = np.repeat(np.arange(docs), lengths)
    size = sizes[words]
    per_doc = np.bincount(doc_of, weights=size, minlength=docs).astype(np.int64)
    head = np.cumsum(per_doc + 2) - (per_doc + 2)
    before = np.cumsum(size) - size
    narrow = lambda x: x.astype(np.int32) if size.sum() + 2 * docs < 1 << 31 else x
    within = narrow(np.arange(size.sum()))
    within -= np.repeat(narrow(before), size)
    place = np.repeat(narrow(before + 2 * doc_of + 1), size)  # every text before adds two ends
    place += within
    flat = np.full(int((per_doc + 2).sum()), END, np.uint16)
    kinds = np.zeros(len(flat), np.int8)
    at = np.repeat(narrow((np.cumsum(sizes) - sizes)[words]), size)
    at += within
    flat[place] = ids[at]
    kinds[place] = within > 0
    kinds[head] = -1
    return flat, kinds, head, per_doc, place, within, size


def block_scores(model: Model, tables: dict, totals: Totals, lengths, words, sums, sizes, ids) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base_score, score) of a block's documents."""
    lengths, sizes = lengths.astype(np.int64), sizes.astype(np.int64)
    docs, n, v = len(lengths), totals.words, totals.distinct
    doc_of = np.repeat(np.arange(docs), lengths)
    ends = np.array([totals.ends])
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    by_doc = lambda x: np.bincount(doc_of, weights=x, minlength=docs)
    known = by_doc((sums > 0)[words]).astype(np.int64) + (totals.ends > 0)
    base_score = by_doc(base(sums)[words]) + base(ends)[0]
    flat, kinds, head, per_doc, at, within, size = _laid_out(lengths, words, sizes, ids)
    by_class, by_id = id_scores(model, tables, flat, kinds)
    here = flat[at]
    per_id = by_id[at] + np.where(within > 0, by_class[at], 0) + np.where(within == np.repeat(size, size) - 1, model.stop[here], model.go[here])
    sub = np.bincount(np.repeat(np.arange(len(words)), size), weights=per_id, minlength=len(words))
    first = at[within == 0]
    held, kinds_held = (x[model.classes[flat[first]]] for x in model.held)
    with np.errstate(divide="ignore"):
        counted = np.logaddexp(np.log(np.maximum(sums[words] - DISCOUNT, 0)), np.log(DISCOUNT * kinds_held) + sub) - np.log(np.maximum(held, 1))
    by_word = by_class[first] + np.where(held > 0, counted, sub)
    score = (by_doc(by_word) + by_class[head + per_doc + 1]) / np.log(10)
    return lengths + 1, known, base_score, score


# ---- what all training texts tell --------------------------------------------------------------------------------

#: Numbers in a piece of a sum.
PIECE = 1 << 18


def _laid_out_training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
    """(number, layout, inner ids' first ids) of each block's training texts."""
    for batch in batches:
        for k in range(batch.num_rows):
            train, lengths, words, sizes, ids = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("train", bool), ("lengths", np.uint32), ("words", np.uint32), ("sizes", np.uint32), ("ids", np.uint16)))
            if train.any():
                lengths, sizes = lengths.astype(np.int64), sizes.astype(np.int64)
                words = words[np.repeat(train, lengths)]
                layout = _laid_out(lengths[train], words, sizes, ids)
                yield batch.column("block")[k].as_py(), layout, np.repeat(ids[(np.cumsum(sizes) - sizes)[words]], layout[-1])


def _summed(made: DataFrame, one, size: int) -> np.ndarray:
    """Sum of the vectors that `one` makes of the blocks of a task. There are about as many tasks as cores, so that what they send doesn't grow with the corpus."""
    spark = made.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _free()
        out, part = one(_laid_out_training(batches)), TaskContext.get().partitionId()
        for i in range(0, size, PIECE):
            if out[i : i + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // PIECE]), pa.array([part]), pa.array([out[i : i + PIECE].tobytes()], pa.binary())], ["piece", "part", "v"])

    def add(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("part").to_pylist(), range(table.num_rows)))
        total = sum(np.frombuffer(table.column("v")[i].as_py()) for _, i in parts)
        return pa.table({"piece": table.column("piece")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    rows = made.select("block", "train", "lengths", "words", "sizes", "ids").coalesce(spark.sparkContext.defaultParallelism)
    out, key = np.zeros(size), "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = spark.conf.get(key)
    spark.conf.set(key, 4)  # a task reads many blocks, of some MB each
    try:
        for r in rows.mapInArrow(run, "piece long, part long, v binary").groupBy("piece").applyInArrow(add, "piece long, v binary").toLocalIterator():
            v = np.frombuffer(r["v"])
            out[r["piece"] * PIECE : r["piece"] * PIECE + len(v)] = v
    finally:
        spark.conf.set(key, most)
    return out


def ids_beside(made: DataFrame) -> np.ndarray:
    """`_beside` over all training texts."""

    def one(blocks):
        out = np.zeros((END + 1, 2 * NEAR + 1))
        for _, (flat, kinds, *_), _ in blocks:
            _beside(flat, kinds, out)
        return out.ravel()

    return _summed(made, one, (END + 1) * (2 * NEAR + 1)).reshape(END + 1, -1)


def _windows(model: Model, inner: np.ndarray, layout: tuple[np.ndarray, ...], firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids, kinds, classes and weights of the next ids, of windows that hold each id of the texts once."""
    flat, kinds, head, per_doc, at, within, _ = layout
    weight = np.ones(len(flat), _F)
    weight[at] = np.where(within > 0, inner[firsts], 1)
    length = per_doc + 1  # ids to be told
    n = -(-length // WINDOW)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    step = np.arange(WINDOW)
    place = np.minimum(np.repeat(head, n)[:, None] + start[:, None] + step, len(flat) - 2)
    live = start[:, None] + step < np.repeat(length, n)[:, None]
    ids = np.where(live, flat[place], np.uint16(END))
    place += 1
    return ids, np.where(live, kinds[place], np.int8(-1)), model.classes[flat[place]].astype(np.uint8), weight[place]


def fit_corpus(made: DataFrame, model: Model, counts: np.ndarray) -> Model:
    """The model after a pass over all training texts.

    Each partition of the texts goes on from the model's weights on its own, with all its ids. An id's vector moves by the mean of the partitions' moves,
    weighted by how often they met the id, all other weights by the mean weighted by their ids.
    """
    inner, names = _inner_weight(counts), [k for k in model.p if k != "e"]
    shared = made.sparkSession.sparkContext.broadcast((model, inner))
    dense = sum(model.p[k].size for k in names)
    size = (END + 1) * (WIDTH + 1) + dense + 1

    def one(blocks):
        model, inner = shared.value
        out = np.zeros(size)
        e, rest = out[: (END + 1) * (WIDTH + 1)].reshape(END + 1, WIDTH + 1), out[(END + 1) * (WIDTH + 1) :]
        fit = held = of = None

        def steps(last: bool):
            nonlocal held
            full = len(held[0]) if last else len(held[0]) // CORPUS_BATCH * CORPUS_BATCH
            for a in range(0, full, CORPUS_BATCH):
                batch = [x[a : min(full, a + CORPUS_BATCH)] for x in held]
                fit.step(*batch, RATES[1])
                met[:] += np.bincount(batch[0][batch[1] >= 0], minlength=END + 1)
            held = [x[full:].copy() for x in held]

        def close():
            steps(True)
            e[:, :-1] += met[:, None] * (fit.p["e"].astype(float) - model.p["e"])
            e[:, -1] += met
            moved = np.concatenate([(fit.p[k].astype(float) - model.p[k]).ravel() for k in names])
            rest[:-1] += met.sum() * moved
            rest[-1] += met.sum()

        for number, layout, firsts in blocks:
            if of != number >> 32:
                if fit:
                    close()
                fit, held, of, met = _Fit(model.p), None, number >> 32, np.zeros(END + 1)
            new = _windows(model, inner, layout, firsts)
            held = list(new) if held is None or not len(held[0]) else [np.concatenate(x) for x in zip(held, new)]
            del new, layout, firsts
            steps(False)
        if fit:
            close()
        return out

    total = _summed(made, one, size)
    shared.unpersist()
    e, rest = total[: (END + 1) * (WIDTH + 1)].reshape(END + 1, WIDTH + 1), total[(END + 1) * (WIDTH + 1) :]
    p = {"e": (model.p["e"] + e[:, :-1] / np.maximum(e[:, -1:], 1)).astype(_F)}
    moved, at = rest[:-1] / max(rest[-1], 1), 0
    for k in names:
        n = model.p[k].size
        p[k] = (model.p[k] + moved[at : at + n].reshape(model.p[k].shape)).astype(_F)
        at += n
    return replace(model, p=p)


def score(spark: SparkSession, docs: DataFrame, train_on: Column, tokenizer: str, sample_key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score; learns where `train_on` is true."""
    made = blocks(docs, train_on, tokenizer)
    sums, totals = word_totals(made)
    counts = id_counts(made, totals.by_id)
    sample = bounded(docs.where(train_on), F.col("doc_id") if sample_key is None else sample_key, SAMPLE)
    model = train([r[0] for r in sample.select("text").collect()], counts, totals.by_id[0], tokenizer, beside=ids_beside(made))
    shared = spark.sparkContext.broadcast((fit_corpus(made, model, counts), totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _free()
        model, totals = shared.value
        tables = model.tables()
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, words, sizes, ids = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("lengths", np.uint32), ("words", np.uint32), ("sizes", np.uint32), ("ids", np.uint16)))
                own = batch.column("sums")[k].as_py() or []
                own = np.frombuffer(b"".join(own), np.int64)
                n, known, base, value = block_scores(model, tables, totals, lengths, words, own, sizes, ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[k].values, pa.array(np.frombuffer(batch.column("train")[k].as_py(), bool)), pa.array(n), pa.array(known),
                     pa.array(np.full(len(n), totals.words, np.int64)), pa.array(base, pa.float64()), pa.array(value, pa.float64())],
                    ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = made.select("block", "doc_ids", "train", "lengths", "words", "sizes", "ids").join(sums, "block", "left")
    return rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
