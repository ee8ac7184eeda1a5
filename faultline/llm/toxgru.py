"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling.

A word enters as a vector of its characters (hashed runs of bytes, with the ends of the word marked) beside a vector of
its own if it is frequent in the sample. Two gated recurrent layers read a window forwards and backwards;
attention weighs the positions, and the pooled states and inputs give the window's score. A text is scored over
all its overlapping windows; the highest one counts, calibrated on whole texts.

The network is trained here on about `SAMPLE` labelled documents of each class, chosen by a digest of doc_id (the
bound of the fit). A document's label belongs to one window of it, so each document gives the window with
its most telling word; label 0 documents give a random one as well. Only the text is an input of a score.

Defined results: null and empty texts get the score of an empty window; repeated rows get equal scores;
rows with conflicting labels all count; with no labelled row, or one class only, every score is that class's
share (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.words import bounded, grams, letters, sums_by

#: Labelled documents of each class, about.
SAMPLE = 1500
WINDOW, STRIDE = 64, 48
BUCKETS, SIZES = 1 << 14, (2, 3, 4)
CHARS, OWN, HIDDEN, FOCUS = 8, 8, 8, 8
VOCABULARY, SEEN = 8000, 15
EPOCHS, BATCH, STEPS = 10, 256, 300  # rounds over the windows, at least so many batches
THRESHOLD = 0.3
CHUNK, TOGETHER = 1_000_000, 4096

_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  # no network: this score for every text

    @staticmethod
    def new(vocabulary: dict[bytes, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        d = CHARS + OWN
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(_F)
        p = {"chars": rng.normal(size=(BUCKETS, CHARS)).astype(_F) * _F(0.3), "own": rng.normal(size=(len(vocabulary) + 1, OWN)).astype(_F) * _F(0.1)}
        p["own"][0] = 0
        for side in "fb":
            p |= {f"w{side}": draw(d, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, _F)}
        p |= {"a": draw(2 * HIDDEN + d, FOCUS), "v": draw(FOCUS, 1), "o": draw(2 * HIDDEN + d, 1), "z": np.zeros(1, _F)}
        return Network(vocabulary, p)

    def inputs(self, words: list[bytes]):
        """Vectors of words, and what the gradient needs."""
        at, of = grams(words, SIZES, BUCKETS)
        scale = (1 / np.sqrt(np.bincount(of, minlength=len(words)))).astype(_F)
        own = np.array([self.vocabulary.get(w, 0) for w in words])
        x = np.concatenate([sums_by(self.p["chars"][at], of, len(words)) * scale[:, None], self.p["own"][own]], axis=1)
        return x, (at, of, scale, own)


def _scan(gates: np.ndarray, u: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
    """States of a gated recurrent layer over (steps, windows, 3 x HIDDEN) gate inputs; steps that aren't live keep the state."""
    h = np.zeros((gates.shape[1], HIDDEN), _F)
    out = np.empty((*gates.shape[:2], HIDDEN), _F)
    for t in range(len(gates)):
        g, r = gates[t], h @ u
        zr = _sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
        z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
        z = np.where(live[t][:, None], z, _F(1))
        new = n + z * (h - n)
        if keep is not None:
            keep.append((h, z, reset, n, r[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out


def _scan_back(grad: np.ndarray, u: np.ndarray, live: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u."""
    gates = np.zeros((*grad.shape[:2], 3 * HIDDEN), _F)
    du, dh = np.zeros_like(u), np.zeros(grad.shape[1:], _F)
    for t in range(len(grad) - 1, -1, -1):
        h, z, reset, n, rn = keep[t]
        dh = dh + grad[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z) * live[t][:, None]
        dr = dn * rn * reset * (1 - reset)
        inner = np.concatenate([dz, dr, dn * reset], axis=1)
        gates[t] = np.concatenate([dz, dr, dn], axis=1)
        du += h.T @ inner
        dh = dh * z + inner @ u.T
    return gates, du


def _forward(net: Network, x: np.ndarray, ids: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows. x: vectors of the words; ids: (steps, windows) rows of x; live: where a word stands."""
    p = net.p
    states = []
    for side in "fb":
        table = x @ p[f"w{side}"] + p[f"c{side}"]
        order = slice(None) if side == "f" else slice(None, None, -1)
        steps = [] if keep is not None else None
        states.append(_scan(table[ids[order]], p[f"u{side}"], live[order], steps)[order])
        if keep is not None:
            keep[side] = steps
    c = np.concatenate([*states, x[ids]], axis=2)
    focus = np.tanh(c @ p["a"])
    weight = np.where(live, (focus @ p["v"])[..., 0], _F(-30))
    weight = np.exp(weight - weight.max(axis=0)) * live
    weight = weight / np.maximum(weight.sum(axis=0), _F(1e-9))
    pooled = np.einsum("tb,tbd->bd", weight, c)
    if keep is not None:
        keep |= {"c": c, "focus": focus, "weight": weight, "pooled": pooled}
    return (pooled @ p["o"] + p["z"])[:, 0]


def _gradients(net: Network, words: list[bytes], x, origin, ids, live, target, importance) -> dict[str, np.ndarray]:
    p, keep = net.p, {}
    logit = _forward(net, x, ids, live, keep)
    d = ((_sigmoid(logit) - target) * importance / len(target)).astype(_F)
    g = {"o": keep["pooled"].T @ d[:, None], "z": d.sum(keepdims=True)}
    dpool = d[:, None] @ p["o"].T
    c, focus, weight = keep["c"], keep["focus"], keep["weight"]
    dc = weight[..., None] * dpool
    dw = np.einsum("tbd,bd->tb", c, dpool)
    dw = weight * (dw - (weight * dw).sum(axis=0))
    g["v"] = np.einsum("tbf,tb->f", focus, dw)[:, None]
    df = dw[..., None] * p["v"][:, 0] * (1 - focus * focus)
    g["a"] = np.einsum("tbd,tbf->df", c, df)
    dc += df @ p["a"].T
    dx = dc[..., 2 * HIDDEN :].copy()
    for k, side in enumerate("fb"):
        order = slice(None) if side == "f" else slice(None, None, -1)
        gates, g[f"u{side}"] = _scan_back(dc[..., k * HIDDEN : (k + 1) * HIDDEN][order], p[f"u{side}"], live[order], keep[side])
        gates = gates[order] * live[..., None]
        g[f"c{side}"] = gates.sum(axis=(0, 1))
        g[f"w{side}"] = np.einsum("tbd,tbg->dg", x[ids], gates)
        dx += gates @ p[f"w{side}"].T
    dx *= live[..., None]
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    per_word = sums_by(dx.reshape(-1, dx.shape[2])[order], flat[order], len(x))
    at, of, scale, own = origin
    shared = (per_word[:, :CHARS] * scale[:, None])[of]
    g["chars"] = np.stack([np.bincount(at, weights=shared[:, j], minlength=BUCKETS) for j in range(CHARS)], axis=1)
    g["own"] = np.stack([np.bincount(own, weights=per_word[:, CHARS + j], minlength=len(p["own"])) for j in range(OWN)], axis=1)
    g["own"][0] = 0
    return g


def windows(n: int) -> list[int]:
    """Where the windows over n words begin; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Scorer:
    """A network with the vectors of the words met so far; number 0 stands for no word."""

    def __init__(self, net: Network, most: int = 250_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1, CHARS + OWN), _F)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text's windows."""
        words = [letters(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.clear()
            new = set().union(*words)
        if new:
            fresh, parts, base = sorted(new), [self.table], len(self.known) + 1
            for i in range(0, len(fresh), 20_000):
                parts.append(self.net.inputs(fresh[i : i + 20_000])[0])
            self.table = np.concatenate(parts)
            self.known.update((w, base + i) for i, w in enumerate(fresh))
        ids = np.concatenate([np.fromiter(map(self.known.__getitem__, w), np.int64, len(w)) for w in words] + [np.zeros(WINDOW, np.int64)])
        begin = np.cumsum([0, *map(len, words)])
        first, size, doc = [], [], []
        for i, w in enumerate(words):
            at = windows(len(w))
            first += [begin[i] + a for a in at]
            size += [min(WINDOW, len(w))] * len(at)
            doc += [i] * len(at)
        first, size, doc = np.array(first), np.array(size), np.array(doc)
        out = np.full(len(texts), -np.inf, np.float64)
        p = self.net.p
        order = np.argsort(size, kind="stable")  # short windows together: fewer steps
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            steps = np.arange(max(1, int(size[some].max())))[:, None]
            live = steps < size[some]
            at = np.where(live, ids[np.minimum(first[some] + steps, len(ids) - 1)], 0)
            np.maximum.at(out, doc[some], _forward_fast(p, self.table, at, live))
        return out


def _forward_fast(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, live: np.ndarray) -> np.ndarray:
    used, ids = np.unique(ids, return_inverse=True)  # project each word once
    return _forward(Network({}, p), x[used], ids.reshape(live.shape), live)


def train(rows: list[tuple[str | None, int]], rates: tuple[float, float], seed: int = 5) -> Network:
    """Learns from (text, label). rates: how many documents of label 0 and 1 a row of each stands for."""
    rows = sorted(rows, key=lambda r: (r[1], r[0] or ""))
    y = np.array([label for _, label in rows], _F)
    if not len(y) or y.min() == y.max():
        return Network({}, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    words = [letters(t) for t, _ in rows]
    df = [Counter(), Counter()]
    for w, label in zip(words, y):
        df[int(label)].update(set(w))
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    common = Counter({w: df[0][w] + df[1][w] for w in df[0].keys() | df[1].keys()})
    vocabulary = {w: i + 1 for i, (w, c) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if c >= SEEN}
    telling = lambda w: np.log((df[1][w] + 0.5) / (n[1] + 1)) - np.log((df[0][w] + 0.5) / (n[0] + 1))
    samples = []
    for w, label in zip(words, y):
        if not w:
            samples.append(([], label))
            continue
        at = max(range(len(w)), key=lambda i: telling(w[i]))
        starts = [int(np.clip(at - rng.integers(4, WINDOW - 4), 0, max(0, len(w) - WINDOW)))]
        if not label:
            starts.append(int(rng.integers(0, max(1, len(w) - WINDOW + 1))))
        samples += [(w[s : s + WINDOW], label) for s in starts]
    samples += [([], 0.0)] * max(8, len(samples) // 50)  # no word at all is no sign of toxicity
    net = Network.new(vocabulary, seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    t, label = 0, np.array([s[1] for s in samples], _F)
    # each class weighs as it stands in the corpus, softened
    importance = np.where(label == 1, rates[1], rates[0]).astype(_F) ** _F(0.5)
    importance /= importance.mean()
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(samples)))
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            distinct = sorted({w for i in some for w in samples[i][0]})
            index = {w: i + 1 for i, w in enumerate(distinct)}
            ids = np.zeros((WINDOW, len(some)), np.int64)
            live = np.zeros(ids.shape, bool)
            for j, i in enumerate(some):
                w = samples[i][0]
                ids[: len(w), j] = [index[x] for x in w]
                live[: len(w), j] = True
            if not distinct:
                continue
            x, origin = net.inputs(distinct)
            x = np.concatenate([np.zeros((1, x.shape[1]), _F), x])
            at, of, scale, own = origin
            origin = (at, of + 1, np.concatenate([[_F(0)], scale]), np.concatenate([[0], own]))
            g = _gradients(net, distinct, x, origin, ids, live, label[some], importance[some])
            t += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for k, v in net.p.items():
                d = g[k].astype(_F) + (_F(1e-4) * v if k not in ("chars", "own") else _F(1e-5) * v)
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.99 * m[1] + 0.01 * d * d
                v -= (rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-7)).astype(_F)
    scorer = Scorer(net)
    raw = np.concatenate([scorer.logits([t for t, _ in rows[i : i + 200]]) for i in range(0, len(rows), 200)])
    none = max(8, len(y) // 50)
    raw, y = np.append(raw, np.repeat(scorer.logits([""]), none)), np.append(y, np.zeros(none, _F))
    net.slope, net.shift = _calibrate(raw, y, np.where(y == 1, rates[1], rates[0]))
    return net


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the highest logits (Newton steps, slightly damped)."""
    a = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    weight = weight / weight.mean()
    for _ in range(30):
        q = _sigmoid(design @ a)
        grad = design.T @ (weight * (q - y)) + 1e-2 * (a - [1.0, 0.0])
        curve = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
        a = a - np.linalg.solve(curve, grad)
    return (float(a[0]), float(a[1])) if np.isfinite(a).all() and a[0] > 0 else (1.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    """Trains on about `most` documents of each label; `labels`: (doc_id, toxic)."""
    given = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    held = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = None
    for k, n in held.items():
        part = bounded(given.where(F.col("toxic") == k), F.col("doc_id"), most, n)
        some = part if some is None else some.unionByName(part)
    if some is None:
        return Network({}, constant=0.0)
    # about 2 x `most` rows
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic").collect()
    rates = tuple(max(1.0, held.get(k, 0) / most) for k in (0, 1))
    return train([(r["text"], r["toxic"]) for r in rows], rates)


def score(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """All columns of `docs` with `score` (0 to 1)."""
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*[f"`{c}`" for c in kept])
    if net.constant is not None:
        return rows.withColumn("score", F.lit(net.constant))
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            at, found = 0, [np.empty(0)]
            while at < batch.num_rows:
                texts, chars = [], 0
                while at < batch.num_rows and chars < CHUNK:
                    texts.append(batch.column("text")[at].as_py())
                    chars += len(texts[-1] or "")
                    at += 1
                found.append(_sigmoid(scorer.net.slope * scorer.logits(texts) + scorer.net.shift))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(found), pa.float64())], [*kept, "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, kind + ", score double")
