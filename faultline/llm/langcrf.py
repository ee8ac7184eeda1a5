"""Language of words and documents by a linear-chain conditional random field.

A word's evidence comes from its affixes and inner n-grams of bytes (hashed weights) and from a lexicon of words
seen in the sample; learned transitions tie neighbouring words together. Training sequences join spans of
several documents, so that switches of language within a text are seen. Words are labelled by
forward-backward over the whole text, however long; a document's language is the one with the most expected words.

The field is fitted on about `SAMPLE` labelled documents, chosen by a digest of doc_id, but on about `LEAST` of each language at
least (the bound of the fit; prediction covers all rows). Only the text is an input of a prediction.

Defined results: a null text or one without letters gets `und`, score 0; words without letters are no
evidence; repeated rows get equal answers; ties go to the smaller language code; with no labelled row every
text is `und`; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import packed, unpacked
from faultline.llm.words import grams, has_letter, letters, sums_by

#: Documents that the field is fitted on, about; least of each language, and most languages.
SAMPLE, LEAST, LANGUAGES = 3000, 50, 200
BUCKETS = 1 << 15
SIZES = (2, 3, 4)
#: Words of a training sequence, sequences for each document, rounds.
SPAN, SPANS, ROUNDS = 24, 4, 40
#: Words in lock-step together, about, and documents read together.
TOGETHER, CHUNK = 400_000, 1_000_000


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # buckets x languages
    lexicon: dict[bytes, tuple[float, ...]]  # share of each language among the documents with the word
    trust: np.ndarray  # weight of the lexicon: languages x languages
    moves: np.ndarray  # transitions
    start: np.ndarray

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Emission scores, a row for each word."""
        at, of = grams(words, SIZES, BUCKETS)
        out = sums_by(self.weights[at], of, len(words)) / np.sqrt(np.bincount(of, minlength=len(words)))[:, None]
        none = (0.0,) * len(self.langs)
        return (out + np.array([self.lexicon.get(w, none) for w in words]) @ self.trust).astype(np.float32)


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents of similar length, longest first, whose padded size stays bounded (a single one may be larger)."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, TOGETHER // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def forward_backward(field: Field, scores: np.ndarray, of: np.ndarray, lengths: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Expected number of words of each language in each document; `labels` receives each word's likeliest language.

    `scores`: exponentiated evidence by word number, `of`: word numbers of all texts, joined. All texts of a
    group take a step at once; the ones that have ended drop out at the end of the group.
    """
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    move = np.exp(field.moves).astype(np.float32)
    first = np.exp(field.start).astype(np.float32)
    total = np.zeros((len(lengths), len(field.langs)))
    for docs in _groups(lengths):
        docs = docs[lengths[docs] > 0]
        if not len(docs):
            continue
        size = lengths[docs]
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts longer than t
        place = begin[docs]
        e = np.zeros((longest, len(docs), len(first)), np.float32)
        for t in range(longest):
            e[t, : active[t]] = scores[of[place[: active[t]] + t]]
        alpha = np.zeros_like(e)
        a = first * e[0]
        a /= a.sum(axis=1, keepdims=True)
        alpha[0] = a
        for t in range(1, longest):
            a = (a[: active[t]] @ move) * e[t, : active[t]]
            a /= a.sum(axis=1, keepdims=True)
            alpha[t, : active[t]] = a
        back = np.ones((len(docs), len(first)), np.float32)
        found = np.zeros((len(docs), len(first)))
        for t in range(longest - 1, -1, -1):
            n = active[t]
            if t + 1 < longest and active[t + 1]:
                m = active[t + 1]
                b = (back[:m] * e[t + 1, :m]) @ move.T
                back[:m] = b / b.sum(axis=1, keepdims=True)
            p = alpha[t, :n] * back[:n]
            p /= p.sum(axis=1, keepdims=True)
            found[:n] += p
            if labels is not None:
                labels[place[:n] + t] = p.argmax(axis=1)
        total[docs] = found
    return total


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Field | None:
    """Learns from (text, language). Adam over the conditional log-likelihood of all sequences."""
    rng = np.random.default_rng(seed)
    docs = [(w, lang) for text, lang in sorted(texts) if (w := letters(text))]
    langs = sorted({lang for _, lang in docs})
    if not langs:
        return None
    k, number = len(langs), {lang: i for i, lang in enumerate(langs)}
    seen: dict[bytes, Counter] = {}
    per_lang = Counter(lang for _, lang in docs)
    for w, lang in docs:
        for x in set(w):
            seen.setdefault(x, Counter())[lang] += 1
    lexicon = {}
    for x, c in seen.items():
        if sum(c.values()) >= 5:
            share = np.array([c[lang] / per_lang[lang] for lang in langs])
            lexicon[x] = tuple(share / share.sum())
    n_seq = SPANS * len(docs)
    words, gold = [], np.zeros((n_seq, SPAN), np.int64)
    order = rng.permutation(np.repeat(np.arange(len(docs)), SPANS * 2))
    at = 0
    for s in range(n_seq):
        row: list[bytes] = []
        while len(row) < SPAN:
            w, lang = docs[order[at % len(order)]]
            at += 1
            want = min(SPAN - len(row), int(rng.choice([4, 8, 12, SPAN])))
            i = int(rng.integers(0, max(1, len(w) - want + 1)))
            part = w[i : i + want]
            gold[s, len(row) : len(row) + len(part)] = number[lang]
            row += part
        words.append(row)
    distinct = sorted({x for row in words for x in row})
    index = {x: i for i, x in enumerate(distinct)}
    ids = np.array([[index[x] for x in row] for row in words])
    feats, of = grams(distinct, SIZES, BUCKETS)
    scale = (1 / np.sqrt(np.bincount(of, minlength=len(distinct)))).astype(np.float32)
    none = (0.0,) * k
    lex = np.array([lexicon.get(x, none) for x in distinct], np.float32)
    hide = rng.random(len(distinct)) < 0.5  # unknown words must be learned as well
    lex[hide] = 0
    params = [np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    last = np.zeros((n_seq, SPAN, k), np.float32)
    rows = np.arange(n_seq)
    for step in range(1, ROUNDS + 1):
        weights, trust, moves, start = params
        e = sums_by(weights[feats], of, len(distinct)) * scale[:, None] + lex @ trust
        x = np.exp(np.clip(e, -30, 30))[ids]
        move, first = np.exp(moves), np.exp(start)
        alpha = np.zeros_like(last)
        back = np.ones_like(last)
        a = first * x[:, 0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, SPAN):
            a = (alpha[:, t - 1] @ move) * x[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        expect = np.zeros((k, k), np.float32)
        for t in range(SPAN - 2, -1, -1):
            b = back[:, t + 1] * x[:, t + 1]
            pair = alpha[:, t, :, None] * move * b[:, None, :]
            expect += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ move.T
            back[:, t] = b / b.sum(axis=1, keepdims=True)
        p = alpha * back
        p /= p.sum(axis=2, keepdims=True)
        p[rows[:, None], np.arange(SPAN), gold] -= 1  # model less truth
        flat, g = ids.ravel(), p.reshape(-1, k)
        ge = np.stack([np.bincount(flat, weights=g[:, j], minlength=len(distinct)) for j in range(k)], axis=1)
        gs = (ge * scale[:, None])[of]
        true = np.bincount(gold[:, :-1].ravel() * k + gold[:, 1:].ravel(), minlength=k * k).reshape(k, k)
        grads = [
            np.stack([np.bincount(feats, weights=gs[:, j], minlength=BUCKETS) for j in range(k)], axis=1) + 0.02 * weights,
            lex.T @ ge + 0.1 * trust, expect - true + 0.1 * moves, p[:, 0].sum(axis=0) + 0.1 * start]
        for q, (param, grad) in enumerate(zip(params, grads)):
            grad = (grad / n_seq).astype(np.float32)
            m[q] = 0.9 * m[q] + 0.1 * grad
            v[q] = 0.99 * v[q] + 0.01 * grad**2
            param -= 0.15 * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-7)
    weights, trust, moves, start = params
    return Field(langs, weights, lexicon, trust, moves, start)


def learn(docs: DataFrame, most: int = SAMPLE, least: int = LEAST, languages: int = LANGUAGES) -> Field | None:
    """Fits the field on a sample of (doc_id, text, lang): about `most` rows, but `least` of each language (all if it has fewer).

    Of more than `languages` languages the most frequent ones are learned.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not n:
        return None
    share = most / sum(n.values())
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    wanted = F.element_at(F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(int(min(1.0, max(share, least / v)) * (1 << 30))))]), F.col("lang"))
    return fit([(r["text"], r["lang"]) for r in rows.where(draw < wanted).select("text", "lang").collect()])


class Labeller:
    """A field with the scores of the words met so far."""

    def __init__(self, field: Field, most: int = 300_000):
        self.field, self.most = field, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.ones((0, len(self.field.langs)), np.float32)

    def number(self, texts: list[list[bytes]]) -> np.ndarray:
        new = set().union(*texts).difference(self.known) if texts else set()
        if len(self.known) + len(new) > self.most:
            self.clear()
            new = set().union(*texts)
        if new:
            words = sorted(new)
            parts = [self.table]
            for i in range(0, len(words), 20_000):
                e = self.field.evidence(words[i : i + 20_000])
                parts.append(np.exp(np.clip(e - e.max(axis=1, keepdims=True), -20, 0)))
            base = len(self.known)
            self.table = np.concatenate(parts)
            self.known.update((w, base + i) for i, w in enumerate(words))
        return np.concatenate([np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in texts]) if texts else np.empty(0, np.int64)

    def documents(self, texts: list[str | None], spans: bool = False):
        """(language or `und`, score, spans) for each text; a span is (language, words)."""
        words = [letters(t) for t in texts]
        lengths = np.array([len(w) for w in words])
        of = self.number(words)
        labels = np.zeros(len(of), np.int16) if spans else None
        total = forward_backward(self.field, self.table, of, lengths, labels)
        best = total.argmax(axis=1)
        end = np.cumsum(lengths)
        for i, text in enumerate(texts):
            if not lengths[i] or not has_letter(text):
                yield "und", 0.0, []
                continue
            runs = []
            if spans:
                x = labels[end[i] - lengths[i] : end[i]]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]])
                runs = [(self.field.langs[x[a]], int(b - a)) for a, b in zip(cut[:-1], cut[1:])]
            yield self.field.langs[best[i]], float(min(1.0, total[i, best[i]] / lengths[i])), runs


def identify(spark: SparkSession, docs: DataFrame, field: Field | None, spans: bool = False) -> DataFrame:
    """All columns of `docs` with `lang_pred`, `score` and, if asked for, `spans` (runs of words in one language)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    kind = T.StructType(docs.select(*[f"`{c}`" for c in kept]).schema.fields).add("lang_pred", "string").add("score", "double")
    kind = kind.add("spans", T.ArrayType(T.StructType().add("lang", "string").add("words", T.LongType()))) if spans else kind
    if field is None:
        out = docs.select(*[f"`{c}`" for c in kept]).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
        return out.withColumn("spans", F.expr("cast(array() as array<struct<lang: string, words: bigint>>)")) if spans else out
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and chars < CHUNK:
                    texts.append(batch.column("text")[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                part = batch.slice(at, len(texts))
                at += len(texts)
                found = list(labeller.documents(texts, spans))
                new = [pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())]
                if spans:
                    new.append(pa.array([[{"lang": a, "words": b} for a, b in f[2]] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], [*kept, "lang_pred", "score", *["spans"] * spans])

    return docs.mapInArrow(run, kind)


def keep_identified(spark: SparkSession, docs: DataFrame, field: Field | None) -> DataFrame:
    """Documents that have a language, whatever their columns are called."""
    return unpacked(identify(spark, packed(docs, "text"), field).where(F.col("lang_pred") != "und"), docs, "text")
