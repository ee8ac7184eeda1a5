"""The training-data operators against brute force, and on odd input."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import contamination, imatch, langcrf, lmscore, maintext, mixing, sharding, simhash, tokenfiles, toxgru
from faultline.llm.common import fold
from faultline.llm.queries import QUERIES
from faultline.llm.subwords import _ODD, _RUNS, Subwords, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    rnd = random.Random(5)
    words = "the of and tion ing er es re th an on idiot der die und le la que el los".split()
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", ".", ","]) for _ in range(n))
    long = text(6000)
    rows = [(i, text(rnd.randint(1, 60)), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), 5) for i in range(40)]
    rows += [(50, None, "en", "a", None), (51, "", None, None, 0), (52, "  \n\t ", "en", "b", 3), (53, "123 !!!", "de", "b", 7), (54, long, "en", "a", 1), (55, long, "de", None, 1)]
    rows += [(None, "no id at all", "en", "a", 1), (None, None, None, None, None), rows[3], rows[3], (3, "other text of id three", "en", "a", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).withColumns({"size": F.lit("clash"), "fp": F.lit(1), "score": F.lit("clash"), "html": F.col("text"), "token": F.lit(0)}).repartition(3).cache()


def sf(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- 1 ----------------------------------------------------------------------------------------------------------


def test_fingerprints_equal_brute_force_over_the_whole_band(spark):
    import regex

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x, seed: xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed)
    docs = sf(spark, "documents").select("doc_id", "text")
    band = imatch.lexicon(docs)
    held = {r.term for r in band.collect()}
    tables = imatch.slots(band)
    assert len(held) == band.count() > 1000 and sorted(t for table in tables for t in table if t) == sorted(held)
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs).collect()}
    for r in docs.orderBy("doc_id").limit(50).collect():
        words = dict.fromkeys(w for w in regex.split(r"[^\p{L}\p{N}]+", (r.text or "").lower()) if w)
        all_terms = list(dict.fromkeys(signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words))
        kept, places = [t for t in all_terms if t in held] or all_terms, []
        for c in range(imatch.CHAINS):
            drawn = sorted(signed(xxhash.xxh64_intdigest(c.to_bytes(4, "little"), long(t, 42))) for t in kept)
            for k in range(imatch.LEVELS):
                subset, seed = [x for x in drawn if x % (1 << k) == 0], 42
                for x in subset:
                    seed = long(x, seed)
                places.append(f"{seed:016x}"[:8] if 1 <= len(subset) <= imatch.MOST else "")
        assert got[r.doc_id] == "-".join(places)


def test_fingerprints_and_edited_texts(spark, odd):
    got = imatch.fingerprints(odd).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, []).append(r)
    single = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    for r in single:
        i = rows.index(r)
        after = rows[(i + 1) % len(rows)]
        if sum(x[0] == after[0] for x in rows) > 1 or after[0] is None:
            continue
        t, nxt = r[1] or "", after[1] or ""
        k = len(t) // 3
        want = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert by_text[r[0]][0].edited_sha256 == want and by_text[r[0]][0].n_chars == len(t)
    same = {r.doc_id: r for r in got}
    assert same[54].fingerprint == same[55].fingerprint and same[50].fingerprint == same[51].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert imatch.fingerprints(odd.limit(0)).count() == 0


def test_likeness_tells_edited_from_next(spark):
    got = imatch.fingerprints(sf(spark, "documents")).toPandas()
    assert got.near_edited.mean() > 0.2 > 10 * got.near_next.mean()


def test_slices_cut_by_percentiles_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(imatch, "SLICE", 7)
    monkeypatch.setattr(imatch, "CUTS", 4)
    docs = spark.range(500).select((F.col("id") * F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    rows = sorted(((i * i, f"text number {i}") for i in range(500)), reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in imatch.fingerprints(docs).collect()}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        assert got[d] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()


# ---- 2 ----------------------------------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    field = langcrf.Field(["a", "b"], np.zeros((langcrf.BUCKETS, 2), np.float32), {}, np.zeros((2, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores = np.exp(rng.normal(size=(5, 2))).astype(np.float32)
    of, lengths = np.array([0, 1, 2, 3, 4, 4, 0]), np.array([4, 0, 3])
    labels = np.zeros(7, np.int16)
    got = langcrf.forward_backward(field, scores, of, lengths, labels)
    at = 0
    for d, n in enumerate(lengths):
        total, expected = 0.0, np.zeros(2)
        for path in range(2**n):
            y = [(path >> t) & 1 for t in range(n)]
            w = math.exp(field.start[y[0]]) if n else 0
            for t in range(n):
                w *= scores[of[at + t], y[t]] * (math.exp(field.moves[y[t - 1], y[t]]) if t else 1)
            total += w
            expected += w * np.bincount(y, minlength=2) if n else 0
        assert np.allclose(got[d], expected / total if n else 0, atol=1e-4)
        at += n


def test_language_of_held_out_and_mixed_texts(spark):
    docs = sf(spark, "documents")
    field = langcrf.learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    got = langcrf.identify(spark, docs, field).where(fold(F.col("doc_id"), 5) == 0)
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()
    parts = {r.lang: r.text for r in docs.where("length(text) > 400").collect()}
    mixed = " ".join(parts["en"].split()[:30] + parts["de"].split()[:30])
    row = langcrf.identify(spark, spark.createDataFrame([(1, mixed)], "doc_id long, text string"), field, spans=True).first()
    assert {s.lang for s in row.spans} >= {"en", "de"} and sum(s.words for s in row.spans) == len(langcrf.letters(mixed))


def test_language_of_odd_texts(spark, odd):
    field = langcrf.learn(odd)
    got = langcrf.identify(spark, odd, field)
    assert got.count() == odd.count() and "size" in got.columns
    assert {r.lang_pred for r in got.where("doc_id in (50, 51, 52, 53)").collect()} == {"und"}
    assert langcrf.identify(spark, odd, langcrf.learn(odd.limit(0))).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert langcrf.identify(spark, odd.limit(0), field).count() == 0
    assert langcrf.keep_identified(spark, odd, field).columns == odd.columns


# ---- 3 ----------------------------------------------------------------------------------------------------------


def test_gradient_of_attention():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lmscore._new_params(1).items()}
    for k in ("o0", "o1"):
        p[k] = rng.normal(size=p[k].shape) * 0.3
    ids, kinds = rng.integers(0, 50, (2, lmscore.WINDOW)), rng.integers(-1, 2, (2, lmscore.WINDOW))
    target, weight = rng.integers(0, lmscore.CLASSES, ids.shape), np.ones(ids.shape)
    _, g = lmscore._step(p, ids, kinds, target, weight)
    for name in ("q", "k", "v", "o0", "b1", "e_at"):
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        losses = []
        for e in (1e-4, -1e-4):
            p[name][at] += e
            losses.append(lmscore._step(p, ids, kinds, target, weight)[0])
            p[name][at] -= e
        assert abs((losses[0] - losses[1]) / 2e-4 - g[name][at]) < 1e-4 + 0.02 * abs(g[name][at])


def test_windows_score_every_id_once_with_its_context():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, (4, lmscore.END + 1))
    counts[2] = np.minimum(counts[2], counts[0] + counts[1])
    model = lmscore.train([], counts, counts[3], tokenizer_path("byte_bpe_50k.json"))
    model.p["o0"] = rng.normal(size=model.p["o0"].shape).astype(np.float32)
    n = 100
    ids = np.concatenate([[lmscore.END], rng.integers(0, 500, n), [lmscore.END]])
    kinds = np.array([-1] + [0] * (n + 1))
    by_class, _ = lmscore.id_scores(model, model.tables(), ids, kinds)
    both, _ = lmscore.id_scores(model, model.tables(), np.concatenate([ids, ids]), np.concatenate([kinds, kinds]))
    assert np.allclose(both, np.concatenate([by_class, by_class]), atol=1e-4)
    changed = ids.copy()
    changed[60] = 7  # nothing before it may change
    other, _ = lmscore.id_scores(model, model.tables(), changed, kinds)
    assert np.allclose(other[:60], by_class[:60], atol=1e-4) and not np.allclose(other[61:70], by_class[61:70], atol=1e-4)
    assert (by_class[1:] < 0).all() and by_class[0] == 0


def test_every_id_after_the_first_window_has_nine_ids_of_context():
    counts = np.ones((4, lmscore.END + 1), int)
    model = lmscore.train([], counts, counts[3], tokenizer_path("byte_bpe_50k.json"))
    model.p["o0"] = np.random.default_rng(1).normal(size=model.p["o0"].shape).astype(np.float32)
    ids = np.concatenate([[lmscore.END], np.random.default_rng(2).integers(0, 500, 100), [lmscore.END]])
    kinds = np.array([-1] + [0] * 101)
    scores = lambda x: lmscore.id_scores(model, model.tables(), x, kinds)[0]
    for t in range(10, 102):
        changed = ids.copy()
        changed[t - 9] = 777
        assert scores(changed)[t] != scores(ids)[t], t


def test_counts_and_base_score(spark, odd):
    train = fold(F.col("doc_id"), 5) != 1
    got = lmscore.score(spark, odd, train, tokenizer_path("byte_bpe_50k.json")).toPandas()
    rows = odd_rows()
    key = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5
    words = [(d, (t or "").encode().lower().split() + [None]) for d, t, *_ in rows]
    c = {}
    for d, w in words:
        for x in w if key(d) != 1 else []:
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted((len(w), sum(c.get(x, 0) > 0 for x in w), round(sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for _, w in words)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all() and (got.score < 0).all()
    assert lmscore.score(spark, odd.limit(0), train, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert np.isfinite(lmscore.score(spark, odd, F.lit(False), tokenizer_path("byte_bpe_50k.json")).toPandas().score).all()


def test_scores_do_not_follow_the_blocks(spark, monkeypatch):
    rows = [(i, f"the word of w{i % 5} and unseen{i} the end", None, None, None) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    scores = []
    for size in (lmscore.BLOCK, 20):
        monkeypatch.setattr(lmscore, "BLOCK", size)
        got = lmscore.score(spark, docs, F.col("doc_id") < 20, tokenizer_path("byte_bpe_50k.json")).toPandas().sort_values("doc_id")
        scores.append(got.score.to_numpy())
    assert np.allclose(*scores, atol=1e-3)


def test_every_training_text_fits_the_model(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SAMPLE", 2)
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("the cat sat on a mat and the dog ran".split()) for _ in range(40)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {r.doc_id for r in lmscore.bounded(docs.where("doc_id < 40"), F.col("doc_id"), lmscore.SAMPLE).collect()}
    other = min(set(range(40)) - first)
    # the same words in another order: all counts stay
    turned = docs.withColumn("text", F.when(F.col("doc_id") == other, " ".join(sorted(texts[other].split()))).otherwise(F.col("text")))
    a, b = (lmscore.score(spark, d.repartition(3, "doc_id"), F.col("doc_id") < 40, tokenizer_path("byte_bpe_50k.json")).toPandas().sort_values("doc_id") for d in (docs, turned))
    assert np.allclose(a.base_score, b.base_score)
    held = (a.doc_id >= 40).to_numpy()
    assert (np.abs(a.score.to_numpy() - b.score.to_numpy())[held] > 1e-5).all()


def test_ids_beside_and_windows_hold_every_training_id(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * k) % 7}" for k in range(30 + i))) for i in range(12)] + [(12, None)], "doc_id long, text string")
    made = lmscore.blocks(docs.repartition(3), F.col("doc_id") % 4 != 1, tokenizer_path("byte_bpe_50k.json"))
    known = Subwords(tokenizer_path("byte_bpe_50k.json"))
    want, total = np.zeros((lmscore.END + 1, 2 * lmscore.NEAR + 1)), 0
    model = lmscore.train([], np.ones((4, lmscore.END + 1), int), np.ones(lmscore.END + 1, int), tokenizer_path("byte_bpe_50k.json"))
    for r in docs.collect():
        if r.doc_id % 4 != 1:
            parts = [np.frombuffer(x, np.uint16) for x in known.words(lmscore.words_of(r.text))]
            ids = np.concatenate([[lmscore.END], *parts, [lmscore.END]]).astype(np.int64)
            lmscore._beside(ids, np.array([-1] + [0] * (len(ids) - 1)), want)
            total += len(ids) - 1
    assert (lmscore.ids_beside(made) == want).all() and want[:, -1].sum() == total + sum(i % 4 != 1 for i in range(13))
    got = 0
    for _, layout, firsts in lmscore._laid_out_training(made.toArrow().to_batches()):
        ids, kinds, _, _ = lmscore._windows(model, np.ones(lmscore.END + 1, np.float32), layout, firsts)
        got += int((kinds >= 0).sum())
        assert ids.shape[1] == lmscore.WINDOW
    assert got == total


# ---- 4 ----------------------------------------------------------------------------------------------------------


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for limit in (5, 8, 18):
        counts = np.concatenate([[0], (rng.random(25) ** 6 * 1e6).astype(np.int64) + 1])
        lengths = tokenfiles.code_lengths(counts, limit)
        assert lengths[0] == 0 and lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) == 1
    import heapq

    heap = [(int(c), [i]) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, (a + b, x + y))
    assert cost == int((counts * lengths).sum())  # Huffman's cost where the limit doesn't bind


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 4 * 60000).astype(np.uint16)
    lengths = tokenfiles.code_lengths(np.bincount(ids, minlength=1 << 16))
    data = tokenfiles.image([1, None], np.array([n, 0]), ids, 7, lengths, tokenfiles.codes(lengths))
    start, docs, counts, back = tokenfiles.read_image(data)
    assert (start, docs, counts.tolist()) == (7, [1, None], [n, 0]) and (back == ids).all()


def test_token_files(spark, odd, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE", 300)
    path = tokenfiles.write_files(odd, tokenizer_path("byte_bpe_50k.json"))
    got = tokenfiles.read_files(spark, path).toPandas().sort_values("start")
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    assert len(got) == len(odd_rows()) and got.doc_id.isna().tolist()[-2:] == [True, True] and got.doc_id.dropna().is_monotonic_increasing
    assert (got.start.values == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]])).all()
    want = sorted((-1 if r[0] is None else r[0], np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], np.uint16).tobytes()) for r in odd_rows())
    assert sorted((-1 if d != d or d is None else int(d), bytes(i)) for d, i in zip(got.doc_id, got.ids)) == want
    digest = tokenfiles.read_files(spark, path, digest_only=True).toPandas().sort_values("start")
    assert [zlib.crc32(np.frombuffer(i, np.uint16).astype("<u4").tobytes()) for i in got.ids] == digest.ids_crc32.tolist()
    assert tokenfiles.read_files(spark, tokenfiles.write_files(odd.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_ids_are_those_of_the_library_by_default(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), Subwords(path)
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", "one\ua7dd two", "a \U0001f600b 12", "\U00010940 \u0558s", "\U00012550\U00033000 z"]
    assert [np.frombuffer(x, np.uint16).tolist() for x in own.encode([*texts, *texts])] == 2 * [ids(t) for t in texts] and ids(texts[0]) == [64, 220, 50256, 275]
    # white space of every kind, long runs, and pieces that the bounded store has dropped
    rng = np.random.default_rng(1)
    atoms = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "<|endoftext|>", "'s", "12", "\xe9", "!!", "\ua7dd", "\U0001f600", "x" * 130, "\u200b", "\x00"]
    small = Subwords(path, most=40)
    for _ in range(400):
        mixed = ["".join(rng.choice(atoms) if rng.random() < 0.7 else " " for _ in range(rng.integers(0, 14))) for _ in range(5)]
        assert [np.frombuffer(x, np.uint16).tolist() for x in small.encode(mixed)] == [ids(t) for t in mixed]
        words = [w for t in mixed for w in t.encode().split()]
        assert [np.frombuffer(x, np.uint16).tolist() for x in small.words(words)] == [ids(" " + w.decode()) for w in words]
    assert max(map(len, [*small.runs, *small.pieces, *small.runs.older, *small.pieces.older])) <= Subwords.LONG
    # every code point that goes the fast way falls into the library's runs
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if not _ODD.search(c):
            text = f"a{c}{c}1 {c} !{c}\t"
            assert [len(r) for r in _RUNS.findall(text)] == [b - a for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))
    docs = [(1, "before"), (2, texts[0]), (3, texts[4]), (4, "after")]
    got = tokenfiles.read_files(spark, tokenfiles.write_files(spark.createDataFrame(docs, "doc_id long, text string"), path)).orderBy("start").collect()
    assert [np.frombuffer(bytes(r.ids), np.uint16).tolist() for r in got] == [[*ids(t), 0] for _, t in docs]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


# ---- 5 and 9 ----------------------------------------------------------------------------------------------------


def test_mix_of_odd_rows(spark, odd):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(odd_rows()) and got.copies.between(0, 2).all() and mixing.mix(odd.limit(0)).count() == 0
    again = mixing.mix(odd.repartition(7)).toPandas()
    order = ["doc_id", "text", "source"]
    assert got.sort_values(order)["copies"].tolist() == again.sort_values(order)["copies"].tolist()
    assert got.loc[got.text.isna(), "size"].tolist() == [0, 0]


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (1 + i % 37), "abc"[min(2, i % 7)]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.assign(taken=got["size"] * got.copies).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 5).all() and abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"] + 1e-9).all()


def test_shards_of_odd_rows(spark, odd):
    got = sharding.shard(odd, 4).toPandas()
    assert len(got) == len(odd_rows()) and sharding.shard(odd.limit(0)).count() == 0
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    assert sorted(zip(got["size"], got.text_crc32)) == want


def test_shards_are_even_and_keep_copies_together(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randint(1, 400) if i % 3 else f"copy {i % 9}", "en") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() <= 1.02 * size.mean()
    assert (got.groupby("text_crc32").shard.nunique() == 1).mean() > 0.95


def test_equal_texts_stay_together_whatever_their_metadata(spark):
    rnd = random.Random(6)
    rows = [(i, f"text {i} " * rnd.randint(1, 9), rnd.choice(["en", "de", "fr", "zh", None])) for i in range(3000)]
    rows += [(3000 + i, f"copied passage {i // 4} of several languages", rnd.choice(["en", "de", "fr", "zh", None])) for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert (got.groupby("text_crc32").shard.nunique() == 1).all() and len(size) == 8 and size.max() <= 1.03 * size.mean()


def test_a_heavy_group_is_divided(spark):
    rows = [(i, "same text" if i < 600 else f"text {i}", "en") for i in range(1000)]
    size = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string")).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert len(size) == 8 and size.max() <= 1.05 * size.mean()


# ---- 6 ----------------------------------------------------------------------------------------------------------


def reference_groups(rows, radius=3):
    fps = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((-1 if r[0] is None else r[0]), f"{fps[i]:016x}", low.get(find(i))) for i, r in enumerate(rows))


def test_groups_equal_brute_force(spark, odd):
    rows = [r for r in odd_rows() if r[1] != "other text of id three"]  # would give two components one name
    base = "one two three four five six seven eight nine ten".split() * 12
    for i in range(60):
        w = list(base)
        w[i % len(w)] = f"w{i // 20}"
        rows.append((100 + i, " ".join(w), "en", "a", 1))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == reference_groups(rows)
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert kept.count() == len({c for _, _, c in reference_groups(rows)})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.keep_first(odd.limit(0)).count() == 0


def test_tile_links_keep_components(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400,)).astype(np.uint64)
    a = np.unique(base[rng.integers(0, 40, 400)] ^ flips)
    x, y = simhash.tile_links(a, None, 3)
    parent = {int(v): int(v) for v in a}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in zip(x.tolist(), y.tolist()):
        parent[find(u)] = find(v)
    close = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    for _ in range(len(a)):
        label = np.where(close, label[None, :], len(a)).min(axis=1)
    assert len({find(int(v)) for v in a}) == len(set(label)) and len(x) < len(a)


# ---- 7 ----------------------------------------------------------------------------------------------------------


def test_gradient_of_network():
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in range(12)]
    net = toxgru.Network.new({w: i + 1 for i, w in enumerate(words[:5])}, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, live = rng.integers(1, 13, (9, 4)), np.ones((9, 4), bool)
    live[6:, 1] = False
    ids[~live] = 0
    y, imp = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 1])

    def run():
        x, (at, of, scale, own) = net.inputs(words)
        x = np.concatenate([np.zeros((1, x.shape[1])), x])
        return x, (at, of + 1, np.concatenate([[0], scale]), np.concatenate([[0], own]))

    def loss():
        q = toxgru._sigmoid(toxgru._forward(net, run()[0], ids, live))
        return float((imp * -(y * np.log(q) + (1 - y) * np.log(1 - q))).mean())

    x, origin = run()
    g = toxgru._gradients(net, words, x, origin, ids, live, y, imp)
    for name in ("wf", "wb", "uf", "ub", "cf", "a", "v", "o", "own", "chars"):
        at = tuple(int(i[0]) for i in np.nonzero(np.abs(g[name]) > 1e-6))
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3 + 0.05 * abs(g[name][at]), name


def test_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        seen = {i for s in toxgru.windows(n) for i in range(s, min(n, s + toxgru.WINDOW))}
        assert seen == set(range(n)) and all(s + toxgru.WINDOW <= n or s == 0 for s in toxgru.windows(n))


def test_toxic_words_are_learned_anywhere_in_a_text(spark):
    rnd = random.Random(3)
    plain = [f"{a}{b}" for a in "ka lo mi ne".split() for b in "ra tu vo".split()]
    bad = ["zorgle", "blix"]

    def text(n, toxic):
        w = [rnd.choice(plain) for _ in range(n)]
        for _ in range(2 * toxic):
            w[rnd.randrange(n)] = rnd.choice(bad)
        return " ".join(w)

    rows = [(i, text(rnd.randint(5, 300), i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxgru.learn(docs.drop("toxic"), docs.select("doc_id", "toxic").where("doc_id < 400"))
    far = spark.createDataFrame([(1, text(2000, False) + " zorgle blix you zorgle " + text(3000, False)), (2, text(5000, False)), (3, None), (4, ""), (None, "zorgle zorgle")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxgru.score(spark, far, net).collect()}
    assert got[1] >= 0.3 > got[2] and got[3] == got[4] and 0 <= got[3] < 0.3 and got[None] >= 0.3
    test = toxgru.score(spark, docs.where("doc_id >= 400"), net)
    assert test.where("(score >= 0.3) = (toxic = 1)").count() >= 0.95 * test.count()


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(45)], "doc_id long, quality int, t boolean").select("doc_id", F.col("t").cast("int").alias("toxic"))
    got = toxgru.score(spark, odd, toxgru.learn(odd, labels))
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxgru.score(spark, odd, toxgru.learn(odd, labels.limit(0))).select("score").distinct().collect()[0][0] == 0
    assert toxgru.score(spark, odd.limit(0), toxgru.learn(odd, labels)).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------------------------


def test_contamination_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(contamination, "SEGMENT", 500)
    monkeypatch.setattr(contamination, "BLOCK", 10)  # several blocks
    rows = odd_rows()
    items = [(1, rows[0][1]), (2, rows[54 - 14][1] if rows[40][1] else "the of"), (3, None), (4, "..."), (5, "THE of"), (5, "THE of"), (None, "idiot"), (7, " ".join(rows[44][1].split()[100:140]))]
    got = contamination.contamination(contamination.build_index(odd), spark.createDataFrame(items, "item_id long, text string")).collect()
    windows = {}
    for item, text in items:
        w = contamination.words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    want = []
    for r in rows:
        w, hit, found = contamination.words(r[1]), set(), set()
        for p, names in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= names
        want.append((-1 if r[0] is None else r[0], len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got) == sorted(want)
    index = contamination.build_index(odd)
    assert contamination.contamination(index, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0
    assert contamination.contamination(contamination.build_index(odd.limit(0)), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_exact_and_near_occurrences(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "c x b a"), (3, "b b b"), (4, None)], "doc_id long, text string")
    index = contamination.build_index(docs)
    queries = spark.createDataFrame([("p", "b c"), ("q", "a b c")], "item_id string, text string")
    exact = {(r.item_id, r.doc_id, r.start, r.n_words) for r in contamination.occurrences(index, queries).collect()}
    assert exact == {("p", 1, 1, 2), ("q", 1, 0, 3)}
    near = {(r.item_id, r.doc_id) for r in contamination.occurrences(index, queries, slop=1).collect()}
    assert near == {("p", 1), ("p", 2), ("q", 1), ("q", 2)}


# ---- 10 ---------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body><header class="top">Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="sidebar"><p>See also</div><article><h1>Head &amp; line {0}</h1><p>First <b>para</b>graph&nbsp;{0}<p>Second<br>line
<div class="ad">buy</div><ul><li>one<li>two</ul><form><input>Name <button>Go</button></form><section id="comments"><p>nice!</section></article><footer>&copy; Site</footer>"""


def test_main_text(spark):
    rows = [(i, "http://h.example/p", PAGE.format(i)) for i in range(6)] + [(7, None, None), (8, "not a url", ""), (9, "http://other/", "<p>alone"), (10, "http://h.example/x", PAGE.format(10)[:-40] + "<"), (0, "http://h.example/p", PAGE.format(0))]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for i in range(6):
        assert texts[i] == f"Head & line {i}\n\nFirst paragraph {i}\n\nSecond line\n\none\n\ntwo"
    assert texts[7] == texts[8] == "" and texts[9] == "alone" and texts[10].startswith("Head & line 10")
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_template_without_an_article(spark):
    page = "<html><body><div class='x'><p>Always here</p></div><div class='y'><p>Text {0} of its own</p></div><div class='z'><p>Also always</p></div></body></html>"
    rows = [(i, "http://h.example/", page.format(i)) for i in range(8)]
    got = {r.page_id: r.text for r in maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i} of its own" for i in range(8)}


def test_class_words_around_an_article_lose_nothing(spark):
    for around in ("<body class='has-sidebar'>{}", "<body class='search'>{}", "<div class='share'>{}</div>", "<div class='with-ads'>{}</div>"):
        rows = [(i, "http://h.example/", around.format(f"<article><p>Text {i}</p><div class='share'>no</div></article>")) for i in range(4)]
        got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {i: f"Text {i}" for i in range(4)}, around
    assert maintext.read_slots("<aside><article>teaser</article></aside><article>text</article>", frozenset()) == ["text"]


def test_a_template_has_a_fixed_order_and_nests(spark):
    # "one" and "two" stand on every page, but not in one order; "left" and "right" do; so do "in" and "out", which overlap with them on some pages
    line = lambda *x: "".join(f"<p>{t}</p>" for t in x)
    moved = [line("one", f"own {i}", "two") if i % 2 else line("two", f"own {i}", "one") for i in range(8)]
    kept = [line("left", f"own {i}", "right") for i in range(8)]
    crossed = [line("a", "b", "c", f"own {i}", *["x", "y"]) if i < 7 else line("a", "x", "b", "y", "c", f"own {i}") for i in range(8)]
    crossed[6] = line("a", "b", "c", "own 6")  # x and y have another vector than a, b and c
    rows = [(100 * k + i, f"http://h{k}.example/", page) for k, pages in enumerate((moved, kept, crossed)) for i, page in enumerate(pages)]
    got = {r.page_id: r.text.split("\n\n") for r in maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == (["one", f"own {i}", "two"] if i % 2 else ["two", f"own {i}", "one"])
        assert got[100 + i] == [f"own {i}"]
        assert got[200 + i] == {6: ["own 6"], 7: ["x", "y", "own 7"]}.get(i, [f"own {i}", "x", "y"])


# ---- all --------------------------------------------------------------------------------------------------------


def test_each_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_rare_languages_are_learned(spark):
    words = {"en": "the of and tion ing er".split(), "de": "der die und le la ung".split(), "sr": "je smo nisam hvala dobar dan".split()}
    rnd = random.Random(7)
    lang = lambda i: "sr" if i < 3 else "en" if i % 2 else "de"
    rows = [(i, " ".join(rnd.choices(words[lang(i)], k=8)), lang(i)) for i in range(20_000)]
    field = langcrf.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(field.langs) == ["de", "en", "sr"]


def test_pages_that_stand_twice_get_equal_texts(spark):
    page = lambda i: f"<html><body><div>Acme portal</div><div>Menu</div><p>Story {i} tells of day {i * 7}.</p><p>More {i}.</p><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://acme.test/{i}", page(i)) for i in range(8)]
    kind = "page_id long, url string, html string"
    once = {r.url: r.text for r in maintext.extract(spark.createDataFrame(rows, kind)).collect()}
    twice = maintext.extract(spark.createDataFrame(rows + rows, kind)).collect()
    assert len(twice) == 16 and all(r.text == once[r.url] for r in twice)
    assert all("Acme portal" not in t and "Story" in t for t in once.values())
