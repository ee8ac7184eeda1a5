"""Near-duplicate grouping against the sequential rule, and the bounds used to prune it."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import similarity
from faultline.operators import grouping, neardup

WORDS = "timeout order claim failed null value batch host retry payload schema deadlock".split()


def sequential(rows, threshold=0.85):
    """Row by row: the first open row of a type leads and takes the later open rows similar to it."""
    leader = {}
    types = sorted({r[1] or "" for r in rows})
    for t in types:
        block = [r for r in rows if (r[1] or "") == t]
        for i, a in enumerate(block):
            if a[0] in leader:
                continue
            leader[a[0]] = a[0]
            for b in block[i + 1:]:
                if b[0] in leader or not a[2] or not b[2]:
                    continue
                s = (SequenceMatcher(None, a[2], b[2]).ratio() + SequenceMatcher(None, b[2], a[2]).ratio()) / 2
                if a[3] and b[3] and a[3] != b[3]:
                    s *= 0.8
                if s >= threshold:
                    leader[b[0]] = a[0]
    return leader


def random_rows(n, seed):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(3, 8))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        text = "" if rnd.random() < 0.05 else " ".join(words)
        rows.append((i, rnd.choice(["A", "A", "A", "B", None]), text, rnd.choice(["", "", "E1", "E2"])))
    return rows


@pytest.mark.parametrize("seed,seeds,block,step", [(1, 3, 8, neardup.BAND_STEP), (2, 5, 16, 0.03), (3, 512, 512, 0.5), (4, 20, 4, 0.1)])
def test_groups_equal_sequential_rule(spark, monkeypatch, seed, seeds, block, step):
    monkeypatch.setattr(neardup._packed, "__defaults__", (block, 1000 * block, step))
    rows = random_rows(160, seed)
    df = spark.createDataFrame(rows, "row_ord long, Exception_Type string, Exception_Message string, Error_Code string")
    got = {r.row_ord: r.leader_ord for r in neardup.near_dup_groups(df, seeds=seeds, step=step).collect()}
    assert got == sequential(rows)


def test_group_numbers_follow_type_then_leader(spark):
    rows = random_rows(80, 9)
    df = spark.createDataFrame(rows, "row_ord long, Exception_Type string, Exception_Message string, Error_Code string")
    got = neardup.near_dup_groups(df).filter("row_ord = leader_ord").toPandas()
    got["t"] = got["Exception_Type"].fillna("~")
    order = got.sort_values(["t", "leader_ord"])
    assert order["Dedup_Group_ID"].tolist() == [f"GROUP_{i}" for i in range(len(order))]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=40), st.text("abcd ", max_size=40), st.sampled_from([0.6, 0.85, 0.9]))
def test_pruning_never_drops_a_similar_pair(a, b, threshold):
    m = similarity.Matcher([a, b], ["", ""])
    got = dict(m.similar_to(m, 0, np.array([1]), threshold, True, 0.8))
    s = (SequenceMatcher(None, a, b).ratio() + SequenceMatcher(None, b, a).ratio()) / 2 if a and b else 0.0
    assert (1 in got) == (s >= threshold)


def test_kb_anti_similar_equals_brute_force(spark):
    new, old = random_rows(60, 4), random_rows(40, 5)
    cols = "row_ord long, Exception_Type string, Exception_Message string, Error_Code string"
    got = {r.row_ord for r in neardup.kb_anti_similar(spark.createDataFrame(new, cols), spark.createDataFrame(old, cols)).collect()}
    want = {
        a[0] for a in new
        if not any(a[1] == b[1] and a[2] and b[2] and SequenceMatcher(None, a[2], b[2]).ratio() >= 0.9 for b in old)
    }
    assert got == want


def test_prepare_for_kb_counts_add_up(spark):
    cols = "row_ord long, Exception_Type string, Exception_Message string, Error_Code string"
    new = spark.createDataFrame(random_rows(60, 4), cols)
    unique, report = neardup.prepare_for_kb(new, spark.createDataFrame(random_rows(40, 5), cols))
    r = report.first()
    assert r.original_count == 60 and r.after_kb_dedup == unique.count() <= r.after_internal_dedup <= 60
    assert r.duplicates_removed == 60 - r.after_kb_dedup


def test_no_row_is_lost_in_expansion(spark):
    results = spark.createDataFrame([(0, "a", "G0", 1, "a"), (1, "b", "G1", 1, "b"), (2, "z", None, 1, "z")],
                                    "row_ord long, Exception_ID string, Dedup_Group_ID string, Dedup_Count int, Original_Exception_IDs string")
    bridge = spark.createDataFrame([("G0", "a"), ("G0", "c"), ("G1", "b"), ("G1", "c")], "Dedup_Group_ID string, Exception_ID string")
    got = {r.Exception_ID: (r.Dedup_Group_ID, r.Dedup_Count, r.Original_Exception_IDs) for r in grouping.expand_groups(results, bridge).collect()}
    assert got == {"a": ("G0", 2, "a|c"), "c": ("G0", 2, "a|c"), "b": ("G1", 2, "b|c"), "z": (None, 1, "z")}


def test_large_group_lists_only_its_size(spark):
    df = spark.range(150).select(F.lit("G").alias("Dedup_Group_ID"), F.col("id").cast("string").alias("Exception_ID"))
    assert grouping.listed_ids(df, "Dedup_Group_ID", 100).first().Original_Exception_IDs == "G (150 exceptions)"


def _edited(rnd, t):
    out = list(t)
    for _ in range(rnd.randint(0, max(1, len(t) // 7))):
        at = rnd.randrange(len(out))
        out[at:at + rnd.randint(0, 2)] = rnd.choice(["", "x", "ab", "7"])
        out = out or ["x"]
    return "".join(out)


@pytest.mark.parametrize("threshold,both_ways", [(0.85, True), (0.9, False), (0.6, True)])
def test_bounds_of_long_texts_drop_no_similar_pair(threshold, both_ways):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(60)] + ["QX-7", "zébre", "日本", "", "42!"]
    base = [" ".join(rnd.choices(words, k=rnd.choice([5, 35, 60, 200]))) for _ in range(12)]
    texts = base + [_edited(rnd, t) for t in base for _ in range(3)]
    m = similarity.Matcher(texts, [""] * len(texts))
    rows = np.arange(len(texts))
    for i, maybe in zip(rows, m.maybe(m, rows, rows, threshold, both_ways)):
        got = {int(r) for r in maybe if m.measured(m, int(i), int(r), threshold, both_ways, 1.0) is not None}
        for j in rows:
            s = SequenceMatcher(None, texts[j], texts[i]).ratio()
            if both_ways and texts[i] != texts[j]:
                s = (s + SequenceMatcher(None, texts[i], texts[j]).ratio()) / 2
            assert (j in got) == (s >= threshold), (i, j)


def test_few_unlike_messages_are_measured(monkeypatch):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(4, 12))) for _ in range(3000)]
    m = similarity.Matcher(texts, [""] * len(texts))
    rows = np.arange(len(texts))
    candidates = sum(len(x) - 1 for x in m.maybe(m, rows, rows, 0.85, True))
    assert candidates < len(texts) ** 2 / 10_000


def test_stored_index_finds_what_rows_find(spark, tmp_path):
    from faultline.sources import tables

    cols = "row_ord long, Exception_Type string, Exception_Message string, Error_Code string"
    new, old = random_rows(150, 14), random_rows(200, 15)
    path = str(tmp_path / "index")
    for part in (old[:90], old[50:], old[:20]):  # overlapping parts: each message is stored once
        tables.append_message_index(spark.createDataFrame(part, cols), path)
    index = tables.read_message_index(spark, path)
    assert index.count() == neardup.message_index(spark.createDataFrame(old, cols), codes=False).count()
    assert any(p.name.startswith("_band=") for p in (tmp_path / "index").iterdir())
    rows = spark.createDataFrame(new, cols)
    got = {r.row_ord for r in neardup.kb_anti_similar(rows, index, indexed=True).collect()}
    want = {a[0] for a in new if not any(a[1] == b[1] and a[2] and b[2] and SequenceMatcher(None, a[2], b[2]).ratio() >= 0.9 for b in old)}
    assert got == want == {r.row_ord for r in neardup.kb_anti_similar(rows, spark.createDataFrame(old, cols)).collect()}


@pytest.mark.parametrize("seed", [21, 22])
def test_batches_group_as_one_log(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "INDEX_BLOCK", 5)
    cols = "row_ord long, Exception_Type string, Exception_Message string, Error_Code string"
    rows = random_rows(150, seed)
    known, found = spark.createDataFrame([], neardup.LEADER_COLUMNS), {}
    for part in (rows[:40], rows[40:90], rows[90:]):
        grouped = neardup.follow_leaders(spark.createDataFrame(part, cols), known).cache()
        found.update({r.row_ord: r.Dedup_Group_ID for r in grouped.collect()})
        known = spark.createDataFrame((known.unionByName(neardup.leaders_of(grouped))).collect(), neardup.LEADER_COLUMNS)
    whole = sequential(rows)
    by_group = {}
    for row, group in found.items():
        by_group.setdefault(group, set()).add(row)
    by_leader = {}
    for row, leader in whole.items():
        by_leader.setdefault(leader, set()).add(row)
    assert sorted(map(sorted, by_group.values())) == sorted(map(sorted, by_leader.values()))
    assert known.count() == len(by_leader) == known.select("group_ord").distinct().count()


@pytest.mark.parametrize("n,seed,most", [(160, 1, 16), (70, 5, 1)])
def test_large_rounds_are_settled_by_all_tasks_and_equal_the_sequential_rule(spark, monkeypatch, n, seed, most):
    in_one_task = []
    settle = neardup._settled_apart
    monkeypatch.setattr(neardup, "MAX_SEEDS", 4)
    monkeypatch.setattr(neardup, "MOST_EARLIER", most)  # 1: most messages are not certain at once
    monkeypatch.setattr(neardup, "SIDE_BLOCK", 8)
    monkeypatch.setattr(neardup, "_settled_apart", lambda heads, *a: in_one_task.append(heads.count()) or settle(heads, *a))
    rows = random_rows(n, seed)
    df = spark.createDataFrame(rows, "row_ord long, Exception_Type string, Exception_Message string, Error_Code string")
    got = {r.row_ord: r.leader_ord for r in neardup.near_dup_groups(df, seeds=4).collect()}
    assert got == sequential(rows) and max(in_one_task) > 16


def _edited(rnd, text):
    chars = list(text)
    for _ in range(rnd.randint(0, max(1, len(chars) // 12))):
        at = rnd.randrange(len(chars) + 1)
        chars[at : at + rnd.randint(0, 4)] = rnd.choice(["", "ab", "x", "qq ", "\n", "\U0001f600"])
    return "".join(chars)


@pytest.mark.parametrize("most_meets", [0, 1 << 21])
def test_blocks_are_those_of_the_ratio(monkeypatch, most_meets):
    monkeypatch.setattr(similarity, "_MOST_MEETS", most_meets)
    rnd = random.Random(9)
    for size in (1, 7, 60, 199, 200, 201, 900):
        for _ in range(12):
            a = "".join(rnd.choices("etaoinshr dlu,.QZ\u00e9", k=size))
            b = _edited(rnd, a)
            matcher = SequenceMatcher(None, a, b)
            starts = similarity.block_starts_of(b)
            assert starts == matcher.b2j
            want = sum(x.size for x in matcher.get_matching_blocks())
            assert similarity.matched(a, b, starts, 0) == want
            assert similarity.matched(a, b, starts, want + 1) is None


def test_long_texts_are_told_apart_by_one_product(monkeypatch):
    """Runs are counted pair by pair only for pairs that the product of roots leaves, and no similar pair is lost."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9)))
    texts = [" ".join(word() for _ in range(150)) for _ in range(60)]
    texts += [" ".join(w if rnd.random() > 0.02 else word() for w in t.split()) for t in texts[:10]]
    rowwise = []
    counted = similarity.Matcher._long_rows
    monkeypatch.setattr(similarity.Matcher, "_long_rows", lambda self, rows, buckets: rowwise.append(len(rows)) or counted(self, rows, buckets))
    m, everything = similarity.Matcher(texts, [""] * len(texts)), np.arange(len(texts))
    kept = m.maybe(m, everything, everything, 0.85, True)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if (SequenceMatcher(None, a, b).ratio() + SequenceMatcher(None, b, a).ratio()) / 2 >= 0.85:
                assert j in kept[i]
    assert sum(rowwise) < 10 * len(texts)  # pair by pair it was every text for every other
