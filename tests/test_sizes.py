"""Tasks stay bounded as tables grow: pieces of inputs, arriving files, meetings of near duplicates."""

import os
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from conftest import SF
from faultline import session
from faultline.operators import grouping, kb, neardup
from faultline.plans import q_jobs, standins
from faultline.sources import files, tables
from faultline.streaming import jobs as streams


def piece_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_a_compact_table_is_dealt_into_pieces_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PIECE_ROWS", 50)
    rows = standins.table(spark, SF, "events")
    sizes = piece_sizes(rows)
    assert sum(sizes) == spark.read.parquet(f"{SF}/events.parquet").count() and max(sizes) <= 60


def test_arriving_files_are_bounded_and_make_as_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_jobs, "PIECE_ROWS", 30)
    rows = standins.view(spark, SF, "kbfile")
    each = q_jobs.arrive(rows, f"{tmp_path}/in")
    per_file = [r["count"] for r in spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).count().collect()]
    assert max(per_file) <= 40 and len(per_file) == 2 * each
    seen = []
    stream = streams.read_log_stream(spark, f"{tmp_path}/in", rows.schema, max_files=each)
    streams._start(stream, f"{tmp_path}/state", lambda batch, i: seen.append(batch.count())).awaitTermination()
    assert len(seen) == 2 and sum(seen) == rows.count()


def test_a_large_batch_of_entries_is_spread(spark, tmp_path, monkeypatch):
    standins.view(spark, SF, "kbfile").coalesce(1).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(session, "PIECE_ROWS", 100)
    pieces = []
    build = streams.kb_ops.kb_build
    monkeypatch.setattr(streams.kb_ops, "kb_build", lambda df: pieces.append(max(piece_sizes(df))) or build(df))
    schema = standins.view(spark, SF, "kbfile").schema
    streams.stream_kb_append(streams.read_log_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/kb", f"{tmp_path}/state").awaitTermination()
    assert pieces and pieces[0] <= 120
    assert tables.read_kb(spark, f"{tmp_path}/kb").count() > 0


def test_key_value_lines_are_split_once(spark, tmp_path):
    (tmp_path / "log.txt").write_text("id: 1\nid: 2\nnote: a:b\nplain\n\n\nnote: x\n id : 3 \nid:4\n")
    rows = files.scan_kv_blocks(spark, str(tmp_path / "log.txt"), ["id", "note"])
    assert sorted((r["id"], r["note"]) for r in rows.collect()) == [("2", "a:b"), ("4", "x")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1  # the pairs were computed anew inside the search for a later equal key


def messages(n, seed):
    rnd = random.Random(seed)
    words = "timeout order claim failed null value batch host retry payload schema deadlock".split()
    base = [" ".join(random.Random(k).choices(words, k=6)) for k in range(8)]
    return [(i, rnd.choice("AAB"), f"{rnd.choice(base)} {rnd.choice(words)} u{rnd.randrange(999)}", "") for i in range(n)]


def test_layers_of_an_index_find_the_first_alike(spark, monkeypatch):
    monkeypatch.setattr(neardup, "INDEX_BLOCK", 8)
    kind = "ord long, _t string, _msg string, _code string"
    known, new = messages(120, 1), [(1000 + i, *r) for i, *r in messages(60, 2)]
    index = spark.createDataFrame(known, kind).withColumn("_band", neardup._band(F.col("_msg")))
    met = []
    all_at_once = neardup._first_of
    monkeypatch.setattr(neardup, "_first_of", lambda items, *rest: met.append(items.count()) or all_at_once(items, *rest))
    got = {r.ord: r.leader for r in neardup.first_in_index(spark.createDataFrame(new, kind), index, 0.85, both_ways=False).collect()}
    want = {}
    for o, t, m, _ in new:
        alike = [k for k, kt, km, _ in known if kt == t and SequenceMatcher(None, m, km).ratio() >= 0.85]
        if alike:
            want[o] = min(alike)
    assert got == want and len(want) > 20
    assert met[0] == 60 and len(met) > 2 and met[-1] <= 60 - len(want) // 2  # what is found early goes no further


def test_blocks_meet_leaders_in_more_than_one_task(spark, monkeypatch):
    rows = [(i, "A", f"order {'x' * (i % 40)} failed with payload {i * 7919 % 1000:03d}", "") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_ord long, Exception_Type string, Exception_Message string, Error_Code string")
    df = df.withColumn("Exception_Message", F.translate("Exception_Message", "0123456789", "abcdefghij"))
    tasks, cut = [], neardup.cut

    def watched(one):
        out = cut(one)
        if "sims" in out.columns:
            tasks.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(neardup, "cut", watched)
    neardup.near_dup_groups(df, seeds=8).count()
    assert tasks and min(tasks) > 1


def test_repeated_entries_are_parsed_once(spark, monkeypatch):
    rows = standins.view(spark, SF, "kbfile")
    parsed, candidates = [], kb.kb_candidates
    want = grouping.first_per(candidates(rows), ["module", "signature"])
    monkeypatch.setattr(kb, "kb_candidates", lambda df: parsed.append(df.count()) or candidates(df))
    got = kb.kb_build(rows).drop("id")
    assert parsed[0] < rows.count() * 0.8
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def held(folder):
    return sum(os.path.getsize(f"{top}/{name}") for top, _, names in os.walk(folder) for name in names)


def test_rounds_write_every_message_once(spark, tmp_path, monkeypatch):
    """What meets is named, not copied: the shared folder grew by all messages several times in every round."""
    monkeypatch.setattr(neardup, "MAX_SEEDS", 16)
    monkeypatch.setattr(neardup, "INDEX_BLOCK", 32)
    monkeypatch.setattr(neardup, "SIDE_BLOCK", 32)
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("etaoinshrdlu ", k=8000)) for _ in range(250)]
    texts += [t + " and more" for t in texts[:20]]
    df = spark.createDataFrame([(i, "A", t, "") for i, t in enumerate(texts)], "row_ord long, Exception_Type string, Exception_Message string, Error_Code string")
    for module in (session, neardup):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path), raising=False)
    usual = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        got = {(r.leader_ord, r.member_ord) for r in neardup.similar_pairs(df, seeds=16).collect()}
    finally:
        if usual:
            spark.sparkContext.setCheckpointDir(usual)
    assert got == {(i, 250 + i) for i in range(20)}
    assert held(tmp_path) < 2.5 * sum(map(len, texts))  # it was 13 times


def test_source_trees_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver never lists the files; folders are walked level by level, and a task reads a bounded number of files."""
    monkeypatch.setattr(files, "FILES", 40)
    monkeypatch.setattr(files, "LISTED", 16)
    monkeypatch.setattr(files, "BATCH_BYTES", 64)
    names = {f"src{i % 3}/en/x{i % 2}/doc_{i}.py": f"text {i}\r\nend" for i in range(300)}
    odd = {"d e/sub%20x/f g.PY": "1", "k=v/_m=1/z.cs": "2", "_metadata/m.py": "3", "_metadata.py": "-", "__init__.py": "-", ".git/h.py": "-", "_private/p.py": "-", ".py": "-", "node_modules/n.py": "-", "d.py/t.txt": "-"}
    for name, text in (names | odd).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "linked.py").symlink_to(tmp_path / "src0/en/x0/doc_0.py")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    spark_side = files._listed_by_spark(spark, str(tmp_path)).select("file_path", "mtime", F.col("_plain").alias("full_path"))
    rows = files.scan_code(spark, f"{tmp_path}/")
    assert not rows._jdf.inputFiles() or all("saved-" in x for x in rows._jdf.inputFiles())  # tables of names; it was every file
    got = rows.collect()
    want = {k: v.replace("\r\n", "\n") for k, v in names.items()} | {k: v for k, v in odd.items() if v != "-"} | {"linked.py": "text 0\nend"}
    assert {r.file_path: r.content for r in got} == want and len(got) == len(want)
    assert sorted((r.file_path, r.mtime, r.full_path) for r in got) == sorted(map(tuple, spark_side.collect()))
    assert max(piece_sizes(rows)) <= 60
