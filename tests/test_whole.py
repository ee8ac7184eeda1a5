"""Nothing is cut, dropped or merged for size."""

import json

from pyspark.sql import functions as F

from faultline.functions import events, text
from faultline.operators import code_index, clean, context, grouping, kb, neardup, vectors
from conftest import SF
from faultline.plans import triage
from faultline.plans.standins import view
from faultline.sources import files


def test_top_k_is_honoured(spark):
    queries = spark.createDataFrame([(1, "m", [0.0, 1.0])], "q_id long, module string, vec array<double>")
    entries = spark.createDataFrame([(i, "m", [i / 100, 1.0]) for i in range(30)], "kb_id long, module string, embedding array<double>")
    assert vectors.kb_topk(queries, entries, 10).count() == 10
    assert vectors.cross_module(queries, entries, 12).count() == 12


def test_cross_module_searches_the_other_modules_only(spark):
    queries = spark.createDataFrame([(1, "m", [0.0, 1.0]), (2, "M", [1.0, 0.0])], "q_id long, module string, vec array<double>")
    entries = spark.createDataFrame([(1, "m", [1.0, 0.1]), (2, "n", [0.6, 0.8]), (3, "m", [0.9, 0.3])], "kb_id long, module string, embedding array<double>")
    got = {(r.q_id, r.module, r.kb_id) for r in vectors.cross_module(queries, entries, 5, 0.95).collect()}
    assert got == {(1, "n", 2), (2, "m", 1), (2, "m", 3)}


def test_stored_action_is_whole(spark):
    payload = json.dumps({"Exception": {"Exception Type": "T", "Message": "m"}})
    rows = spark.createDataFrame([(1, "M", payload, "x" * 5000, "PURGE")], "row_ord long, Module string, EVENT_INFORMATION string, Action string, Resolution string")
    built = kb.kb_build(rows).first()
    assert len(built.action) == 5000
    other = kb.kb_append(kb.kb_build(rows).limit(0), rows).first()
    assert other.id.endswith(other.signature)


def test_search_text_is_whole_unless_asked(spark):
    d = spark.range(1).select(F.struct(*[F.lit("~" * 2000).alias(n) for n in events.DETAIL_FIELDS]).alias("d"))
    whole, short = d.select(kb.search_text(F.col("d")), kb.search_text(F.col("d"), {"message": 10})).first()
    assert whole.count("~") == 2000 * 6 and short.count("~") == 2000 * 5 + 10


def test_unreadable_payload_and_trace_survive(spark):
    raw = "not json " + "z" * 2000
    flat = clean.flatten_event(spark.createDataFrame([(raw,)], "EVENT_INFORMATION string")).first()
    assert flat.Exception_Message == raw
    damaged = '{"StackTrace": "' + "at a.b " * 400 + '"'
    got = spark.createDataFrame([(damaged,)], "raw string").select(events.fallback_details("raw")["stack_trace"].alias("t")).first()
    assert got.t == "at a.b " * 400


def test_rows_without_number_keep_their_own_ids(spark):
    rows = [("Payment", "T", "same", i) for i in range(50)]
    df = spark.createDataFrame(rows, "Module string, Exception_Type string, Exception_Message string, n int")
    assert clean.clean_exceptions(df, "now").select("Exception_ID").distinct().count() == 50
    assert clean.clean_exceptions(df, "now", short_ids=True).select("Exception_ID").distinct().count() == 1


def test_whole_digest_decides(spark):
    df = spark.createDataFrame([(1, "T", "a b", None), (2, "T", "a b", None), (3, "T", "c", None)], "row_ord long, Exception_Type string, Exception_Message string, Error_Code string")
    assert {r.row_ord for r in grouping.unique_for_dev(df).collect()} == {1, 3}
    assert {r.row_ord for r in neardup.kb_anti_signature(df, df.where("row_ord = 3")).collect()} == {1, 2}
    assert df.select(F.length(text.dedup_key("Exception_Type", "Exception_Message", "Error_Code"))).first()[0] == 32


def test_all_ids_and_machines_are_kept(spark):
    df = spark.range(300).select(F.lit("g").alias("Dedup_Group_ID"), F.col("id").alias("row_ord"), F.col("id").alias("Exception_ID"), F.concat(F.lit("m"), F.col("id") % 20).alias("MACHINE_NAME"), F.lit("t").alias("Timestamp"))
    assert grouping.id_table(df, "Dedup_Group_ID").count() == 300
    assert grouping.machine_table(df, "Dedup_Group_ID").count() == 20
    assert grouping.representatives(df, listed=300).first().Original_Exception_IDs.count("|") == 299
    assert grouping.representatives(df).first().Original_Exception_IDs == "g (300 exceptions)"


def test_prompt_is_whole_unless_asked(spark):
    df = spark.createDataFrame([(("T", "m", "s" * 3000), "k" * 4000)], "d struct<exception_type: string, message: string, stack_trace: string>, c string")
    none = F.expr("cast(null as array<struct<snippet_no: int, match_type: string, file_path: string, line_start: int, line_end: int, target_line: int, content: string>>)")
    whole = df.select(context.code_prompt(F.col("d"), none, F.col("c"))["essential"]).first()[0]
    short = df.select(context.code_prompt(F.col("d"), none, F.col("c"), {"stack_trace": 5, "context": 7})["essential"]).first()[0]
    assert "s" * 3000 in whole and "k" * 4000 in whole and "s" * 6 not in short and "k" * 8 not in short


def test_one_bad_prompt_fails_alone(spark):
    def model(prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    def wrong_number(prompts):
        return ["only one"]

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.raw_answer, r.error) for r in triage.score_with_callable(df, model, "prompt").collect()}
    assert got == {"a": ("A", None), "bad": (None, "no"), "b": ("B", None)}
    assert {r.raw_answer for r in triage.score_with_callable(df, wrong_number, "prompt").collect()} == {"only one"}


def test_groups_go_on_over_batches(spark):
    exc = view(spark, SF, "exc").select("row_ord", "Exception_ID", "Exception_Type", "Exception_Message", "Error_Code")
    whole = {r.row_ord: r.leader_ord for r in neardup.near_dup_groups(exc).collect()}
    edge = exc.selectExpr("percentile(row_ord, 0.5)").first()[0]
    first = neardup.follow_leaders(exc.where(F.col("row_ord") < edge), spark.createDataFrame([], neardup.LEADER_COLUMNS))
    first = spark.createDataFrame(first.collect(), first.schema)
    second = neardup.follow_leaders(exc.where(F.col("row_ord") >= edge), neardup.leaders_of(first))
    group_of = {r.row_ord: r.Dedup_Group_ID for r in [*first.collect(), *second.collect()]}
    assert group_of.keys() == whole.keys()
    assert all(group_of[row] == group_of[leader] for row, leader in whole.items())
    assert len(set(group_of.values())) == len(set(whole.values()))


def test_frames_among_files_that_share_their_folders(spark):
    import random

    rnd = random.Random(5)
    names = [f"src/main/java/com/Acme/{rnd.choice(['core', 'web', 'db'])}/{rnd.choice('ABCDEFG')}{i % 40}.java" for i in range(400)]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(names)], "file_path string, file_ord long")
    asked = ["src/main", "src\\main\\java", "SRC/MAIN/JAVA/", "a", "in", "com", "Acme/web", "core/A1.java", "B2.java", "c/d", "", None, "nothing.py", names[7], names[7] + "x", "x" * 200]
    asked += [p[rnd.randint(0, 20):] for p in names[:40]] + [p[5:rnd.randint(8, 30)] for p in names[:40]]
    got = {r.frame_path: r.file_path for r in code_index.frame_to_file(spark.createDataFrame([(a,) for a in asked], "file_path string"), files).collect()}
    want = {a: next((p for p in names if a.lower().replace("\\", "/") in p.lower()), None) for a in asked if a}
    assert got == {a: p for a, p in want.items() if p}


def test_csv_files_stay_small(spark, tmp_path):
    """A file with line breaks in its cells is read by one task, so no partition writes one file of any size."""
    rows = spark.range(1000, numPartitions=1).selectExpr("id", "concat('a', chr(10), id) AS text")
    files.write_csv(rows, str(tmp_path / "c"), 100)
    assert len(list((tmp_path / "c").glob("part-*"))) == 10
    assert sorted(map(tuple, files.scan_csv(spark, str(tmp_path / "c"), rows.schema).collect())) == sorted(map(tuple, rows.collect()))
