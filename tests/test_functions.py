"""Column functions against small cases worked out by hand or by Python's own rules."""

import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import embedding, events, scoring, text, traces
from faultline.operators import clean, code_index, context, kb


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("value", ["c:\\windows\\foo.exe", "my app-2 name", "ÉTÉ d'or", "x"])
def test_title_case_like_python(spark, value):
    assert one(spark, text.title_case(F.col("s")), s=value) == value.title()


@pytest.mark.parametrize("value", ["  a\u00a0b\t\tc\u2003 \x1c", "a\x01b\x85c", "", None])
def test_clean_text_like_python(spark, value):
    want = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", re.sub(r"\s+", " ", value or "")).strip()
    assert one(spark, text.clean_text("s"), s=value) == want


def test_signature_order_makes_dates_plain_numbers(spark):
    assert one(spark, text.message_signature("m", "c"), m="At 2024-01-02 User a@b.c id deadbeefa", c=" 7 ") == "at N-N-N user EMAIL id ID|CODE: 7"


def test_normalize_compat_and_strict(spark):
    m = "2024-01-02T03:04:05 12345678-1234-1234-1234-123456789012 server: abc 42"
    assert one(spark, text.normalize_message("m"), m=m).startswith("NUM-NUM-02t03:NUM:NUM")
    assert one(spark, text.normalize_message("m", strict=True), m=m) == "TIMESTAMP GUID SERVER NUM"


@pytest.mark.parametrize("payload,kind", [
    ('{"Exception": {"Exception Type": "T", "InnerException": null}}', "T"),
    ('\ufeff{"Exception": {"Exception Type": "T"}}', "T"),
    ('{"Exception": {"Exception Type": "T\x01"}}', "T"),
    ('"Exception": {"Exception Type": "T", "Message": "m"', "T"),
    ('{"Exception": {"Exception Type": "T", "Message": "cut', "T"),
    ("no json at all", ""), ("", ""), (None, ""), ("[1]", ""), ('{"Exception": {"Exception Type": "T"}} tail "x"', "T"),
])
def test_details_survive_damage(spark, payload, kind):
    df = spark.createDataFrame([(payload,)], "EVENT_INFORMATION string")
    assert kb.with_details(df).select("d.exception_type").first()[0] == kind


def test_text_after_a_json_value_is_no_json(spark):
    for bad in ['{"a": 1} x', '{"a": 1} {"b": 2}', '"Exception": {"a": 1}', '{"a": 1},{"b": 2}']:
        assert one(spark, events.strict_json(F.col("s")).isNull(), s=bad), bad


def test_flatten_defaults(spark):
    df = spark.createDataFrame([(1, '{"Exception": {}}'), (2, "oops"), (3, '{"Exception": {"InnerException": {"Message": "m", "ErrorCode": 5}}}')], "i int, EVENT_INFORMATION string")
    rows = {r.i: r for r in clean.flatten_event(df).collect()}
    assert rows[1].Exception_Type == "Unknown" and rows[2].Exception_Type == "ParseError" and rows[2].Exception_Message == "oops"
    assert rows[3].Inner_Exception == ": m" and rows[3].Error_Code == "5"


def test_id_hash_when_no_sequence_number(spark):
    df = spark.createDataFrame([("m", "2024")], "Exception_Message string, LOGTIME string")
    assert clean.clean_exceptions(df, "now").first().Exception_ID.startswith("EX_")


@pytest.mark.parametrize("said,want", [
    ("PURGE|REPROCESS", "PURGE"), ("escalate to dev team", "INVESTIGATE"), ("RETRY", "UNDEFINED"), ("", "UNDEFINED"),
    ("THE MESSAGE TO REPROCESS", "REPROCESS"), ("purge", "PURGE"), ("none of these", "UNDEFINED"),
])
def test_one_resolution(spark, said, want):
    assert one(spark, scoring.one_resolution(F.col("s")), s=said) == want


@pytest.mark.parametrize("sim,want", [(0.96, 95), (0.95, 88), (0.9, 78), (0.85, 68), (0.8, 58), (0.75, 45), (0.0, 0)])
def test_kb_confidence_bands(spark, sim, want):
    assert one(spark, scoring.kb_confidence("s"), s=sim) == want


def test_blend_with_code(spark):
    assert one(spark, scoring.blended_with_code("a", "b", "c"), a=80.0, b=90.0, c=50.0) == 75


def test_no_match_is_confidence_zero(spark):
    df = spark.createDataFrame([(None,)], "s double")
    assert df.select(scoring.kb_confidence("s").alias("x")).first().x == 0


def test_frames_drive_letters_and_compat(spark):
    t = "at A.B.Run(Int32 n) in C:\\p\\f.cs:line 12\n  File \"x.py\", line 3, in go\n  File \"x.py\", line 3, in go"
    got = spark.createDataFrame([(t,)], "t string").select(traces.unique_frames(traces.stack_frames("t")).alias("f"), traces.stack_frames("t", compat=True).alias("g")).first()
    assert [(f.file_path, f.line_number, f.language) for f in got.f] == [("C:\\p\\f.cs", 12, "csharp"), ("x.py", 3, "python")]
    assert [f.language for f in got.g] == ["python", "python"]


def test_header_of_indented_line(spark):
    got = one(spark, traces.trace_header("t"), t="intro\n   ValueError\nbad thing\n")
    assert (got.exception_type, got.error_message) == ("ValueError", "bad thing")


def sequential_chunks(content):
    out, cur, start = [], [], 1
    lines = content.split("\n")
    for n, line in enumerate(lines, 1):
        cur.append(line)
        if len(cur) >= 100 or line.strip().startswith(("}", "end", "End Sub", "End Function")):
            if "\n".join(cur).strip():
                out.append((start, n, "\n".join(cur)))
            cur, start = [], n + 1
    if cur and "\n".join(cur).strip():
        out.append((start, len(lines), "\n".join(cur)))
    return out


def test_chunks_equal_line_loop(spark):
    import random

    rnd = random.Random(5)
    files = [(f"f{i}", "\n".join(rnd.choices(["x = 1", "  }", "", "end", "   "], [60, 1, 3, 1, 1], k=rnd.randint(0, 420)))) for i in range(60)]
    got = {}
    for r in code_index.code_chunks(spark.createDataFrame(files, "file_path string, content string")).orderBy("chunk_index").collect():
        got.setdefault(r.file_path, []).append((r.line_start, r.line_end, r.content))
    assert got == {f: c for f, t in files if (c := sequential_chunks(t))}


def test_frame_paths_inside_file_paths(spark):
    files = spark.createDataFrame([("src/a/Foo.cs", 2), ("lib/a/foo.cs", 1), ("x/b.c", 3), ("x/myfoo.cs", 0)], "file_path string, file_ord long")
    frames = spark.createDataFrame([("a\\FOO.cs",), ("foo.cs",), ("b.c",), ("c",), ("zzz.py",)], "file_path string")
    got = {r.frame_path: r.file_path for r in code_index.frame_to_file(frames, files).collect()}
    assert got == {"a\\FOO.cs": "lib/a/foo.cs", "foo.cs": "x/myfoo.cs", "b.c": "x/b.c", "c": "x/myfoo.cs"}


def test_prompt_budget(spark):
    e, c = "a b c", " ".join(str(i) for i in range(50))
    df = spark.createDataFrame([(e, c)], "e string, c string")
    def run(limit, kept):
        return df.select(context.within_budget(F.col("e"), F.col("c"), limit, kept).alias("x")).first().x

    assert run(100, 80) == e + "\n" + c
    assert run(40, 10) == e + "\n\n" + " ".join(str(i) for i in range(7))
    assert run(40, 3) == e


def test_embedder_gives_unit_vectors_and_can_be_swapped(spark):
    df = spark.createDataFrame([("disk full on node",), ("deadlock in table",), (None,)], "t string")
    rows = embedding.TermEmbedder.fit(df, "t").transform(df, "t", "v").collect()
    assert [round(sum(x * x for x in r.v), 3) for r in rows] == [1.0, 1.0, 0.0]
    mine = embedding.CallableEmbedder(lambda texts: [[float(len(t))] for t in texts])
    assert [r.v for r in mine.transform(df, "t", "v").collect()] == [[17.0], [17.0], [0.0]]
