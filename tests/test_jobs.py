"""Vectors, stores, streams, plans, and the registered queries on the smallest tables."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from faultline.operators import audit, grouping, kb, neardup, review, vectors
from faultline.plans import q_kb, triage
from faultline.plans.standins import view
from faultline.sources import files, tables
from faultline.streaming import jobs as streams


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_equals_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "ENTRY_BLOCK", 7)
    rnd = random.Random(3)
    def vec():
        return [rnd.gauss(0, 1) for _ in range(5)]

    same = vec()
    entries = [(i, rnd.choice(["a", "b c"]), same if i % 3 == 0 else vec()) for i in range(40)]
    queries = [(i, rnd.choice(["A", "b_c", "none"]), vec()) for i in range(15)]
    got = vectors.knn_join(spark.createDataFrame(queries, "q_id long, module string, vec array<double>"), spark.createDataFrame(entries, "kb_id long, module string, embedding array<double>"), 4, metric)
    found = {(r.q_id, r["rank"]): r.kb_id for r in got.collect()}

    def dist(x, y):
        if metric == "l2":
            return sum((a - b) ** 2 for a, b in zip(x, y))
        return 1 - sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))

    want = {}
    for q, m, v in queries:
        mine = sorted((round(max(dist(v, e), 0), 9), i) for i, em, e in entries if em.replace(" ", "_").lower() == m.lower())
        want.update({(q, n + 1): i for n, (_, i) in enumerate(mine[:4])})
    assert found == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("mode", [{}, {"within_module": False}, {"within_module": False, "per_module": True}, {"within_module": False, "per_module": True, "others": True}])
def test_cells_equal_brute_force(spark, monkeypatch, metric, mode):
    monkeypatch.setattr(vectors, "ENTRY_BLOCK", 9)
    rnd = random.Random(8)
    centres = [[rnd.gauss(0, 3) for _ in range(6)] for _ in range(5)]

    def vec(i):
        return [x + rnd.gauss(0, 0.3) for x in centres[i % 5]]

    entries = [(i, rnd.choice(["a", "A", "b c", "d"]), vec(i)) for i in range(150)] + [(150 + i, "a", [0.0] * 6) for i in range(2)] + [(160 + i, "a", centres[0]) for i in range(9)]
    queries = [(i, rnd.choice(["a", "B_c", "none"]), vec(i)) for i in range(40)] + [(41, "a", [0.0] * 6), (42, "a", centres[0])]
    q, e = spark.createDataFrame(queries, "q_id long, module string, vec array<double>"), spark.createDataFrame(entries, "kb_id long, module string, embedding array<double>")
    whole = sorted(map(tuple, vectors.knn_join(q, e, 4, metric, cell=10**6, **mode).collect()))
    assert sorted(map(tuple, vectors.knn_join(q, e, 4, metric, cell=7, **mode).collect())) == whole
    if not mode:
        def dist(x, y):
            if metric == "l2":
                return sum((a - b) ** 2 for a, b in zip(x, y))
            norm = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
            return 1 - (sum(a * b for a, b in zip(x, y)) / norm if norm else 0)

        want = {i: sorted((round(max(dist(v, w), 0), 9), j) for j, em, w in entries if em.replace(" ", "_").lower() == m.lower())[:4] for i, m, v in queries}
        got = {}
        for r in sorted(whole, key=lambda r: (r[0], r[4])):
            got.setdefault(r[0], []).append(r[2])
        assert got == {i: [j for _, j in w] for i, w in want.items() if w}


def test_copies_of_a_vector_are_one(spark):
    """However many copies a vector has, it searches once and stands as one entry with its first ids."""
    e = spark.createDataFrame([(i, "m", [1.0, 0.0]) for i in range(200)] + [(300, "m", [0.0, 1.0])], "kb_id long, module string, embedding array<float>")
    entries, owners = vectors._distinct_entries(e.select("kb_id", "module", F.lit("").alias("pkey"), F.col("embedding").alias("vec")), 3)
    assert sorted((r.kb_id, [x.kb_id for x in r.owners]) for r in owners.collect()) == [(0, [0, 1, 2]), (300, [300])] and entries.count() == 2
    q = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(50)] + [(60, [1.0, 0.0])], "q_id long, vec array<float>")
    found = sorted((r.q_id, r["rank"], r.kb_id, round(r.distance, 6)) for r in vectors.code_topk(q, e.drop("module"), 3).collect())
    assert found == sorted([(i, n, j, d) for i in range(50) for n, j, d in [(1, 300, 0.4), (2, 0, 0.8), (3, 1, 0.8)]] + [(60, n + 1, n, 0.0) for n in range(3)])


def test_cells_far_away_are_not_visited(spark):
    rnd = random.Random(9)
    centres = [[rnd.gauss(0, 5) for _ in range(16)] for _ in range(20)]
    rows = [(i, "m", "m", [x + rnd.gauss(0, 0.1) for x in centres[i % 20]]) for i in range(2000)]
    entries, cells, _ = vectors.entry_cells(spark.createDataFrame(rows, "kb_id long, module string, pkey string, vec array<double>"), "l2", 50)
    q = spark.createDataFrame([("m", [i for i, *_ in rows[:200]], [x for r in rows[:200] for x in r[3]], [0.5] * 200)], "pkey string, q_ids array<bigint>, q_mat array<double>, kth array<double>")
    n_cells = len(cells.first().cells)
    visited = sum(len(r.q_ids) for second in (False, True) for r in vectors.routes(q, cells, 5, "l2", second).collect())
    assert n_cells >= 20 and visited < 200 * n_cells / 3


def test_cross_module_without_own_kb(spark):
    q = spark.createDataFrame([(1, "missing", [1.0, 0.0]), (2, "missing", [-1.0, 0.0])], "q_id long, module string, vec array<double>")
    k = spark.createDataFrame([(7, "m1", [1.0, 0.0]), (8, "m2", [0.9, 0.1])], "kb_id long, module string, embedding array<double>")
    assert [(r.q_id, r.module, r.kb_id) for r in vectors.cross_module(q, k).collect()] == [(1, "m1", 7)]


def test_snapshot_keeps_old_version_readable(spark, tmp_path):
    path = str(tmp_path / "q")
    assert tables.read_snapshot(spark, path) is None
    tables.write_snapshot(spark.range(3), path)
    old = tables.read_snapshot(spark, path)
    tables.write_snapshot(old.filter("id > 0"), path)
    assert old.count() == 3 and tables.read_snapshot(spark, path).count() == 2
    (tmp_path / "q" / "version=9").mkdir()
    assert tables.latest_version(spark, path) == 2


def test_kb_replace_touches_only_its_module(spark, tmp_path):
    path = str(tmp_path / "kb")
    tables.replace_kb(spark.createDataFrame([("s1", "A"), ("s2", "B")], "signature string, module string"), path)
    tables.replace_kb(spark.createDataFrame([("s3", "A")], "signature string, module string"), path)
    assert sorted((r.signature, r.module) for r in tables.read_kb(spark, path).collect()) == [("s2", "B"), ("s3", "A")]
    assert {r.module for r in tables.loaded_modules(spark, path).collect()} == {"A", "B"}


def test_replayed_audit_batch_is_not_doubled(spark, tmp_path):
    results = view(spark, SF, "results")
    e = audit.audit_entry(results, F.count_if("Requires_Review"), "f.csv", "M", "2024-01-01 00:00:00", 90)
    for batch in (1, 1, 2):
        tables.append_audit(e, str(tmp_path), batch)
    assert tables.audit_scan(spark, str(tmp_path)).count() == 2


def test_kb_stream_restart_adds_nothing(spark, tmp_path):
    rows = view(spark, SF, "kbfile")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    for attempt in ("s1", "s2"):
        stream = streams.read_log_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
        streams.stream_kb_append(stream, str(tmp_path / "kb"), str(tmp_path / attempt)).awaitTermination()
    got = tables.read_kb(spark, str(tmp_path / "kb"))
    assert got.count() == got.select("module", "signature").distinct().count() == kb.kb_build(rows).count()


def test_stream_batches_replace_themselves(spark, tmp_path):
    rows = view(spark, SF, "results").select("Exception_ID", "Resolution", "Confidence_Score", "Requires_Review")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for attempt in ("s1", "s2"):
        stream = streams.read_log_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
        none = spark.createDataFrame([], neardup.LEADER_COLUMNS)
        streams.stream_triage(stream, lambda b, leaders: (b, none), str(tmp_path / "out"), str(tmp_path / "leaders"), str(tmp_path / attempt), str(tmp_path / "audit"), "M", "2024-01-01 00:00:00").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
    assert tables.audit_scan(spark, str(tmp_path / "audit")).agg(F.sum("Total_Records")).first()[0] == rows.count()


def test_scan_code_rules(spark, tmp_path):
    for name, data in {"a/x.PY": b"one\r\ntwo", "a/node_modules/y.py": b"no", "b.txt": b"no", "c.cs": b"", "d.js": b"ok\xff\xfe!", "debug/e.go": b"yes", "Debug/f.go": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.file_path: r.content for r in files.scan_code(spark, str(tmp_path)).collect()}
    assert got == {"a/x.PY": "one\ntwo", "d.js": "ok!", "debug/e.go": "yes"}


def test_key_value_blocks(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a: 1\nb: x:y\nnothing\na: 2\n\n\n\nc : 3\r\n \r\na: 4\n")
    got = [r.asDict() for r in files.scan_kv_blocks(spark, str(tmp_path / "l.txt"), ["a", "b", "c"], whole_files=True).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [{"a": "2", "b": "x:y", "c": None}, {"a": None, "b": None, "c": "3"}, {"a": "4", "b": None, "c": None}]))


def test_json_scan_and_unknown_format(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"LOG_SEQ_NO": 1}, {"LOG_SEQ_NO": 2}]')
    assert files.scan_exceptions(spark, str(tmp_path / "l.json")).count() == 2
    with pytest.raises(ValueError):
        files.scan_exceptions(spark, "x.xlsx")


def test_failing_model_keeps_rows(spark):
    def broken(prompts):
        raise RuntimeError("down")

    got = triage.score_with_callable(spark.createDataFrame([(1, "p")], "i int, p string"), broken, "p").first()
    assert got.raw_answer is None and got.error == "down"


def test_triage_returns_every_exception(spark):
    got = entry.entry(spark)
    ids = got.select("Exception_ID").collect()
    assert len(ids) == len({r[0] for r in ids}) == 1000
    assert got.columns == [*triage.RESULT_COLUMNS, "Classified_Type"]


def test_page_by_key_equals_page_by_offset(spark):
    q = view(spark, SF, "queue").select("review_id")
    first = [r[0] for r in review.review_page(q, 0).collect()]
    assert [r[0] for r in review.review_page_after(q, first[-1]).collect()] == [r[0] for r in review.review_page(q, 1).collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_product_or_single_task(spark):
    msg, exc = view(spark, SF, "msg"), view(spark, SF, "exc")
    for df in [
        neardup.kb_anti_similar(exc, view(spark, SF, "kbmsg")), vectors.kb_topk(q_kb.vector_queries(spark, SF), view(spark, SF, "kbvec")),
        grouping.signature_dedup(msg), review.review_route(view(spark, SF, "results"), "r", "t"), grouping.representatives(exc.withColumn("Dedup_Group_ID", F.col("k").cast("string"))),
    ]:
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan
    assert "WindowGroupLimit" in plan_of(grouping.signature_dedup(msg))


def test_filters_and_columns_reach_the_scan(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice").filter("o_orderpriority = '2-HIGH'").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in plan_of(rows)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
