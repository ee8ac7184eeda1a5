"""The pipeline, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import contamination, simhash
from test_operators import SF


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    junk = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "12 34 !!", "en", "src1", 8), (10_003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(junk)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "contamination", "mixing", "shards"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_drops_what_has_none(stages):
    before, after = stages[0]
    assert {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()} == {10_001, 10_002, 10_003}


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    groups = simhash.near_duplicates(before)
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups.collect()}
    assert after.count() == groups.select("component_id").distinct().count() < before.count()


def test_contaminated_documents_go(spark, stages):
    before, after = stages[2]
    bad = contamination.contamination(contamination.build_index(before), spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
    assert after.count() == before.count() - bad.count() and after.join(bad, "doc_id").count() == 0


def test_mixing_and_shards(stages):
    before, after = stages[3]
    words = lambda d: d.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(after) / words(before) - 1.5) < 0.05
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert stages[4][1].count() == after.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_columns_of_any_name_are_kept_by_value(spark):
    names = ["score", "spans", "lang_pred", "size", "source_size", "target", "copies", "_copy", "a.b", "held_out", "component_id", "n_hit", "contaminated", "html"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3))  # repeated rows
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
