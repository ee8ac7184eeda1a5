"""The registered queries of this package and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import contamination, imatch, langcrf, linkgraph, lmscore, maintext, mixing, orchard, repair, sharding, simhash, tokenfiles, toxgru
from faultline.llm.common import fold
from faultline.llm.subwords import tokenizer_path
from faultline.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op5_mix(spark, sf_dir):
    mixed = mixing.mix(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source")


@query
def op1_imatch(spark, sf_dir):
    return imatch.fingerprints(_docs(spark, sf_dir).select("doc_id", "text"))


@query
def op2_language(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    field = langcrf.learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = langcrf.identify(spark, docs.select("doc_id", "text"), field)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op3_lm(spark, sf_dir):
    held_out = fold(F.col("doc_id"), 5) == 1
    found = lmscore.score(spark, _docs(spark, sf_dir), ~held_out, tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_token_files(spark, sf_dir):
    path = tokenfiles.write_files(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return tokenfiles.read_files(spark, path, digest_only=True)


CHECKS["op5_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u,
    length(regexp_replace(text, '[^\pL ]', '', 'g')) * 1.0::DOUBLE / greatest(length(text), 1) AS share FROM documents),
k AS (SELECT doc_id, source, size, round(-ln(u) / round(coalesce(1 + 2 * share * share, 1.0), 6), 12) AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM k GROUP BY source),
w AS (SELECT source, total, [3.0, 1.0, 2.0][place + 1]::DOUBLE AS weight, 2 * total AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (1.5 * sum(total) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, total, coalesce(least(cap, (SELECT level FROM v) * weight), cap) AS target FROM w),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, total, target, epochs, target - epochs * total AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
g AS (SELECT source, any_value(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap FROM r GROUP BY source),
x AS (SELECT r.source, arg_min(key, struct_pack(a := abs(size - gap), b := key)) AS extra FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
  WHERE upto > rest AND abs(size - gap) < gap GROUP BY r.source),
c AS (SELECT r.*, CAST(epochs + CASE WHEN upto <= rest AND (rest > 0 OR size = 0 AND upto = 0 AND total > 0) OR key = extra THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM r LEFT JOIN x ON r.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken, source FROM c
"""


@query
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(_docs(spark, sf_dir).select("doc_id", "text"))


@query
def op7_toxicity(spark, sf_dir):
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxgru.learn(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    found = toxgru.score(spark, docs.select("doc_id", "text"), net)
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxgru.THRESHOLD).cast("int").alias("predicted"))


@query
def op8_contamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.contamination(contamination.build_index(_docs(spark, sf_dir)), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        contamination.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


#: Words, windows, occurrences by a join on the whole window, and the words inside any occurrence.
CHECKS["op8_contamination"] = r"""
WITH words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
items AS (
  SELECT DISTINCT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
sized AS (SELECT *, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n),
found AS (SELECT q.doc_id, q.i, q.n, v.item_id FROM places q JOIN windows v ON v.n = q.n AND v.p = array_to_string(q.w[q.i : q.i + q.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op9_shards(spark, sf_dir):
    return sharding.shard(_docs(spark, sf_dir), 8)


@query
def op10_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return maintext.extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query
def op11_host_graph(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return linkgraph.judge(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _fits(host: str, path: str, prefix: str = "") -> str:
    return f"({prefix}host = '{host}' OR ends_with({prefix}host, '.{host}')) AND starts_with({prefix}path, '{path}')"


def _graph_sql() -> str:
    ordered = sorted(linkgraph.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    rule = " ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hidden = linkgraph._HIDDEN.replace("'", "''")
    link = linkgraph._LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(html, '') AS html, {lower.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS said FROM u),
l AS (SELECT row_number() OVER () AS i, host AS source, list_distinct(list_transform(regexp_extract_all(regexp_replace(html, '{hidden}', ' ', 'g'), '{link}', 1),
  lambda x: {lower.format("x")})) AS links FROM u WHERE host <> '' AND html <> ''),
e AS (SELECT source, target, count(*)::DOUBLE AS n FROM (SELECT source, unnest(links) AS target FROM l) WHERE source <> target GROUP BY ALL),
f AS (SELECT source AS a, target AS b, n / sum(n) OVER (PARTITION BY source) AS forth, n / sum(n) OVER (PARTITION BY target) AS back FROM e),
w AS (SELECT a, b, sum(forth) AS forth, sum(back) AS back FROM (SELECT a, b, forth, 0.0 AS back FROM f UNION ALL SELECT b, a, 0.0, back FROM f) GROUP BY ALL),
c AS (SELECT host, path, said, count(*) AS n FROM p WHERE host <> '' GROUP BY ALL
  UNION ALL SELECT host, path, CASE {verdict} END, 1 FROM (SELECT DISTINCT target AS host, '/' AS path FROM e WHERE target NOT IN (SELECT host FROM p))),
s AS (SELECT host, coalesce(sum(n) FILTER (said = 'allow'), 0)::DOUBLE AS t, coalesce(sum(n) FILTER (said = 'block'), 0)::DOUBLE AS d FROM c WHERE said IS NOT NULL GROUP BY host),
r AS (SELECT 0 AS k, host, {1 - linkgraph.DAMPING} * t AS t, {1 - linkgraph.DAMPING} * d AS d FROM s
  UNION ALL SELECT r.k + 1, w.b, {linkgraph.DAMPING} * sum(r.t * w.forth), {linkgraph.DAMPING} * sum(r.d * w.back) FROM r JOIN w ON w.a = r.host
    WHERE r.k < {linkgraph.ROUNDS} GROUP BY r.k, w.b HAVING sum(r.t * w.forth) > 0 OR sum(r.d * w.back) > 0),
h AS (SELECT host, round(sum(d) / (sum(t) + sum(d)), 9) > {linkgraph.THRESHOLD} AS bad FROM r GROUP BY host)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.said, CASE WHEN h.bad THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN h ON h.host = p.host
"""


CHECKS["op11_host_graph"] = _graph_sql()


@query
def op12_repair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair.repair(repair.damage(rows)).withColumnRenamed("conv_id", "_id")
    nothing = F.sha2(F.lit(""), 256)
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    gaps = F.when(F.col("audit").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("gaps")).alias("gaps")
    return every.select("conv_id", gaps, *counts[1:], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


@query
def op13_orchard(spark, sf_dir):
    found = orchard.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _cluster_sql() -> str:
    steps = []
    nearest = """a{0} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m), c := c)) AS x
  FROM p, c{0} GROUP BY rid)"""
    for k in range(orchard.ROUNDS):
        steps.append(nearest.format(k))
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(n.m, c{k}.m) AS m FROM c{k} LEFT JOIN (SELECT c, list(floor(s / n) ORDER BY i) AS m
  FROM (SELECT x.c AS c, i, sum(v[i]) AS s, count(*)::DOUBLE AS n FROM a{k}, range(1, {orchard.DIMENSIONS + 1}) AS g(i) GROUP BY ALL) GROUP BY c) AS n ON n.c = c{k}.c)""")
    steps.append(nearest.format(orchard.ROUNDS))
    last = orchard.ROUNDS
    return f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({orchard.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {orchard.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {orchard.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{orchard.SALT}' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v AS m FROM p QUALIFY c < {orchard.CENTROIDS}),
{(","+chr(10)).join(steps)}
SELECT vec_id, CAST(x.c AS INTEGER) AS cluster, CAST(x.d AS BIGINT) AS distance, CAST(sum(x.d) OVER (PARTITION BY x.c) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON c{last}.c = x.c
"""


CHECKS["op13_orchard"] = _cluster_sql()
