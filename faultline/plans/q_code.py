"""Queries: source chunks, index, frames to code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import embedding
from faultline.operators import code_index, context
from faultline.plans import checksql as q
from faultline.plans.q_text import FRAMES_SQL
from faultline.plans.registry import query
from faultline.plans.standins import sql_view, view, with_views
from faultline.session import cut, saved

INDEXED_AT = "2024-02-01 00:00:00"

_CHUNKS = f"""code AS ({sql_view('code')}),
ln AS (SELECT file_path, file_ord, mtime, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS pos FROM code),
bd AS (SELECT *, CAST(regexp_matches(line, '^{q.SPACE}*(\\}}|end|End Sub|End Function)') AS INT) AS b FROM ln),
sg AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY file_path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM bd),
ps AS (SELECT *, (row_number() OVER (PARTITION BY file_path, seg ORDER BY pos) - 1) // 100 AS piece FROM sg),
cc AS (SELECT file_path, file_ord, mtime, CAST(min(pos) AS INT) AS line_start, CAST(max(pos) AS INT) AS line_end, string_agg(line, chr(10) ORDER BY pos) AS content FROM ps GROUP BY file_path, file_ord, mtime, seg, piece),
ck AS (SELECT file_path, file_ord, mtime, CAST(row_number() OVER (PARTITION BY file_path ORDER BY line_start) - 1 AS INT) AS chunk_index, line_start, line_end, content FROM cc
  WHERE regexp_matches(content, '[^{q.SPACE[1:-1]}]'))
"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return code_index.code_chunks(view(spark, sf, "code"))


@query("code_chunks", "WITH " + _CHUNKS + "SELECT * FROM ck")
def _(spark, sf):
    return chunks(spark, sf)


@query("files_to_index", with_views("code", "manifest") + """SELECT c.file_path, c.mtime FROM code c
WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.file_path = c.file_path AND c.mtime <= m.mtime)""")
def _(spark, sf):
    return code_index.files_to_index(view(spark, sf, "code"), view(spark, sf, "manifest")).select("file_path", "mtime")


@query("index_report", with_views("code", "manifest") + """SELECT count(*) AS total_files_found, count(*) FILTER (m.mtime IS NULL OR c.mtime > m.mtime) AS files_indexed,
count(*) FILTER (m.mtime IS NOT NULL AND c.mtime <= m.mtime) AS files_skipped, count(*) FILTER (c.mtime > m.mtime) AS files_updated, CAST(0 AS BIGINT) AS errors
FROM code c LEFT JOIN manifest m ON m.file_path = c.file_path""")
def _(spark, sf):
    return code_index.index_report(view(spark, sf, "code"), view(spark, sf, "manifest"))


@query("repo_stats", "WITH " + _CHUNKS + f", f AS (SELECT file_path, count(*) AS n FROM ck GROUP BY 1) SELECT count(*) AS indexed_files, CAST(sum(n) AS BIGINT) AS total_chunks, '{INDEXED_AT}' AS last_indexed FROM f")
def _(spark, sf):
    files = view(spark, sf, "code")
    return code_index.repo_stats(code_index.new_manifest(files, code_index.code_chunks(files), INDEXED_AT))


_LOCATED = FRAMES_SQL.rstrip() + ", " + _CHUNKS.rstrip() + """,
fp AS (SELECT DISTINCT file_path AS frame_path FROM uf WHERE coalesce(file_path, '') <> ''),
ff AS (SELECT frame_path, arg_min(code.file_path, code.file_ord) AS file_path FROM fp JOIN code ON contains(lower(code.file_path), lower(replace(frame_path, chr(92), '/'))) GROUP BY 1),
wl AS (SELECT DISTINCT ff.file_path, uf.line_number FROM uf JOIN ff ON ff.frame_path = uf.file_path),
pk AS (SELECT wl.file_path, wl.line_number, coalesce((SELECT min(chunk_index) FROM ck WHERE ck.file_path = wl.file_path AND wl.line_number BETWEEN ck.line_start AND ck.line_end),
  (SELECT min(chunk_index) FROM ck WHERE ck.file_path = wl.file_path)) AS chunk_index FROM wl)
"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return saved(code_index.exploded_frames(view(spark, sf, "exc").select("row_ord", "Exception_ID", "Stack_Trace")))


@query("frame_to_file", _LOCATED + "SELECT * FROM ff")
def _(spark, sf):
    return code_index.frame_to_file(frames(spark, sf), view(spark, sf, "code"))


@query("line_to_chunk", _LOCATED + "SELECT pk.file_path, pk.line_number, pk.chunk_index, ck.line_start, ck.line_end FROM pk JOIN ck ON ck.file_path = pk.file_path AND ck.chunk_index = pk.chunk_index")
def _(spark, sf):
    fr = frames(spark, sf)
    located = fr.withColumnRenamed("file_path", "frame_path").join(code_index.frame_to_file(fr, view(spark, sf, "code")), "frame_path")
    out = code_index.line_to_chunk(located.select("file_path", "line_number"), chunks(spark, sf))
    return out.select("file_path", "line_number", "chunk_index", "line_start", "line_end")


_CHUNK_TEXTS = """cs AS MATERIALIZED (SELECT file_path || '__chunk_' || chunk_index AS id, content AS txt, file_path, chunk_index FROM ck)"""
_CHUNK_VECTORS = _CHUNK_TEXTS + ", " + q.embedded("c", "cs", "c", "(SELECT count(*) FROM cs)")
# distinct traces against all chunks
_SNIP = _LOCATED.rstrip() + ", " + _CHUNK_VECTORS + """,
tr AS MATERIALIZED (SELECT DISTINCT coalesce(Stack_Trace, '') AS id, coalesce(Stack_Trace, '') AS txt FROM exc),
di AS (SELECT CAST(uf.row_ord AS STRING) AS Exception_ID, 0 AS kind, uf.frame_no AS o, pk.file_path, pk.chunk_index, uf.line_number AS target_line FROM uf JOIN ff ON ff.frame_path = uf.file_path JOIN pk ON pk.file_path = ff.file_path AND pk.line_number = uf.line_number),
""" + q.embedded("t", "tr", "c", "(SELECT count(*) FROM cs)") + """,
nd AS (SELECT t.id, t.v, list_dot_product(t.v::DOUBLE[], t.v::DOUBLE[]) AS tt FROM tv t),
ne AS (SELECT id, v, list_dot_product(v::DOUBLE[], v::DOUBLE[]) AS ee FROM cv),
nn AS MATERIALIZED (SELECT q_id, x.d AS d, x.kb_id AS kb_id FROM (SELECT t.id AS q_id,
  min(struct_pack(d := round(greatest(0, tt + ee - 2 * list_dot_product(t.v::DOUBLE[], e.v::DOUBLE[])), 9), kb_id := e.id), 5) AS xs FROM nd t, ne e GROUP BY t.id) y, unnest(xs) AS u(x)),
sm AS (SELECT q_id, kb_id, row_number() OVER (PARTITION BY q_id ORDER BY d, kb_id) AS rank FROM nn),
se AS (SELECT e.Exception_ID, 1 AS kind, sm.rank AS o, cs.file_path, cs.chunk_index, CAST(NULL AS INT) AS target_line FROM exc e JOIN sm ON sm.q_id = coalesce(e.Stack_Trace, '') JOIN cs ON cs.id = sm.kb_id
  LEFT JOIN (SELECT Exception_ID, count(*) AS n FROM di GROUP BY 1) h ON h.Exception_ID = e.Exception_ID WHERE sm.rank <= 5 - coalesce(h.n, 0)),
sn AS (SELECT *, CAST(row_number() OVER (PARTITION BY Exception_ID ORDER BY kind, o) AS INT) AS snippet_no FROM (SELECT * FROM di UNION ALL SELECT * FROM se) x QUALIFY snippet_no <= 5)
"""


def indexed_code(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, embedding.TermEmbedder]:
    """(files, chunks with vectors, embedder fitted on the chunks)."""
    source = view(spark, sf, "code")
    embedder = embedding.TermEmbedder.fit(saved(code_index.code_chunks(source)), "content")
    return source, code_index.indexed(source, embedder), embedder


def _snippets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    source, ch, embedder = indexed_code(spark, sf)
    keyed, found = code_index.retrieved(view(spark, sf, "exc").select("Exception_ID", "Stack_Trace"), source, ch, embedder)
    return keyed.select("Exception_ID", "trace_id"), found


@query("snippets", _SNIP + "SELECT Exception_ID, snippet_no, CASE kind WHEN 0 THEN 'direct' ELSE 'semantic' END AS match_type, file_path, chunk_index, target_line FROM sn")
def _(spark, sf):
    keyed, found = _snippets(spark, sf)
    return keyed.join(found, "trace_id").select("Exception_ID", "snippet_no", "match_type", "file_path", "chunk_index", "target_line")


@query("code_summary", _SNIP + """, sx AS (SELECT sn.*, ck.line_start, ck.line_end FROM sn JOIN ck ON ck.file_path = sn.file_path AND ck.chunk_index = sn.chunk_index)
SELECT Exception_ID, concat_ws(chr(10), 'Analyzed ' || count(*) || ' code file(s):', string_agg('  ' || snippet_no || '. ' || regexp_extract(file_path, '([^/]*)$', 1) || ' (lines ' || line_start || '-' || line_end || ') - '
|| CASE kind WHEN 0 THEN 'direct' ELSE 'semantic' END || ' match', chr(10) ORDER BY snippet_no) FILTER (snippet_no <= 3), CASE WHEN count(*) > 3 THEN '  ... and ' || (count(*) - 3) || ' more' END) AS summary FROM sx GROUP BY 1""")
def _(spark, sf):
    keyed, found = _snippets(spark, sf)
    summary = context.code_summary(found.withColumnRenamed("trace_id", "Exception_ID")).withColumnRenamed("Exception_ID", "trace_id")
    return keyed.join(summary, "trace_id").select("Exception_ID", "summary")


@query("code_embed", "WITH " + _CHUNKS.rstrip() + ", " + _CHUNK_VECTORS + f""" SELECT id AS kb_id, {q.VECTOR_TEXT} AS embedding FROM cv""")
def _(spark, sf):
    return indexed_code(spark, sf)[1].select("kb_id", embedding.vector_text("embedding").alias("embedding"))
