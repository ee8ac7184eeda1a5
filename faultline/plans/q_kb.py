"""Queries: knowledge base and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import embedding, events, scoring
from faultline.functions.text import once
from faultline.operators import context, kb, vectors
from faultline.plans import checksql as q
from faultline.plans.registry import query
from faultline.plans.standins import view, with_views
from faultline.schemas import KB_ALIASES
from faultline.session import cut

NORM_RES = """CASE WHEN regexp_matches(upper(coalesce(Resolution, '')), 'PURGE|DELETE|REMOVE|DISCARD') THEN 'PURGE'
WHEN regexp_matches(upper(coalesce(Resolution, '')), 'REPROCESS|RETRY|RESEND|RE-PROCESS') THEN 'REPROCESS'
WHEN regexp_matches(upper(coalesce(Resolution, '')), 'INVESTIGATE|ESCALATE|REVIEW|ANALYZE|CHECK') THEN 'INVESTIGATE' ELSE 'UNDEFINED' END"""


def _line(label: str, value: str) -> str:
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '{label}: ' || {value} END"


_LABELS = [("Exception Type", "exception_type"), ("Message", "message"), ("Stack Trace", "stack_trace"),
           ("Inner Exception", "inner_exception_type"), ("Inner Message", "inner_exception_message"), ("Error Code", "error_code")]
_PRIMARY = ", ".join(_line(a, b) for a, b in _LABELS)
_DOC = (f"concat_ws(chr(10), '{kb.PRIMARY_HEADING}', {_PRIMARY}, '{kb.SECONDARY_HEADING}', "
        + ", ".join([_line("Resolution", "Resolution"), _line("Root Cause", "Summary"), _line("Action", '"Suggested Step"')]) + ")")
_SIG = (f"md5(concat_ws('|', {q.strip('lower(exception_type)')}, {q.strip('lower(message)')}, {q.strip('lower(stack_trace)')}, "
        + q.strip("upper(coalesce(Resolution, ''))") + ", " + q.strip("lower(coalesce(\"Suggested Step\", ''))") + "))")


def entries_sql(source: str, tag: str) -> str:
    """CTEs `{tag}d` (details), `{tag}c` (candidates), `{tag}k` (first per module and signature)."""
    details = ", ".join(f"{q.detail_or_fallback(n, 'EVENT_INFORMATION')} AS {n}" for n in events.DETAIL_FIELDS)
    parsed = q.parsed(source, "EVENT_INFORMATION", True)
    for name in ("p0", "p1", "p AS"):
        parsed = parsed.replace(name, tag + name)
    return (
        parsed + f", {tag}d AS (SELECT *, {details} FROM {tag}p), "
        f"{tag}c AS (SELECT row_ord, Module AS module, exception_type, message AS exception_message, {NORM_RES} AS resolution, coalesce(Summary, '') AS root_cause, "
        f"coalesce(\"Suggested Step\", '') AS action, stack_trace, inner_exception_type, inner_exception_message, error_code, '' AS process_name, Added_At AS added_at, "
        f"{_DOC} AS document, {_SIG} AS signature FROM {tag}d WHERE coalesce(EVENT_INFORMATION, '') <> '' AND exception_type <> ''), "
        f"{tag}k AS (SELECT * FROM {tag}c QUALIFY row_number() OVER (PARTITION BY module, signature ORDER BY row_ord) = 1)"
    )


_KB = with_views("kbfile").rstrip() + ", " + entries_sql("kbfile", "a") + " "
_KB2 = with_views("kbfile", "kbnew").rstrip() + ", " + entries_sql("kbfile", "a") + ", " + entries_sql("kbnew", "b") + " "


def kbfile(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "kbfile")


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return kb.kb_build(kbfile(spark, sf))


@query("normalize_resolution", with_views("kbfile") + f"SELECT row_ord, {NORM_RES} AS resolution FROM kbfile")
def _(spark, sf):
    return kbfile(spark, sf).select("row_ord", scoring.normalize_resolution("Resolution").alias("resolution"))


@query("kb_normalize", with_views("kbfile") + """SELECT row_ord, EVENT_INFORMATION, CAST(NULL AS STRING) AS Exception_Type, CAST(NULL AS STRING) AS Exception_Message,
Summary AS Root_Cause, Resolution, "Suggested Step" AS Action, CAST(NULL AS STRING) AS Stack_Trace FROM kbfile""")
def _(spark, sf):
    return kb.kb_normalize(kbfile(spark, sf)).select("row_ord", *KB_ALIASES)


@query("kb_document", _KB + "SELECT row_ord, document FROM ac")
def _(spark, sf):
    return kb.kb_candidates(kbfile(spark, sf)).select("row_ord", "document")


@query("kb_signature", _KB + "SELECT row_ord, signature FROM ac")
def _(spark, sf):
    return kb.kb_candidates(kbfile(spark, sf)).select("row_ord", "signature")


_SEARCH = with_views("log").rstrip() + ", " + q.parsed("log", "payload", True) + ", d AS (SELECT event_id, " + ", ".join(
    f"{q.detail_or_fallback(n, 'payload')} AS {n}" for n in events.DETAIL_FIELDS) + " FROM p) "


@query("search_text", _SEARCH + f"SELECT event_id, '{kb.PRIMARY_HEADING}' || chr(10) || concat_ws(chr(10), {_PRIMARY}) AS search_text FROM d WHERE concat_ws('', {_PRIMARY}) <> ''")
def _(spark, sf):
    rows = kb.with_details(view(spark, sf, "log").select("event_id", F.col("payload").alias("EVENT_INFORMATION")))
    return once(rows, "search_text", kb.search_text(F.col("d"))).select("event_id", "search_text").filter(F.col("search_text").isNotNull())


@query("kb_rejects", _KB + """SELECT row_ord, CASE WHEN coalesce(EVENT_INFORMATION, '') = '' THEN 'EVENT_INFORMATION missing' ELSE 'no exception type' END AS reason
FROM ad WHERE coalesce(EVENT_INFORMATION, '') = '' OR exception_type = ''""")
def _(spark, sf):
    return kb.kb_rejects(kbfile(spark, sf)).select("row_ord", "reason")


@query("kb_build", _KB + "SELECT *, module || '_' || row_ord || '_' || substr(signature, 1, 8) AS id FROM ak")
def _(spark, sf):
    return stored(spark, sf)


@query("kb_load_report", _KB + """SELECT t.module, t.total_rows, CAST(coalesce(k.n, 0) AS BIGINT) AS entries, CAST(coalesce(c.n, 0) - coalesce(k.n, 0) AS BIGINT) AS duplicates_removed,
CAST(t.total_rows - coalesce(c.n, 0) AS BIGINT) AS skipped_no_event_info FROM (SELECT Module AS module, count(*) AS total_rows FROM kbfile GROUP BY 1) t
LEFT JOIN (SELECT module, count(*) AS n FROM ac GROUP BY 1) c ON c.module = t.module LEFT JOIN (SELECT module, count(*) AS n FROM ak GROUP BY 1) k ON k.module = t.module""")
def _(spark, sf):
    return kb.kb_load_report(kbfile(spark, sf))


@query("kb_append", _KB2 + """SELECT b.*, b.module || '_append_' || b.signature AS id FROM bk b
WHERE NOT EXISTS (SELECT 1 FROM ak a WHERE a.module = b.module AND a.signature = b.signature)""")
def _(spark, sf):
    return kb.kb_append(stored(spark, sf), view(spark, sf, "kbnew"))


@query("kb_clear", _KB + "SELECT module, signature FROM ak WHERE module <> 'Payment'")
def _(spark, sf):
    return kb.kb_clear(stored(spark, sf), "Payment").select("module", "signature")


@query("kb_export", _KB + """SELECT exception_type AS Exception_Type, exception_message AS Exception_Message, resolution AS Resolution, root_cause AS Root_Cause,
action AS Action, document AS Document FROM ak""")
def _(spark, sf):
    return kb.kb_export(stored(spark, sf))


@query("kb_stats", _KB + "SELECT module AS Module, count(*) AS Entries, count(DISTINCT signature) AS Unique_Patterns, max(added_at) AS Last_Updated FROM ak GROUP BY 1")
def _(spark, sf):
    return kb.kb_stats(stored(spark, sf))


@query("module_list", _KB + "SELECT DISTINCT module FROM (SELECT module FROM ak UNION ALL SELECT 'ClaimGeneration' UNION ALL SELECT 'ClaimPricing') m ORDER BY 1")
def _(spark, sf):
    return kb.module_list(stored(spark, sf))


# --- vectors --------------------------------------------------------------------------------------

def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "paired")
    return p.select("q_id", "module", vectors.blend(F.col("e1"), F.col("e2"), F.col("w")).alias("vec"))


_VEC = with_views("paired", "kbvec").rstrip() + """,
mix AS MATERIALIZED (SELECT q_id, module, list_transform(list_zip(e1, e2), lambda x: w * CAST(x[1] AS DOUBLE) + (1 - w) * CAST(x[2] AS DOUBLE)) AS m FROM paired),
qv AS MATERIALIZED (SELECT q_id, module, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM mix),
kv AS MATERIALIZED (SELECT kb_id, module, CAST(embedding AS DOUBLE[]) AS e FROM kbvec),
dist AS MATERIALIZED (SELECT q.q_id, q.module AS q_module, k.module, k.kb_id, round(greatest(0, list_dot_product(q.v, q.v) + list_dot_product(k.e, k.e) - 2 * list_dot_product(q.v, k.e)), 9) AS d FROM qv q, kv k),
own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, kb_id) AS rnk FROM dist WHERE q_module = module QUALIFY rnk <= 5),
every AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id, module ORDER BY d, kb_id) AS rnk FROM dist QUALIFY rnk <= 5)
"""
_HIT = "q_id, module, kb_id, CAST(rnk AS INT) AS rank, round(d, 6) AS distance, round(greatest(0, 1 - d), 6) AS similarity"


def rounded(hits: DataFrame) -> DataFrame:
    return hits.select("q_id", "module", "kb_id", "rank", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("kb_topk", _VEC + f"SELECT {_HIT} FROM own")
def _(spark, sf):
    return rounded(vectors.kb_topk(vector_queries(spark, sf), view(spark, sf, "kbvec")))


@query("best_match", _VEC + "SELECT q_id, kb_id, round(greatest(0, 1 - d), 6) AS similarity FROM own WHERE rnk = 1")
def _(spark, sf):
    return rounded(vectors.best_match(vectors.kb_topk(vector_queries(spark, sf), view(spark, sf, "kbvec"))).withColumn("rank", F.lit(1))).select("q_id", "kb_id", "similarity")


@query("cross_module", _VEC + f""", cand AS (SELECT q_id, module, greatest(0, 1 - d) AS s, module = q_module AS mine FROM every WHERE rnk = 1),
pick AS (SELECT q_id, module FROM cand WHERE mine OR s > 0 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY mine AND s >= 0.7 DESC, s DESC, mine DESC, module) = 1)
SELECT {_HIT.replace('q_id, module', 'e.q_id, e.module')} FROM every e JOIN pick p ON p.q_id = e.q_id AND p.module = e.module""")
def _(spark, sf):
    return rounded(vectors.cross_module(vector_queries(spark, sf), view(spark, sf, "kbvec")))


@query("code_topk", with_views("paired", "kbvec").rstrip() + _VEC[_VEC.index(",\nmix"):] + """SELECT q_id, kb_id, CAST(rnk AS INT) AS rank, round(d, 6) AS distance, round(greatest(0, 1 - d), 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, kb_id) AS rnk FROM dist) x WHERE rnk <= 10""")
def _(spark, sf):
    chunks = view(spark, sf, "kbvec").select("kb_id", "embedding")
    return rounded(vectors.code_topk(vector_queries(spark, sf), chunks, 10)).drop("module")


def _kb_texts(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).withColumnRenamed("id", "kb_id")


def embedded_kb(spark: SparkSession, sf: str) -> tuple[DataFrame, embedding.TermEmbedder]:
    entries = cut(_kb_texts(spark, sf))
    embedder = embedding.TermEmbedder.fit(entries, "document")
    return embedder.transform(entries, "document", "embedding"), embedder


@query("kb_embed", _KB.rstrip() + """, ke AS MATERIALIZED (SELECT module || '_' || row_ord || '_' || substr(signature, 1, 8) AS id, coalesce(document, '') AS txt, module FROM ak), """
       + q.embedded("k", "ke", "k", "(SELECT count(*) FROM ke)") + f""" SELECT ke.id AS kb_id, module, {q.VECTOR_TEXT} AS embedding FROM kv JOIN ke ON ke.id = kv.id""")
def _(spark, sf):
    return embedded_kb(spark, sf)[0].select("kb_id", "module", embedding.vector_text("embedding").alias("embedding"))


_CASE = ("'Exception Type: Kind' || f.module || chr(10) || 'Stack Trace Match: ' || chr(10) || 'Inner Exception: ' || chr(10) || 'Error Code: ' || f.kb_id || chr(10) || "
         "'Resolution: PURGE' || chr(10) || 'Root Cause: cause' || chr(10) || 'Recommended Action: act'")
_SHARE = "printf('%.1f%%', f.s * 100.0)"


@query("kb_context", _VEC.rstrip() + f""", good AS (SELECT q_id FROM own WHERE rnk = 1 AND greatest(0, 1 - d) >= 0.7),
cand AS (SELECT q_id, module, greatest(0, 1 - d) AS s, module = q_module AS mine FROM every WHERE rnk = 1 AND q_id NOT IN (SELECT q_id FROM good)),
pick AS (SELECT q_id, module FROM cand WHERE mine OR s > 0 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s DESC, mine DESC, module) = 1),
f AS (SELECT q_id, module, kb_id, rnk, greatest(0, 1 - d) AS s FROM own WHERE q_id IN (SELECT q_id FROM good)
  UNION ALL SELECT e.q_id, e.module, e.kb_id, e.rnk, greatest(0, 1 - e.d) FROM every e JOIN pick p ON p.q_id = e.q_id AND p.module = e.module)
SELECT q_id, CASE WHEN max(s) >= 0.7
  THEN 'Found ' || count(*) || ' similar case(s) in knowledge base. Best match (similarity: ' || max(CASE WHEN rnk = 1 THEN {_SHARE} || '):' || chr(10) || {_CASE} END)
  ELSE 'Found ' || count(*) || ' similar case(s) in knowledge base (similarity < 70%):' || chr(10)
    || string_agg('Case ' || rnk || ' (similarity: ' || {_SHARE} || ')' || chr(10) || {_CASE}, chr(10) || chr(10) ORDER BY rnk) END AS kb_context FROM f GROUP BY q_id""")
def _(spark, sf):
    hits = vectors.cross_module(vector_queries(spark, sf), view(spark, sf, "kbvec"))
    facts = view(spark, sf, "kbvec").select(
        "kb_id", F.concat(F.lit("Kind"), "module").alias("exception_type"), F.lit("").alias("stack_trace"), F.lit("").alias("inner_exception_type"),
        F.lit("").alias("inner_exception_message"), F.col("kb_id").cast("string").alias("error_code"), F.lit("PURGE").alias("resolution"), F.lit("cause").alias("root_cause"), F.lit("act").alias("action"),
    )
    return context.kb_context(vector_queries(spark, sf), hits, facts)
