"""Queries: text functions, cleaning, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import events, text, traces
from faultline.operators import clean
from faultline.plans import checksql as q
from faultline.plans.registry import query
from faultline.plans.standins import table, view, with_views
from faultline.schemas import REQUIRED_EXCEPTION_COLUMNS

RUN_TS = "2024-02-01 00:00:00"

# every message there is: the documents' texts and the exceptions' messages
_TEXTS = with_views("msg", "exc").rstrip() + """, texts AS (
SELECT 'd' AS src, row_ord, Module, Exception_Type, Exception_Message, Error_Code FROM msg
UNION ALL SELECT 'e' AS src, row_ord, Module, Exception_Type, Exception_Message, Error_Code FROM exc)
"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["row_ord", "Module", "Exception_Type", "Exception_Message", "Error_Code"]
    return view(spark, sf, "msg").select(F.lit("d").alias("src"), *cols).unionByName(view(spark, sf, "exc").select(F.lit("e").alias("src"), *cols))


@query("clean_text", _TEXTS + f"SELECT src, row_ord, trim({q.rx(q.rx('Exception_Message', q.SPACE + '+', ' '), q.CONTROL, '')}) AS cleaned FROM texts")
def _(spark, sf):
    return texts(spark, sf).select("src", "row_ord", text.clean_text("Exception_Message").alias("cleaned"))


@query("message_signature", _TEXTS + f"SELECT src, row_ord, {q.signature('Exception_Message', 'Error_Code')} AS signature FROM texts")
def _(spark, sf):
    return texts(spark, sf).select("src", "row_ord", text.message_signature("Exception_Message", "Error_Code").alias("signature"))


@query("normalize_message", _TEXTS + f"SELECT src, row_ord, {q.normalized('Exception_Message')} AS normalized FROM texts")
def _(spark, sf):
    return texts(spark, sf).select("src", "row_ord", text.normalize_message("Exception_Message").alias("normalized"))


@query("dedup_signature", _TEXTS + f"SELECT src, row_ord, {q.compare_signature('Exception_Type', 'Exception_Message', 'Error_Code')} AS sig FROM texts")
def _(spark, sf):
    sig = text.dedup_signature("Exception_Type", text.normalize_message("Exception_Message"), "Error_Code")
    return texts(spark, sf).select("src", "row_ord", sig.alias("sig"))


@query("exception_id", _TEXTS + "SELECT src, row_ord, 'EX_' || substr(md5(Module || coalesce(Exception_Type, '') || Exception_Message), 1, 12) AS exception_id FROM texts")
def _(spark, sf):
    return texts(spark, sf).select("src", "row_ord", text.exception_id("Module", "Exception_Type", "Exception_Message").alias("exception_id"))


_IND = r"(?i)(ORA-\p{Nd}+|ERROR[:\t-\r\x1c-\x20\x{85}\p{Z}]*\p{Nd}+|Code[:\t-\r\x1c-\x20\x{85}\p{Z}]*\p{Nd}+)"


@query("error_indicators", _TEXTS + f"SELECT src, row_ord, nullif(array_to_string(regexp_extract_all(Exception_Message, '{_IND}', 1)[1:3], ', '), '') AS indicators FROM texts")
def _(spark, sf):
    return texts(spark, sf).select("src", "row_ord", text.error_indicators("Exception_Message").alias("indicators"))


@query("issue_flags", _TEXTS + """SELECT src, row_ord, contains(lower(Exception_Message), 'constraint') OR contains(lower(Exception_Message), 'violated') AS is_constraint,
contains(lower(Exception_Message), 'null') OR contains(lower(Exception_Message), 'no elements') AS is_null FROM texts""")
def _(spark, sf):
    return texts(spark, sf).select("src", "row_ord", text.is_constraint_violation("Exception_Message").alias("is_constraint"), text.is_null_issue("Exception_Message").alias("is_null"))


@query("module_from_title", with_views("log") + """SELECT event_id, CASE WHEN title IS NULL THEN 'Unknown'
WHEN contains(lower(title), 'claim') OR contains(lower(title), 'billing') THEN 'ClaimGeneration' WHEN contains(lower(title), 'auth') THEN 'Authentication'
WHEN contains(lower(title), 'payment') THEN 'Payment' WHEN contains(lower(title), 'database') OR contains(lower(title), 'db') THEN 'Database'
WHEN contains(lower(title), 'api') OR contains(lower(title), 'service') THEN 'API' ELSE 'General' END AS module FROM log""")
def _(spark, sf):
    return view(spark, sf, "log").select("event_id", text.module_from_title("title").alias("module"))


_SEG = "list_filter(string_split(lower(proc), chr(92)), lambda s: len(s) > 3 AND NOT contains(s, 'windows'))[1]"
_TITLE = f"array_to_string(list_transform(regexp_extract_all({_SEG}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda r: upper(r[1]) || r[2:]), '')"


@query("module_from_process", with_views("log") + f"""SELECT event_id, CASE WHEN contains(lower(proc), 'claimgeneration') THEN 'ClaimGeneration'
WHEN contains(lower(proc), 'auth') THEN 'Authentication' WHEN contains(lower(proc), 'payment') THEN 'Payment' WHEN contains(lower(proc), 'billing') THEN 'Billing'
WHEN {_SEG} IS NULL THEN 'General' ELSE {_TITLE} END AS module FROM log""")
def _(spark, sf):
    return view(spark, sf, "log").select("event_id", text.module_from_process("proc").alias("module"))


@query("short_label", with_views("exc") + """SELECT row_ord, CASE WHEN coalesce(Exception_Type, '') = '' THEN 'Unknown'
WHEN contains(Exception_Type, '.') THEN string_split(Exception_Type, '.')[-1] ELSE string_split(Exception_Type, ' ')[-1] END AS label FROM exc""")
def _(spark, sf):
    return view(spark, sf, "exc").select("row_ord", text.short_label("Exception_Type").alias("label"))


@query("percent_text", with_views("answers") + "SELECT row_ord, printf('%.1f%%', kb_similarity * 100.0) AS pct FROM answers")
def _(spark, sf):
    return view(spark, sf, "answers").select("row_ord", text.percent_text("kb_similarity").alias("pct"))


# --- payloads -------------------------------------------------------------------------------------

_INNER_OK = "ok AND json_type(j, '$.Exception.InnerException') = 'OBJECT' AND len(json_keys(j, '$.Exception.InnerException')) > 0"
_FLAT = {
    "Exception_Type": f"CASE WHEN ok THEN coalesce({q.js('j', 'Exception', 'Exception Type')}, 'Unknown') ELSE 'ParseError' END",
    "Exception_Message": f"CASE WHEN ok THEN coalesce({q.js('j', 'Exception', 'Message')}, '') ELSE coalesce(payload, '') END",
    "Stack_Trace": f"CASE WHEN ok THEN coalesce({q.js('j', 'Exception', 'StackTrace')}, '') ELSE '' END",
    "Inner_Exception": f"CASE WHEN {_INNER_OK} THEN coalesce({q.js('j', 'Exception', 'InnerException', 'Exception Type')}, '') || ': ' || coalesce({q.js('j', 'Exception', 'InnerException', 'Message')}, '') ELSE '' END",
    "Error_Code": f"CASE WHEN {_INNER_OK} THEN {q.CODE} ELSE '' END",
}
_FLAT_SQL = ", ".join(f"{e} AS {n}" for n, e in _FLAT.items())
_DETAILS_SQL = ", ".join(f"{q.detail(n)} AS d_{n}" for n in events.DETAIL_FIELDS)


@query("flatten_event", with_views("log").rstrip() + ", " + q.parsed("log", "payload", False) + f" SELECT event_id, {_FLAT_SQL}, {_DETAILS_SQL} FROM p")
def _(spark, sf):
    rows = events.with_payload(view(spark, sf, "log").select("event_id", "payload"), "payload")
    v = F.col("_v")
    return rows.withColumns(events.flat_columns("payload", v)).select(
        "event_id", *_FLAT, *[c.alias(f"d_{n}") for n, c in events.details(v).items()]
    )


@query("first_of_keys", with_views("log").rstrip() + ", " + q.parsed("log", "payload", False) + " SELECT event_id, coalesce(" + ", ".join(
    f"nullif({q.strip(q.js('j', k))}, '')" for k in ("Process Name", "PRCS_NAME", "process_name", "ProcessName")) + ", 'Unknown') AS process_name FROM p")
def _(spark, sf):
    rows = events.with_payload(view(spark, sf, "log").select("event_id", "payload"), "payload")
    return rows.select("event_id", events.first_of_keys(F.col("_v")).alias("process_name"))


@query("json_repair", with_views("log").rstrip() + ", " + q.parsed("log", "payload", True) + f" SELECT event_id, j IS NOT NULL AS readable, {q.js('j', 'Exception', 'Exception Type')} AS exception_type FROM p")
def _(spark, sf):
    rows = events.with_payload(view(spark, sf, "log").select("event_id", "payload"), "payload", repair=True)
    return rows.select("event_id", F.col("_v").isNotNull().alias("readable"), events.field(F.col("_v"), "Exception", "Exception Type").alias("exception_type"))


@query("json_regex_fallback", with_views("log") + "SELECT event_id, " + ", ".join(f"{q.fallback(n, 'payload')} AS {n}" for n in events.DETAIL_FIELDS) + " FROM log")
def _(spark, sf):
    return view(spark, sf, "log").select("event_id", *[c.alias(n) for n, c in events.fallback_details("payload").items()])


# --- cleaning -------------------------------------------------------------------------------------

def raw_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log as an uploaded file would hold it; blanks in a column name are part of the test."""
    return view(spark, sf, "log").select(
        F.col("event_id").alias("LOG_SEQ_NO"), F.col("payload").alias("EVENT_INFORMATION"), F.col("sev").alias("SEVERITY"),
        F.col("machine").alias(" MACHINE_NAME "), F.col("proc").alias("PRCS_NAME"), F.col("logtime").alias("LOGTIME"),
    )


_PNAME = "CASE WHEN ok THEN coalesce(" + ", ".join(f"nullif({q.strip(q.js('j', k))}, '')" for k in ("Process Name", "PRCS_NAME", "process_name", "ProcessName")) + ", 'Unknown') ELSE 'Unknown' END"
_MODULE = f"""CASE WHEN contains(lower(proc), 'claimgeneration') THEN 'ClaimGeneration' WHEN contains(lower(proc), 'auth') THEN 'Authentication'
WHEN contains(lower(proc), 'payment') THEN 'Payment' WHEN contains(lower(proc), 'billing') THEN 'Billing' WHEN {_SEG} IS NULL THEN 'General' ELSE {_TITLE} END"""


@query("clean_exceptions", with_views("log").rstrip() + ", " + q.parsed("log", "payload", False) + f""" SELECT DISTINCT event_id AS LOG_SEQ_NO, payload AS EVENT_INFORMATION, sev AS SEVERITY,
machine AS MACHINE_NAME, proc AS PRCS_NAME, logtime AS LOGTIME, {_FLAT_SQL}, {_PNAME} AS Process_Name, CAST(event_id AS STRING) AS Exception_ID, logtime AS Timestamp, {_MODULE} AS Module FROM p""")
def _(spark, sf):
    doubled = raw_log(spark, sf).unionByName(raw_log(spark, sf))
    return clean.clean_exceptions(doubled, RUN_TS)


@query("distinct_rows", "SELECT DISTINCT event_type, user_id, props FROM events")
def _(spark, sf):
    return clean.distinct_rows(table(spark, sf, "events"), ["event_type", "user_id", "props"])


@query("features", with_views("exc") + f"""SELECT Exception_ID AS exception_id, Module AS module, Exception_Type AS exception_type, Exception_Message AS message, SEVERITY AS severity,
CAST(PRIORITY AS STRING) AS priority, CAST(1 AS BIGINT) AS frequency, MACHINE_NAME AS machine_name, Process_Name AS process_name, Timestamp AS timestamp, Error_Code AS error_code,
Stack_Trace AS stack_trace, Inner_Exception AS inner_exception, nullif(array_to_string(regexp_extract_all(Exception_Message, '{_IND}', 1)[1:3], ', '), '') AS error_indicators,
CASE WHEN contains(lower(Exception_Message), 'constraint') OR contains(lower(Exception_Message), 'violated') THEN true END AS is_constraint_violation,
CASE WHEN contains(lower(Exception_Message), 'null') OR contains(lower(Exception_Message), 'no elements') THEN true END AS is_null_issue FROM exc""")
def _(spark, sf):
    return clean.features(view(spark, sf, "exc")).select("Features.*")


@query("full_error", with_views("exc") + """, parts AS (SELECT row_ord, Exception_Message AS m, concat_ws(' | ', CASE WHEN Inner_Type <> '' THEN 'Inner Exception: ' || Inner_Type END,
CASE WHEN Inner_Message <> '' THEN 'Inner Message: ' || Inner_Message END, CASE WHEN Error_Code <> '' THEN 'Error Code: ' || Error_Code END) AS i FROM exc)
SELECT row_ord, CASE WHEN m = '' AND i = '' THEN '' WHEN i = '' THEN m WHEN m = '' THEN ' | ' || i ELSE m || '  | ' || i END AS original_error FROM parts""")
def _(spark, sf):
    e = view(spark, sf, "exc")
    c = clean.full_error(F.col("Exception_Message"), F.col("Inner_Type"), F.col("Inner_Message"), F.col("Error_Code"), F.col("Exception_Message"))
    return e.select("row_ord", c.alias("original_error"))


@query("schema_check", with_views("log") + "SELECT count(*) AS n_rows, 'SEVERITY' AS missing_columns, false AS valid FROM log")
def _(spark, sf):
    return clean.schema_check(raw_log(spark, sf).drop("SEVERITY"), REQUIRED_EXCEPTION_COLUMNS)


@query("enum_check", with_views("results") + """SELECT field, bad_value, count(*) AS n_rows FROM (SELECT 'Resolution' AS field, Resolution AS bad_value FROM results
WHERE Resolution NOT IN ('PURGE', 'REPROCESS', 'INVESTIGATE', 'UNDEFINED') UNION ALL SELECT 'Severity', Severity FROM results WHERE Severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')) t GROUP BY ALL""")
def _(spark, sf):
    return clean.enum_check(view(spark, sf, "results"))


@query("preview", with_views("log") + "SELECT event_id, payload, sev FROM log ORDER BY event_id LIMIT 10")
def _(spark, sf):
    return view(spark, sf, "log").select("event_id", "payload", "sev").orderBy("event_id").limit(10)


# --- traces ---------------------------------------------------------------------------------------

_W, _S, _L, _N = q.WORD, q.SPACE, r"\p{L}\p{N}_", r"\p{Nd}"
_FORMATS = [
    ("csharp", rf"at{_S}+([{_L}.]+)\.([{_L}<>]+)\([^)]*\){_S}+in{_S}+((?:[A-Za-z]:)?[^:]+):line{_S}+({_N}+)", 3, 4, 2, 1, None),
    ("python", rf'File{_S}+"([^"]+)",{_S}+line{_S}+({_N}+),{_S}+in{_S}+([{_L}]+)', 1, 2, 3, None, None),
    ("java", rf"at{_S}+([{_L}.]+)\.([{_L}]+)\(([{_L}.]+):({_N}+)\)", 3, 4, 2, None, 1),
    ("javascript", rf"at{_S}+([{_L}]+){_S}+\(((?:[A-Za-z]:)?[^:]+):({_N}+):({_N}+)\)", 2, 3, 1, None, None),
    ("generic", r"(?i)([A-Za-z]:[^\t-\r\x1c-\x20\x{85}\p{Z}:()]+\.(?:cs|py|java|js|ts|cpp|c|h|vb|php|rb|go))\(?:(" + _N + r"+)\)?", 1, 2, None, None, None),
]


def _format_sql(i: int, name: str, p: str, f, ln, m, ns, pkg) -> str:
    def g(n):
        return "CAST(NULL AS STRING)" if n is None else f"unnest(regexp_extract_all(Stack_Trace, '{p}', {n}))"

    return (f"SELECT row_ord, {i} AS fmt, unnest(range(len(regexp_extract_all(Stack_Trace, '{p}')))) AS pos, {g(f)} AS file_path, {g(ln)} AS line_text, "
            f"{g(m)} AS method_name, {g(ns)} AS namespace, {g(pkg)} AS package, '{name}' AS language FROM exc")


FRAMES_SQL = with_views("exc").rstrip() + ", fr AS (" + " UNION ALL ".join(_format_sql(i, *f) for i, f in enumerate(_FORMATS)) + """),
frames AS (SELECT row_ord, CAST(row_number() OVER (PARTITION BY row_ord ORDER BY fmt, pos) - 1 AS INT) AS frame_no, file_path, CAST(line_text AS INT) AS line_number, method_name, namespace, package, language FROM fr),
uf AS (SELECT row_ord, CAST(row_number() OVER (PARTITION BY row_ord ORDER BY frame_no) - 1 AS INT) AS frame_no, file_path, line_number, method_name, namespace, package, language
  FROM (SELECT *, row_number() OVER (PARTITION BY row_ord, file_path, line_number ORDER BY frame_no) AS dup FROM frames) d WHERE dup = 1)
"""


def _frames(spark, sf, unique: bool) -> DataFrame:
    f = traces.stack_frames("Stack_Trace")
    e = view(spark, sf, "exc").select("row_ord", "Stack_Trace")
    return text.unroll(e, ["row_ord"], traces.unique_frames(f) if unique else f, "frame_no", "f").select("row_ord", "frame_no", "f.*")


@query("stack_frames", FRAMES_SQL + "SELECT * FROM frames")
def _(spark, sf):
    return _frames(spark, sf, False)


@query("unique_frames", FRAMES_SQL + "SELECT * FROM uf")
def _(spark, sf):
    return _frames(spark, sf, True)


@query("primary_frame", FRAMES_SQL + """SELECT e.row_ord, p.file_path, p.line_number, p.method_name, p.language, coalesce(r.n_related, 0) AS n_related, r.related
FROM exc e LEFT JOIN (SELECT * FROM uf WHERE frame_no = 0) p ON p.row_ord = e.row_ord
LEFT JOIN (SELECT row_ord, CAST(count(*) AS INT) AS n_related, string_agg(file_path || ':' || line_number, ';' ORDER BY frame_no) AS related FROM uf WHERE frame_no BETWEEN 1 AND 3 GROUP BY row_ord) r ON r.row_ord = e.row_ord""")
def _(spark, sf):
    e = view(spark, sf, "exc").withColumn("f", traces.unique_frames(traces.stack_frames("Stack_Trace")))
    e = e.withColumn("c", traces.error_context("Exception_Type", "Exception_Message", "Inner_Type", "f"))
    rel = F.col("c.related_locations")
    listed = F.array_join(F.transform(rel, lambda x: F.concat(x["file_path"], F.lit(":"), x["line_number"].cast("string"))), ";")
    return e.select("row_ord", "c.primary_location.file_path", "c.primary_location.line_number", "c.primary_location.method_name", "c.primary_location.language",
                    F.size(rel).alias("n_related"), F.nullif(listed, F.lit("")).alias("related"))


@query("trace_files", FRAMES_SQL + "SELECT DISTINCT row_ord, file_path FROM uf WHERE file_path <> ''")
def _(spark, sf):
    f = traces.unique_frames(traces.stack_frames("Stack_Trace"))
    files = F.array_distinct(F.filter(F.transform(f, lambda x: x["file_path"]), lambda p: p != ""))
    return text.unroll(view(spark, sf, "exc"), ["row_ord"], files, "at", "file_path").drop("at")


_LINES = FRAMES_SQL.rstrip() + f""",
li AS (SELECT row_ord, unnest(string_split(Stack_Trace, chr(10))) AS line, unnest(range(1, len(string_split(Stack_Trace, chr(10))) + 1)) AS pos FROM exc),
ls AS (SELECT row_ord, pos, {q.strip('line')} AS s FROM li),
lk AS (SELECT *, CASE WHEN contains(s, ': ') AND contains(split_part(s, ': ', 1), 'Exception') THEN 1 WHEN suffix(s, 'Error') OR suffix(s, 'Exception') THEN 2 END AS kind FROM ls WHERE pos <= 5),
lf AS (SELECT row_ord, min(pos) AS pos FROM lk WHERE kind IS NOT NULL GROUP BY row_ord),
hd AS (SELECT e.row_ord, CASE k.kind WHEN 1 THEN {q.strip("split_part(k.s, ': ', 1)")} WHEN 2 THEN k.s END AS exception_type,
  CASE k.kind WHEN 1 THEN {q.strip("substr(k.s, strpos(k.s, ': ') + 2)")} WHEN 2 THEN CASE WHEN n.s <> '' AND NOT starts_with(n.s, 'at ') AND NOT starts_with(n.s, 'File ') THEN n.s END END AS error_message
  FROM exc e LEFT JOIN lf ON lf.row_ord = e.row_ord LEFT JOIN lk k ON k.row_ord = e.row_ord AND k.pos = lf.pos LEFT JOIN ls n ON n.row_ord = e.row_ord AND n.pos = lf.pos + 1)
"""


@query("trace_header", _LINES + "SELECT * FROM hd")
def _(spark, sf):
    return view(spark, sf, "exc").select("row_ord", traces.trace_header("Stack_Trace").alias("h")).select("row_ord", "h.*")


@query("retrieval_query", _LINES + """, w AS (SELECT row_ord, string_agg(concat_ws(' ', nullif(method_name, ''), nullif(namespace, '')), ' ' ORDER BY frame_no) AS words FROM uf
WHERE frame_no < 3 AND (coalesce(method_name, '') <> '' OR coalesce(namespace, '') <> '') GROUP BY row_ord)
SELECT hd.row_ord, concat_ws(' ', nullif(exception_type, ''), nullif(error_message, ''), w.words) AS query FROM hd LEFT JOIN w ON w.row_ord = hd.row_ord""")
def _(spark, sf):
    e = view(spark, sf, "exc").select("row_ord", traces.unique_frames(traces.stack_frames("Stack_Trace")).alias("f"), traces.trace_header("Stack_Trace").alias("h"))
    return e.select("row_ord", traces.retrieval_query("f", "h").alias("query"))


# whole words only: both ends of every term pattern are word boundaries
_WORDS = f"regexp_extract_all(Exception_Message, '{q.WORD}+')"
_TERM_SQL = [
    "[A-Z][a-z]+(?:[A-Z][a-z]+)+", "[a-z]+_[a-z_]+", "[A-Z]{2,}", f"{q.WORD}+Exception", f"{q.WORD}+Error",
]
_ALL_TERMS = "list_filter(flatten([" + ", ".join(f"list_filter({_WORDS}, lambda x: regexp_full_match(x, '{p}'))" for p in _TERM_SQL) + "]), lambda x: len(x) > 3)"


def _terms_sql(source: str) -> str:
    return f"(SELECT *, list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i) AS terms FROM (SELECT *, {_ALL_TERMS} AS t FROM {source}) a)"


@query("technical_terms", _TEXTS + f"SELECT src, row_ord, array_to_string(terms, ' ') AS terms FROM {_terms_sql('texts')} b")
def _(spark, sf):
    return texts(spark, sf).select("src", "row_ord", F.array_join(text.technical_terms("Exception_Message"), " ").alias("terms"))


_SQ = f"""concat_ws(' ', nullif(Exception_Type, ''), nullif(p.method_name, ''), CASE WHEN contains(p.namespace, '.') THEN string_split(p.namespace, '.')[-1] END,
nullif(array_to_string(terms[1:3], ' '), ''), nullif(Inner_Type, ''))"""
_ES = r"substr(md5(concat_ws('|', coalesce(Exception_Type, ''), CASE WHEN p.file_path <> '' THEN regexp_extract(p.file_path, '([^\\/]*)$', 1) END, nullif(p.method_name, ''))), 1, 16)"
_CTX = FRAMES_SQL.rstrip() + f""", tm AS {_terms_sql('exc')}, cx AS (SELECT tm.row_ord, {_SQ} AS search_query, {_ES} AS error_signature, p.language, p.file_path AS primary_file,
CAST(coalesce(c.n, 0) AS INT) AS total_frames FROM tm LEFT JOIN (SELECT * FROM uf WHERE frame_no = 0) p ON p.row_ord = tm.row_ord LEFT JOIN (SELECT row_ord, count(*) AS n FROM uf GROUP BY row_ord) c ON c.row_ord = tm.row_ord)
"""


def _context(spark, sf) -> DataFrame:
    e = view(spark, sf, "exc").withColumn("f", traces.unique_frames(traces.stack_frames("Stack_Trace")))
    return e.select("row_ord", traces.error_context("Exception_Type", "Exception_Message", "Inner_Type", "f").alias("c"))


@query("search_query", _CTX + "SELECT row_ord, search_query FROM cx")
def _(spark, sf):
    return _context(spark, sf).select("row_ord", "c.search_query")


@query("error_signature", _CTX + "SELECT row_ord, error_signature FROM cx")
def _(spark, sf):
    return _context(spark, sf).select("row_ord", "c.error_signature")


@query("error_context", _CTX + "SELECT * FROM cx")
def _(spark, sf):
    return _context(spark, sf).select("row_ord", "c.search_query", "c.error_signature", "c.language", F.col("c.primary_location.file_path").alias("primary_file"), "c.total_frames")
