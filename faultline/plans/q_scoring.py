"""Queries: answer validation, merge, confidences, result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import events, scoring
from faultline.operators import clean, context
from faultline.plans import checksql as q
from faultline.plans.registry import query
from faultline.plans.standins import table, view, with_views
from faultline.plans.triage import result_columns

_KEPT = "replace(upper(said), '|', ' ')"
for _w in ("THE", "MESSAGE", "TO", "DEV", "TEAM", "FOR", "ANALYSIS"):
    _KEPT = f"replace({_KEPT}, '{_w}', '')"
_INT = (f"CASE WHEN json_type(j, '$.K') = 'VARCHAR' THEN CASE WHEN regexp_full_match({q.strip(q.js('j', 'K'))}, '[+-]?[0-9]+') THEN CAST({q.strip(q.js('j', 'K'))} AS INT) ELSE 65 END "
        f"WHEN json_type(j, '$.K') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(trunc(CAST({q.js('j', 'K')} AS DOUBLE)) AS INT) ELSE 65 END")
_CONF = f"CASE WHEN {q.js('j', 'Confidence')} IS NOT NULL THEN {_INT.replace('K', 'Confidence')} ELSE {_INT.replace('K', 'confidence')} END"


def _either(a: str, b: str, default: str) -> str:
    return f"coalesce(nullif(coalesce({q.js('j', a)}, {q.js('j', b)}), ''), '{default}')"


def checked_sql(kb: str) -> str:
    """CTEs over `answers`: `v` = checked answers, with `kb` as the knowledge-base resolution."""
    return f"""a0 AS (SELECT *, {kb} AS kb, CASE WHEN json_valid(raw_answer) AND json_type(raw_answer) = 'OBJECT' THEN raw_answer END AS j FROM answers),
a1 AS (SELECT *, coalesce({q.js('j', 'Resolution')}, {q.js('j', 'resolution')}, '') AS said, {_CONF} AS stated FROM a0),
a2 AS (SELECT *, CASE WHEN contains({q.strip('upper(said)')}, '|') OR contains({q.strip('upper(said)')}, ' ')
  THEN list_filter(regexp_extract_all({_KEPT}, '[^ ]+'), lambda w: w IN ('PURGE', 'REPROCESS', 'INVESTIGATE', 'ESCALATE'))[1] ELSE {q.strip('upper(said)')} END AS one FROM a1),
a3 AS (SELECT *, CASE WHEN one = 'ESCALATE' THEN 'INVESTIGATE' WHEN one IN ('PURGE', 'REPROCESS', 'INVESTIGATE') THEN one ELSE 'UNDEFINED' END AS model_res,
  coalesce(kb IN ('PURGE', 'REPROCESS', 'INVESTIGATE'), false) AS over FROM a2),
v AS (SELECT row_ord, k, user_id, Exception_Type, kb_resolution, kb_similarity, kb_root_cause, kb_action, j IS NOT NULL AS valid,
  CASE WHEN j IS NULL THEN coalesce(nullif(kb, ''), 'UNDEFINED') WHEN over THEN kb ELSE model_res END AS resolution,
  CASE WHEN j IS NULL THEN 65 WHEN over THEN greatest(stated, CASE WHEN kb_similarity >= 0.95 THEN 90 WHEN kb_similarity >= 0.85 THEN 80 WHEN kb_similarity >= 0.7 THEN 70 ELSE stated END) ELSE stated END AS confidence,
  CASE WHEN j IS NULL THEN 'Not provided' ELSE {_either('Root_Cause', 'root_cause', 'Not provided')} END AS root_cause,
  CASE WHEN j IS NULL THEN 'Not provided' ELSE {_either('Reasoning', 'reasoning', 'Not provided')} END AS reasoning,
  CASE WHEN j IS NULL THEN 'Not provided' ELSE {_either('Suggested_Action', 'suggested_action', 'Not provided')} END AS suggested_action,
  CASE WHEN j IS NULL THEN 'None identified' ELSE {_either('Similar_Patterns', 'similar_patterns', 'None identified')} END AS similar_patterns FROM a3)"""


_USABLE = "CASE WHEN kb_similarity >= 0.7 AND kb_resolution IN ('PURGE', 'REPROCESS', 'INVESTIGATE') THEN kb_resolution END"
_A = with_views("answers").rstrip() + ", "
MERGED = _A + checked_sql(_USABLE) + f""",
m0 AS (SELECT *, {_USABLE} AS usable, CASE WHEN kb_similarity >= 0.7 THEN kb_root_cause ELSE '' END AS kc, CASE WHEN kb_similarity >= 0.7 THEN kb_action ELSE '' END AS ka FROM v),
m AS (SELECT row_ord, k, user_id, kb_similarity, resolution, confidence,
  CASE WHEN kc <> '' THEN CASE WHEN contains(kc, chr(10)) AND contains(kc, 'Explanation:') AND contains(kc, 'Action:') THEN kc
      WHEN contains(root_cause, chr(10)) AND contains(root_cause, 'Summary:') AND contains(root_cause, 'Action:') AND len(root_cause) > len(kc) THEN root_cause ELSE kc END
    ELSE root_cause END AS root_cause,
  CASE WHEN usable IS NOT NULL THEN 'KB Match (similarity: ' || printf('%.1f%%', kb_similarity * 100.0) || ')' ELSE reasoning END AS reasoning,
  CASE WHEN ka <> '' THEN ka WHEN suggested_action <> 'Not provided' THEN suggested_action
    WHEN resolution = 'PURGE' THEN 'Message Can be purged' WHEN resolution = 'REPROCESS' THEN 'Reprocess the message with corrected data'
    WHEN resolution = 'INVESTIGATE' THEN 'Escalate to dev team for investigation' ELSE 'Review and determine appropriate action' END AS suggested_action FROM m0)
"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "answers").withColumn("_v", events.strict_json(F.col("raw_answer")))


@query("validate_answer", _A + checked_sql("kb_resolution") + " SELECT row_ord, resolution, root_cause, reasoning, suggested_action, confidence, similar_patterns, valid FROM v")
def _(spark, sf):
    a = answers(spark, sf).withColumn("a", scoring.validated(F.col("_v"), "kb_resolution", "kb_similarity"))
    return a.select("row_ord", "a.*")


@query("kb_override", _A + checked_sql("kb_resolution") + " SELECT row_ord, resolution, confidence FROM v")
def _(spark, sf):
    a = answers(spark, sf).withColumn("a", scoring.validated(F.col("_v"), "kb_resolution", "kb_similarity"))
    return a.select("row_ord", "a.resolution", "a.confidence")


@query("validate_code_answer", _A + f"""a0 AS (SELECT *, CASE WHEN json_valid(raw_answer) AND starts_with(raw_answer, '{{') THEN raw_answer END AS j FROM answers)
SELECT row_ord, coalesce({q.js('j', 'Code_Issue_Found')}, 'Unknown') AS code_issue_found, coalesce({q.js('j', 'Affected_Code_File')}, 'Unknown') AS affected_code_file,
coalesce({q.js('j', 'Suggested_Fix')}, 'Not provided') AS suggested_fix FROM a0""")
def _(spark, sf):
    return answers(spark, sf).select("row_ord", *[c.alias(n) for n, c in scoring.code_fields("raw_answer", F.col("_v")).items()])


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    usable = scoring.kb_usable("kb_similarity", "kb_resolution")
    a = answers(spark, sf).withColumn("a", scoring.validated(F.col("_v"), usable, "kb_similarity"))
    m = scoring.merged(F.col("a"), F.col("kb_resolution"), F.col("kb_root_cause"), F.col("kb_action"), F.col("kb_similarity"))
    return a.select("row_ord", *[c.alias(n) for n, c in m.items()])


@query("merge_analysis", MERGED + "SELECT row_ord, resolution, root_cause, reasoning, suggested_action FROM m")
def _(spark, sf):
    return _merged(spark, sf)


@query("coherence", MERGED + """SELECT row_ord, contains(lower(root_cause), 'purge') AND resolution <> 'PURGE' AS coherence_purge,
contains(lower(root_cause), 'reprocess') AND resolution <> 'REPROCESS' AS coherence_reprocess FROM m""")
def _(spark, sf):
    return _merged(spark, sf).select("row_ord", *[c.alias(n) for n, c in scoring.coherence("root_cause", "resolution").items()])


def kb_conf_sql(s: str) -> str:
    return (f"CASE WHEN {s} IS NULL THEN 0 WHEN {s} > 0.95 THEN 95 WHEN {s} > 0.9 THEN 88 WHEN {s} > 0.85 THEN 78 WHEN {s} > 0.8 THEN 68 WHEN {s} > 0.75 THEN 58 "
            f"ELSE CAST(trunc({s} * 60) AS INT) END")


def blend_sql(m: str, k: str, has: str) -> str:
    return f"CAST(trunc(CASE WHEN {has} THEN {m} * 0.4e0 + {k} * 0.6e0 ELSE {m} * 0.8e0 + {k} * 0.2e0 END) AS INT)"


@query("kb_confidence", with_views("answers") + f"SELECT row_ord, {kb_conf_sql('kb_similarity')} AS kb_confidence FROM answers")
def _(spark, sf):
    return view(spark, sf, "answers").select("row_ord", scoring.kb_confidence("kb_similarity").alias("kb_confidence"))


@query("blended_confidence", with_views("answers") + f"SELECT row_ord, {blend_sql('(user_id % 101)', '(k % 96)', 'k % 3 <> 0')} AS confidence FROM answers")
def _(spark, sf):
    a = view(spark, sf, "answers")
    return a.select("row_ord", scoring.blended_confidence(F.col("user_id") % 101, F.col("k") % 96, F.col("k") % 3 != 0).alias("confidence"))


_ISSUE = "CASE WHEN k % 3 = 0 THEN 'Yes' WHEN k % 3 = 1 THEN 'No' ELSE 'Unknown' END"
_FIX = "CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'Not provided' ELSE 'guard it' END"


@query("code_confidence", with_views("answers") + f"""SELECT row_ord, CAST(least(95, 40 + user_id % 50 + CASE WHEN {_ISSUE} = 'Yes' THEN 10 ELSE 0 END + CASE WHEN k % 8 > 0 THEN least(3 * (k % 8), 15) ELSE 0 END
+ CASE WHEN {_FIX} NOT IN ('', 'Not provided') THEN 5 ELSE 0 END) AS INT) AS confidence FROM answers""")
def _(spark, sf):
    a = view(spark, sf, "answers")
    return a.select("row_ord", scoring.code_confidence(40 + F.col("user_id") % 50, F.expr(_ISSUE), F.col("k") % 8, F.expr(_FIX)).alias("confidence"))


@query("code_review_rule", with_views("answers") + f"""SELECT row_ord, user_id % 101 < 70 OR ({_ISSUE} = 'No' AND user_id % 101 < 85) OR coalesce(kb_resolution, '') = 'INVESTIGATE' AS requires_review FROM answers""")
def _(spark, sf):
    return view(spark, sf, "answers").select("row_ord", scoring.code_review_rule(F.col("user_id") % 101, F.expr(_ISSUE), "kb_resolution").alias("requires_review"))


@query("inferred_confidence", with_views("exc") + """SELECT row_ord, CAST(least(98, greatest(40, 65 + CASE WHEN len(Stack_Trace) > 100 THEN 15 ELSE 0 END
+ CASE WHEN k % 4 < 3 THEN 10 ELSE 0 END + CASE WHEN len(Exception_Message) > 100 THEN 8 ELSE 0 END + CASE WHEN trim(Error_Code) <> '' THEN 7 ELSE 0 END + CASE WHEN k % 6 > 2 THEN 5 ELSE 0 END)) AS INT) AS confidence FROM exc""")
def _(spark, sf):
    e = view(spark, sf, "exc")
    res = F.expr("CASE k % 4 WHEN 0 THEN 'PURGE' WHEN 1 THEN 'REPROCESS' WHEN 2 THEN 'INVESTIGATE' ELSE 'UNDEFINED' END")
    return e.select("row_ord", scoring.inferred_confidence("Stack_Trace", res, "Exception_Message", "Error_Code", F.col("k") % 6).alias("confidence"))


_LABEL = "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN ' DatabaseError ' WHEN 2 THEN 'Weird' ELSE NULL END"


@query("classified_type", with_views("answers") + f"""SELECT row_ord, coalesce(nullif(trim({_LABEL}), ''), Exception_Type) AS classified,
coalesce(nullif(trim({_LABEL}), ''), Exception_Type) = 'DatabaseError' AS known FROM answers""")
def _(spark, sf):
    a = view(spark, sf, "answers").select("row_ord", scoring.classified_type(F.expr(_LABEL), "Exception_Type").alias("classified"))
    return a.withColumn("known", scoring.known_label(F.col("classified")))


_ERR = "CASE WHEN m.k % 13 = 0 THEN 'model down' END"
_N = "CASE WHEN m.kb_similarity < 0.1 THEN 0 ELSE 3 END"
_KC = kb_conf_sql("CASE WHEN m.kb_similarity >= 0.1 THEN m.kb_similarity END")
_CF = blend_sql("m.confidence", f"({_KC})", "m.kb_similarity >= 0.1")
_FULL = """concat_ws(' ', nullif(e.Exception_Message, ''), nullif(CASE WHEN i.inner_text = '' THEN '' ELSE ' | ' || i.inner_text END, ''))"""


@query("result_table", with_views("exc").rstrip() + ", " + MERGED[len("WITH "):].rstrip() + f""",
i AS (SELECT row_ord, concat_ws(' | ', CASE WHEN Inner_Type <> '' THEN 'Inner Exception: ' || Inner_Type END, CASE WHEN Inner_Message <> '' THEN 'Inner Message: ' || Inner_Message END,
  CASE WHEN Error_Code <> '' THEN 'Error Code: ' || Error_Code END) AS inner_text FROM exc)
SELECT e.Exception_ID, 'Payment' AS Selected_Module, e.Exception_Type, e.Exception_Message, {_FULL} AS Original_Error, e.Stack_Trace,
CASE WHEN {_ERR} IS NOT NULL THEN 'INVESTIGATE' ELSE m.resolution END AS Resolution, CASE WHEN {_ERR} IS NOT NULL THEN 'Error during analysis' ELSE m.root_cause END AS Root_Cause,
CASE WHEN {_ERR} IS NOT NULL THEN 0 ELSE {_CF} END AS Confidence_Score, CASE WHEN {_ERR} IS NOT NULL THEN 'Analysis error: model down' ELSE m.reasoning END AS Reasoning,
CASE WHEN {_ERR} IS NOT NULL THEN '0 cases' ELSE {_N} || ' cases - KB confidence: ' || {_KC} || '%' END AS Similar_Past_Cases,
CASE WHEN {_ERR} IS NOT NULL THEN 'Review manually' ELSE m.suggested_action END AS Suggested_Action, CASE WHEN {_ERR} IS NOT NULL THEN 'HIGH' ELSE e.SEVERITY END AS Severity,
e.MACHINE_NAME AS Machine_Name, e.Process_Name, e.Timestamp, CASE WHEN {_ERR} IS NOT NULL THEN 'error' WHEN {_KC} < 80 THEN 'deep_constructive' ELSE 'constructive' END AS Analysis_Type,
CASE WHEN {_ERR} IS NOT NULL THEN true ELSE {_CF} < 80 END AS Requires_Review FROM exc e JOIN m ON m.row_ord = e.row_ord JOIN i ON i.row_ord = e.row_ord""")
def _(spark, sf):
    usable = scoring.kb_usable("kb_similarity", "kb_resolution")
    a = answers(spark, sf).withColumn("answer", scoring.validated(F.col("_v"), usable, "kb_similarity")).drop("Exception_Type", "k", "user_id")
    e = view(spark, sf, "exc").join(a, "row_ord")
    full = clean.full_error(F.col("Exception_Message"), F.col("Inner_Type"), F.col("Inner_Message"), F.col("Error_Code"), F.col("Exception_Message"))
    row = {"id": F.col("Exception_ID"), "exception_type": F.col("Exception_Type"), "message": F.col("Exception_Message"), "stack_trace": F.col("Stack_Trace"), "full_error": full,
           "severity": F.col("SEVERITY"), "machine": F.col("MACHINE_NAME"), "process": F.col("Process_Name"), "timestamp": F.col("Timestamp")}
    n = F.when(F.col("kb_similarity") < 0.1, 0).otherwise(3)
    best = {"resolution": F.col("kb_resolution"), "root_cause": F.col("kb_root_cause"), "action": F.col("kb_action"), "similarity": F.col("kb_similarity"), "n_cases": n}
    error = F.when(F.col("k") % 13 == 0, "model down")
    return e.select(*[c.alias(name) for name, c in result_columns(row, best, F.col("answer"), error, "Payment").items()])


_ASK = ("Decide how to resolve this exception. Answer with one JSON object holding the keys Resolution, Root_Cause, Reasoning, Suggested_Action, Confidence and "
        "Similar_Patterns. Resolution is PURGE, REPROCESS or INVESTIGATE; Confidence is a whole number from 0 to 100. A knowledge-base match of 70% or more decides the Resolution.")


@query("prompt_table", with_views("exc") + f"""SELECT row_ord, concat_ws(chr(10), '{_ASK}', 'Type: ' || coalesce(Exception_Type, ''), 'Message: ' || Exception_Message, 'Inner type: ' || Inner_Type,
'Inner message: ' || Inner_Message, 'Error code: ' || Error_Code, 'Stack trace: ' || Stack_Trace, 'Knowledge base:', 'none') AS prompt FROM exc""")
def _(spark, sf):
    e = view(spark, sf, "exc")
    d = F.struct(F.col("Exception_Type").alias("exception_type"), F.col("Exception_Message").alias("message"), F.col("Inner_Type").alias("inner_exception_type"),
                 F.col("Inner_Message").alias("inner_exception_message"), F.col("Error_Code").alias("error_code"), F.col("Stack_Trace").alias("stack_trace"))
    return e.select("row_ord", context.analysis_prompt(d, F.lit("none")).alias("prompt"))


def _words(value: str) -> str:
    return f"list_filter(regexp_split_to_array({value}, '{q.SPACE}+'), lambda x: x <> '')"


@query("prompt_budget", f"""WITH w AS (SELECT doc_id, text, source || ' ' || lang AS essential, {_words("source || ' ' || lang")} AS ew, {_words('text')} AS cw FROM documents)
SELECT doc_id, CASE WHEN len(ew) + len(cw) > 500 THEN essential || chr(10) || chr(10) || array_to_string(cw[1:400 - len(ew)], ' ') ELSE essential || chr(10) || text END AS prompt FROM w""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("essential"))
    return d.select("doc_id", context.within_budget(F.col("essential"), F.col("text"), 500, 400).alias("prompt"))
