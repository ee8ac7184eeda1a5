"""Queries: review queue and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import audit, kb, review
from faultline.plans import checksql as q
from faultline.plans.q_kb import _DOC, NORM_RES, entries_sql
from faultline.plans.registry import query
from faultline.plans.standins import view, with_views

RUN_TS = "2024-02-01 00:00:00"
AUDIT_TS = "1999-01-01 00:00:00"

_ROUTED = with_views("results").rstrip() + """, pr AS (SELECT *, CASE WHEN Confidence_Score <= 70 THEN 1 WHEN Resolution = 'INVESTIGATE' THEN 2 WHEN Resolution = 'UNDEFINED' THEN 3 END AS p FROM results),
fi AS (SELECT Exception_ID, min(p) AS mp FROM pr WHERE p IS NOT NULL GROUP BY 1),
rt AS (SELECT pr.row_ord, pr.Exception_ID, pr.Resolution, pr.Confidence_Score, pr.Module, CASE p WHEN 1 THEN 'Low Confidence' WHEN 2 THEN 'Investigate' ELSE 'Undefined Resolution' END AS Review_Reason,
  'Pending' AS Review_Status FROM pr JOIN fi ON fi.Exception_ID = pr.Exception_ID AND fi.mp = pr.p)
"""
_ROUTE_COLS = ["row_ord", "Exception_ID", "Resolution", "Confidence_Score", "Review_Reason", "Review_Status", "review_id"]
_RID = "md5('run1|' || Exception_ID || '|' || Review_Reason || '|' || row_ord)"


@query("review_route", _ROUTED + f"SELECT row_ord, Exception_ID, Resolution, Confidence_Score, Review_Reason, Review_Status, {_RID} AS review_id FROM rt")
def _(spark, sf):
    return review.review_route(view(spark, sf, "results"), "run1", RUN_TS).select(*_ROUTE_COLS)


@query("review_append", _ROUTED.rstrip() + ", " + with_views("queue")[5:] + f""" SELECT review_id, Exception_ID, Resolution, Review_Reason, Review_Status, User_Resolution, CAST(NULL AS STRING) AS Added_To_Review FROM queue
UNION ALL SELECT {_RID}, Exception_ID, Resolution, Review_Reason, Review_Status, NULL, '{RUN_TS}' FROM rt""")
def _(spark, sf):
    both = review.review_append(view(spark, sf, "queue"), review.review_route(view(spark, sf, "results"), "run1", RUN_TS))
    return both.select("review_id", "Exception_ID", "Resolution", "Review_Reason", "Review_Status", "User_Resolution", "Added_To_Review")


@query("review_apply", with_views("queue", "decisions") + f"""SELECT q.review_id, CASE WHEN d.decision IS NOT NULL THEN 'Completed' ELSE q.Review_Status END AS Review_Status,
CASE d.decision WHEN 'purge' THEN 'Purged by user' WHEN 'reprocess' THEN 'Reprocessed by user' END AS Review_Action, CASE WHEN d.decision IS NOT NULL THEN '{RUN_TS}' END AS Review_Timestamp,
CASE WHEN d.decision IS NOT NULL THEN coalesce(d.Resolution, '') ELSE q.User_Resolution END AS User_Resolution,
CASE WHEN d.decision IS NOT NULL THEN coalesce(d.Suggested_Step, '') ELSE q.User_Suggested_Step END AS User_Suggested_Step FROM queue q LEFT JOIN decisions d ON d.review_id = q.review_id""")
def _(spark, sf):
    out = review.review_apply(view(spark, sf, "queue"), view(spark, sf, "decisions"), RUN_TS)
    return out.select("review_id", "Review_Status", "Review_Action", "Review_Timestamp", "User_Resolution", "User_Suggested_Step")


@query("review_filter", with_views("queue") + "SELECT review_id, Exception_ID FROM queue WHERE contains(lower(Exception_ID), 'x1') AND Module = 'Payment' AND Exception_Type = 'ValueError' AND coalesce(Review_Status, 'Pending') = 'Pending'")
def _(spark, sf):
    return review.review_filter(view(spark, sf, "queue"), "X1", etype="ValueError", module="Payment", wanted_status="Pending").select("review_id", "Exception_ID")


@query("results_filter", with_views("results") + """SELECT row_ord, Exception_ID, CASE WHEN Requires_Review THEN 'YES' ELSE 'NO' END AS Requires_Review FROM results
WHERE contains(lower(Exception_ID), 'x1') AND Resolution = 'PURGE' AND Confidence_Score <= 70""")
def _(spark, sf):
    hits = review.results_filter(view(spark, sf, "results"), "x1", resolution="PURGE", low_confidence=70)
    return review.results_display(hits).select("row_ord", "Exception_ID", "Requires_Review")


@query("review_display", with_views("queue") + """SELECT review_id, Module, Exception_ID, Process_Name, Exception_Type, Exception_Message, Root_Cause, Resolution, Suggested_Action, Confidence_Score, Review_Reason,
coalesce(nullif(User_Resolution, 'None'), '') AS User_Resolution, coalesce(nullif(User_Suggested_Step, 'None'), '') AS User_Suggested_Step, Review_Status FROM queue""")
def _(spark, sf):
    return review.review_display(view(spark, sf, "queue"))


@query("review_clear", with_views("queue") + "SELECT review_id, Review_Status FROM queue WHERE coalesce(Review_Status, 'Pending') <> 'Completed'")
def _(spark, sf):
    return review.review_clear(view(spark, sf, "queue")).select("review_id", "Review_Status")


@query("review_totals", with_views("queue") + """SELECT count(*) AS total, count(*) FILTER (coalesce(Review_Status, 'Pending') = 'Pending') AS pending,
count(*) FILTER (Review_Status = 'Completed') AS completed FROM queue""")
def _(spark, sf):
    return review.review_totals(view(spark, sf, "queue"))


@query("review_page", with_views("queue") + "SELECT review_id, Exception_ID FROM queue ORDER BY review_id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return review.review_page(view(spark, sf, "queue").select("review_id", "Exception_ID"), 2)


@query("review_report", with_views("queue").rstrip() + f""", m AS (SELECT Module, count(*) AS n FROM queue GROUP BY 1), r AS (SELECT Resolution, count(*) AS n FROM queue GROUP BY 1)
SELECT '{{"timestamp":"{RUN_TS}","total_items":' || (SELECT count(*) FROM queue) || ',"pending":' || (SELECT count(*) FROM queue WHERE coalesce(Review_Status, 'Pending') = 'Pending')
|| ',"completed":' || (SELECT count(*) FROM queue WHERE Review_Status = 'Completed') || ',"modules":{{' || (SELECT string_agg('"' || Module || '":' || n, ',' ORDER BY Module) FROM m)
|| '}},"resolutions":{{' || (SELECT string_agg('"' || Resolution || '":' || n, ',' ORDER BY Resolution) FROM r) || '}}}}' AS report""")
def _(spark, sf):
    return review.review_report(view(spark, sf, "queue"), RUN_TS)


_SAVED = with_views("queue", "decisions").rstrip() + f""", ent AS (SELECT q.review_id, q.row_ord, q.Module, d.Resolution, q.Root_Cause AS Summary, d.Suggested_Step AS "Suggested Step", '{RUN_TS}' AS Added_At,
q.Exception_Type AS exception_type, q.Exception_Message AS message, q.Stack_Trace AS stack_trace, '' AS inner_exception_type, '' AS inner_exception_message, '' AS error_code
FROM queue q JOIN decisions d ON d.review_id = q.review_id WHERE coalesce(d.Resolution, '') <> '' AND coalesce(d.Suggested_Step, '') <> '') """


@query("review_to_kb", _SAVED + f"SELECT row_ord, Module AS module, exception_type, message AS exception_message, {NORM_RES} AS resolution, Summary AS root_cause, \"Suggested Step\" AS action, {_DOC} AS document FROM ent WHERE exception_type <> ''")
def _(spark, sf):
    entries, _ = review.review_to_kb(view(spark, sf, "queue"), view(spark, sf, "decisions"), RUN_TS)
    return kb.kb_candidates(entries).select("row_ord", "module", "exception_type", "exception_message", "resolution", "root_cause", "action", "document")


@query("review_rejects", with_views("queue", "decisions") + """SELECT q.review_id, 'Resolution and Suggested Step are required' AS reason FROM queue q JOIN decisions d ON d.review_id = q.review_id
WHERE coalesce(d.Resolution, '') = '' OR coalesce(d.Suggested_Step, '') = ''""")
def _(spark, sf):
    return review.review_to_kb(view(spark, sf, "queue"), view(spark, sf, "decisions"), RUN_TS)[1]


# --- reports over a run ---------------------------------------------------------------------------

def _n(name: str) -> str:
    return f"count(*) FILTER (Resolution = '{name}')"


@query("run_stats", with_views("results") + "SELECT count(*) AS total, count(*) FILTER (Requires_Review) AS review_count, round(avg(Confidence_Score), 4) AS avg_confidence, " + ", ".join(
    f"{_n(r)} AS {r.lower()}_count, round({_n(r)} / count(*) * 100, 4) AS {r.lower()}_pct" for r in ("PURGE", "REPROCESS", "INVESTIGATE")) + " FROM results")
def _(spark, sf):
    return audit.run_stats(view(spark, sf, "results"))


@query("audit_entry", with_views("results") + f"""SELECT TIMESTAMP '{RUN_TS}' AS Upload_DateTime, 'log.csv' AS File_Name, 'Payment' AS Module, count(*) AS Total_Records, {_n('REPROCESS')} AS Reprocess_Count,
{_n('PURGE')} AS Purge_Count, {_n('INVESTIGATE')} AS Investigate_Count, count(*) FILTER (Requires_Review) AS Review_Count, round(avg(Confidence_Score), 2) AS Avg_Confidence, 2.05e0 AS Processing_Time_Minutes FROM results""")
def _(spark, sf):
    return audit.audit_entry(view(spark, sf, "results"), F.count_if("Requires_Review"), "log.csv", "Payment", RUN_TS, 123.0)


@query("kpis", with_views("results") + """SELECT count(*) AS total_processed, count(*) FILTER (Requires_Review) AS review_required, count(*) FILTER (NOT Requires_Review AND Resolution = 'PURGE') AS auto_purged,
count(*) FILTER (NOT Requires_Review AND Resolution = 'INVESTIGATE') AS investigate, round(avg(Confidence_Score), 4) AS avg_confidence FROM results""")
def _(spark, sf):
    return audit.kpis(view(spark, sf, "results"))


@query("resolution_counts", with_views("results") + """SELECT 'Resolution' AS field, Resolution AS val, count(*) AS n FROM results GROUP BY 2 UNION ALL SELECT 'Module', Module, count(*) FROM results GROUP BY 2
UNION ALL SELECT 'Exception_Type', Exception_Type, count(*) FROM results GROUP BY 2""")
def _(spark, sf):
    r = view(spark, sf, "results")
    parts = [audit.value_counts(r, c).select(F.lit(c).alias("field"), F.col(c).alias("val"), "n") for c in ("Resolution", "Module", "Exception_Type")]
    return audit.union_runs(*parts)


@query("confidence_histogram", with_views("results") + "SELECT CAST(least(Confidence_Score // 5, 19) AS INT) AS bin, count(*) AS n FROM results GROUP BY 1")
def _(spark, sf):
    return audit.confidence_histogram(view(spark, sf, "results"))


@query("review_required", with_views("results") + """SELECT count(DISTINCT CASE WHEN Resolution = 'INVESTIGATE' OR Confidence_Score <= 70 THEN Exception_ID END) AS needs_review,
count(*) FILTER (Confidence_Score >= 80) AS high_confidence, count(*) FILTER (Confidence_Score <= 70) AS low_confidence FROM results""")
def _(spark, sf):
    return audit.review_required(view(spark, sf, "results"))


@query("top_types", with_views("results") + """SELECT Exception_Type, count(*) AS n, CASE WHEN contains(Exception_Type, '.') THEN string_split(Exception_Type, '.')[-1] ELSE string_split(Exception_Type, ' ')[-1] END AS label
FROM results GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def _(spark, sf):
    return audit.top_types(view(spark, sf, "results"))


@query("insights", with_views("results").rstrip() + f""", o AS (SELECT avg(Confidence_Score) AS mean, {_n('INVESTIGATE')} / count(*) * 100 AS inv, {_n('PURGE')} / count(*) * 100 AS purge, count(*) AS total FROM results),
t AS (SELECT Exception_Type AS t, count(*) AS n FROM results GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1),
l AS (SELECT list_filter([CASE WHEN mean >= 80 THEN 'Answers are confident on average' WHEN mean >= 60 THEN 'Answers are fairly confident; more known cases would help'
  ELSE 'Answers are unsure; the knowledge base lacks cases' END, CASE WHEN inv > 30 THEN printf('%.1f%% of the exceptions are left to people', inv) END,
  CASE WHEN purge > 50 THEN printf('%.1f%% of the exceptions can be purged', purge) END,
  CASE WHEN n > total * 0.2 THEN 'Most frequent type: ' || t || ', ' || n || ' times' END], lambda x: x IS NOT NULL) AS x FROM o, t)
SELECT CAST(unnest(range(len(x))) AS INT) AS position, unnest(x) AS insight FROM l""")
def _(spark, sf):
    return audit.insights(view(spark, sf, "results"))


@query("summary_json", with_views("results") + f"""SELECT '{{"Module":"Payment","Processing_Date":"{RUN_TS}","Total_Exceptions":' || count(*) || ',"Reprocess_Count":' || {_n('REPROCESS')} || ',"Purge_Count":' || {_n('PURGE')}
|| ',"Investigate_Count":' || {_n('INVESTIGATE')} || ',"Needs_Review_Count":' || count(DISTINCT CASE WHEN Resolution = 'INVESTIGATE' OR Confidence_Score <= 70 THEN Exception_ID END)
|| ',"Avg_Confidence":"' || printf('%.1f%%', avg(Confidence_Score)) || '"}}' AS summary FROM results""")
def _(spark, sf):
    return audit.summary_json(view(spark, sf, "results"), "Payment", RUN_TS)


@query("union_runs", with_views("results") + """SELECT row_ord, Exception_ID, Reasoning, CAST(NULL AS STRING) AS Suggested_Action FROM results
UNION ALL SELECT row_ord, Exception_ID, NULL, Suggested_Action FROM results""")
def _(spark, sf):
    r = view(spark, sf, "results")
    return audit.union_runs(r.select("row_ord", "Exception_ID", "Reasoning"), r.select("row_ord", "Exception_ID", "Suggested_Action"))


# --- audit log ------------------------------------------------------------------------------------

@query("audit_filter", with_views("audit") + f"SELECT File_Name, Upload_DateTime FROM audit WHERE Upload_DateTime >= TIMESTAMP '{AUDIT_TS}' - INTERVAL 90 DAY AND Module = '2-HIGH'")
def _(spark, sf):
    return audit.audit_filter(view(spark, sf, "audit"), AUDIT_TS, 90, "2-HIGH").select("File_Name", "Upload_DateTime")


@query("audit_sorted", with_views("audit") + "SELECT File_Name, Upload_DateTime, Total_Records FROM audit ORDER BY Upload_DateTime DESC, File_Name")
def _(spark, sf):
    return audit.audit_sorted(view(spark, sf, "audit")).select("File_Name", "Upload_DateTime", "Total_Records")


@query("audit_by_module", with_views("audit") + """SELECT Module, CAST(sum(Purge_Count) AS BIGINT) AS Purge_Count, CAST(sum(Reprocess_Count) AS BIGINT) AS Reprocess_Count,
CAST(sum(Investigate_Count) AS BIGINT) AS Investigate_Count FROM audit GROUP BY 1""")
def _(spark, sf):
    return audit.audit_by_module(view(spark, sf, "audit"))


@query("audit_summary", with_views("audit") + """SELECT count(*) AS total_uploads, CAST(sum(Total_Records) AS BIGINT) AS total_records, round(avg(Avg_Confidence), 4) AS avg_confidence,
CAST(sum(Review_Count) AS BIGINT) AS total_review, CAST(sum(Reprocess_Count) AS BIGINT) AS total_reprocess FROM audit""")
def _(spark, sf):
    return audit.audit_summary(view(spark, sf, "audit"))


@query("audit_display", with_views("audit") + """SELECT strftime(Upload_DateTime, '%Y-%m-%d %H:%M:%S') AS "Date & Time", File_Name AS "File Name", Module,
CASE WHEN Processing_Time_Minutes IS NULL THEN '0:00' ELSE printf('%d:%02d', CAST(floor(Processing_Time_Minutes) AS INT), CAST(floor((Processing_Time_Minutes % 1) * 60) AS INT)) END AS "Time (MM:SS)",
Total_Records AS "Total Records", Reprocess_Count AS Reprocess, Purge_Count AS Purge, Investigate_Count AS Investigate, Review_Count AS "Review Queue", Avg_Confidence AS "Avg Confidence %" FROM audit""")
def _(spark, sf):
    return audit.audit_display(view(spark, sf, "audit"))
