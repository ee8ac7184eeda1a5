"""Exception-log shaped views over the given tables.

The given tables hold no exception logs, so each view derives one from them, row for row, over the
whole table. The texts use only what Spark SQL and the checking SQL engine both understand, so a query
and its check start from the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.session import spread

_BASE = """
SELECT event_id, substr(CAST(ts AS STRING), 1, 19) AS logtime, user_id, value, event_type,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM {events}
"""

# one row per event: the fields an exception log would carry
_RAW = f"""
SELECT event_id, logtime, user_id, value, k,
  CASE event_type WHEN 'click' THEN 'ClaimGeneration' WHEN 'view' THEN 'ClaimPricing'
       WHEN 'purchase' THEN 'Payment' WHEN 'error' THEN 'Billing' ELSE 'Authentication' END AS module,
  CASE k % 6 WHEN 0 THEN 'System.NullReferenceException'
             WHEN 1 THEN 'System.Data.SqlClient.SqlException'
             WHEN 2 THEN 'java.util.concurrent.TimeoutException'
             WHEN 3 THEN 'ValueError'
             WHEN 4 THEN 'System.InvalidOperationException'
             ELSE 'Upstream Timeout Exception' END AS typ,
  CASE WHEN k % 16 = 7 THEN ''
       WHEN k % 8 = 0 THEN 'Object reference not set for order_item ' || k || ' on server: srv' || user_id || ' value null'
       WHEN k % 8 = 1 THEN 'Cannot insert duplicate key, unique constraint violated ORA-0' || (1000 + k) || ' Code: ' || user_id
       WHEN k % 8 = 2 THEN 'Timeout after ' || CAST(value AS STRING) || ' ms calling billing_api for user' || user_id || '@mail.example'
       WHEN k % 8 = 3 THEN 'Failed ClaimProcessor step ' || k || ' at 2024-01-0' || (1 + k % 9) || ' 10:0' || (k % 6) || ':00 on machine m' || user_id
       WHEN k % 8 = 4 THEN 'Sequence contains no elements in batch ' || md5(CAST(k AS STRING))
       WHEN k % 8 = 5 THEN 'ERROR ' || k || ' Code:' || user_id || ' ORA-12 error: 7 retry exhausted'
       WHEN k % 8 = 6 THEN '  Payload   rejected' || chr(9) || ' by SchemaValidator ' || k || ' '
       ELSE 'Deadlock found by session ' || user_id END AS msg,
  CASE event_id % 5
    WHEN 0 THEN 'System.InvalidOperationException: step ' || k || ' failed' || chr(10)
         || '   at Acme.Claims.ClaimProcessor.Process' || (k % 4) || '(String id) in src' || (k % 20) || '/en/doc_' || ((user_id * 7 + k) % 1500) || '.cs:line ' || (1 + k) || chr(10)
         || '   at Acme.Core.Runner.Run() in C:/work/Runner.cs:line 7' || chr(10)
         || '   at Acme.Core.Runner.Run() in C:/work/Runner.cs:line 7'
    WHEN 1 THEN 'Traceback (most recent call last):' || chr(10)
         || '  File "doc_' || ((user_id * 7 + k) % 1500) || '.py", line ' || (1 + k % 60) || ', in step_' || (k % 9) || chr(10)
         || '  File "en/doc_' || (k % 30) || '", line ' || (1 + k) || ', in run' || chr(10) || 'ValueError' || chr(10) || 'bad value ' || k
    WHEN 2 THEN 'java.lang.IllegalStateException: bad state ' || k || chr(10)
         || '    at com.acme.claims.Worker' || (k % 5) || '.run(Worker' || (k % 5) || '.java:' || (10 + k) || ')' || chr(10)
         || '    at com.acme.Main.main(Main.java:3)'
    WHEN 3 THEN 'TypeError' || chr(10) || 'at handle (web/app' || (k % 3) || '.js:' || (1 + k) || ':5)' || chr(10)
         || 'at boot (C:/site/boot.js:9:1)'
    ELSE CASE WHEN k % 10 = 0 THEN '' ELSE
         'failure near C:/p/f' || (k % 7) || '.cs:' || k || ' and C:/p/f' || (k % 7) || '.cs:' || k || chr(10)
         || 'at Acme.Mixed.Go(Int32 n) in doc_' || (k % 40) || '.py:line ' || (2 + k % 30) END
  END AS trace,
  CASE k % 3 WHEN 1 THEN 'E' || (k % 4) WHEN 2 THEN CAST(70 + k % 5 AS STRING) ELSE '' END AS code,
  CASE k % 3 WHEN 0 THEN '' ELSE 'InnerFault' || (k % 2) END AS inner_type,
  CASE k % 3 WHEN 0 THEN '' ELSE 'inner detail ' || (k % 12) END AS inner_msg,
  'M' || (user_id % 10) AS machine,
  CASE WHEN value < 5 THEN 'LOW' WHEN value < 20 THEN 'MEDIUM' WHEN value < 90 THEN 'HIGH'
       WHEN value < 200 THEN 'CRITICAL' ELSE 'FATAL' END AS sev,
  CASE k % 5 WHEN 0 THEN 'C:' || chr(92) || 'apps' || chr(92) || 'claimgeneration' || chr(92) || 'run.exe'
             WHEN 1 THEN 'c:' || chr(92) || 'windows' || chr(92) || 'order.svc' || (k % 3) || '.exe'
             WHEN 2 THEN 'AuthHost' WHEN 3 THEN 'x' ELSE 'payment-worker' END AS proc,
  CASE k % 7 WHEN 0 THEN 'Nightly Billing run' WHEN 1 THEN 'OAuth refresh' WHEN 2 THEN 'Payment capture'
             WHEN 3 THEN 'DB failover' WHEN 4 THEN 'Service call' WHEN 5 THEN CAST(NULL AS STRING)
             ELSE 'Misc job' END AS title
FROM ({_BASE}) b
"""


def _esc(col: str) -> str:
    return (
        f"replace(replace(replace({col}, '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')"
    )


_HEAD = (
    "'\"Exception\": {{\"Exception Type\": \"' || typ || '\", \"Message\": \"' || "
    + _esc("msg") + " || '\", \"StackTrace\": \"' || " + _esc("trace") + " || '\"'"
)
_INNER = (
    "CASE k % 3 WHEN 0 THEN 'null' "
    "WHEN 1 THEN '{{\"Exception Type\": \"' || inner_type || '\", \"Message\": \"' || inner_msg || '\", \"Code\": \"' || code || '\"}}' "
    "ELSE '{{\"Exception Type\": \"' || inner_type || '\", \"Message\": \"' || inner_msg || '\", \"ErrorCode\": ' || code || '}}' END"
)
_PROC = (
    "CASE k % 4 WHEN 0 THEN '\"Process Name\": \"' || replace(proc, chr(92), '/') || '\"' "
    "WHEN 1 THEN '\"PRCS_NAME\": \"  \", \"process_name\": \" ' || replace(proc, chr(92), '/') || ' \"' "
    "WHEN 2 THEN '\"ProcessName\": \"' || replace(proc, chr(92), '/') || '\"' "
    "ELSE '\"Other\": 1' END"
)
_GOOD = f"'{{{{' || {_HEAD} || ', \"InnerException\": ' || {_INNER} || '}}}}, ' || {_PROC} || '}}}}'"

# the log as it arrives, JSON column included; 7 in 50 payloads are damaged in the ways seen in practice
LOG = f"""
SELECT r.*,
  CASE event_id % 50
    WHEN 0 THEN {_HEAD}
    WHEN 1 THEN 'log line: ' || msg
    WHEN 2 THEN ''
    WHEN 3 THEN '{{{{' || {_HEAD} || ', \"InnerException\": {{{{\"Exception Type\": \"I' || k || '\", \"Message\": \"cut ' || k || '\", \"Code\": \"E9\"'
    WHEN 4 THEN '﻿' || {_GOOD}
    WHEN 5 THEN replace({_GOOD}, 'Exception Type', 'Exception Type' || chr(1))
    WHEN 6 THEN CAST(NULL AS STRING)
    ELSE {_GOOD} END AS payload
FROM ({_RAW}) r
"""

# the same log after cleaning, with the columns every later step reads
EXC = f"""
SELECT event_id AS row_ord, CAST(event_id AS STRING) AS Exception_ID, logtime AS Timestamp,
       module AS Module, CASE WHEN k % 25 = 3 THEN CAST(NULL AS STRING) ELSE typ END AS Exception_Type,
       msg AS Exception_Message, trace AS Stack_Trace, code AS Error_Code,
       inner_type AS Inner_Type, inner_msg AS Inner_Message,
       CASE WHEN inner_type = '' THEN '' ELSE inner_type || ': ' || inner_msg END AS Inner_Exception,
       proc AS Process_Name, sev AS SEVERITY, machine AS MACHINE_NAME, k % 9 AS PRIORITY, k, user_id, value
FROM ({_RAW}) r
"""

# free text as messages
MSG = """
SELECT doc_id AS row_ord, CAST(doc_id AS STRING) AS Exception_ID, lang AS Module, source AS Exception_Type,
       text AS Exception_Message, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'C' || (n_chars % 3) END AS Error_Code
FROM {documents}
"""

_ORD = """
SELECT o_orderkey AS n, o_custkey AS c, o_totalprice AS price, o_orderdate, o_orderpriority,
       CASE o_orderstatus WHEN 'F' THEN 'ClaimGeneration' WHEN 'O' THEN 'Payment' ELSE 'Billing' END AS module,
       CAST(o_custkey % 5 AS INT) AS a, CAST(o_custkey % 7 AS INT) AS b, CAST(o_orderkey % 4 AS INT) AS d
FROM {orders}
"""

# knowledge base file rows (many repeats), from orders
KBFILE = f"""
SELECT n AS row_ord, module AS Module,
  CASE WHEN n % 41 = 0 THEN '' WHEN n % 43 = 0 THEN 'not json ' || a
       ELSE '{{{{"Exception": {{{{"Exception Type": "Fault.Kind' || a || 'Exception", "Message": "Pattern ' || b || ' in step ' || a
            || '", "StackTrace": "at Step' || a || '.Run", "InnerException": '
            || CASE WHEN d = 0 THEN 'null' ELSE '{{{{"Exception Type": "Inner' || d || '", "Message": "why ' || b || '", "Code": "K' || d || '"}}}}' END
            || '}}}}}}}}' END AS EVENT_INFORMATION,
  CASE CAST(c % 11 AS INT) WHEN 0 THEN 'Message can be purged' WHEN 1 THEN 'retry later' WHEN 2 THEN 'please check'
       WHEN 3 THEN 'RE-PROCESS' WHEN 4 THEN 'discard or resend' WHEN 5 THEN '' WHEN 6 THEN 'Escalate'
       WHEN 7 THEN 'unknown' WHEN 8 THEN 'delete' WHEN 9 THEN 'Resend now' ELSE 'analyze' END AS Resolution,
  CASE WHEN b = 6 THEN CAST(NULL AS STRING) ELSE 'Cause ' || b || ' of kind ' || a END AS Summary,
  CASE WHEN b = 5 THEN CAST(NULL AS STRING) ELSE 'Do step ' || b END AS `Suggested Step`,
  substr(CAST(o_orderdate AS STRING), 1, 19) AS Added_At
FROM ({_ORD}) o
"""

# rows offered to an existing knowledge base later, from customer
KBNEW = """
SELECT c_custkey AS row_ord,
  CASE WHEN c_nationkey % 3 = 0 THEN 'ClaimGeneration' WHEN c_nationkey % 3 = 1 THEN 'Payment' ELSE 'Billing' END AS Module,
  CASE WHEN c_custkey % 17 = 0 THEN ''
       ELSE '{{"Exception": {{"Exception Type": "Fault.Kind' || (c_custkey % 6) || 'Exception", "Message": "Pattern ' || (c_custkey % 8) || ' in step ' || (c_custkey % 6)
            || '", "StackTrace": "at Step' || (c_custkey % 6) || '.Run", "InnerException": null}}}}' END AS EVENT_INFORMATION,
  CASE WHEN c_custkey % 4 = 0 THEN 'Message can be purged' WHEN c_custkey % 4 = 1 THEN 'retry later' ELSE 'analyze' END AS Resolution,
  'Cause ' || (c_custkey % 8) || ' of kind ' || (c_custkey % 6) AS Summary,
  'Do step ' || (c_custkey % 8) AS `Suggested Step`,
  '2024-02-01 00:00:00' AS Added_At
FROM {customer}
"""

# messages already known, from orders: some equal to, some close to, some far from the log's
KBMSG = """
SELECT o_orderkey AS row_ord, 'KB' || o_orderkey AS Exception_ID,
  CASE o_custkey % 6 WHEN 0 THEN 'System.NullReferenceException' WHEN 1 THEN 'System.Data.SqlClient.SqlException'
    WHEN 2 THEN 'java.util.concurrent.TimeoutException' WHEN 3 THEN 'ValueError' WHEN 4 THEN 'System.InvalidOperationException'
    ELSE 'Upstream Timeout Exception' END AS Exception_Type,
  CASE o_orderkey % 4 WHEN 0 THEN 'Deadlock found by session ' || o_custkey
    WHEN 1 THEN 'Timeout after ' || o_custkey || ' ms calling billing_api for some user' || o_custkey || '@mail.example'
    WHEN 2 THEN 'Payload rejected by SchemaValidator ' || o_custkey
    ELSE 'Disk ' || o_orderpriority || ' is almost full' END AS Exception_Message,
  CASE o_custkey % 3 WHEN 1 THEN 'E' || (o_custkey % 4) WHEN 2 THEN CAST(70 + o_custkey % 5 AS STRING) ELSE '' END AS Error_Code
FROM {orders}
"""

# a finished run
RESULTS = f"""
SELECT event_id AS row_ord, 'X' || (user_id * 100 + k) AS Exception_ID, module AS Selected_Module,
       module AS Module, typ AS Exception_Type, msg AS Exception_Message, msg AS Original_Error, trace AS Stack_Trace,
       CASE WHEN k % 10 < 4 THEN 'PURGE' WHEN k % 10 < 6 THEN 'REPROCESS' WHEN k % 10 < 9 THEN 'INVESTIGATE' ELSE 'UNDEFINED' END AS Resolution,
       CASE WHEN k % 4 = 0 THEN 'Please purge this' WHEN k % 4 = 1 THEN 'Reprocess after fix' ELSE 'Not provided' END AS Root_Cause,
       CAST((k * 7 + user_id * 3) % 101 AS INT) AS Confidence_Score, 'why ' || k AS Reasoning,
       'act ' || (k % 5) AS Suggested_Action, sev AS Severity, machine AS Machine_Name, proc AS Process_Name,
       logtime AS Timestamp, (k * 7 + user_id * 3) % 101 < 80 AS Requires_Review,
       CASE WHEN k % 20 = 0 THEN CAST(NULL AS STRING) ELSE 'GROUP_' || k END AS Dedup_Group_ID, k, user_id
FROM ({_RAW}) r
"""

# the review queue as stored
QUEUE = f"""
SELECT 'R' || row_ord AS review_id, r.*,
       CASE WHEN k % 3 = 0 THEN 'Low Confidence' WHEN k % 3 = 1 THEN 'Investigate' ELSE 'Undefined Resolution' END AS Review_Reason,
       CASE WHEN k % 7 = 0 THEN CAST(NULL AS STRING) WHEN k % 7 < 4 THEN 'Pending' ELSE 'Completed' END AS Review_Status,
       CASE WHEN k % 5 = 0 THEN 'None' WHEN k % 5 = 1 THEN CAST(NULL AS STRING) ELSE 'PURGE' END AS User_Resolution,
       CASE WHEN k % 6 = 0 THEN CAST(NULL AS STRING) ELSE 'step ' || k END AS User_Suggested_Step,
       CAST(NULL AS STRING) AS Review_Action, CAST(NULL AS STRING) AS Review_Timestamp
FROM ({RESULTS}) r
"""

# reviewer decisions, from labels
DECISIONS = """
SELECT 'R' || doc_id AS review_id, CASE WHEN quality = 1 THEN 'purge' ELSE 'reprocess' END AS decision,
       CASE WHEN doc_id % 6 = 0 THEN '' WHEN quality = 1 THEN 'PURGE' ELSE 'REPROCESS' END AS Resolution,
       CASE WHEN toxic = 1 THEN CAST(NULL AS STRING) ELSE 'step for ' || doc_id END AS Suggested_Step
FROM {labels}
"""

# model answers, one per exception
ANSWERS = f"""
SELECT event_id AS row_ord,
  CASE k % 12
    WHEN 0 THEN '{{{{"Resolution": "PURGE|REPROCESS", "Root_Cause": "Summary: a' || k || '", "Confidence": 91}}}}'
    WHEN 1 THEN '{{{{"resolution": "escalate to dev team", "root_cause": "r' || k || '", "confidence": "72", "reasoning": "because"}}}}'
    WHEN 2 THEN '{{{{"Resolution": "RETRY", "Confidence": "85%", "Suggested_Action": "act"}}}}'
    WHEN 3 THEN '{{{{"Resolution": "purge", "Confidence": 66.7, "Similar_Patterns": "p' || (k % 5) || '"}}}}'
    WHEN 4 THEN 'API Error: timeout ' || k
    WHEN 5 THEN '{{{{"Resolution": "", "Root_Cause": "", "Confidence": 40}}}}'
    WHEN 6 THEN '{{{{"Resolution": "Investigate", "Root_Cause": "reprocess later", "Code_Issue_Found": "Yes", "Suggested_Fix": "guard", "Affected_Code_File": "a.cs"}}}}'
    WHEN 7 THEN '{{{{"Resolution": "THE MESSAGE TO REPROCESS", "Code_Issue_Found": "No", "Confidence": 75}}}}'
    WHEN 8 THEN '{{{{"Resolution": "ESCALATE", "Confidence": 99, "Suggested_Action": "call"}}}}'
    WHEN 9 THEN '{{{{"Resolution": "PURGE", "Root_Cause": "cut'
    WHEN 10 THEN '{{{{"Root_Cause": "Summary: long text ' || k || '", "Suggested_Action": "Action: go", "Confidence": 55}}}}'
    ELSE '{{{{"Resolution": "none of these", "Confidence": 12}}}}' END AS raw_answer,
  CASE WHEN k % 4 = 0 THEN CAST(NULL AS STRING) WHEN k % 4 = 1 THEN 'PURGE' WHEN k % 4 = 2 THEN 'INVESTIGATE' ELSE 'UNDEFINED' END AS kb_resolution,
  CAST((user_id * 37 + k * 11) % 1000 AS DOUBLE) / 1000 AS kb_similarity,
  CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'kb cause ' || k ELSE 'Summary: s' || chr(10) || 'Explanation: e' || chr(10) || 'Action: a' END AS kb_root_cause,
  CASE WHEN k % 5 < 2 THEN '' ELSE 'kb action ' || (k % 5) END AS kb_action, k, user_id,
  typ AS Exception_Type
FROM ({_RAW}) r
"""

# audit rows, one per order
AUDIT_LOG = """
SELECT o_orderdate AS Upload_DateTime, 'file_' || o_orderkey || '.csv' AS File_Name, o_orderpriority AS Module,
       o_custkey AS Total_Records, o_custkey % 5 AS Reprocess_Count, o_custkey % 7 AS Purge_Count,
       o_orderkey % 3 AS Investigate_Count, o_orderkey % 4 AS Review_Count,
       CAST(o_orderkey % 101 AS DOUBLE) AS Avg_Confidence,
       CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_orderkey % 997 AS DOUBLE) / 16 END AS Processing_Time_Minutes
FROM {orders}
"""

# one source file per document
CODE = """
SELECT source || '/' || lang || '/doc_' || doc_id || '.py' AS file_path, doc_id AS file_ord, text AS content,
       CAST(doc_id % 50 AS DOUBLE) AS mtime
FROM {documents}
"""

# files already indexed: what an earlier run left behind, keyed by the labelled documents
MANIFEST = """
SELECT d.source || '/' || d.lang || '/doc_' || d.doc_id || '.py' AS file_path, CAST(25 AS DOUBLE) AS mtime
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

# vectors: every vector is an entry of its module's KB; every vector blended with the next is a query
KBVEC = """
SELECT vec_id AS kb_id, CASE label % 3 WHEN 0 THEN 'ModuleA' WHEN 1 THEN 'ModuleB' ELSE 'ModuleC' END AS module, embedding
FROM {embeddings}
"""
_PAIRED = """
SELECT a.vec_id AS q_id, CASE a.label % 3 WHEN 0 THEN 'ModuleA' WHEN 1 THEN 'ModuleB' ELSE 'ModuleC' END AS module,
       CAST(a.vec_id % 6 AS DOUBLE) / 10 AS w, a.embedding AS e1, coalesce(b.embedding, a.embedding) AS e2
FROM {embeddings} a LEFT JOIN {embeddings} b ON b.vec_id = a.vec_id + 1
"""

_VIEWS = {
    "log": LOG, "exc": EXC, "msg": MSG, "kbfile": KBFILE, "kbnew": KBNEW, "kbmsg": KBMSG, "results": RESULTS,
    "queue": QUEUE, "decisions": DECISIONS, "answers": ANSWERS, "audit": AUDIT_LOG, "code": CODE,
    "manifest": MANIFEST, "kbvec": KBVEC, "paired": _PAIRED,
}
_TABLES = ["events", "documents", "orders", "customer", "labels", "embeddings"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, rows.count())  # counted by the files' footers


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in view `name` over the tables in `sf_dir`."""
    text = _VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql_view(name: str) -> str:
    """The same view as text for the checking engine."""
    return _VIEWS[name].format(**{t: t for t in _TABLES}).replace("`", '"')


def with_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` prefix for a check query."""
    return "WITH " + ", ".join(f"{n} AS ({sql_view(n)})" for n in names) + "\n"
