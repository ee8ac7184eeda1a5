"""The review queue: routing, decisions, filters, write-back to the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.schemas import PAGE_SIZE, REVIEW_DISPLAY_COLUMNS, REVIEW_THRESHOLD
from faultline.session import dense_number

ACTIONS = {"purge": "Purged by user", "reprocess": "Reprocessed by user"}


def status() -> Column:
    return F.coalesce("Review_Status", F.lit("Pending"))


def review_id(run_id: str) -> Column:
    """Id of a queue row, stable under replay: hash of run, exception and reason."""
    return F.md5(F.concat_ws("|", F.lit(run_id), "Exception_ID", "Review_Reason", F.col("row_ord").cast("string")))


def review_route(results: DataFrame, run_id: str, run_ts: str, threshold: int = REVIEW_THRESHOLD) -> DataFrame:
    """Rows for review: low confidence, then INVESTIGATE, then UNDEFINED.

    An exception id met under an earlier reason is not queued again under a later one. The first reason
    per id is an aggregate joined back, so one id with very many rows is not gathered in one task.
    """
    order = (
        F.when(F.col("Confidence_Score") <= threshold, 1)
        .when(F.col("Resolution") == "INVESTIGATE", 2)
        .when(F.col("Resolution") == "UNDEFINED", 3)
    )
    rows = results.withColumn("_p", order).filter(F.col("_p").isNotNull())
    first = rows.groupBy(F.col("Exception_ID").alias("_id")).agg(F.min("_p").alias("_min"))
    kept = rows.join(first, (F.col("Exception_ID") == F.col("_id")) & (F.col("_p") == F.col("_min")))
    reason = F.when(F.col("_p") == 1, "Low Confidence").when(F.col("_p") == 2, "Investigate").otherwise("Undefined Resolution")
    return (
        kept.withColumn("Review_Reason", reason)
        .withColumn("Review_Status", F.lit("Pending"))
        .withColumn("Added_To_Review", F.lit(run_ts))
        .withColumn("review_id", review_id(run_id))
        .drop("_p", "_id", "_min")
    )


def review_append(queue: DataFrame, routed: DataFrame) -> DataFrame:
    return queue.unionByName(routed, allowMissingColumns=True)


def review_apply(queue: DataFrame, decisions: DataFrame, run_ts: str) -> DataFrame:
    """Queue with decisions (review_id, decision, Resolution, Suggested_Step) applied."""
    d = decisions.select(
        "review_id", F.col("decision"), F.col("Resolution").alias("_res"), F.col("Suggested_Step").alias("_step")
    )
    hit = F.col("decision").isNotNull()
    action = F.when(F.col("decision") == "purge", ACTIONS["purge"]).otherwise(ACTIONS["reprocess"])
    return queue.join(d, "review_id", "left").withColumns({
        "Review_Status": F.when(hit, "Completed").otherwise(F.col("Review_Status")),
        "Review_Action": F.when(hit, action).otherwise(F.col("Review_Action")),
        "Review_Timestamp": F.when(hit, run_ts).otherwise(F.col("Review_Timestamp")),
        "User_Resolution": F.when(hit, text.text("_res")).otherwise(F.col("User_Resolution")),
        "User_Suggested_Step": F.when(hit, text.text("_step")).otherwise(F.col("User_Suggested_Step")),
    }).drop("decision", "_res", "_step")


def review_filter(queue: DataFrame, search: str = "", resolution: str = "All", etype: str = "All", module: str = "All", wanted_status: str = "All") -> DataFrame:
    """Rows whose id contains `search` (case does not count) and whose fields equal the given values."""
    out = queue
    if search:
        out = out.filter(F.lower("Exception_ID").contains(search.lower()))
    for column, value in [("Resolution", resolution), ("Exception_Type", etype), ("Module", module)]:
        if value != "All":
            out = out.filter(F.col(column) == value)
    return out if wanted_status == "All" else out.filter(status() == wanted_status)


def results_filter(results: DataFrame, search: str = "", resolution: str = "All", etype: str = "All", low_confidence: int | None = None) -> DataFrame:
    out = review_filter(results, search, resolution, etype)
    return out if low_confidence is None else out.filter(F.col("Confidence_Score") <= low_confidence)


def results_display(results: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """YES or NO for the review flag and, given an order, a row number from 1."""
    shown = results.withColumn("Requires_Review", F.when(F.col("Requires_Review"), "YES").otherwise("NO"))
    return dense_number(shown, order_by, "_n").withColumn("Row", F.col("_n") + 1).drop("_n") if order_by else shown


def review_display(queue: DataFrame) -> DataFrame:
    """The shown columns that exist; user fields as text, without `None`."""
    def shown(name: str) -> Column:
        if name in ("User_Resolution", "User_Suggested_Step"):
            return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("None")), F.lit("")).alias(name)
        return F.col(name)

    return queue.select("review_id", *[shown(c) for c in REVIEW_DISPLAY_COLUMNS if c in queue.columns])


def review_clear(queue: DataFrame) -> DataFrame:
    return queue.filter(status() != "Completed")


def review_totals(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status() == "Pending").alias("pending"), F.count_if(status() == "Completed").alias("completed")
    )


def review_page(queue: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    return queue.orderBy("review_id").offset(page * size).limit(size)


def review_page_after(queue: DataFrame, last_id: str, size: int = PAGE_SIZE) -> DataFrame:
    """Next page by key: a deep page costs no more than the first."""
    return queue.filter(F.col("review_id") > last_id).orderBy("review_id").limit(size)


def review_report(queue: DataFrame, run_ts: str) -> DataFrame:
    """One row: totals and counts per module and per resolution, as JSON."""
    counts = queue.groupBy("Module", "Resolution", status().alias("_s")).agg(F.count(F.lit(1)).alias("n"))

    def per(column: str) -> DataFrame:
        by = counts.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
        return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("n"))))).alias("m"))

    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum(F.when(F.col("_s") == "Pending", F.col("n"))), F.lit(0)).alias("pending"),
        F.coalesce(F.sum(F.when(F.col("_s") == "Completed", F.col("n"))), F.lit(0)).alias("completed"),
    )
    one = F.lit(1).alias("_one")
    joined = (
        totals.select("*", one).join(per("Module").select(F.col("m").alias("modules"), one), "_one")
        .join(per("Resolution").select(F.col("m").alias("resolutions"), one), "_one").drop("_one")
    )
    return joined.select(F.to_json(F.struct(F.lit(run_ts).alias("timestamp"), "total_items", "pending", "completed", "modules", "resolutions")).alias("report"))


def review_to_kb(queue: DataFrame, decisions: DataFrame, run_ts: str) -> tuple[DataFrame, DataFrame]:
    """(knowledge-base file rows, rejected rows) from decided queue rows.

    The reviewer's resolution and step replace the model's; the payload is rebuilt when missing. Rows
    without both fields are rejected, not saved.
    """
    d = decisions.select("review_id", F.col("Resolution").alias("_res"), F.col("Suggested_Step").alias("_step"))
    rows = queue.join(d, "review_id")
    complete = (text.text("_res") != "") & (text.text("_step") != "")
    rebuilt = F.to_json(F.struct(F.struct(
        F.coalesce("Exception_Type", F.lit("Unknown")).alias("Exception Type"), text.text("Exception_Message").alias("Message"), text.text("Stack_Trace").alias("StackTrace")
    ).alias("Exception")))
    payload = F.coalesce(text.present("EVENT_INFORMATION"), rebuilt) if "EVENT_INFORMATION" in queue.columns else rebuilt
    entries = rows.filter(complete).select(
        "review_id", "row_ord", "Exception_ID", "Module", "Exception_Type", "Exception_Message", "Stack_Trace",
        F.col("_res").alias("Resolution"), "Root_Cause", F.col("_step").alias("Suggested Step"), "Confidence_Score",
        payload.alias("EVENT_INFORMATION"), F.lit("User").alias("Reviewed_By"), F.lit(run_ts).alias("Review_Date"), F.lit(run_ts).alias("Added_At"),
    )
    return entries, rows.filter(~complete).select("review_id", F.lit("Resolution and Suggested Step are required").alias("reason"))
