"""Reports over results and over the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import short_label
from faultline.schemas import HIGH_CONFIDENCE, REVIEW_THRESHOLD

BINS, BIN_WIDTH = 20, 5


def is_resolution(name: str) -> Column:
    return F.col("Resolution") == name


def share(n: Column, total: Column) -> Column:
    return F.round(n / total * 100, 4)


def run_stats(results: DataFrame) -> DataFrame:
    """Totals, mean confidence, count and share per resolution: one aggregate."""
    total = F.count(F.lit(1))
    cols = [total.alias("total"), F.count_if("Requires_Review").alias("review_count"), F.round(F.avg("Confidence_Score"), 4).alias("avg_confidence")]
    for name in ("PURGE", "REPROCESS", "INVESTIGATE"):
        n = F.count_if(is_resolution(name))
        cols += [n.alias(f"{name.lower()}_count"), share(n, total).alias(f"{name.lower()}_pct")]
    return results.agg(*cols)


def audit_entry(results: DataFrame, review_count: Column, file_name: str, module: str, run_ts: str, seconds: float) -> DataFrame:
    """One audit row about a run; `review_count` is an aggregate over the results."""
    return results.agg(
        F.lit(run_ts).cast("timestamp_ntz").alias("Upload_DateTime"), F.lit(file_name).alias("File_Name"), F.lit(module).alias("Module"),
        F.count(F.lit(1)).alias("Total_Records"),
        F.count_if(is_resolution("REPROCESS")).alias("Reprocess_Count"), F.count_if(is_resolution("PURGE")).alias("Purge_Count"),
        F.count_if(is_resolution("INVESTIGATE")).alias("Investigate_Count"), review_count.alias("Review_Count"),
        F.round(F.coalesce(F.avg("Confidence_Score"), F.lit(0.0)), 2).alias("Avg_Confidence"),
        F.round(F.lit(float(seconds) / 60), 2).alias("Processing_Time_Minutes"),
    )


def kpis(results: DataFrame) -> DataFrame:
    auto = ~F.col("Requires_Review")
    return results.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if("Requires_Review").alias("review_required"),
        F.count_if(auto & is_resolution("PURGE")).alias("auto_purged"), F.count_if(auto & is_resolution("INVESTIGATE")).alias("investigate"),
        F.round(F.avg("Confidence_Score"), 4).alias("avg_confidence"),
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values by falling count (ties by value); nulls are not counted."""
    out = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out.limit(n) if n else out


def top_types(results: DataFrame, n: int = 10) -> DataFrame:
    return value_counts(results, "Exception_Type", n).withColumn("label", short_label("Exception_Type"))


def confidence_histogram(results: DataFrame) -> DataFrame:
    """20 bins of five points over 0-100, the last one closed."""
    b = F.least(F.floor(F.col("Confidence_Score") / BIN_WIDTH), F.lit(BINS - 1)).cast("int")
    return results.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def review_required(results: DataFrame, threshold: int = REVIEW_THRESHOLD) -> DataFrame:
    """Distinct ids needing review (two-step), and rows of high and of low confidence."""
    needs = is_resolution("INVESTIGATE") | (F.col("Confidence_Score") <= threshold)
    per_id = results.groupBy("Exception_ID").agg(
        F.max(needs).alias("_needs"), F.count_if(F.col("Confidence_Score") >= HIGH_CONFIDENCE).alias("_high"), F.count_if(F.col("Confidence_Score") <= threshold).alias("_low")
    )
    return per_id.agg(F.count_if("_needs").alias("needs_review"), F.sum("_high").alias("high_confidence"), F.sum("_low").alias("low_confidence"))


def insights(results: DataFrame) -> DataFrame:
    """One row per finding, in order."""
    per_type = results.groupBy("Exception_Type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Confidence_Score").alias("conf"), F.count("Confidence_Score").alias("n_conf"),
        F.count_if(is_resolution("INVESTIGATE")).alias("inv"), F.count_if(is_resolution("PURGE")).alias("purge"),
    )
    named = F.col("Exception_Type").isNotNull()
    one = per_type.agg(
        F.sum("n").alias("total"), (F.sum("conf") / F.sum("n_conf")).alias("mean"), F.sum("inv").alias("inv"), F.sum("purge").alias("purge"),
        F.min(F.when(named, F.struct((-F.col("n")).alias("neg"), F.col("Exception_Type").alias("t")))).alias("top"),
    )
    top_n = -F.col("top.neg")
    inv_pct, purge_pct = F.col("inv") / F.col("total") * 100, F.col("purge") / F.col("total") * 100
    found = F.array_compact(F.array(
        F.when(F.col("mean") >= 80, "Answers are confident on average")
        .when(F.col("mean") >= 60, "Answers are fairly confident; more known cases would help")
        .otherwise("Answers are unsure; the knowledge base lacks cases"),
        F.when(inv_pct > 30, F.format_string("%.1f%% of the exceptions are left to people", inv_pct)),
        F.when(purge_pct > 50, F.format_string("%.1f%% of the exceptions can be purged", purge_pct)),
        F.when(top_n > F.col("total") * 0.2, F.concat(F.lit("Most frequent type: "), F.col("top.t"), F.lit(", "), top_n.cast("string"), F.lit(" times"))),
    ))
    nothing = F.array(F.lit("There are no results"))
    return one.select(F.posexplode(F.when(F.coalesce("total", F.lit(0)) == 0, nothing).otherwise(found)).alias("position", "insight"))


def summary_json(results: DataFrame, module: str, run_ts: str, threshold: int = REVIEW_THRESHOLD) -> DataFrame:
    """Run summary as one JSON text."""
    needs = is_resolution("INVESTIGATE") | (F.col("Confidence_Score") <= threshold)
    per_id = results.groupBy("Exception_ID").agg(
        F.max(needs).alias("_needs"), F.count(F.lit(1)).alias("n"), F.sum("Confidence_Score").alias("conf"),
        *[F.count_if(is_resolution(r)).alias(r) for r in ("REPROCESS", "PURGE", "INVESTIGATE")],
    )
    one = per_id.agg(
        F.sum("n").alias("Total_Exceptions"), F.sum("REPROCESS").alias("Reprocess_Count"), F.sum("PURGE").alias("Purge_Count"),
        F.sum("INVESTIGATE").alias("Investigate_Count"), F.count_if("_needs").alias("Needs_Review_Count"),
        F.format_string("%.1f%%", F.sum("conf") / F.sum("n")).alias("Avg_Confidence"),
    )
    return one.select(F.to_json(F.struct(F.lit(module).alias("Module"), F.lit(run_ts).alias("Processing_Date"), *one.columns)).alias("summary"))


# --- audit log ------------------------------------------------------------------------------------

def audit_filter(audit: DataFrame, run_ts: str, days: int | None = None, module: str = "All") -> DataFrame:
    out = audit
    if days is not None:
        out = out.filter(F.col("Upload_DateTime") >= F.expr(f"TIMESTAMP_NTZ '{run_ts}' - INTERVAL {int(days)} DAYS"))
    return out if module == "All" else out.filter(F.col("Module") == module)


def audit_sorted(audit: DataFrame, by: str = "Newest First") -> DataFrame:
    keys = {
        "Newest First": [F.desc("Upload_DateTime")], "Oldest First": [F.asc("Upload_DateTime")], "Most Records": [F.desc("Total_Records")],
    }[by]
    return audit.orderBy(*keys, "File_Name")


def audit_by_module(audit: DataFrame) -> DataFrame:
    return audit.groupBy("Module").agg(*[F.sum(c).alias(c) for c in ("Purge_Count", "Reprocess_Count", "Investigate_Count")])


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("total_uploads"), F.sum("Total_Records").alias("total_records"), F.round(F.avg("Avg_Confidence"), 4).alias("avg_confidence"),
        F.sum("Review_Count").alias("total_review"), F.sum("Reprocess_Count").alias("total_reprocess"),
    )


def audit_display(audit: DataFrame) -> DataFrame:
    minutes = F.col("Processing_Time_Minutes")
    clock = F.format_string("%d:%02d", F.floor(minutes), F.floor((minutes % 1) * 60))
    return audit.select(
        F.date_format("Upload_DateTime", "yyyy-MM-dd HH:mm:ss").alias("Date & Time"), F.col("File_Name").alias("File Name"), "Module",
        F.when(minutes.isNull(), "0:00").otherwise(clock).alias("Time (MM:SS)"), F.col("Total_Records").alias("Total Records"),
        F.col("Reprocess_Count").alias("Reprocess"), F.col("Purge_Count").alias("Purge"), F.col("Investigate_Count").alias("Investigate"),
        F.col("Review_Count").alias("Review Queue"), F.col("Avg_Confidence").alias("Avg Confidence %"),
    )


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
