"""Cleaning of an exception table and feature extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import events, text
from faultline.schemas import PROCESS_NAME_COLUMNS, RESOLUTIONS, SEVERITIES


def flatten_event(df: DataFrame, raw: str = "EVENT_INFORMATION") -> DataFrame:
    """Add the five flattened payload columns; the payload is parsed once per row."""
    parsed = events.with_payload(df, raw)
    return parsed.withColumns(events.flat_columns(raw, F.col("_v"))).drop("_v")


def clean_exceptions(df: DataFrame, run_ts: str, module: str | None = None, short_ids: bool = False) -> DataFrame:
    """Distinct rows, trimmed column names, flattened payload, and defaults for absent columns.

    `run_ts` stands for "now"; `module` fills the module when the table carries no hint of it. Without a
    sequence number or id, a row's id is a digest of all its columns; `short_ids` gives the short id of its kind
    instead, which rows of equal module, type and message share.
    """
    df = df.dropDuplicates()
    df = df.toDF(*[c.strip() for c in df.columns])
    source = df.columns
    for name in PROCESS_NAME_COLUMNS[1:]:
        if name in df.columns and "Process_Name" not in df.columns:
            df = df.withColumnRenamed(name, "Process_Name")
    if "EVENT_INFORMATION" in df.columns:
        has_name = "Process_Name" in df.columns
        df = events.with_payload(df, "EVENT_INFORMATION")
        added = events.flat_columns("EVENT_INFORMATION", F.col("_v"))
        if not has_name:
            added["Process_Name"] = F.when(events.is_record(F.col("_v")), events.first_of_keys(F.col("_v"))).otherwise("Unknown")
        df = df.withColumns(added).drop("_v")
    has = set(df.columns)

    def have(name: str) -> Column:
        return F.col(name) if name in has else F.lit(None).cast("string")

    if "Exception_ID" not in has:
        hashed = text.exception_id(have("Module"), have("Exception_Type"), have("Exception_Message")) if short_ids else text.row_id(source)
        df = df.withColumn("Exception_ID", F.col("LOG_SEQ_NO").cast("string") if "LOG_SEQ_NO" in has else hashed)
    if "Timestamp" not in has:
        df = df.withColumn("Timestamp", F.col("LOGTIME").cast("string") if "LOGTIME" in has else F.lit(run_ts))
    if "Module" not in has:
        if "TITLE" in has:
            found = text.module_from_title("TITLE")
        elif "PRCS_NAME" in has:
            found = text.module_from_process("PRCS_NAME")
        else:
            found = F.lit(module or "Unknown")
        df = df.withColumn("Module", found)
    return df


def features(df: DataFrame) -> DataFrame:
    """Add the `Features` struct: 13 fields with defaults, three optional ones nullable."""
    has = set(df.columns)

    def pick(default: object, *names: str) -> Column:
        found = [n for n in names if n in has]
        return F.col(found[0]) if found else F.lit(default)

    message = text.text(pick("", "Exception_Message"))
    return df.withColumn("Features", F.struct(
        pick("Unknown", "Exception_ID").cast("string").alias("exception_id"),
        pick("Unknown", "Module").alias("module"),
        pick("Unknown", "Exception_Type").alias("exception_type"),
        pick("", "Exception_Message").alias("message"),
        pick("MEDIUM", "SEVERITY", "Severity").alias("severity"),
        pick(5, "PRIORITY", "Priority").cast("string").alias("priority"),
        pick(1, "Occurrence_Count").cast("bigint").alias("frequency"),
        pick("Unknown", "MACHINE_NAME").alias("machine_name"),
        pick("Unknown", "PRCS_NAME", "Process_Name").alias("process_name"),
        pick("", "Timestamp").cast("string").alias("timestamp"),
        pick("", "Error_Code").alias("error_code"),
        pick("", "Stack_Trace").alias("stack_trace"),
        pick("", "Inner_Exception").alias("inner_exception"),
        text.error_indicators(message).alias("error_indicators"),
        F.when(text.is_constraint_violation(message), True).alias("is_constraint_violation"),
        F.when(text.is_null_issue(message), True).alias("is_null_issue"),
    ))


def full_error(message: Column, inner_type: Column, inner_msg: Column, code: Column, fallback: Column) -> Column:
    """Message followed by the inner exception's parts; the row's own message when all are empty."""
    def part(label: str, c: Column) -> Column:
        return F.when(text.text(c) != "", F.concat(F.lit(label), c))

    inner = F.concat_ws(" | ", part("Inner Exception: ", inner_type), part("Inner Message: ", inner_msg), part("Error Code: ", code))
    parts = F.concat_ws(" ", text.present(message), F.when(inner != "", F.concat(F.lit(" | "), inner)))
    return F.coalesce(text.present(parts), text.text(fallback))


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).dropDuplicates()


def schema_check(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: which required columns are missing, and whether the table is acceptable."""
    missing = sorted(set(required) - set(df.columns))
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("n_rows", F.lit(", ".join(missing)).alias("missing_columns"), F.lit(not missing).alias("valid"))


def enum_check(df: DataFrame, resolution: str = "Resolution", severity: str = "Severity") -> DataFrame:
    """Rows per undeclared resolution or severity value."""
    bad_r = F.when(~text.text(resolution).isin(*RESOLUTIONS), F.struct(F.lit("Resolution").alias("field"), text.text(resolution).alias("bad_value")))
    bad_s = F.when(~text.text(severity).isin(*SEVERITIES), F.struct(F.lit("Severity").alias("field"), text.text(severity).alias("bad_value")))
    return (
        df.select(F.explode(F.array_compact(F.array(bad_r, bad_s))).alias("b"))
        .groupBy(F.col("b.field").alias("field"), F.col("b.bad_value").alias("bad_value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
