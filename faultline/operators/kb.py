"""The knowledge base: normalising files, building entries, appending, reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import events, scoring, text
from faultline.operators.grouping import first_per
from faultline.schemas import KB_ALIASES, STANDARD_MODULES

PRIMARY_HEADING = "# What happened"
SECONDARY_HEADING = "\n# What was done"
DETAILS = events.DETAIL_FIELDS


def kb_normalize(df: DataFrame) -> DataFrame:
    """Give every stored column the value of its first alias present in the file."""
    added = {}
    for target, aliases in KB_ALIASES.items():
        source = next((a for a in aliases if a in df.columns), None)
        if target not in df.columns:
            added[target] = F.col(f"`{source}`") if source else F.lit(None).cast("string")
    return df.withColumns(added) if added else df


def with_details(df: DataFrame) -> DataFrame:
    """Add the struct `d` of six fields from the payload, repaired or picked by pattern if need be."""
    parsed = events.with_payload(df, "EVENT_INFORMATION", repair=True)
    return text.once(parsed, "d", events.details_or_fallback("EVENT_INFORMATION", F.col("_v"))).drop("_v")


def admitted() -> Column:
    """A row needs a payload and an exception type found in it."""
    return (text.text("EVENT_INFORMATION") != "") & (text.text("d.exception_type") != "")


def kb_rejects(df: DataFrame) -> DataFrame:
    """Rows that cannot become entries, with the reason."""
    reason = F.when(text.text("EVENT_INFORMATION") == "", "EVENT_INFORMATION missing").otherwise("no exception type")
    return with_details(kb_normalize(df)).filter(~admitted()).withColumn("reason", reason)


def _line(label: str, value: Column, cap: int | None = None) -> Column:
    shown = F.substring(value, 1, cap) if cap else value
    return F.when(text.text(value) != "", F.concat(F.lit(label), shown))


def primary_lines(d: Column, caps: dict[str, int] | None = None) -> list[Column]:
    caps = caps or {}
    labels = ["Exception Type: ", "Message: ", "Stack Trace: ", "Inner Exception: ", "Inner Message: ", "Error Code: "]
    return [_line(label, d[name], caps.get(name)) for label, name in zip(labels, DETAILS)]


def kb_document(d: Column, resolution: Column, root_cause: Column, action: Column) -> Column:
    return F.concat_ws(
        "\n", F.lit(PRIMARY_HEADING), *primary_lines(d), F.lit(SECONDARY_HEADING),
        _line("Resolution: ", resolution), _line("Root Cause: ", root_cause), _line("Action: ", action),
    )


def search_text(d: Column, caps: dict[str, int] | None = None) -> Column:
    """Search text of an exception, null when there is nothing to search for.

    Whole fields; `caps` shortens single ones, for embedders that read a limited number of characters.
    """
    lines = F.concat_ws("\n", *primary_lines(d, caps))
    return F.when(lines != "", F.concat_ws("\n", F.lit(PRIMARY_HEADING), lines))


def kb_signature(d: Column, resolution: Column, action: Column) -> Column:
    def low(c: Column) -> Column:
        return text.strip(F.lower(text.text(c)))

    return F.md5(F.concat_ws(
        "|", low(d["exception_type"]), low(d["message"]), low(d["stack_trace"]),
        text.strip(F.upper(text.text(resolution))), low(action),
    ))


def _step(df: DataFrame) -> str:
    return "`Suggested Step`" if "Suggested Step" in df.columns else "Action"


def kb_candidates(df: DataFrame) -> DataFrame:
    """Admitted rows as entries, repeats included. Needs `row_ord` and `Module`."""
    df = kb_normalize(df)
    d = F.col("d")
    step = F.col(_step(df))
    process = F.col("Process_Name") if "Process_Name" in df.columns else F.lit("")
    added_at = F.col("Added_At") if "Added_At" in df.columns else F.lit(None).cast("string")
    return with_details(df).filter(admitted()).select(
        "row_ord",
        F.col("Module").alias("module"),
        d["exception_type"].alias("exception_type"),
        d["message"].alias("exception_message"),
        scoring.normalize_resolution("Resolution").alias("resolution"),
        text.text("Root_Cause").alias("root_cause"),
        text.text("Action").alias("action"),
        d["stack_trace"].alias("stack_trace"),
        d["inner_exception_type"].alias("inner_exception_type"),
        d["inner_exception_message"].alias("inner_exception_message"),
        d["error_code"].alias("error_code"),
        text.text(process).alias("process_name"),
        added_at.alias("added_at"),
        kb_document(d, F.col("Resolution"), F.col("Root_Cause"), F.col("Action")).alias("document"),
        kb_signature(d, F.col("Resolution"), step).alias("signature"),
    )


def entry_id(tag: str | None) -> Column:
    """Ids of a build carry the row's order, appended ones the whole signature, so that none is met twice."""
    if tag:
        return F.concat_ws("_", "module", F.lit(tag), "signature")
    return F.concat_ws("_", "module", F.col("row_ord").cast("string"), F.substring("signature", 1, 8))


def _first_entries(df: DataFrame) -> DataFrame:
    """First entry per module and signature. Of rows alike in all that a signature is made of, only the first is parsed."""
    df = kb_normalize(df)
    raw = first_per(df, ["Module", "EVENT_INFORMATION", "Resolution", _step(df)])
    return first_per(kb_candidates(raw), ["module", "signature"])


def kb_build(df: DataFrame) -> DataFrame:
    """Fresh knowledge base: first row per module and signature."""
    return _first_entries(df).withColumn("id", entry_id(None))


def kb_load_report(df: DataFrame) -> DataFrame:
    """Per module: rows, entries, repeats, rows skipped for lack of a usable payload."""
    total = df.groupBy(F.col("Module").alias("module")).agg(F.count(F.lit(1)).alias("total_rows"))
    per_key = kb_candidates(df).groupBy("module", "signature").agg(F.count(F.lit(1)).alias("n"))
    kept = per_key.groupBy("module").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("usable"))
    return total.join(kept, "module", "left").select(
        "module", "total_rows",
        F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"),
        (F.coalesce("usable", F.lit(0)) - F.coalesce("entries", F.lit(0))).cast("bigint").alias("duplicates_removed"),
        (F.col("total_rows") - F.coalesce("usable", F.lit(0))).cast("bigint").alias("skipped_no_event_info"),
    )


def kb_append(stored: DataFrame, df: DataFrame) -> DataFrame:
    """New entries only: neither stored already nor earlier in the same file."""
    fresh = _first_entries(df)
    return fresh.join(stored.select("module", "signature").distinct(), ["module", "signature"], "left_anti").withColumn(
        "id", entry_id("append")
    )


def kb_clear(stored: DataFrame, module: str) -> DataFrame:
    return stored.filter(F.col("module") != module)


def kb_export(stored: DataFrame, module: str | None = None) -> DataFrame:
    rows = stored.filter(F.col("module") == module) if module else stored
    return rows.select(
        F.col("exception_type").alias("Exception_Type"), F.col("exception_message").alias("Exception_Message"),
        F.col("resolution").alias("Resolution"), F.col("root_cause").alias("Root_Cause"),
        F.col("action").alias("Action"), F.col("document").alias("Document"),
    )


def kb_stats(stored: DataFrame) -> DataFrame:
    """Entries, distinct signatures and last update per module (two-step, so a big module is no hot spot)."""
    per_key = stored.groupBy("module", "signature").agg(F.count(F.lit(1)).alias("n"), F.max("added_at").alias("last"))
    return per_key.groupBy(F.col("module").alias("Module")).agg(
        F.sum("n").alias("Entries"), F.count(F.lit(1)).alias("Unique_Patterns"),
        F.substring(F.coalesce(F.max("last"), F.lit("Unknown")), 1, 19).alias("Last_Updated"),
    )


def module_list(stored: DataFrame) -> DataFrame:
    """Standard modules and loaded ones, each once, in order."""
    names = stored.select("module").distinct()
    standard = names.sparkSession.createDataFrame([(m,) for m in STANDARD_MODULES], "module string")
    return names.union(standard).distinct().orderBy("module")
