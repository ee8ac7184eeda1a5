"""Signature grouping and representatives.

"First" always means smallest `row_ord`. First-per-key filters keep one row per key and map task before
the shuffle (window group limit), and every list that is gathered is bounded before it is gathered, so a
key holding a third of the rows costs no more than its share of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline.functions import text
from faultline.session import dense_number

MAX_MACHINES = 5
MAX_LISTED_IDS = 100


def first_per(df: DataFrame, keys: list[str], order: list[str | Column] = ["row_ord"], n: int = 1, rank: str | None = None) -> DataFrame:
    """First `n` rows per key in the given order."""
    out = rank or "_rn"
    kept = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)
    return kept if rank else kept.drop(out)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def with_signature(df: DataFrame, out: str = "signature") -> DataFrame:
    return df.withColumn(out, text.message_signature("Exception_Message", "Error_Code"))


def signature_dedup(df: DataFrame) -> DataFrame:
    return first_per(with_signature(df), ["Module", "Exception_Type", "signature"])


def signature_groups(df: DataFrame) -> DataFrame:
    """Add `Exception_Group` = G{n}, numbered by module, type and first appearance.

    Only the distinct keys are numbered; the rows get their number by a join.
    """
    keys = ["Module", "Exception_Type", "signature"]
    rows = with_signature(df)
    firsts = rows.groupBy(*keys).agg(F.min("row_ord").alias("_first"))
    order = [F.col("Module").asc_nulls_last(), F.col("Exception_Type").asc_nulls_last(), F.col("_first")]
    numbered = dense_number(firsts, order, "_n")
    named = numbered.select(*keys, F.concat(F.lit("G"), F.col("_n").cast("string")).alias("Exception_Group"))
    return null_safe_join(rows, named, keys)


def group_totals(df: DataFrame, group: str, time: str = "Timestamp") -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("Occurrence_Count"), F.min(time).alias("First_Seen"), F.max(time).alias("Last_Seen")
    )


def machine_table(df: DataFrame, group: str, machine: str = "MACHINE_NAME") -> DataFrame:
    """(group, machine, first row_ord): all machines of every group, one row each."""
    return df.groupBy(group, F.coalesce(F.col(machine).cast("string"), F.lit("nan")).alias(machine)).agg(F.min("row_ord").alias("first_ord"))


def id_table(df: DataFrame, group: str) -> DataFrame:
    """(group, Exception_ID): all ids of every group, one row each; the table that results are expanded by."""
    return df.select(group, F.col("Exception_ID").cast("string").alias("Exception_ID")).distinct()


def group_machines(df: DataFrame, group: str, machine: str = "MACHINE_NAME", shown: int = MAX_MACHINES) -> DataFrame:
    """The first `shown` distinct machines per group in order of appearance; `machine_table` has all of them."""
    seen = machine_table(df, group, machine).select(group, F.col(machine).alias("_m"), F.col("first_ord").alias("_first"))
    top = first_per(seen, [group], ["_first"], shown)
    return top.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_m"))), lambda x: x["_m"]), ", ").alias("Affected_Machines")
    )


def compress_groups(df: DataFrame, group: str = "Exception_Group") -> DataFrame:
    """First row of every group with count, first/last seen and machines."""
    out = first_per(df, [group]).join(group_totals(df, group), group)
    return out.join(group_machines(df, group), group, "left") if "MACHINE_NAME" in df.columns else out


def listed_ids(df: DataFrame, group: str, limit: int) -> DataFrame:
    """Distinct ids per group: their number, and the sorted list when there are at most `limit`.

    Larger groups get a short text instead, so the list that is gathered never exceeds `limit` items;
    `id_table` has all ids, and `limit=0` gives every group the short text.
    """
    pairs = id_table(df, group)
    counts = pairs.groupBy(group).agg(F.count("Exception_ID").alias("n_ids"))
    listed = first_per(pairs, [group], ["Exception_ID"], limit).groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_list("Exception_ID")), "|").alias("_ids")
    )
    label = F.concat(F.col(group), F.lit(" ("), F.col("n_ids").cast("string"), F.lit(" exceptions)"))
    return counts.join(listed, group, "left").select(
        group, "n_ids", F.when(F.col("n_ids") <= limit, F.col("_ids")).otherwise(label).alias("Original_Exception_IDs")
    )


def representatives(df: DataFrame, group: str = "Dedup_Group_ID", listed: int = MAX_LISTED_IDS) -> DataFrame:
    """Representative of every near-duplicate group: first row, counts, ids (listed up to `listed`), machines."""
    base = compress_groups(df, group).withColumn("Dedup_Count", F.col("Occurrence_Count"))
    ids = listed_ids(df, group, listed).select(group, "Original_Exception_IDs")
    return base.join(ids, group)


def unique_for_dev(df: DataFrame) -> DataFrame:
    """One row per group, or per comparison signature when the rows are not grouped."""
    if "Dedup_Group_ID" in df.columns:
        return first_per(df, ["Dedup_Group_ID"])
    key = text.dedup_key("Exception_Type", text.normalize_message("Exception_Message"), "Error_Code")
    signed = first_per(df.withColumn("_key", key), ["_key"])
    return signed.withColumn("Signature", F.substring("_key", 1, text.SHOWN_DIGITS)).drop("_key")


def expand_groups(results: DataFrame, bridge: DataFrame, limit: int = 10) -> DataFrame:
    """Give every original exception its group's result; an id met in several groups keeps the first.

    `results` holds one row per group (`row_ord` = group order) or ungrouped rows; `bridge` holds
    (Dedup_Group_ID, Exception_ID).
    """
    group = "Dedup_Group_ID"
    members = bridge.select(group, F.col("Exception_ID").cast("string").alias("_member")).distinct()
    stats = listed_ids(bridge, group, limit).withColumnRenamed("Original_Exception_IDs", "_listed")
    own = results.withColumnRenamed("Exception_ID", "_own_id").withColumnRenamed("Dedup_Count", "_own_count").withColumnRenamed(
        "Original_Exception_IDs", "_own_ids"
    )
    per_group = own.join(stats, group, "left")
    rows = per_group.join(members, group, "left").withColumn("Exception_ID", F.coalesce("_member", F.col("_own_id").cast("string")))
    first = rows.groupBy("Exception_ID").agg(F.min("row_ord").alias("_first"))
    kept = rows.join(first.withColumnRenamed("Exception_ID", "_fid"), (F.col("Exception_ID") == F.col("_fid")) & (F.col("row_ord") == F.col("_first")))
    return (
        kept.withColumn("Dedup_Count", F.coalesce("n_ids", F.col("_own_count").cast("bigint")))
        .withColumn("Original_Exception_IDs", F.coalesce("_listed", "_own_ids"))
        .drop("_member", "_own_id", "_own_count", "_own_ids", "_listed", "n_ids", "_fid", "_first")
    )
