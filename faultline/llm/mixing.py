"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, scaled by its quality weight (Efraimidis and Spirakis): the
smaller the key, the earlier it is taken. A source's target holds whole epochs first; what is left
of the target is filled in key order until the budget is reached, and one more document that closes
the remaining gap best may follow. Documents are taken whole.

A source may hold any share of the rows. Sizes are summed per source and slice of the key, so the slice
in which the budget ends is known from sums; only that slice is ordered. The outcome is a
threshold per source, applied to the documents without moving their texts.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; rows equal in
id and text share a key and are taken together; a source without words has target 0 and documents
of size 0 take 0 words (`copies` follows their key all the same); an empty table gives no rows. Names that
clash are no problem: only `doc_id`, `text` and `source` are read, and helper columns start with `_mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline.llm.common import WORD, bucket_count
from faultline.session import saved

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Total of the mix and the most of one source, in sizes of the input.
SHARE, MOST = 1.5, 2.0
#: Up to this many sources (some 10 MB) their table is sent to all tasks.
MOST_SENT = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight from 1 to 3: the share of letters and spaces in the text, squared, above 1 (symbols and digits lower it)."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    share = kept / F.greatest(F.length(text), F.lit(1))
    return F.round(F.coalesce(1 + 2 * share * share, F.lit(1.0)), 6)


def draw(doc_id: Column, text: Column) -> Column:
    """Uniform number in (0, 1) from the digest of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """Adds `_mix_source`, `_mix_size` and `_mix_key` = -ln(uniform) / weight (weights are 1 or more)."""
    w = quality(F.col("text")) if weight is None else weight
    return docs.withColumns({
        "_mix_source": F.col("source"),
        "_mix_size": n_words(F.col("text")),
        "_mix_key": F.round(-F.log(draw(F.col("doc_id"), F.col("text"))) / w, 12),
    })


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source from (`_mix_source`, `_mix_total`): shares by weight, capped, the excess reshared.

    One row per source. With sources ordered by cap / weight, the capped ones come first; the level is
    what is left for the others by weight, at the first place where the next source stays below its cap.
    """
    place = F.row_number().over(W.orderBy(F.col("_mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_mix_weight", weight).withColumn("_mix_cap", most * F.col("_mix_total"))
    order = W.orderBy((F.col("_mix_cap") / F.col("_mix_weight")).asc(), F.col("_mix_source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("_mix_total").over(everything) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))
    heavy = F.sum("_mix_weight").over(everything) - F.coalesce(F.sum("_mix_weight").over(before), F.lit(0.0))
    level = rows.withColumn("_mix_level", left / heavy)
    fits = F.col("_mix_level") * F.col("_mix_weight") <= F.col("_mix_cap")
    level = level.withColumn("_mix_level", F.min(F.when(fits, F.struct((F.col("_mix_cap") / F.col("_mix_weight")).alias("r"), F.col("_mix_level").alias("v")))).over(everything)["v"])
    return level.select("_mix_source", "_mix_total", F.coalesce(F.least(F.col("_mix_cap"), F.col("_mix_level") * F.col("_mix_weight")), F.col("_mix_cap")).alias("_mix_target"))


def plan(rows: DataFrame, sizes: DataFrame, slices: int, sent=F.broadcast) -> DataFrame:
    """One row per source: target, whole epochs, and up to which key the rest is taken, with the document closing the gap.

    `sent` is applied to tables of a row per source before they are joined.
    """
    epochs = F.when(F.col("_mix_total") > 0, F.floor(F.col("_mix_target") / F.col("_mix_total"))).otherwise(0)
    goal = targets(sizes).withColumn("_mix_epochs", epochs.cast("int"))
    goal = saved(goal.withColumn("_mix_rest", F.col("_mix_target") - F.col("_mix_epochs") * F.col("_mix_total")))
    src = rows.withColumn("_mix_slice", slice_of(slices))
    same = lambda a, b: a["_mix_source"].eqNullSafe(b["_mix_source"])

    per = src.groupBy("_mix_source", "_mix_slice").agg(F.sum("_mix_size").alias("_s"))
    run = W.partitionBy("_mix_source").orderBy("_mix_slice")
    per = per.withColumn("_upto", F.sum("_s").over(run)).alias("p")
    met = per.join(sent(goal.select("_mix_source", "_mix_rest").alias("g")), same_named("p", "g")).where("_upto > _mix_rest")
    edge = saved(met.groupBy(F.col("p._mix_source").alias("_mix_source")).agg(
        F.min("_mix_slice").alias("_edge"), F.min_by(F.col("_upto") - F.col("_s"), "_mix_slice").alias("_full"), F.first("_mix_rest").alias("_mix_rest")))

    near = src.alias("p").join(sent(edge.alias("g")), same_named("p", "g") & (F.col("p._mix_slice") == F.col("g._edge")))
    near = near.select(F.col("p._mix_source").alias("_mix_source"), "_mix_key", "_full", "_mix_rest", F.sum("_mix_size").over(W.partitionBy("p._mix_source").orderBy("_mix_key")).alias("_in"))
    taken = F.col("_full") + F.col("_in") <= F.col("_mix_rest")
    cut = near.groupBy("_mix_source").agg(
        F.coalesce(F.max(F.when(taken, F.col("_mix_key"))), F.lit(-1.0)).alias("_upto_key"),
        (F.first("_mix_rest") - F.first("_full") - F.coalesce(F.max(F.when(taken, F.col("_in"))), F.lit(0))).alias("_gap"))
    rule = edge.select("_mix_source", "_edge").alias("p").join(cut.alias("g"), same_named("p", "g")).select("p._mix_source", "_edge", "_upto_key", "_gap")
    rule = saved(rule)

    open_ = src.alias("p").join(sent(rule.alias("g")), same_named("p", "g"))
    open_ = open_.where((F.col("_mix_slice") > F.col("_edge")) | ((F.col("_mix_slice") == F.col("_edge")) & (F.col("_mix_key") > F.col("_upto_key"))))
    off = F.abs(F.col("_mix_size") - F.col("_gap"))
    extra = open_.where(off < F.col("_gap")).groupBy(F.col("p._mix_source").alias("_mix_source")).agg(F.min_by("_mix_key", F.struct(off, F.col("_mix_key"))).alias("_extra"))
    out = goal.alias("p").join(rule.alias("g"), same_named("p", "g"), "left").join(extra.alias("x"), same_named("p", "x"), "left")
    return out.select("p._mix_source", "_mix_total", "_mix_target", "_mix_epochs", "_edge", "_upto_key", "_extra")


def same_named(a: str, b: str) -> Column:
    return F.col(f"{a}._mix_source").eqNullSafe(F.col(f"{b}._mix_source"))


def slice_of(slices: int) -> Column:
    """Slice of the key; with weights of 1 or more no slice gets more than weight / slices of the rows on average."""
    return F.floor((1 - F.exp(-F.col("_mix_key"))) * slices).cast("int")


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """All rows of `docs` with `size`, `source_size`, `target` and `copies` (how often the mix holds the document).

    Sources are counted: up to `MOST_SENT` their table (one row each) is sent to all tasks, so that no text is shuffled.
    """
    rows = saved(keyed(docs, weight).select("_mix_source", "_mix_size", "_mix_key"))
    sizes = saved(rows.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_total"), F.count(F.lit(1)).alias("_mix_rows")))
    found = sizes.agg(F.sum("_mix_rows").alias("rows"), F.count(F.lit(1)).alias("sources")).first()
    slices = bucket_count(found["rows"] or 0)
    sent = F.broadcast if found["sources"] <= MOST_SENT else lambda df: df
    rules = saved(plan(rows, sizes.drop("_mix_rows"), slices, sent).withColumnRenamed("_mix_source", "_mix_of"))
    out = keyed(docs, weight).withColumn("_mix_slice", slice_of(slices))
    out = out.join(sent(rules), F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
    drawn = (F.col("_mix_slice") < F.col("_edge")) | ((F.col("_mix_slice") == F.col("_edge")) & (F.col("_mix_key") <= F.col("_upto_key"))) | (F.col("_mix_key") == F.col("_extra"))
    copies = F.col("_mix_epochs") + F.coalesce(drawn, F.lit(False)).cast("int")
    return out.select(
        *[docs[c] for c in docs.columns if c not in ("size", "source_size", "target", "copies")],
        F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), copies.alias("copies"))
