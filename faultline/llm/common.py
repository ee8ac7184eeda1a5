"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space between words in the contracts of the operators.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal id modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bucket_count(rows: int) -> int:
    """Buckets for two-level numbering: as many buckets as rows in one, about the square root of the rows."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2))


def numbered(df: DataFrame, groups: list[str], spread: str, order_by: list[str], out: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2... by `spread` (a hash-like long), then `order_by`.

    A group may hold any share of the rows: rows are counted per slice of the hash, the counts are
    summed up over slices, and only rows of one slice are ordered together.
    """
    slices = bucket_count(df.count())
    sliced = df.withColumn("_slice", F.floor((F.col(spread) / 2.0**64 + 0.5) * slices).cast("int"))
    by = [*groups, "_slice"]
    earlier = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sliced.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by).orderBy(spread, *order_by)) - 1
    return sliced.withColumn("_in", inside).join(offsets, by).withColumn(out, F.col("_before") + F.col("_in")).drop("_slice", "_before", "_in")


class Memo(dict):
    """A function's values by argument; `map(memo.__getitem__, items)` fills it. Call `trim` between batches.

    Of two generations, the older one goes when the newer is full; what is asked for again moves to the newer.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def fill(self, keys, make_all) -> None:
        """Takes in the values of keys that are missing here, those that are new made together."""
        new = []
        for key in keys:
            value = self.older.get(key)
            if value is None:
                new.append(key)
            else:
                self[key] = value
        if new:
            self.update(zip(new, make_all(new)))

    def trim(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()


def key_of_row() -> dict[str, Column]:
    """A row's identity for joining decisions back: its id and a digest of its text (nulls told apart)."""
    return {"_key_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_key_text": F.coalesce(F.xxhash64("text"), F.lit(0))}


def sized_join(rows: DataFrame, keys: DataFrame, how: str, most: int = 500_000) -> DataFrame:
    """Semi or anti join of documents with (`_key_id`, `_key_text`); the texts stay in place if the keys are few.

    The keys are counted: up to `most` (some 30 MB) they are sent to all tasks, beyond that both sides are shuffled.
    """
    keys = keys.select("_key_id", "_key_text")
    if keys.limit(most + 1).count() <= most:
        keys = F.broadcast(keys)
    return rows.withColumns(key_of_row()).join(keys, ["_key_id", "_key_text"], how).drop("_key_id", "_key_text")


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator needs, all others in one struct `_row`, whatever their names; `unpacked` gives them back."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*[F.col(f"`{c}`").alias(c) for c in rest]).alias("_row")] if rest else []))


def unpacked(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of `docs` from packed rows."""
    return rows.select(*[F.col(c) if c in needed else F.col("_row").getField(c).alias(c) for c in docs.columns])
