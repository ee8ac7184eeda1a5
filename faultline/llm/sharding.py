"""Shards of near equal bytes from a k-d tree over document metadata.

Each node is split at the weighted median (weights are bytes) of its widest dimension, until there are as
many leaves as shards. A dimension is a long: the ranked metadata in the high bits and a digest of the text
below, so that a dimension with few values still has a median. Rows of one text whose metadata differ all take the
smallest value of each dimension, so equal texts have equal coordinates and stay together. Only a group of equal texts that alone holds more than `HEAVY` of its
node is split further, by the digest of the id.

Medians come from histograms: bytes are summed per node and bin, the bin with the middle is split into
bins again, until it holds one coordinate or little weight. All nodes of a level share the jobs; only
`BINS` sums per node reach the driver, whatever the number of documents. Rows are never gathered by shard.

Defined results: a null text has no bytes, so size 1; null metadata ranks lowest; repeated rows are
separate documents with slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import numbered
from faultline.session import saved

BINS = 1024
#: A bin that holds less of its node's bytes is not split any further.
FINE = 0.0005
#: A single coordinate that holds more of its node's bytes is divided by id.
HEAVY = 0.01
_LOW = 40  # bits of the text's digest below the ranked metadata


def measured(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Narrow table: doc_id, size, text_crc32, `_id` (digest of the id), `_text` (of the text) and the dimensions `_d0`, `_d1`..."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.shiftrightunsigned(F.xxhash64(text), 64 - _LOW)
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("_id"), F.xxhash64(text).alias("_text"),
        *[(F.shiftleft(F.coalesce(d, F.lit(0)).cast("long"), _LOW) + low).alias(f"_d{i}") for i, d in enumerate(dims.values())])


def agreed(rows: DataFrame, n_dims: int) -> DataFrame:
    """`measured` rows with the same coordinates for all rows of a text; only texts whose rows differ are looked up."""
    dims = [f"_d{i}" for i in range(n_dims)]
    per = rows.groupBy("_text").agg(*[F.min(d).alias(f"{d}a") for d in dims], *[F.max(d).alias(f"{d}b") for d in dims])
    differ = saved(per.where(" or ".join(f"{d}a <> {d}b" for d in dims)).drop(*[f"{d}b" for d in dims]))
    return rows.join(differ, "_text", "left").withColumns({d: F.coalesce(f"{d}a", d) for d in dims}).drop("_text", *[f"{d}a" for d in dims])


def default_dims() -> dict[str, Column]:
    """Length on a log scale, language, and the share of bytes beyond one per character; each below 2^22."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text)
    lang = F.coalesce(F.col("lang"), F.lit(""))
    return {
        "length": F.floor(F.log(size + 1.0) * 65536),
        "lang": F.conv(F.substring(F.hex(F.concat(lang, F.lit("\0\0\0"))), 1, 6), 16, 10).cast("long") / 4,
        "wide": F.floor((size - F.length(text)) * 1_000_000.0 / F.greatest(size, F.lit(1))),
    }


def _case(values: dict[int, object], node: Column) -> Column:
    """A value per node; halves the nodes at each step."""
    keys = sorted(values)
    if len(keys) == 1:
        v = values[keys[0]]
        return v if isinstance(v, Column) else F.lit(v)
    mid = keys[len(keys) // 2]
    return F.when(node < mid, _case({k: values[k] for k in keys if k < mid}, node)).otherwise(_case({k: values[k] for k in keys if k >= mid}, node))


def _medians(rows: DataFrame, keys: dict[int, Column], spans: dict[int, tuple[int, int]], goals: dict[int, float]) -> dict[int, tuple[int, int, float, int]]:
    """For each node the coordinate v so that what lies below v weighs at most the goal, up to FINE of the node.

    Returns (v, w, below, held): below v lies `below`, and [v, w] is the last bin looked at, of weight `held` (v = w: one coordinate).
    """
    node = F.col("_node")
    spans, below, done = dict(spans), dict.fromkeys(spans, 0.0), {}
    total = {k: None for k in spans}
    while spans:
        key = _case({k: keys[k] for k in spans}, node)
        low, high = _case({k: v[0] for k, v in spans.items()}, node), _case({k: v[1] for k, v in spans.items()}, node)
        width = _case({k: max(1, -((v[0] - v[1] - 1) // BINS)) for k, v in spans.items()}, node)
        part = rows.where(node.isin(*spans)).select(node, "size", key.alias("_k"), low.alias("_a"), high.alias("_b"), width.alias("_w"))
        part = part.where("_k between _a and _b").withColumn("_bin", F.expr("(_k - _a) div _w"))
        sums = part.groupBy("_node", "_bin").agg(F.sum("size").alias("s"), F.min("_k").alias("a"), F.max("_k").alias("b")).collect()
        for k in list(spans):
            bins = sorted((r for r in sums if r["_node"] == k), key=lambda r: r["a"])
            if not bins:
                done[k] = (spans[k][0], spans.pop(k)[0], below[k], 0)
                continue
            total[k] = total[k] or sum(r["s"] for r in bins)
            for r in bins:
                if below[k] + r["s"] > goals[k] or r is bins[-1]:
                    break
                below[k] += r["s"]
            if r["a"] == r["b"] or r["s"] <= FINE * total[k]:
                done[k] = (r["a"], r["b"], below[k], r["s"])
                spans.pop(k)
            else:
                spans[k] = (r["a"], r["b"])
    return done


def _short_id() -> Column:
    return F.shiftright(F.col("_id"), 2)  # differences stay within a long


def tree(rows: DataFrame, n_dims: int, shards: int) -> Column:
    """The shard of a row of `measured`, as an expression over its dimensions and `_id`."""
    dims = [F.col(f"_d{i}") for i in range(n_dims)]
    shard_of, leaves, place = F.lit(0), {0: shards}, {0: 0}
    extent: list[float] = []
    while any(n > 1 for n in leaves.values()):
        level = rows.withColumn("_node", shard_of)
        stats = level.groupBy("_node").agg(F.sum("size").alias("s"), *[F.min(d).alias(f"a{i}") for i, d in enumerate(dims)], *[F.max(d).alias(f"b{i}") for i, d in enumerate(dims)]).collect()
        stats = {r["_node"]: r for r in stats}
        if not stats:
            return shard_of
        extent = extent or [max(1.0, float(max(r[f"b{i}"] for r in stats.values()) - min(r[f"a{i}"] for r in stats.values()))) for i in range(n_dims)]
        split = [k for k, n in leaves.items() if n > 1 and k in stats]
        widest = {k: max(range(n_dims), key=lambda i: ((stats[k][f"b{i}"] - stats[k][f"a{i}"]) / extent[i], -i)) for k in split}
        goals = {k: stats[k]["s"] * (leaves[k] // 2) / leaves[k] for k in split}
        if not split:
            break
        found = _medians(level, {k: dims[widest[k]] for k in split}, {k: (stats[k][f"a{widest[k]}"], stats[k][f"b{widest[k]}"]) for k in split}, goals)
        heavy = [k for k in split if found[k][0] == found[k][1] and found[k][3] > HEAVY * stats[k]["s"]]
        inner: dict[int, tuple] = {}
        if heavy:
            same = level.where(_case({k: dims[widest[k]] == F.lit(found[k][0]) for k in heavy}, F.col("_node")))
            inner = _medians(same, {k: _short_id() for k in heavy}, {k: (-(1 << 61), (1 << 61) - 1) for k in heavy}, {k: goals[k] - found[k][2] for k in heavy})
        right = {}
        for k, (a, b, under, held) in ((k, found[k]) for k in split):
            d = dims[widest[k]]
            if k in inner:
                right[k] = (d > a) | ((d == a) & (_short_id() >= inner[k][0]))
            else:  # the last bin goes to the side that comes nearer to the goal
                right[k] = d > b if under + held - goals[k] < goals[k] - under else d >= a
        new_leaves: dict[int, int] = {}
        for k, n in leaves.items():
            new_leaves[k] = n // 2 if k in split else n
            if k in split:
                new_leaves[k + n // 2] = n - n // 2
        step = {k: F.lit(k) + F.when(right[k], leaves[k] // 2).otherwise(0) if k in split else F.lit(k) for k in leaves}
        shard_of = _case(step, shard_of) if len(leaves) == 1 else _nest(step, shard_of)
        leaves = new_leaves
        if any(k not in stats for k in leaves) and not split:
            break
    return shard_of


def _nest(step: dict[int, Column], node: Column) -> Column:
    """`_case` with the node bound once, so that the expression doesn't grow with each level."""
    return F.transform(F.array(node), lambda x: _case(step, x))[0]


def shard(docs: DataFrame, shards: int = 8, dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (0, 1, 2... in each shard) and grown_shard (null under this law)."""
    dims = default_dims() if dims is None else dims
    rows = saved(agreed(saved(measured(docs, dims)), len(dims)))
    placed = saved(rows.withColumn("shard", tree(rows, len(dims), shards).cast("int")).select("doc_id", "size", "text_crc32", "_id", "shard"))
    return numbered(placed, ["shard"], "_id", ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
