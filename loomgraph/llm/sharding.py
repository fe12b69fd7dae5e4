"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, hash_bucket, running


def best_fit(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, number of groups, bin) of best-fit decreasing; None if more than `bins` would be needed.

    classes: (size, number of groups), sizes falling. The bins' remaining capacities stand in a sorted array, searched
    as a balanced tree. The tightest bin that takes a group is still the tightest that takes the next one of that size,
    so it takes all it can at once: the result is that of one group after the other.
    """
    tree: list[tuple[int, int]] = []
    out, opened = [], 0
    for size, n in classes:
        while n:
            at = bisect_left(tree, (size, -1))
            if at < len(tree):
                rest, b = tree.pop(at)
            else:
                if opened == bins or size > capacity:
                    return None
                rest, b, opened = capacity, opened, opened + 1
            k = min(n, rest // size)
            insort(tree, (rest - k * size, b))
            out.append((size, k, b))
            n -= k
    return out


def pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Runs (size, number of groups, bin) over exactly `bins` bins at nearly the least capacity that suffices.

    A group larger than an equal share gets a bin of its own; the others share what remains.
    """
    classes = sorted((c for c in classes if c[1]), reverse=True)
    own, total = [], sum(s * n for s, n in classes)
    while classes and bins - len(own) > 1 and classes[0][0] * (bins - len(own)) > total:
        size, n = classes[0]
        own.append((size, 1, bins - 1 - len(own)))
        total -= size
        classes = [(size, n - 1), *classes[1:]] if n > 1 else classes[1:]
    if not classes:
        return own
    left = bins - len(own)
    low = max(math.ceil(total / left), classes[0][0])
    step, fits = 0, best_fit(classes, low, left)
    while fits is None:
        step = max(1, step * 2)
        fits = best_fit(classes, low + step, left)
    bad = step // 2
    while step - bad > 1:
        middle = (step + bad) // 2
        if (tried := best_fit(classes, low + middle, left)) is None:
            bad = middle
        else:
            step, fits = middle, tried
    return own + fits


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, shard_bytes of its group.

    size: the text's UTF-8 bytes (null: none) plus 8. Rows with equal texts form a group that stays in one shard; a null
    text equals an empty one. Shards have nearly equal bytes unless a group alone is larger than an equal share: it then
    has a shard to itself. Within a shard, slots number the rows from 0 in an order shuffled by doc_id.
    The driver packs size classes, not groups: sizes that differ sum up to the input at most, so there are at most
    sqrt(2 * bytes) of them. Groups of equal bytes are told apart by their text's digest. Rows alike have
    slots of their own, as do rows without a doc_id, in either order; a very long text is a row like any other, by its bytes.
    An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    slim = cut(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key")))
    groups = cut(slim.groupBy("digest").agg(F.sum("size").alias("group_bytes")))
    classes = groups.groupBy("group_bytes").count().toPandas()
    runs = pd.DataFrame(pack([(int(s), int(n)) for s, n in classes.itertuples(index=False)], shards), columns=["of_bytes", "n", "shard"]).astype("int64")
    runs["to"] = runs.groupby("of_bytes")["n"].cumsum()
    runs["from"] = runs["to"] - runs["n"]
    spark = docs.sparkSession
    runs = spark.createDataFrame(runs.astype({"shard": "int32"})[["of_bytes", "from", "to", "shard"]], "of_bytes long, from long, to long, shard int")

    n = max(1, math.isqrt(int(classes["count"].sum())))
    ranked = running(groups.withColumn("bucket", hash_bucket(F.col("digest"), n)), ["group_bytes"], ["digest"], "bucket", F.lit(1), "at")
    homes = ranked.join(runs, (F.col("group_bytes") == F.col("of_bytes")) & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to"))).select("digest", "shard", "group_bytes")
    placed = slim.join(homes, "digest")
    slots = running(placed.withColumn("bucket", hash_bucket(F.col("key"), max(1, math.isqrt(slim.count())))), ["shard"], ["key", "digest"], "bucket", F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_bytes")
