"""Mixing sources to target weights by a low-discrepancy schedule. Native: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, hash_bucket, n_words, running

#: The golden ratio's fractional part in 32 bits: slot i lies at (i * GOLDEN mod 2^32) / 2^32.
GOLDEN, PERIOD = 2654435769, 1 << 31
#: Words of a block; a source's last one may be shorter.
BLOCK = 1024
#: Stretches that the cumulated weights are divided into to find the source of a point; slots that are ranked together.
STRETCHES, TOGETHER = 4096, 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """sizes (source, source_size) with weight and target. What a source's limit cuts off is shared anew by weight.

    Sorted by limit per weight, the limited sources come first; the others share what those leave over at one level.
    The table has a row for each source, so one task sorts it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ahead = Window.orderBy("ratio", "rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w).withColumn("limit", F.col("source_size") * repeats).withColumn("ratio", F.col("limit") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("before", F.coalesce(F.sum("limit").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(ahead.rowsBetween(0, Window.unboundedFollowing))).withColumn("level", (total - F.col("before")) / F.col("rest"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double")))).select("source", "source_size", "weight", "rank", "target")


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, block, words): which block of which source each slot takes, for goal (rank, words), words > 0.

    Each source has as many slots as its words need blocks. Slot i goes to the source whose span of the cumulated blocks
    holds the golden-ratio point i, and a source's k-th slot takes its k-th block. The points come near those numbers, not
    always to them: slots that a source has too many go, in order, to the blocks that lack one. Those are at most a few
    for each source, which one task ranks; the slots themselves are never ranked in one task.
    """
    by_rank, ahead = Window.orderBy("rank"), Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut(goal.select("rank", "words", F.ceil(F.col("words") / block).alias("blocks")).withColumn("since", F.coalesce(F.sum("blocks").over(ahead), F.lit(0))).withColumn("upto", F.sum("blocks").over(by_rank)))
    slots = spans.agg(F.sum("blocks")).first()[0] or 0
    stretch = max(1, math.ceil(slots / STRETCHES))
    at = (F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32)) * F.lit(float(slots))
    points = goal.sparkSession.range(slots).select(F.col("id").alias("slot"), at.alias("at")).withColumn("stretch", F.floor(F.col("at") / stretch))
    known = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("since") / stretch), F.floor((F.col("upto") - 1) / stretch))))
    held = points.join(known, "stretch").where("at >= since AND at < upto").select("slot", "rank", "words", "blocks", F.shiftright("slot", TOGETHER.bit_length() - 1).alias("bucket"))
    ranked = cut(running(held, ["rank"], ["slot"], "bucket", F.lit(1), "block").select("slot", "rank", "words", "blocks", F.col("block").cast("long").alias("block")))
    kept = ranked.where("block < blocks").select("slot", "rank", "block", "words")
    free = ranked.where("block >= blocks").select("slot", F.row_number().over(Window.orderBy("slot")).alias("n"))
    given = ranked.groupBy("rank").agg(F.count("*").alias("given"))
    lacking = spans.join(given, "rank", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks")
    lacking = lacking.select("rank", "words", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("block")).withColumn("n", F.row_number().over(Window.orderBy("rank", "block")))
    filled = lacking.join(free, "n").select("slot", "rank", "block", "words")
    return kept.unionByName(filled).select("slot", "rank", "block", F.least(F.lit(block), F.col("words") - F.col("block") * block).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: str = "", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken, slot, slots, rank (of its source),
    tie (the MD5 of its text), turns.

    size counts the words (null text: 0). Sources in code point order, null last, take the weights in turn; a source
    gives at most `repeats` times its size. The words of a source, its documents in an order shuffled by a hash of
    seed and doc_id, form a stream that repeats; it is cut into blocks of equal size, the last one ending with the
    target, rounded to a word. schedule() says which of the `slots` takes which block. slot is the one that takes a document's
    first block (null: not taken), and turns has that for each repeat. taken counts the words that the mix takes of a
    document, repeats included: over a source, its target to the word. At a stream's end a document may be taken in
    part, its first words. Documents without words are never taken. Null doc_ids share one place in the shuffle, which
    their size and text's digest break; rows alike in all of them may change places. A very long text is one document
    whose words lie in many blocks. Other columns are ignored; an empty table gives an empty result.
    """
    slim = cut(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("tie")))
    goal = cut(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats).withColumn("words", F.floor(F.col("target") + 0.5)))
    turns = cut(schedule(goal.where("words > 0"), block).select("rank", "block", "slot"))
    slots = F.lit(turns.count()).cast("long").alias("slots")

    buckets = max(1, math.isqrt(slim.count()))
    named = slim.join(goal.select(F.col("source").alias("_s"), "rank", "source_size", "target", "words"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = running(named.withColumn("bucket", hash_bucket(F.col("key"), buckets)), ["rank"], ["key", "tie", "size"], "bucket", F.col("size"), "start")
    wanted = (F.col("size") > 0) & (F.col("start") < F.col("words"))
    turn = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("start") + e * F.col("source_size"))
    epochs = placed.where(wanted).select("*", F.posexplode(turn).alias("epoch", "from")).withColumn("upto", F.least(F.col("from") + F.col("size"), F.col("words"))).where("from < upto")
    pieces = epochs.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("upto") - 1) / block))))
    pieces = pieces.withColumn("piece", F.least(F.col("upto"), (F.col("block") + 1) * block) - F.greatest(F.col("from"), F.col("block") * block))
    names = ["rank", "start", "doc_id", "source", "size", "source_size", "target", "tie"]
    began = [F.min(F.when(F.col("epoch") == e, F.struct("block", "slot")))["slot"] for e in range(repeats)]
    taken = pieces.join(turns, ["rank", "block"]).groupBy(*names).agg(F.sum("piece").cast("long").alias("taken"), F.array_compact(F.array(*began)).alias("turns"))
    none = placed.where(~wanted).select(*names, F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("turns"))
    first = F.get("turns", F.lit(0)).alias("slot")
    return taken.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken", first, slots, "rank", "tie", "turns")
