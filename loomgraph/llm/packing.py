"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, hash_bucket, n_words, running

SIZES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its tokens, in tokens; the length at which attention costs as much as the tokens do.
OVERHEAD, ATTENTION = 32, 8192


def price(size: int, overhead: int, attention: int) -> float:
    """What a sequence of a size costs: its tokens, padding included, something for each sequence, and what its tokens cost
    by attending to one another, which is as much again as they are at `attention` tokens."""
    return size + overhead + size * size / attention


def best_fit(lengths: dict[int, int], sizes: tuple[int, ...], overhead: int, attention: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """(runs, bins) of best fit with these sizes, lengths falling: see plan(). Bins: (remaining, first bin, bins, filled).

    Bins alike are kept as one range, so the work depends on the lengths, not on how many pieces there are. Where no open
    bin fits, the size is opened that costs least per token it can expect: at most what is still to be packed.
    """
    rest = sum(k * n for k, n in lengths.items())
    opened: list[tuple[int, int, int, int]] = []  # sorted: the tightest that fits comes first
    runs, bins = [], 0
    for length in sorted(lengths, reverse=True):
        n, rank = lengths[length], 0
        while n:
            at = bisect_left(opened, (length, -1, -1, -1))
            if at < len(opened):
                room, first, many, filled = opened.pop(at)
            else:
                room = min((s for s in sizes if s >= length), key=lambda s: (price(s, overhead, attention) / min(s // length * length if rest - n * length <= 0 else s, rest), -s))
                first, filled = bins, 0
                many = math.ceil(n / (room // length))
                bins += many
            each = room // length
            full = min(many, n // each)
            if full:
                runs.append((length, rank, full * each, each, first, filled))
                insort(opened, (room - each * length, first, full, filled + each * length))
            rank, n = rank + full * each, n - full * each
            if n and full < many:  # the last of this class: one bin takes what is left of it
                runs.append((length, rank, n, n, first + full, filled))
                insort(opened, (room - n * length, first + full, 1, filled + n * length))
                full, n = full + 1, 0
            if full < many:
                insort(opened, (room, first + full, many - full, filled))
        rest -= lengths[length] * length
    return runs, opened


def cost_of(bins: list[tuple[int, int, int, int]], sizes: tuple[int, ...], overhead: int, attention: int) -> float:
    """What the bins cost once each has the least size that holds its contents."""
    return sum(many * price(min(s for s in sizes if s >= filled), overhead, attention) for _, _, many, filled in bins)


def plan(lengths: dict[int, int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, pieces per bin, first bin, offset) of variable-capacity best fit.

    The piece of rank r of a run lies in bin first + (r - first rank) // per_bin, behind offset and the pieces before it
    in that bin. The sizes are chosen jointly: best fit runs over the lengths with each set of them that holds the longest
    piece, and the plan whose bins cost least, downsized, is taken (of equal ones, that of the first set); so no single
    size does better.
    """
    sizes, longest = tuple(sorted(sizes)), max(lengths, default=0)
    sets = [s for k in range(1, len(sizes) + 1) for s in combinations(sizes, k) if s[-1] >= longest]
    tried = (best_fit(lengths, s, overhead, attention) for s in sets)
    return min(tried, key=lambda x: cost_of(x[1], sizes, overhead, attention))[0]


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION, tokens: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, bin_id, bin_offset, bin_size, bin_filled.

    A document has a token for each word and one for its end (tokens: another count, at least 1), so null and empty texts
    have one. Documents longer than the largest size are cut into pieces of that size and a last one; start is a piece's
    first token. Pieces of equal length are ranked in an order shuffled by doc_id, and the plan says which rank goes
    where. Bins are numbered from 0; no bin overflows and bin_size is the least permitted size that holds its contents.
    The driver sees one count for each length, at most the largest size of them, and plans over those. Rows alike are
    packed one by one, and may change places, as may rows without a doc_id that have one text; other columns are ignored; an empty table gives an empty result.
    """
    largest = max(sizes)
    count = tokens if tokens is not None else n_words(F.col("text")) + 1
    text_key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    slim = docs.select("doc_id", F.greatest(count, F.lit(1)).cast("long").alias("tokens"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"), text_key.alias("tie"))
    pieces = cut(slim.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / largest)))).withColumn("start", F.col("piece") * largest).withColumn("length", F.least(F.lit(largest), F.col("tokens") - F.col("start"))).drop("tokens"))
    lengths = {int(k): int(n) for k, n in pieces.groupBy("length").count().toPandas().itertuples(index=False)}
    runs = pd.DataFrame(plan(lengths, sizes, overhead, attention), columns=["of", "from", "ranks", "each", "first", "offset"]).astype("int64")
    runs = docs.sparkSession.createDataFrame(runs, "of long, from long, ranks long, each long, first long, offset long")
    buckets = max(1, math.isqrt(sum(lengths.values())))
    ranked = running(pieces.withColumn("bucket", hash_bucket(F.col("key"), buckets)), ["length"], ["key", "tie", "piece"], "bucket", F.lit(1), "rank")
    inside = F.col("rank") - F.col("from")
    # the runs are at most some for each length and never follow the input
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("of")) & (inside >= 0) & (inside < F.col("ranks")))
    placed = placed.select("doc_id", "piece", "start", "length", (F.col("first") + F.floor(inside / F.col("each"))).cast("long").alias("bin_id"), (F.col("offset") + F.pmod(inside, F.col("each")) * F.col("length")).cast("long").alias("bin_offset"))
    filled = F.sum("length").over(Window.partitionBy("bin_id"))
    size = F.coalesce(*[F.when(F.col("bin_filled") <= s, F.lit(s)) for s in sorted(sizes)]).cast("long")
    return placed.withColumn("bin_filled", filled).withColumn("bin_size", size)
