"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of signatures; pieces a signature has at least (where the text allows) and at most, about.
SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
FEWEST, USUAL, MOST = 32, 64, 128
#: Least block size, as a power of two.
LEAST = 2
#: Texts of one bucket of neighbours, in bytes, and the most buckets: a bucket is streamed, so it may be larger.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 4096

_PRIME, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(32)


_BYTES = _scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
_ROLL = (_BYTES & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class _Powers:
    """Powers of a number modulo 2^64, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            self.known = np.concatenate([self.known, self.known * np.uint64(pow(self.base, len(self.known), 1 << 64))])
        return self.known


_UP, _DOWN = _Powers(_PRIME), _Powers(_INVERSE)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _contexts(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, over the eight bytes that end there (fewer at the start)."""
    h = _ROLL[data]
    for span in (1, 2, 4):
        if len(h) > span:
            h[span:] ^= _turned(h[:-span].copy(), span)
    return h


def fingerprint(text: str) -> str:
    """block:signature:signature of double block. A piece ends where the low bits of the rolling hash are all ones, as
    many as the block size has; each piece gives one of 64 symbols. The block size halves from about 64 pieces' length
    until there are 32 pieces, and doubles while there are over 128. An empty text gives '4::'.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    h = _contexts(data)
    ends = np.flatnonzero(h & np.uint32((1 << LEAST) - 1) == (1 << LEAST) - 1)
    low = ~h[ends]
    ones = np.bitwise_count((low & -low) - np.uint32(1)).astype(np.int64)
    at_least = np.bincount(np.minimum(ones, 32), minlength=34)[::-1].cumsum()[::-1]
    k = max(LEAST, (max(1, n) // USUAL).bit_length())
    while k > LEAST and at_least[min(k, 33)] < FEWEST:
        k -= 1
    while k < 33 and at_least[k] > MOST:
        k += 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP.upto(n)[:n], out=sums[1:])
    return f"{1 << k}:{_signature(sums, ends[ones >= k] + 1, n)}:{_signature(sums, ends[ones >= k + 1] + 1, n)}"


def _signature(sums: np.ndarray, ends: np.ndarray, n: int) -> str:
    edges = np.concatenate([[0], ends, [n]] if not len(ends) or ends[-1] < n else [[0], ends]).astype(np.int64)
    if n == 0:
        return ""
    pieces = (sums[edges[1:]] - sums[edges[:-1]]) * _DOWN.upto(n)[edges[:-1]]
    return SYMBOLS[(_scrambled(pieces + np.diff(edges).astype(np.uint64)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions from a to b, a column of the table held in the bits of two integers."""
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for c in b:
        m = where.get(c, 0)
        diagonal = (((m & up) + up) ^ up) | m | down
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        right = right << 1 | 1
        up, down = (left << 1 | ~(diagonal | right)) & full, right & diagonal & full
    return score


def likeness(a: str, b: str) -> float:
    """0 to 1, from the edit distance of signatures at the same block size; 0 if block sizes differ by more than a factor
    of two, 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (p, *s), (q, *t) = a.split(":"), b.split(":")
    pairs = zip(s, t, strict=True) if p == q else [(s[1], t[0])] if 2 * int(p) == int(q) else [(s[0], t[1])] if int(p) == 2 * int(q) else []
    return max([0.0, *(1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in pairs if x and y)])


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down, in code points) replaced by as many (or all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. The next document is that of the next larger doc_id; null identifiers come last, rows with
    the same doc_id in the order of their texts, and the first follows the last. A lone document follows itself. Other
    columns are ignored; an empty table gives an empty result.
    Buckets of neighbours are cut at quantiles of doc_id that are identifiers themselves; the row at a cut goes to both
    sides, and each bucket is read in order, two texts at a time.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, first = base.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    n = min(MOST_BUCKETS, max(1, int((size or 0) // BUCKET_BYTES)))
    cuts = base.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(100 * n))).first()[0] if n > 1 else []
    cuts = sorted({c for c in cuts or [] if c is not None and c > first})
    known = F.array(*map(F.lit, cuts)).cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(known, lambda c: c <= F.col("doc_id"))))
    stray = F.when(F.col("doc_id").eqNullSafe(F.lit(first)), F.lit(len(cuts))).when(F.array_contains(known, F.col("doc_id")), F.col("bucket") - 1)
    rows = base.withColumn("bucket", bucket).withColumn("stray", stray)
    spots = F.filter(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("ghost")), F.struct(F.col("stray").alias("to"), F.lit(True).alias("ghost"))), lambda x: x["to"].isNotNull())
    rows = rows.withColumn("spot", F.explode(spots)).select("doc_id", "text", "spot.to", "spot.ghost")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, text, to, ghost in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made = fingerprint(text)
                if kept and kept[0] == to:
                    changed = edited(kept[2], text)
                    other = fingerprint(changed)
                    row = (kept[1], len(kept[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), kept[3], other, likeness(kept[3], other), likeness(kept[3], made))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kept = None if ghost else (to, i, text, made)
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    order = [F.col("to"), F.col("ghost"), F.col("doc_id").asc_nulls_last(), F.col("text")]
    return rows.repartition("to").sortWithinPartitions(*order).mapInArrow(task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
