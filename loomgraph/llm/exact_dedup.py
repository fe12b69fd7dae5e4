"""Exact dedup by a log-structured merge index.

Each task keeps a memtable of digests; a full memtable is flushed as a run sorted by digest, with a Bloom filter.
Runs of a level are compacted into one of the next, keeping the best identifier of each digest. The runs of all tasks
are then dealt by digest and compacted the same way. Digests seen more than once are hits, whose bytes are compared.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, cut

_NULL = np.iinfo(np.int64).min
_FIELDS = [("hi", "u8"), ("lo", "u8"), ("id", "i8"), ("row", "i8"), ("n", "i8")]


class Bloom:
    """Two bits for each digest, in a power of two of bits, about ten for each of `size` digests."""

    def __init__(self, size: int):
        self.mask = np.uint64((1 << max(6, int(size * 10).bit_length())) - 1)
        self.words = np.zeros((int(self.mask) + 1) // 64, np.uint64)

    def _bits(self, a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [((h & self.mask) >> np.uint64(6), np.uint64(1) << (h & np.uint64(63))) for h in (a["hi"] >> np.uint64(7), a["lo"])]

    def add(self, a: np.ndarray) -> None:
        for word, bit in self._bits(a):
            np.bitwise_or.at(self.words, word.astype(np.int64), bit)

    def may_hold(self, a: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for word, bit in self._bits(a):
            out &= self.words[word.astype(np.int64)] & bit != 0
        return out


def _merged(parts: list[np.ndarray], largest: bool) -> np.ndarray:
    """One sorted run: per digest the best identifier (ties: the smallest row number) and the number of rows."""
    a = np.concatenate(parts)
    if not len(a):
        return a
    a = a[np.lexsort((a["row"], -a["id"] if largest else a["id"], a["lo"], a["hi"]))]
    first = np.flatnonzero(np.r_[True, (a["hi"][1:] != a["hi"][:-1]) | (a["lo"][1:] != a["lo"][:-1])])
    out = a[first].copy()
    out["n"] = np.add.reduceat(a["n"], first)
    return out


class DigestIndex:
    """The index of one task. Runs lie in a temporary folder that ends with it; memory holds a memtable and filters."""

    def __init__(self, largest: bool = False, memtable: int = 200_000, fanout: int = 4):
        self.largest, self.memtable, self.fanout = largest, memtable, fanout
        self.pending: list[np.ndarray] = []
        self.waiting = self.made = 0
        self.levels: list[list[tuple[str, Bloom]]] = []
        self.folder = tempfile.TemporaryDirectory(prefix="lsm-")

    def add(self, rows: np.ndarray) -> None:
        self.pending.append(rows)
        self.waiting += len(rows)
        if self.waiting >= self.memtable:
            self.pending = [_merged(self.pending, self.largest)]
            self.waiting = len(self.pending[0])
            if self.waiting >= self.memtable // 2:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            self._put(0, [_merged(self.pending, self.largest)], self.waiting)
            self.pending, self.waiting = [], 0

    def _put(self, level: int, pieces, size: int) -> None:
        """Writes a run, piece by piece, and compacts its level when that is full."""
        path, bloom = os.path.join(self.folder.name, f"{self.made}.run"), Bloom(size)
        self.made += 1
        with open(path, "wb") as f:
            for p in pieces:
                p.tofile(f)
                bloom.add(p)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((path, bloom))
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            mapped = [self._open(r) for r, _ in runs]
            self._put(level + 1, self._ranges(mapped), sum(map(len, mapped)))
            for r, _ in runs:
                os.remove(r)

    @staticmethod
    def _open(path: str) -> np.ndarray:
        return np.memmap(path, np.dtype(_FIELDS), "r") if os.path.getsize(path) else np.empty(0, _FIELDS)

    def _ranges(self, runs: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The runs merged, one range of digests after the other, each of about a memtable."""
        parts = max(1, sum(map(len, runs)) // self.memtable)
        cuts = [np.uint64(min((1 << 64) - 1, (i << 64) // parts)) for i in range(1, parts)]
        ends = [[0, *np.searchsorted(r["hi"], cuts).tolist(), len(r)] for r in runs]
        for i in range(parts):
            yield _merged([np.asarray(r[e[i] : e[i + 1]]) for r, e in zip(runs, ends, strict=True)], self.largest)

    def results(self) -> Iterator[np.ndarray]:
        """All digests once. What no other run's filter may hold leaves its run as it is; the rest is merged."""
        self.flush()
        runs = [x for level in self.levels for x in level]
        shared: list[np.ndarray] = []
        for i, (path, _) in enumerate(runs):
            a = self._open(path)
            for at in range(0, len(a), self.memtable):
                piece = np.asarray(a[at : at + self.memtable])
                other = np.zeros(len(piece), bool)
                for j, (_, bloom) in enumerate(runs):
                    if j != i:
                        other |= bloom.may_hold(piece)
                yield piece[~other]
                shared.append(piece[other])
        if shared:
            shared = [s[np.lexsort((s["lo"], s["hi"]))] for s in shared]
            yield from self._ranges(shared)
        self.folder.cleanup()


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, _FIELDS)
    key = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, 2)
    out["hi"], out["lo"] = key[:, 0], key[:, 1]
    for i, name in enumerate(("id", "row", "n"), 1):
        out[name] = batch.column(i).to_numpy(zero_copy_only=False)
    return out


def _batch(a: np.ndarray) -> pa.RecordBatch:
    key = np.empty((len(a), 2), ">u8")
    key[:, 0], key[:, 1] = a["hi"], a["lo"]
    raw = key.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), *[pa.array(np.ascontiguousarray(a[x])) for x in ("id", "row", "n")]], ["digest", "id", "row", "n"])


def _index(largest: bool, memtable: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(largest, memtable)
        for b in batches:
            if b.num_rows:
                index.add(_rows(b))
        for a in index.results():
            for at in range(0, len(a), 50_000):
                yield _batch(a[at : at + 50_000])

    return task


def build_index(slim: DataFrame, keep: str = "smallest", memtable: int = 200_000) -> DataFrame:
    """slim (digest binary(16), id, row, n) as an index (digest, id, row, n): a row for each digest."""
    task, schema = _index(keep == "largest", memtable), "digest binary, id long, row long, n long"
    runs = slim.select("digest", "id", "row", "n").mapInArrow(task, schema)
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "digest").mapInArrow(task, schema)


#: Words of 64 bits in the filter that picks the rows whose bytes are compared: 4 MB, whatever the input.
FILTER_WORDS = 1 << 19


def picked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Those of rows (digest, ...) that the filter of the hits lets through: all hits and a few others."""
    h = F.xxhash64("digest")
    words = hits.select((h.bitwiseAND(F.lit(FILTER_WORDS - 1))).alias("w"), F.shiftrightunsigned(h, 58).cast("int").alias("b")).select("w", F.expr("shiftleft(1L, b)").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            on = shared.value[(k & np.uint64(FILTER_WORDS - 1)).astype(np.int64)] >> (k >> np.uint64(58)) & np.uint64(1) == 1
            if on.any():
                yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(on))

    return rows.withColumn("_h", h).mapInArrow(task, rows.schema)


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise=ascii_lower, digest=None, id_col: str = "doc_id", text_col: str = "text", memtable: int = 200_000) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Texts are equal when their normalised bytes are. Of equal texts the row with the
    smallest (or, by keep, largest) doc_id stays; null identifiers come last; of rows alike in both, one stays.
    Other columns are ignored. An empty table gives an empty result.
    digest: from the normalised text to a column binary(16); by default the first half of its SHA-256.
    Rows whose digest agrees and whose bytes don't are grouped by their bytes.
    """
    norm: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    sha = F.sha2(norm.cast("binary"), 256)
    key = digest(F.col("norm")) if digest else F.unhex(F.substring("sha", 1, 32))
    worst = F.lit(_NULL + 1 if keep == "largest" else -(_NULL + 1))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), sha.alias("sha")).withColumn("digest", key)
    slim = cut(texts.select("doc_id", "sha", "digest", F.monotonically_increasing_id().alias("row")))
    index = cut(build_index(slim.select("digest", F.coalesce("doc_id", worst).alias("id"), "row", F.lit(1).cast("long").alias("n")), keep, memtable))

    hits = index.where("n > 1")
    held = picked(texts.select("doc_id", "norm", "digest"), hits)
    compared = held.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    odd = cut(compared.where("a <> b").select("digest"))
    index = index.select("digest", F.when(F.col("id") == worst, None).otherwise(F.col("id")).alias("keep_id"), F.col("row").alias("best"), F.col("n").alias("group_size"))
    if odd.isEmpty():
        return slim.join(index, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))

    split = held.join(odd, "digest", "left_semi").groupBy("digest", "doc_id", "norm").count().drop("count")
    named = slim.join(odd, "digest", "left_semi").join(split.select(F.col("digest").alias("_d"), F.col("doc_id").alias("_i"), "norm"), F.col("digest").eqNullSafe(F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_i")))
    order = F.struct(F.coalesce("doc_id", worst) * (1 if keep == "smallest" else -1), "row")
    best = named.groupBy("digest", "norm").agg(F.min(F.struct(order.alias("o"), "doc_id", "row")).alias("m"), F.count("*").alias("group_size"))
    exact = named.join(best, ["digest", "norm"]).select("doc_id", F.col("m.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("m.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    plain = slim.join(odd, "digest", "left_anti").join(index, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("best")).alias("kept"), F.col("sha").alias("text_sha256"))
    return plain.unionByName(exact)
