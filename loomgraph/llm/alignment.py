"""Alignment of two tokenizers over a corpus: which tokens overlap, in how many documents, and how typical each overlap is."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, cut_files
from loomgraph.llm.tokens import loaded

#: Where the vocabularies are, on every machine.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters that are encoded together; pairs that a task holds before it sums them, and sums before it gives them on.
CHARACTERS, HELD, KEPT = 1 << 20, 1 << 21, 1 << 20
#: Sums that come to a range of pairs; distinct pairs of a shard; documents that are looked up together.
RANGE, SHARD, TOGETHER = 1 << 20, 1 << 20, 512


class Aligner:
    """Both tokenizers, with the bytes of their tokens and the decimal forms of their ids."""

    def __init__(self, byte_level: str, pieces: str):
        self.tokenizers = loaded(byte_level, pieces)
        self.lengths = [np.array([len(b) for b in t.bytes], np.int64) for t in self.tokenizers]
        n = [len(t.bytes) for t in self.tokenizers]
        # An id with what follows it: within its side of a group, at the end of it.
        self.forms = [b"%d%s" % (i, end) for side, ends in enumerate(((b",", b"|"), (b",", b";"))) for end in ends for i in range(n[side])]
        self.form_of = np.array([[0, n[0]], [2 * n[0], 2 * n[0] + n[1]]])

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both, none if the bytes of either are not those of a space and the text."""
        if not text:
            return [], []
        a, b = self.tokenizers[0].ids(" " + text), self.tokenizers[1].ids(text)
        raw = (" " + text).encode()
        same = all(b"".join(map(t.bytes.__getitem__, ids)) == raw for t, ids in zip(self.tokenizers, (a, b), strict=True))
        return (a, b) if same else ([], [])


@lru_cache(2)
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the A token, of the B token, end of what they share) of every overlap, in order, and the ends of groups.

    Between two neighbouring ends, of either side, lies a part of one token of each, and two tokens that overlap share one
    such part: so there is an overlap for each distinct end. Where both sides end, a group does.
    """
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    again = ends[1:] == ends[:-1]
    every = ends[np.r_[True, ~again]] if len(ends) else ends
    return np.searchsorted(ends_a, every), np.searchsorted(ends_b, every), every, ends[1:][again]


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Rising pairs and how often each is there, first ids as steps, byte by byte: most bytes are then zero and compress."""
    a = np.diff(pairs >> 32, prepend=0)
    return np.stack([a, pairs & 0xFFFFFFFF, times]).astype("<u4").view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1).tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(3, 4, -1).transpose(0, 2, 1)
    a, b, times = np.ascontiguousarray(planes).view("<u4")[:, :, 0].astype(np.int64)
    return np.cumsum(a) << 32 | b, times


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
    return pairs[first], np.add.reduceat(counts, first) if len(first) else counts


def together(texts: list[str | None]) -> Iterator[slice]:
    """Neighbouring texts of about CHARACTERS characters; a longer one by itself."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > CHARACTERS:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield slice(start, len(texts))


def described(texts: list[str | None], use: Aligner) -> Iterator[tuple[int, int, int, int, str, bytes]]:
    """n_a, n_b, n_groups, n_links, groups_sha256 and packed pairs of each text."""
    ids = [use.ids(t) for t in texts]
    n = np.array([[len(a), len(b)] for a, b in ids], np.int64).reshape(-1, 2)
    flat = [np.fromiter((i for x in ids for i in x[side]), np.int64, n[:, side].sum()) for side in (0, 1)]
    ends = [np.cumsum(use.lengths[side][flat[side]]) for side in (0, 1)]
    at_a, at_b, every, common = overlaps(*ends)
    pairs = flat[0][at_a] << 32 | flat[1][at_b]

    groups = [np.searchsorted(common, e) for e in ends]
    last = [np.r_[g[1:] != g[:-1], True][: len(g)].astype(np.int64) for g in groups]
    forms = np.concatenate([flat[side] + use.form_of[side][last[side]] for side in (0, 1)])
    forms = forms[np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable")].tolist()

    upto = np.cumsum(n, axis=0)
    size = np.r_[0, ends[0]][upto[:, 0]]  # bytes up to the end of each text
    links, ended = np.searchsorted(every, size, side="right"), np.searchsorted(common, size, side="right")
    link = group = form = 0
    for (n_a, n_b), to, ends_of, (to_a, to_b) in zip(n.tolist(), links.tolist(), ended.tolist(), upto.tolist(), strict=True):
        if not n_a:
            yield 0, 0, 0, 0, "", b""
            continue
        sha = hashlib.sha256(b"".join(map(use.forms.__getitem__, forms[form : to_a + to_b]))[:-1]).hexdigest()
        yield n_a, n_b, ends_of - group, to - link, sha, packed(*np.unique(pairs[link:to], return_counts=True))
        link, group, form = to, ends_of, to_a + to_b


def encoded(docs: DataFrame, id_col: str, text_col: str, byte_level: str, pieces: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = aligner(byte_level, pieces)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in together(texts):
                made = list(zip(*described(texts[part], use), strict=True))
                numbers = [pa.array(c, pa.int64()) for c in made[:4]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *numbers, pa.array(made[4], pa.string()), pa.array(made[5], pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, kind)


def _numbers(pairs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(pairs), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["pair", "n"])


def partial_counts(told: DataFrame) -> DataFrame:
    """(pair, n): of each task, its distinct pairs and in how many of its documents they are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pairs = counts = np.empty(0, np.int64)
        n = 0
        for batch in batches:
            for raw in batch.column(0):
                held.append(unpacked(raw.as_py())[0])
                n += len(held[-1])
                if n >= HELD:
                    own, times = np.unique(np.concatenate(held), return_counts=True)
                    pairs, counts = summed(np.concatenate([pairs, own]), np.concatenate([counts, times]))
                    held, n = [], 0
                    if len(pairs) >= KEPT:
                        yield from _numbers(pairs, counts)
                        pairs = counts = np.empty(0, np.int64)
        own, times = np.unique(np.concatenate([pairs[:0], *held]), return_counts=True)
        yield from _numbers(*summed(np.concatenate([pairs, own]), np.concatenate([counts, times])))

    return told.where("n_links > 0").select("pairs").mapInArrow(task, "pair long, n long")


def shards(partial: DataFrame, ranges: int) -> DataFrame:
    """(first, pairs, counts): the sums over all tasks in shards of SHARD pairs, rising within a shard and from one to the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def shard(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:1]), pa.array([pairs.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["first", "pairs", "counts"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 2 * SHARD:
                pairs, counts = summed(*map(np.concatenate, zip(*held, strict=True)))
                whole = (len(pairs) - 1) // SHARD * SHARD  # the last pair may go on in the next batch
                for at in range(0, whole, SHARD):
                    yield shard(pairs[at : at + SHARD], counts[at : at + SHARD])
                held, size = [(pairs[whole:], counts[whole:])], len(pairs) - whole
        if held:
            pairs, counts = summed(*map(np.concatenate, zip(*held, strict=True)))
            for at in range(0, len(pairs), SHARD):
                yield shard(pairs[at : at + SHARD], counts[at : at + SHARD])

    return partial.repartitionByRange(ranges, "pair").sortWithinPartitions("pair").mapInArrow(task, "first long, pairs binary, counts binary")


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(a, b, n): of each pair of ids that is linked in some document, how many documents hold it linked."""
    partial = cut(partial_counts(encoded(docs, id_col, text_col, byte_level, pieces)))
    rows = _rows(shards(partial, _ranges(partial)))
    return rows.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")


def _ranges(partial: DataFrame) -> int:
    return max(1, math.ceil(partial.count() / RANGE))


def _rows(counts: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n in zip(batch.column(0), batch.column(1), strict=True):
                yield from _numbers(np.frombuffer(pairs.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64))

    return counts.select("pairs", "counts").mapInArrow(task, "pair long, n long")


def highest(counts: DataFrame, size: int) -> np.ndarray:
    """Of each A id the highest count of its pairs: an array as long as the vocabulary, whatever the corpus."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n in zip(batch.column(0), batch.column(1), strict=True):
                a, first = np.unique(np.frombuffer(pairs.as_py(), np.int64) >> 32, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.maximum.reduceat(np.frombuffer(n.as_py(), np.int64), first))], ["a", "n"])

    found = counts.select("pairs", "counts").mapInArrow(task, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["a"].to_numpy()] = found["n"].to_numpy()
    return out


@lru_cache(1)
def _mapped(names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(first pair of each shard, rising; pairs and counts of each shard, mapped from files).

    Spark brings the shards' files to each executor, once; beside its own copy a worker puts the arrays that it maps.
    """
    found = []
    for name in names:
        path = SparkFiles.get(name)
        rows = range(pq.ParquetFile(path).metadata.num_rows)
        own = [[f"{path}-{i}-{kind}.npy" for kind in ("pairs", "counts")] for i in rows]
        if not all(os.path.exists(p) for pair in own for p in pair):
            i = 0
            for batch in pq.ParquetFile(path).iter_batches(1, columns=["pairs", "counts"]):
                for column, to in zip(batch.columns, own[i], strict=True):
                    with open(f"{to}.{os.getpid()}", "wb") as f:
                        np.save(f, np.frombuffer(column[0].as_py(), np.int64))
                    os.replace(f"{to}.{os.getpid()}", to)
                i += 1
        found += [[np.load(p, mmap_mode="r") for p in pair] for pair in own]
    found.sort(key=lambda x: int(x[0][0]))
    return np.array([int(x[0][0]) for x in found], np.int64), [x[0] for x in found], [x[1] for x in found]


def looked_up(pairs: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Counts of pairs, each of which is in a shard."""
    every, back = np.unique(pairs, return_inverse=True)
    firsts, keys, counts = _mapped(names)
    out = np.empty(len(every), np.int64)
    bounds = np.r_[np.searchsorted(every, firsts), len(every)]
    for i in range(len(firsts)):
        lo, hi = bounds[i], bounds[i + 1]
        if hi > lo:
            out[lo:hi] = counts[i][np.searchsorted(keys[i], every[lo:hi])]
    return out[back]


def sent(spark: SparkSession, files: list[str]) -> tuple[str, ...]:
    """Has Spark bring the files to every executor that runs a task from now on, later ones too; their names there."""
    for f in files:
        spark.sparkContext.addFile(f)
    return tuple(f.rsplit("/", 1)[1] for f in files)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (byte-level) encodes a space and the text, B (pieces) the text, to which it adds the space. Tokens of A and B that share
    bytes are linked; where both end, a group does. A pair of ids counts once for each document that links it. n_links
    counts the links of a document, n_best those whose count is the highest of their A id (ties too), count_sum adds up
    their counts. Texts are encoded once; pairs are a single integer each. A task's distinct pairs are summed, dealt by ranges,
    sorted and summed again; the sorted sums lie in the shared folder as shards, which Spark brings to each executor and tasks
    map into memory and search. There are at most as many pairs as the product of the vocabularies, 16 bytes each: 26 GB
    of an executor's disk for these two, were each id ever linked to each other one, and none of its memory.

    Null and empty texts, and those whose tokens' bytes aren't the text's, have no tokens: zeros and ''. A very long text is
    encoded whole, so memory follows the longest one. Rows alike count as documents of their own; null doc_ids stay. Other
    columns are ignored; an empty table gives an empty result.
    """
    told = cut(encoded(docs, id_col, text_col, byte_level, pieces))
    partial = cut(partial_counts(told))
    counts, files = cut_files(shards(partial, _ranges(partial)))
    names = sent(docs.sparkSession, files)
    most = docs.sparkSession.sparkContext.broadcast(highest(counts, len(aligner(byte_level, pieces).lengths[0])))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                some = [unpacked(raw.as_py()) for raw in part.column(6)]
                of = np.repeat(np.arange(len(some)), [len(p) for p, _ in some])
                pairs, times = (np.concatenate([x[i] for x in some]) for i in (0, 1))
                n = looked_up(pairs, names) if len(pairs) else pairs
                best = times * (n == most.value[pairs >> 32])
                sums = [np.zeros(len(some), np.int64) for _ in range(2)]
                for out, values in zip(sums, (best, times * n), strict=True):
                    np.add.at(out, of, values)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *map(pa.array, sums), part.column(5)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return told.mapInArrow(task, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
