"""SimHash near-dedup: fingerprints, vantage-point trees for exact pairs within a Hamming radius, components.

Where texts are to have a given similarity of shingles, a radius that holds all such pairs is too wide for a tree to prune.
Then points meet by their rarest shingles first: of two sets that are so alike, the first few in any one order of all
shingles can't all differ. Points that share one of those are compared; a shingle that many share is divided by a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, gone
from loomgraph.llm.exact_dedup import picked

#: Fingerprints that one leaf of the upper tree is planned for, and the largest set that is compared all with all.
LEAF, BRUTE = 16_384, 256
#: Fingerprints from which vantage points and radii of the upper tree are taken: they decide balance, never results.
SAMPLE = 100_000
#: Forests of a leaf's nearest pairs, and rounds of them: they decide which pairs are checked first, never which remain.
FORESTS, ROUNDS = 3, 2
#: Pairs that are checked in a round after those, at least (or one for each text), and those that a leaf gives at most.
CHECKS, GIVEN = 1 << 18, 1 << 20
#: Of so many slices of all pairs, one is counted to tell how many there are.
THIN = 1024
#: Shingles whose bits are counted at once, and fingerprints that ask at once.
BLOCK, ASK = 1 << 15, 4096
#: Points with one shingle up to which all their pairs are looked at, at most half of so many for a point; with more, they
#: go to trees.
SMALL = 32
#: Bytes of text from which common shingles are told, and how often they must be there: they come last in the order of all
#: shingles, which decides how many pairs meet, never which are found.
COMMON_BYTES, COMMON = 8 << 20, 3


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> np.ndarray:
    """bits / 64 words of 64 bits. A bit is set if it is set in over half of the hashes.

    A shingle is `words` words in lower case (A-Z only) joined by spaces, or all words where there are fewer; repeats
    count; no words and null give 0. The hash is XXH64 of its UTF-8 bytes, seed 42, then 43 and so on.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(bits // 64, np.uint64)
    n, digest = max(1, len(w) - words + 1), xxhash.xxh64_intdigest
    shingles = [b" ".join(w)] if n == 1 else list(map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)))
    out = []
    for seed in range(42, 42 + bits // 64):
        h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, BLOCK):
            ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def _array(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, bits // 64).astype(np.uint64)


def _column(fp: np.ndarray) -> pa.Array:
    raw, step = fp.astype(">u8").tobytes(), 8 * fp.shape[1]
    return pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, twin (hash of the text) and fp (binary, big-endian) for each row of docs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, bits) for t in b.column(2)], np.uint64).reshape(-1, bits // 64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _column(fp)], ["doc_id", "twin", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("twin"), text_col).mapInArrow(task, "doc_id long, twin long, fp binary")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds a fingerprint's words."""
    if a.shape[-1] == 1:
        return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


class Router:
    """The upper tree: each node has a vantage point and a radius; a point goes in if its distance is at most that."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.depth = depth
        self.vantage = np.zeros((1 << depth, sample.shape[1]), np.uint64)
        self.radius = np.full(1 << depth, 32 * sample.shape[1], np.int64)
        rng = np.random.default_rng(seed)
        nodes = {1: sample}
        for node in range(1, 1 << depth):
            own = nodes.pop(node)
            if len(own):
                self.vantage[node] = own[rng.integers(len(own))]
                d = distance(own, self.vantage[node])
                self.radius[node] = max(0, min(int(np.median(d)), int(d.max()) - 1))
                inner = d <= self.radius[node]
                nodes[2 * node], nodes[2 * node + 1] = own[inner], own[~inner]
            else:
                nodes[2 * node] = nodes[2 * node + 1] = own

    def home(self, a: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node, counted from 1 at the top, that a point lies in at its depth."""
        node = np.ones(len(a), np.int64)
        for level in range(self.depth):
            on = np.flatnonzero(depth > level)
            node[on] = 2 * node[on] + (distance(a[on], self.vantage[node[on]]) > self.radius[node[on]])
        return node

    def touched(self, a: np.ndarray, reach: int, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in a, node) of all nodes at its depth that may hold a point within reach: the triangle bound."""
        at, node = np.arange(len(a)), np.ones(len(a), np.int64)
        for level in range(self.depth):
            on = depth[at] > level
            d = distance(a[at[on]], self.vantage[node[on]])
            inner, outer = d - reach <= self.radius[node[on]], d + reach > self.radius[node[on]]
            at, node = np.concatenate([at[~on], at[on][inner], at[on][outer]]), np.concatenate([node[~on], 2 * node[on][inner], 2 * node[on][outer] + 1])
        return at, node


def _joined(q: np.ndarray, p: np.ndarray, qi: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Hits q[qi] ~ p[pi] (qi rising) as links of each point to the least of its component: no more links than points."""
    starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
    rows, label = qi[starts], p.copy()
    while True:
        row = np.minimum(np.minimum.reduceat(label[pi], starts), q[rows])
        new = label.copy()
        np.minimum.at(new, pi, np.repeat(row, np.diff(np.r_[starts, len(qi)])))
        if (new == label).all():
            break
        label = new
    cols = np.unique(pi)
    out = np.stack([np.concatenate([q[rows], p[cols]]), np.concatenate([row, label[cols]])], 1)
    return out[out[:, 0] != out[:, 1]]


def forests(hits: np.ndarray, many: int) -> np.ndarray:
    """Of distinct hits (i, j, distance), a spanning forest of least distance, then one of the rest, and so on."""
    out, hits = [hits[:0]], hits[np.argsort(hits[:, 2], kind="stable")]
    for _ in range(many):
        taken = forest(hits)
        out.append(hits[taken])
        hits = np.delete(hits, taken, axis=0)
    return np.concatenate(out)


def forest(hits: np.ndarray) -> np.ndarray:
    """Positions of a spanning forest of least distance among hits that rise by it: each round, each tree takes its
    nearest edge."""
    nodes, ends = np.unique(hits[:, :2], return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    label, edge, kept = np.arange(len(nodes)), np.arange(len(hits)), []
    while len(edge):
        a, b = label[u[edge]], label[v[edge]]
        apart = a != b
        edge, a, b = edge[apart], a[apart], b[apart]
        if not len(edge):
            break
        best = np.full(len(nodes), len(hits))
        np.minimum.at(best, a, edge)
        np.minimum.at(best, b, edge)
        own = np.flatnonzero(best < len(hits))
        kept.append(np.unique(best[own]))
        above = np.arange(len(nodes))
        above[own] = label[u[best[own]]] + label[v[best[own]]] - own
        above = np.where((above[above] == np.arange(len(nodes))) & (np.arange(len(nodes)) < above), np.arange(len(nodes)), above)
        while (above[above] != above).any():
            above = above[above]
        label = above[label]
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def within(fp: np.ndarray, points: np.ndarray, queries: np.ndarray, reach: int, seed: int = 11) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs (query, point) within reach, in blocks (asks, part, qi, pi, distance): asks[qi] ~ part[pi], qi rising.

    points and queries are positions in fp. If all points are queries too, each pair of points is looked at once. A vantage-point tree over the points, all queries descending at once: of a
    node, only the sides that a query's ball can reach are entered. Small or inseparable nodes are compared in blocks.
    """
    rng = np.random.default_rng(seed)
    twice = np.zeros(len(fp), bool)
    twice[points] = np.isin(points, queries).all()
    stack = [(points, queries, 0)]
    while stack:
        p, q, failed = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > BRUTE and failed <= 3:
            vantage = fp[p[rng.integers(len(p))]]
            d, e = distance(fp[p], vantage), distance(fp[q], vantage)
            radius = min(int(np.median(d)), int(d.max()) - 1)
            inner = d <= radius
            into, beyond = e - reach <= radius, e + reach > radius
            if not inner.any() or into.all() and beyond.all():  # nothing to prune here
                stack.append((p, q, failed + 1))
            else:
                stack += [(p[inner], q[into], 0), (p[~inner], q[beyond], 0)]
            continue
        for i in range(0, len(p), BRUTE):
            part = p[i : i + BRUTE]
            first = q[~twice[q] | (q < part.max())]  # the others are points that these ask, not the other way round
            for k in range(0, len(first), ASK):
                asks = first[k : k + ASK]
                d = distance(fp[asks][:, None], fp[part][None])
                qi, pi = np.nonzero(d <= reach)
                own = np.where(twice[asks[qi]], asks[qi] < part[pi], asks[qi] != part[pi])
                if own.any():
                    qi, pi = qi[own], pi[own]
                    yield asks, part, qi, pi, d[qi, pi]


def links(fp: np.ndarray, points: np.ndarray, queries: np.ndarray, reach: int, seed: int = 11) -> np.ndarray:
    """Links (i, j) between rows of fp that join exactly what the pairs (query, point) within reach join."""
    return np.concatenate([np.empty((0, 2), np.int64), *(_joined(asks, part, qi, pi) for asks, part, qi, pi, _ in within(fp, points, queries, reach, seed))])


def apart(fp: np.ndarray, label: np.ndarray, points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """The hits (i, j, distance) of within() whose labels differ, block by block."""
    for asks, part, qi, pi, d in within(fp, points, queries, reach):
        i, j = asks[qi], part[pi]
        on = label[i] != label[j]
        if on.any():
            yield np.stack([i[on], j[on], d[on]], 1).astype(np.int64)


def nearest(blocks: Iterator[np.ndarray], twin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of all hits between points (twin), FORESTS forests of least distance; which of the points have hits besides; those
    of the latter, as twins, that fall into one of THIN slices; and how many they are."""
    n = len(twin)
    held, size, rest, left, thin = [np.empty((0, 3), np.int64)], 0, np.zeros(n, bool), 0, [np.empty((0, 2), np.int64)]

    def settled() -> np.ndarray:
        nonlocal left
        every = np.concatenate(held)
        taken = forests(every, FORESTS)
        over = every[~np.isin(every[:, 0] * n + every[:, 1], taken[:, 0] * n + taken[:, 1])]
        rest[over[:, :2].ravel()] = True
        ends = np.sort(twin[over[:, :2]], axis=1)
        thin.append(ends[slice_of(ends[:, 0], ends[:, 1], THIN) == 0])
        left += len(over)
        return taken

    for hits in blocks:
        held.append(hits)
        size += len(hits)
        if size > GIVEN:
            held = [settled()]
            size = 0
    return settled(), rest, np.concatenate(thin), left


def slice_of(a: np.ndarray, b: np.ndarray, slices: int) -> np.ndarray:
    """The slice, 0 to slices - 1, that a pair of twins falls into, whichever comes first."""
    u, v = np.minimum(a, b).view(np.uint64), np.maximum(a, b).view(np.uint64)
    h = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (v * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)) % np.uint64(slices)


def routed(points: DataFrame, reach: int, bits: int, most: int) -> DataFrame:
    """band, leaf, fp, asks (and twin, if there): each point (fp, band, depth) in the leaf that holds it, and as a query in
    those that it touches. most: the largest depth; a band is divided into about 2^depth leaves.

    Each pair of points of one band within reach meets in one leaf, or in each of the parts that a leaf's queries are
    dealt to.
    """
    spark, twins = points.sparkSession, "twin" in points.columns
    sample = points.select("fp").sample(min(1.0, SAMPLE / max(1, points.count())), 3).limit(2 * SAMPLE).toPandas()["fp"] if most else []
    router = spark.sparkContext.broadcast(Router(_array(pa.array(sample, pa.binary()), bits), most))
    parts = max(1, math.ceil((1.3 if reach * 8 <= bits else 2) ** most / 32))  # the queries of a leaf, in so many parts

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, depth = _array(b.column(0), bits), b.column(2).to_numpy(zero_copy_only=False)
            home = router.value.home(fp, depth)
            at, leaf = router.value.touched(fp, reach, depth)
            on = leaf >= home[at]  # of two leaves of a band, the one with the lower number asks the other
            own = np.where(depth > 0, parts, 1)  # a band of one leaf isn't divided further
            first = np.repeat(np.arange(len(fp)), own)
            turn = np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own)
            key = np.concatenate([home[first] * parts + turn, leaf[on] * parts + np.where(depth[at[on]] > 0, fp[at[on], 0] % np.uint64(parts), 0).astype(np.int64)])
            of = pa.array(np.concatenate([first, at[on]]))
            asks = pa.array(np.arange(len(key)) >= len(first))
            yield pa.RecordBatch.from_arrays([b.column(1).take(of), pa.array(key), b.column(0).take(of), asks, *(c.take(of) for c in b.columns[3:])], ["band", "leaf", "fp", "asks", *["twin"] * twins])

    return points.select("fp", F.col("band").cast("long").alias("band"), F.col("depth").cast("int").alias("depth"), *["twin"] * twins).mapInArrow(route, "band long, leaf long, fp binary, asks boolean" + ", twin long" * twins)


def _depth(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / LEAF)))


def pairs(points: DataFrame, reach: int = 3, bits: int = 64) -> DataFrame:
    """Links (a, b), a <> b, between the fingerprints of points (fp): a graph with the components of all pairs within reach.

    At most one link for each point and leaf that it touches, not one for each pair.
    """

    def search(table: pa.Table) -> pa.Table:
        fp, at = np.unique(_array(table["fp"], bits), axis=0, return_inverse=True)
        asks = table["asks"].to_numpy()
        found = np.unique(links(fp, np.unique(at[~asks]), np.unique(at[asks]), reach), axis=0)
        return pa.table({"a": _column(fp[found[:, 0]]), "b": _column(fp[found[:, 1]])})

    depth = _depth(points.count())
    return routed(points.select("fp", F.lit(None).alias("band"), F.lit(depth).alias("depth")), reach, bits, depth).groupBy("leaf").applyInArrow(search, "a binary, b binary")


def met(rows: DataFrame) -> DataFrame:
    """What meets in rows (shingle, twin): pairs (a, b) of those that share a shingle with up to SMALL, shingle null; and the
    rows of the other shingles (shingle, a).

    Rows are dealt and sorted by shingle and streamed: a task holds a batch and SMALL rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
        large: int | None = None  # the shingle that the last rows had, if it is known to have too many

        def found(s: np.ndarray, t: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            new = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])] if len(s) else np.empty(0, bool)
            s, t = s[new], t[new]
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
            n = np.diff(np.r_[start, len(s)])
            many = (n > SMALL) | (s[start] == large if large is not None else False)
            keep = len(s)
            if not last and len(n):
                large = int(s[-1]) if many[-1] else None
                if large is None:
                    keep, start, n, many = int(start[-1]), start[:-1], n[:-1], many[:-1]
            held = s[keep:], t[keep:]
            on = np.repeat(many, n)
            shingle, a, b = [s[:keep][on]], [t[:keep][on]], [np.zeros(int(on.sum()), np.int64)]
            for size in range(2, SMALL + 1):
                first = start[(n == size) & ~many]
                if len(first):
                    i, j = np.triu_indices(size, 1)
                    edges = np.unique(np.stack([t[first[:, None] + i].ravel(), t[first[:, None] + j].ravel()], 1), axis=0)
                    a.append(edges[:, 0])
                    b.append(edges[:, 1])
            some = sum(map(len, a)) - len(shingle[0])
            yield pa.RecordBatch.from_arrays([pa.array([*shingle[0].tolist(), *[None] * some], pa.int64()), pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["shingle", "a", "b"])

        for batch in batches:
            s, t = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield from found(np.concatenate([held[0], s]), np.concatenate([held[1], t]), False)
        yield from found(*held, True)

    return rows.select("shingle", "twin").repartition("shingle").sortWithinPartitions("shingle", "twin").mapInArrow(task, "shingle long, a long, b long")


#: Bins of a text's histogram of shingles; a count of FULL stands for that many or more.
BINS, FULL = 256, 255


def histogram(shingles: np.ndarray) -> bytes:
    return np.minimum(np.bincount((shingles >> np.uint64(8) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes()


def enough(a: np.ndarray, b: np.ndarray, both: np.ndarray, ratio: float) -> np.ndarray:
    """Whether sets with these histograms and sizes, added up, can be alike by ratio: they share at most the lesser count of
    each bin."""
    lesser = np.minimum(a, b)
    return (lesser.sum(1, dtype=np.int64) >= ratio / (1 + ratio) * both - 1e-9) | (lesser == FULL).any(1)


def may_be_alike(edges: DataFrame, points: DataFrame, ratio: float) -> DataFrame:
    """Those of the edges (a, b), twins of points (twin, size, bins), whose sets of shingles can be so alike by their sizes and
    histograms. None that is so alike is lost."""
    of = [points.select(F.col("twin").alias(x), F.col("size").alias(f"size_{x}"), F.col("bins").alias(f"bins_{x}")) for x in ("a", "b")]
    near = F.least("size_a", "size_b") >= F.lit(ratio) * F.greatest("size_a", "size_b") - 1e-9
    joined = edges.select("a", "b").join(of[0], "a").join(of[1], "b").where(near).select("a", "b", (F.col("size_a") + F.col("size_b")).alias("n"), "bins_a", "bins_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (3, 4))
            on = pa.array(enough(a, b, batch.column(2).to_numpy(), ratio))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(on)

    return joined.mapInArrow(task, "a long, b long")


def verified(candidates: DataFrame, leaves: DataFrame, docs: DataFrame, words: int, similarity: float, reach: int, bits: int, points: DataFrame, twin: Column, text_col: str = "text") -> DataFrame:
    """(node, root): the components of all pairs of points, twins, whose texts have a similarity of at least that and that are
    candidates (a, b) or within reach in a leaf (band, leaf, fp, asks, twin); root is the least twin that can be reached.

    All candidates are checked at once. Of leaves, forests of the nearest pairs between different components are checked
    first, ROUNDS times; what pairs between components there are besides are then checked too, all of them, in as many
    slices as it takes to give a round a bounded number: each pair is in one slice, and is left out only if its ends are
    in one component by then. So the result is that of checking every pair.
    """
    roots, n = None, points.count()
    none = candidates.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)

    def ends(table: pa.Table) -> tuple[np.ndarray, Iterator[np.ndarray]]:
        """The twins of a leaf, and block by block the pairs of them that are within reach, in different components and not
        told apart by their histograms."""
        twin, first, at = np.unique(table["twin"].to_numpy(), return_index=True, return_inverse=True)
        asks, label = table["asks"].to_numpy(), table["label"].to_numpy()[first]
        kept = table.select(["fp", "size", "bins"]).take(pa.array(first))
        size, bins = kept["size"].to_numpy(), np.frombuffer(b"".join(kept["bins"].to_pylist()), np.uint8).reshape(-1, BINS)

        def hits() -> Iterator[np.ndarray]:
            if (label == label[0]).all():
                return
            for found in apart(_array(kept["fp"], bits), label, np.unique(at[~asks]), np.unique(at[asks]), reach):
                for i in range(0, len(found), BLOCK):
                    part = found[i : i + BLOCK]
                    a, b = part[:, 0], part[:, 1]
                    on = enough(bins[a], bins[b], size[a] + size[b], similarity)
                    if on.any():
                        yield part[on]

        return twin, hits()

    def forest_of(table: pa.Table) -> pa.Table:
        """Pairs to check; points with pairs besides (b null); some of those pairs (leaf null); how many they are (a null)."""
        twin, hits = ends(table)
        found, rest, thin, left = nearest(hits, twin)
        more, many = twin[rest], int(rest.any())
        n, key = len(found) + len(more) + many, [table[c].to_pylist()[:1] for c in ("band", "leaf")]
        a = [*twin[found[:, 0]].tolist(), *more.tolist(), *[None] * many, *thin[:, 0].tolist()]
        b = [*twin[found[:, 1]].tolist(), *[None] * len(more), *[left] * many, *thin[:, 1].tolist()]
        return pa.table({"band": pa.array(key[0] * len(a), pa.int64()), "leaf": pa.array(key[1] * n + [None] * len(thin), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def part_of(k: int, slices: int):
        def search(table: pa.Table) -> pa.Table:
            twin, hits = ends(table)
            found = [np.empty((0, 2), np.int64)]
            for some in hits:
                a, b = twin[some[:, 0]], twin[some[:, 1]]
                on = slice_of(a, b, slices) == k
                found.append(np.stack([a[on], b[on]], 1))
            found = np.concatenate(found)
            return pa.table({"a": found[:, 0], "b": found[:, 1]})

        return search

    def labelled(rows: DataFrame, name: str, label: str) -> DataFrame:
        if roots is None:
            return rows.withColumn(label, F.col(name))
        return rows.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(name) == F.col("_node"), "left").withColumn(label, F.coalesce("_root", name)).drop("_node", "_root")

    def known(leaves: DataFrame) -> DataFrame:
        return labelled(leaves, "twin", "label").join(points.select("twin", "size", "bins"), "twin")

    def learn(edges: DataFrame) -> None:
        nonlocal roots
        new = checked(may_be_alike(edges.distinct(), points, similarity), docs, words, similarity, twin, text_col)
        if new.isEmpty():
            return
        linked = new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, roots = roots, components(linked)
        gone(new, *[] if before is None else [before])

    left = largest = several = 0
    if leaves.isEmpty():
        learn(candidates)
        return roots if roots is not None else none
    for k in range(ROUNDS):
        given = cut(known(leaves).groupBy("band", "leaf").applyInArrow(forest_of, "band long, leaf long, a long, b long"))
        nearest_pairs = given.where("leaf IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select("a", "b")
        learn(nearest_pairs if k else nearest_pairs.unionByName(candidates))
        left, largest = given.where("a IS NULL").agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
        several = THIN * given.where("leaf IS NULL").select("a", "b").distinct().count()  # a pair may be in many leaves
        more = given.where("a IS NOT NULL AND b IS NULL").select(F.col("band").alias("_band"), F.col("leaf").alias("_leaf"), F.col("a").alias("_twin"))
        rest = cut(leaves.join(more, F.col("band").eqNullSafe(F.col("_band")) & (F.col("leaf") == F.col("_leaf")) & (F.col("twin") == F.col("_twin")), "left_semi"))
        gone(given, leaves)
        leaves = rest
        if not left:
            break
    slices = max(int(left > 0), math.ceil(min(left, several) / max(CHECKS, n)), math.ceil(largest / GIVEN))
    for k in range(slices):
        learn(known(leaves).groupBy("band", "leaf").applyInArrow(part_of(k, slices), "a long, b long"))
    return roots if roots is not None else none


_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingled(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes of their words' hashes; all its words where there are fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split() or [b""]
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(w))):
        out = (out ^ out >> np.uint64(29)) * _FIRST + h[i : i + n]
    return np.unique(_scrambled(out))


def sketch(text: str | None, words: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of the distinct shingles, those shingles)."""
    shingles = shingled(text, words)
    out = []
    for lane in range(bits // 64):
        h = _scrambled(shingles + np.uint64((lane + 1) * _NEXT & 0xFFFFFFFFFFFFFFFF))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), BLOCK):
            ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64), shingles


def rarest(shingles: np.ndarray, ratio: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """As many of the shingles, sorted, as of two sets that are alike by ratio one must be in both: the first ones in the
    order of how often they are in the sample (common, sorted, and often; the others never) and then by number."""
    n = len(shingles) - math.ceil(ratio * len(shingles) - 1e-9) + 1
    if not len(common):
        return shingles[:n]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    times = np.where(common[at] == shingles, often[at], 0)
    return shingles[np.lexsort((shingles, times))[:n]]


def common_shingles(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles in at least COMMON texts of a sample of about COMMON_BYTES, sorted; in how many; the sample's share)."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    share = min(1.0, COMMON_BYTES / max(1, size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingled(t.as_py(), words).view(np.int64))], ["shingle"])

    found = docs.sample(share, 3).select(text_col).mapInArrow(task, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON).toArrow()
    shingle, n = found["shingle"].to_numpy().view(np.uint64), found["count"].to_numpy()
    rising = np.argsort(shingle)
    return shingle[rising], n[rising], share


def sketches(docs: DataFrame, words: int, bits: int, ratio: float, twin: Column, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, twin, fp, size (distinct shingles), bins (their histogram), rare (shingles to meet by), hot (those of them that more than LEAF texts have, by the sample)."""
    common, often, share = common_shingles(docs, words, text_col)
    known = docs.sparkSession.sparkContext.broadcast((common, often, common[often > LEAF * share]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, n, hot = known.value
        for b in batches:
            fps, sizes, bins, kept = [], [], [], ([], [])
            for t in b.column(3):
                fp, shingles = sketch(t.as_py(), words, bits)
                sizes.append(len(shingles))
                bins.append(histogram(shingles))
                rare = rarest(shingles, ratio, all_, n)
                on = np.isin(rare, hot)
                fps.append(fp)
                for held, some in zip(kept, (rare[~on], rare[on]), strict=True):
                    held.append(some.view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, k)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *k]))) for k in kept]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _column(np.array(fps, np.uint64).reshape(-1, bits // 64)), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), *lists], ["row", "doc_id", "twin", "fp", "size", "bins", "rare", "hot"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), twin.alias("twin"), F.col(text_col).alias("text"))
    return slim.mapInArrow(task, "row long, doc_id long, twin long, fp binary, size long, bins binary, rare array<long>, hot array<long>")


#: Links of one text that are checked together; bytes of a shingle's hash that are dealt for that.
TOGETHER, SHORT = 32, 6


def _short(shingles: np.ndarray) -> bytes:
    """The upper bytes of sorted shingles, which sort alike."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SHORT, 8), np.uint8)
    out[:, 8 - SHORT :] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
    return out.view(">u8").ravel().astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted lists of different numbers share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def checked(edges: DataFrame, docs: DataFrame, words: int, similarity: float, twin: Column, text_col: str = "text") -> DataFrame:
    """The edges (a, b), twins of docs, whose texts have a Jaccard similarity of shingles of at least that, each shingle
    told by 48 bits of its hash.

    Each text's shingles are made once. Of an edge, the end with more edges is the head; a head's edges are dealt in parts
    of about TOGETHER, each with a copy of the head's shingles in front. A task holds the shingles of two texts at a time.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    degree = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count())
    named = docs.select(F.col(text_col).alias("text"), twin.alias("digest"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, text in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()], pa.int64()), pa.array([_short(shingled(text.as_py(), words))], pa.binary())], ["digest", "set"])

    once = picked(named, degree.select(F.col("node").alias("digest"))).groupBy("digest").agg(F.min("text").alias("text")).join(degree, F.col("digest") == F.col("node"), "left_semi")
    texts = cut(once.mapInArrow(sets, "digest long, set binary"))
    of = [degree.select(F.col("node").alias(x), F.col("count").alias(f"n_{x}")) for x in ("a", "b")]
    known = edges.join(of[0], "a").join(of[1], "b")
    first = F.col("n_a") >= F.col("n_b")
    led = known.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("head"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.ceil(F.greatest("n_a", "n_b") / TOGETHER).alias("parts"))
    led = cut(led.select("head", F.pmod(F.xxhash64("other"), F.col("parts")).alias("part"), "other"))
    others = led.join(texts, F.col("other") == F.col("digest")).select("head", "part", "other", "set")
    heads = led.select("head", "part").distinct().join(texts, F.col("head") == F.col("digest")).select("head", "part", F.lit(None).cast("long").alias("other"), "set")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for b in batches:
            kept = []
            for head, other, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                s = _long(raw.as_py())
                if other is None:
                    own = s
                    continue
                both = _shared(own, s)
                if both >= similarity * (len(own) + len(s) - both):
                    kept.append((head, other))
            a = np.array(kept, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    rows = others.unionByName(heads).repartition("head", "part").sortWithinPartitions("head", "part", F.col("other").asc_nulls_first())
    out = cut(rows.mapInArrow(task, "a long, b long"))
    gone(edges, degree, texts, led)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (a, b): root is the least node that can be reached.

    Each round a node takes the least root among its neighbours, then that root's own root; what changed is counted.
    Labels are written after each round; nothing but that count reaches the driver.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("next"))
        own = roots.select(F.col("node").alias("next"), F.col("root").alias("above"))
        new = cut(step.join(own, "next").select("node", F.least("next", "above").alias("root"), (F.least("next", "above") < F.col("root")).alias("moved")))
        settled = new.where("moved").isEmpty()
        gone(roots)
        roots = new.select("node", "root")
        if settled:
            gone(both)
            return roots


#: The chance that two texts as alike as asked for differ in more bits than reach_of() tells.
MISSED = 1e-6


def reach_of(similarity: float, bits: int) -> int:
    """Bits by which texts of a Jaccard similarity differ, but for the chance MISSED: each bit does with the probability that
    two texts of one length give, or two of as few shingles as can have one of five of their own."""
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 3 / 16 if similarity <= 0.8 else 0.0)
    beyond = 1.0
    for reach in range(bits + 1):
        beyond -= math.comb(bits, reach) * p**reach * (1 - p) ** (bits - reach)
        if beyond < MISSED:
            return reach
    return bits


#: Texts that share their hash with another text up to which they are told apart by a list in the plan.
COLLIDING = 10_000


def twins(docs: DataFrame, text_col: str = "text") -> Column:
    """A number for each distinct text of docs: a hash, another one for those texts that share theirs with a different text.

    Texts are told apart by their SHA-256. There are about three such texts among 10^10.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    hashed = docs.select(sha.alias("sha")).withColumn("twin", F.xxhash64("sha"))
    known = hashed.groupBy("twin").agg(F.min("sha").alias("first"), F.max("sha").alias("last")).where("first <> last").drop("last")
    other = [r["sha"] for r in hashed.join(known, "twin").where("sha <> first").select("sha").distinct().limit(COLLIDING + 1).collect()] if not known.isEmpty() else []
    if len(other) > COLLIDING:
        raise ValueError("too many texts share their hash with another text")
    return F.when(sha.isin(other), F.xxhash64(sha, F.lit("again"))).otherwise(F.xxhash64(sha)) if other else F.xxhash64(sha)


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = 3, bits: int = 64, ratio: float | None = None, id_col: str = "doc_id", text_col: str = "text", twin: Column | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, twin (of the text: see twins(), which gives it by ratio if it isn't given), fp (binary), component_id, root (of the component).

    Fingerprints within `reach` bits are linked; component_id is the smallest doc_id that can be reached. By ratio (say
    0.8), fingerprints are made of distinct shingles, as the similarity is; texts that share one of their rarest shingles,
    as all that are so alike must, and can be so alike by their sizes and histograms, are held against each other, and those whose shingles have
    a Jaccard similarity of at least ratio are linked (root is then the least twin of the component). Those that share only
    such rare shingles as more than SMALL texts have are held against each other if they lie within reach in trees. Texts without words
    and null texts have fingerprint 0 (by ratio: one and the same) and are linked like any other. Null doc_ids
    count as larger than all others, so a component of nothing else has a null component_id. A very long text is one
    point, read whole. Other columns are ignored; rows alike are kept; an empty table gives an empty result. Equal
    fingerprints (by ratio: texts) are one point, whatever their number.
    """
    if ratio:
        twin = twins(docs, text_col) if twin is None else twin
        marked = cut(sketches(docs, words, bits, ratio, twin, id_col, text_col))
        firsts = marked.groupBy("twin").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"))
        points = cut(marked.join(firsts.select("row", "first"), "row").select("twin", "fp", "size", "bins", "first", "rare", "hot"))
        found = cut(met(points.select(F.explode("rare").alias("shingle"), "twin")))
        candidates = found.where("shingle IS NULL").select("a", "b")
        large = found.where("shingle IS NOT NULL").select("shingle", F.col("a").alias("twin")).unionByName(points.select(F.explode("hot").alias("shingle"), "twin"))
        sizes = cut(large.groupBy("shingle").agg(F.count("*").alias("n")))
        most = _depth(sizes.agg(F.max("n")).first()[0] or 0)
        depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF)).cast("int"))
        dealt = large.join(sizes, "shingle").join(points.select("twin", "fp"), "twin").select(F.col("shingle").alias("band"), "twin", "fp", depth.alias("depth"))
        dealt = cut(dealt)
        leaves = cut(routed(dealt, reach, bits, most))
        gone(sizes, dealt)
        roots = verified(candidates, leaves, docs, words, ratio, reach, bits, points, twin, text_col)
        homes = points.select("twin", "first").join(roots, F.col("twin") == F.col("node"), "left").select("twin", F.coalesce("root", "twin").alias("root"), "first")
        homes = homes.join(homes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("twin", "root", "component_id")
        return marked.select("doc_id", "twin", "fp").join(homes, "twin").select("doc_id", "twin", "fp", "component_id", "root")
    marked = cut(fingerprints(docs, words, bits, id_col, text_col))
    points = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(pairs(points, reach, bits))
    named = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    homes = named.join(least, "root").select("fp", "component_id", "root")
    return marked.join(homes, "fp").select("doc_id", "twin", "fp", "component_id", "root")
