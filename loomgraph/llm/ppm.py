"""Language-model scores by prediction by partial matching, and the word model they are compared with.

The trie of all training texts is never held in one place. Its contexts are dealt to parts by their last bytes, so a part has
whole contexts, and all longer ones that end alike; contexts too frequent for a part are divided by one byte more. What stands
above the contexts that are dealt, the head, is known to every part. Blocks of texts ask the parts for the grams they have,
each gram once, and get its code length back.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut

#: Bytes of the longest context; chosen, like ESCAPE, by the code length of held-out texts.
ORDER = 6
#: What a distinct child of a context weighs for its escape.
ESCAPE = 0.3
#: Bytes of the texts of a block, and of the texts whose grams a part is planned for.
BLOCK, PART = 6 << 20, 8 << 20
#: Bytes of a block whose grams are held at once.
SLICE = 2 << 20
#: Bytes of text from which it is told which contexts are too frequent for a part, and how often a context must be in them
#: for that. They decide balance, never results.
SAMPLE, SEEN = 8 << 20, 16
#: A context is divided if it has more than this share of a part.
SHARE = 1 / 8

END = 10
_FLAT = bytes(32 if i in b"\t\n\v\f\r " else i + 32 if 65 <= i <= 90 else i for i in range(256))


def stream(text: str | None) -> bytes:
    """The bytes that are scored: the words in lower case (A-Z only), single spaces between them, and an end."""
    s = (text or "").encode("utf-8", "surrogatepass").translate(_FLAT)
    while b"  " in s:
        s = s.replace(b"  ", b" ")
    return s.strip(b" ") + b"\n"


def pieces_of(s: bytes, step: int) -> Iterator[tuple[int, bytes]]:
    """(place, piece) of a stream: pieces of whole words, of about `step` bytes unless a word alone is longer."""
    at = 0
    while at < len(s):
        end = s.find(b" ", at + step) + 1 if len(s) - at > step else 0
        yield at, s[at : end or len(s)]
        at = end or len(s)


def grams(pieces: list[bytes], contexts: list[bytes] | None = None, order: int = ORDER) -> np.ndarray:
    """For each byte of the pieces, the `order` bytes before it and itself as one number; before a piece stands its context,
    by default ends."""
    contexts = contexts or [bytes([END]) * order] * len(pieces)
    raw = b"".join(x for c, p in zip(contexts, pieces, strict=True) for x in (c, p)) + bytes(8)
    starts = np.cumsum([0, *(len(p) + order for p in pieces[:-1])]) if pieces else np.empty(0, np.int64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    windows = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    out = np.empty(int(sizes.sum()), np.uint64)
    at = 0
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        out[at : at + n] = windows[s : s + n]
        at += n
    out >>= np.uint64(8 * (7 - order))
    return out


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys among sorted ones, and how often each occurs."""
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)
    return sorted_keys[first], np.diff(np.r_[first, len(sorted_keys)])


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Router:
    """Which part a gram belongs to: that of the shortest ending of its context, two bytes at least, that isn't divided."""

    def __init__(self, parts: int, order: int, divided: dict[int, np.ndarray]):
        """divided: for each length from 2, the contexts that are divided, sorted."""
        self.parts, self.order, self.least = parts, order, min(2, order)
        self.divided = {k: divided.get(k, np.empty(0, np.uint64)) for k in range(2, order)}
        for k in range(3, order):  # what ends in a whole context is whole
            own = self.divided[k]
            self.divided[k] = own[_find(self.divided[k - 1], own & _mask(k - 1))[1]]

    def depth(self, keys: np.ndarray) -> np.ndarray:
        """The length of the ending that decides each gram's part."""
        out = np.full(len(keys), self.least, np.uint8)
        on = np.arange(len(keys))
        for k in range(2, self.order):
            on = on[_find(self.divided[k], keys[on] >> np.uint64(8) & _mask(k))[1]]
            out[on] = k + 1
        return out

    def part(self, keys: np.ndarray, depth: np.ndarray) -> np.ndarray:
        h = (keys >> np.uint64(8) & _MASKS[depth] | depth.astype(np.uint64) << np.uint64(56)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ h >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)

    def is_divided(self, length: int, contexts: np.ndarray) -> np.ndarray:
        if length < self.least:
            return np.ones(len(contexts), bool)
        return _find(self.divided[length], contexts)[1] if length in self.divided else np.zeros(len(contexts), bool)

    def nodes(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of the contexts that decide, as (length, context, byte) in one number, distinct and sorted."""
        depth = self.depth(keys)
        return np.unique(keys & _MASKS[depth + 1] | depth.astype(np.uint64) << np.uint64(56))

    def head(self, nodes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order below the longest, the nodes of the divided contexts and their counts, from all nodes()."""
        length, key = nodes >> np.uint64(56), nodes & _mask(7)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        above = np.empty(0, np.uint64)
        for k in range(self.order - 1, -1, -1):
            children = np.concatenate([above, key[length == k + 1]])
            out.append(runs(np.sort(children & _mask(k + 1))))
            above = out[-1][0]
        return out[::-1]

    def levels(self, keys: np.ndarray, n: np.ndarray, head: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(gram, count) for each order from 0 as far as a part's grams (keys, sorted, and their counts) need them.

        Beyond the longest order, a node's count is the number of its own longer nodes (update exclusion)."""
        out, own = [(keys, n)], keys
        for k in range(self.order - 1, -1, -1):
            own, many = runs(np.sort(own & _mask(k + 1)))
            whole = ~self.is_divided(k, own >> np.uint64(8))
            own, many = own[whole], many[whole]
            both, count = np.concatenate([own, head[k][0]]), np.concatenate([many, head[k][1]])
            rising = np.argsort(both)
            out.append((both[rising], count[rising]))
        return out[::-1]


class Trie:
    """A byte-context trie with what escapes and exclusions need, as sorted arrays: one for each order.

    In a context with d children counted t in all, the escape weighs ESCAPE * d. After an escape to the next shorter
    context, the children of the longer one are excluded: what remains is known for each context beforehand, because its
    children are children of every shorter context too. Below order 0, all bytes not excluded are alike.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each order from 0, (gram, count), sorted by gram."""
        self.order = len(counts) - 1
        self.gram, self.start, self.log_n = [], [], []
        self.context, self.escape, self.log_left, self.escape_on = [], [], [], []
        below = None
        for order, (key, n) in enumerate(counts):
            context = key >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(key) else np.empty(0, np.int64)
            names, t = context[first], np.add.reduceat(n, first).astype(float) if len(key) else np.empty(0)
            d = np.diff(np.r_[first, len(key)]).astype(float)
            left = rest = np.zeros(len(names))
            if order and len(names):
                gram0, n0, names0, t0, d0 = below
                parent = np.searchsorted(names0, names & _mask(order - 1))
                shared = np.add.reduceat(n0[np.searchsorted(gram0, key & _mask(order))], first).astype(float)
                left, rest = t0[parent] - shared, ESCAPE * (d0[parent] - d)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.start.append(np.log10(n / np.repeat(t + ESCAPE * d, d.astype(int))))
                self.escape.append(np.log10(ESCAPE * d / (t + ESCAPE * d)))
                self.log_left.append(np.log10(left + rest))
                self.escape_on.append(np.where(left > 0, np.log10(rest / (left + rest)), 0))
            self.gram.append(key)
            self.log_n.append(np.log10(n))
            self.context.append(names)
            below = key, n, names, t, d
        self.floor = -math.log10(256 - (len(self.gram[0]) if counts else 0)) if not counts or len(self.gram[0]) < 256 else 0.0

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others. grams: distinct and sorted is fastest."""
        out = np.zeros(len(grams))
        active, held = np.arange(len(grams)), np.full(len(grams), -1)
        for order in range(self.order, -1, -1):
            g = grams[active] & _mask(order + 1)
            context, known = _find(self.context[order], g >> np.uint64(8))
            gram, hit = _find(self.gram[order], g)
            begun = held[active] >= 0
            above = held[active]
            begins = known & ~begun
            out[active[begins & hit]] += self.start[order][gram[begins & hit]]
            out[active[begins & ~hit]] += self.escape[order][context[begins & ~hit]]
            if begun.any():
                on = begun & hit
                out[active[on]] += self.log_n[order][gram[on]] - self.log_left[order + 1][above[on]]
                on = begun & ~hit
                out[active[on]] += self.escape_on[order + 1][above[on]]
            held[active[known]] = context[known]
            active = active[~(hit & (begins | begun))]
        out[active] += self.floor
        return out


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _whole(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True) if raw[:8] != bytes(8) else b""


def _planes(a: np.ndarray) -> bytes:
    """Numbers with all their first bytes before all second ones and so on, compressed: planes of zeros take no room."""
    return _squeezed(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_whole(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Block:
    """Pieces of texts that ask the parts together."""

    def __init__(self):
        self.row, self.doc, self.training, self.piece, self.context, self.size = [], [], [], [], [], 0

    def add(self, row: int, doc: int | None, training: bool, piece: bytes, context: bytes) -> None:
        for held, x in zip((self.row, self.doc, self.training, self.piece, self.context), (row, doc, training, piece, context), strict=True):
            held.append(x)
        self.size += len(piece)

    def packed(self) -> dict:
        tokens = sum(p.count(b" ", 0, -1) + (len(p) > 1) + p.endswith(b"\n") for p, t in zip(self.piece, self.training, strict=True) if t)
        return {"row": self.row, "doc": self.doc, "training": self.training, "sizes": [len(p) for p in self.piece], "context": _squeezed(b"".join(self.context)), "stream": _squeezed(b"".join(self.piece)), "tokens": tokens}


def _pieces(packed: dict, order: int) -> tuple[list[bytes], list[bytes]]:
    stream_, context = _whole(packed["stream"]), _whole(packed["context"])
    edges = np.cumsum([0, *packed["sizes"]]).tolist()
    return [stream_[a:b] for a, b in zip(edges, edges[1:], strict=False)], [context[i * order : (i + 1) * order] for i in range(len(edges) - 1)]


def _slices(pieces: list[bytes], contexts: list[bytes], order: int) -> Iterator[np.ndarray]:
    """The grams of pieces, some at a time: at most about twice SLICE, also of a piece that is longer."""
    held: list[tuple[bytes, bytes]] = []
    size = 0
    for p, c in zip(pieces, contexts, strict=True):
        for at in range(0, len(p), SLICE):
            held.append((p[at : at + SLICE], c if not at else p[at - order : at]))
            size += len(held[-1][0])
            if size >= SLICE:
                yield grams(*map(list, zip(*held, strict=True)), order)
                held, size = [], 0
    if held:
        yield grams(*map(list, zip(*held, strict=True)), order)


def _asked(packed: dict, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams of a block, distinct and sorted; how often each is in texts to learn from; the latter's alone)."""
    pieces, contexts = _pieces(packed, order)
    by_use = []
    for use in (True, False):
        own = [i for i, t in enumerate(packed["training"]) if t is use]
        found = []
        for g in _slices([pieces[i] for i in own], [contexts[i] for i in own], order):
            g.sort()
            found.append(runs(g))
        by_use.append(found[0] if len(found) == 1 else _summed([k for k, _ in found], [n for _, n in found]))
    (learned, n), (rest, _) = by_use
    keys = np.concatenate([learned, rest])
    keys.sort()
    keys = runs(keys)[0]
    count = np.zeros(len(keys), "<u4")
    count[np.searchsorted(keys, learned)] = n
    return keys, count, learned


class _Words:
    """The distinct words of a block's pieces; each piece's words by number; the parts that the words are dealt to."""

    def __init__(self, pieces: list[bytes], parts: int):
        numbers: dict[bytes, int] = {}
        self.word, self.times = [], []
        for p in pieces:
            own = Counter(p.split())
            self.word.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int32, len(own)))
            self.times.append(np.fromiter(own.values(), np.int32, len(own)))
        self.ends = np.cumsum([0, *map(len, self.word)])
        self.words, self.word, self.times = list(numbers), np.concatenate(self.word), np.concatenate(self.times)
        self.order, self.spans = _dealt(np.fromiter((zlib.crc32(w) % parts for w in self.words), np.int64, len(self.words)))

    def learned(self, training: list[bool]) -> np.ndarray:
        return np.bincount(self.word, self.times * np.repeat(training, np.diff(self.ends)), len(self.words)).astype("<i4")


def _dealt(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by part, and (part, from, to) in it."""
    small = part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part
    by_part = np.argsort(small, kind="stable")
    names, n = runs(part[by_part])
    ends = np.cumsum(n)
    return by_part, list(zip(names.tolist(), (ends - n).tolist(), ends.tolist(), strict=True))


def _divided(texts: DataFrame, size: int, parts: int, order: int) -> dict[int, np.ndarray]:
    """The contexts that are too frequent for a part, as told by a sample of texts."""
    share = min(1.0, SAMPLE / max(1, size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                s = stream(t.as_py())
                for at in range(0, len(s), BLOCK):
                    g = grams([s[at : at + BLOCK]], None, order) >> np.uint64(8)
                    for k in range(2, order):
                        own, n = runs(np.sort(g & _mask(k)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own.view(np.int64)), pa.array(n)], ["k", "context", "n"])

    least = max(SEEN, size * share / max(1, parts) * SHARE)
    # at most SAMPLE / SEEN contexts of a length, about
    found = texts.sample(share, 3).select("text").mapInArrow(task, "k int, context long, n long").groupBy("k", "context").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    k, context = found["k"].to_numpy(), found["context"].to_numpy().view(np.uint64)
    return {i: np.sort(context[k == i]) for i in range(2, order)}


def score(docs: DataFrame, training: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, bytes.

    training picks the rows to learn from. score is the trie's log10 probability of the text's words in lower case with
    single spaces and an end, whole; bytes is their number. base_score adds up log10((c + 0.5) / (N + 0.5 (V + 1))) over
    the words and the end; c: how often the training texts have it, N: their tokens, V: how many of them differ. n_known
    counts the tokens with c > 0. Null and empty texts have the end alone. Without training rows all bytes are alike and
    no token is known. A text longer than a block is scored in pieces, each after the bytes before it, and summed. Rows
    alike are scored alike; other columns are ignored; an empty table gives an empty result.

    Nothing is pruned: each gram of the training texts counts, and what is gathered grows with them. Written are the
    blocks; grams, words and what comes back for them are dealt once each. The head that every task knows has at most 256
    bytes for each of the divided contexts, which the bounded sample limits, and 2^24 nodes above those of two bytes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.monotonically_increasing_id().alias("row"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / PART))
    router = spark.sparkContext.broadcast(Router(parts, order, _divided(base, size, parts, order)))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes = _Block(), np.empty(0, np.uint64)

        def done() -> pa.RecordBatch:
            nonlocal block, nodes
            packed, block = block.packed(), _Block()
            nodes = np.union1d(nodes, router.value.nodes(_asked(packed, order)[2]))
            return _rows([uuid.uuid4().hex], [pickle.dumps(packed)], [packed["tokens"]], [None])

        for b in batches:
            for text, doc, on, row in zip(b.column(0), *(c.to_pylist() for c in b.columns[1:]), strict=True):
                s = stream(text.as_py())
                for at, piece in pieces_of(s, BLOCK // 2):
                    block.add(row, doc, on, piece, bytes([END]) * (order - min(at, order)) + s[at - min(at, order) : at])
                    if block.size >= BLOCK:
                        yield done()
        if block.row:
            yield done()
        yield _rows([None], [None], [None], [nodes.view(np.int64)])

    def _rows(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["block", "data", "tokens", "nodes"])

    made = cut(base.mapInArrow(divide, "block string, data binary, tokens long, nodes array<long>"))
    blocks = made.where("block IS NOT NULL").select("block", "data")
    nodes = made.where("block IS NULL").select(F.explode("nodes").alias("node")).distinct().toArrow()["node"].to_numpy()
    head = spark.sparkContext.broadcast(router.value.head(np.sort(nodes.view(np.uint64))))
    n = made.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packed = pickle.loads(data.as_py())
                out: list[tuple] = []
                keys, count, _ = _asked(packed, order)
                by_part, spans = _dealt(router.value.part(keys, router.value.depth(keys)))
                keys, count = keys[by_part], count[by_part]
                out += [(p, name, _planes(keys[a:z].astype("<u8")), _planes(count[a:z])) for p, a, z in spans]
                w = _Words(_pieces(packed, order)[0], parts)
                learned = w.learned(packed["training"])
                out += [(-1 - p, name, _squeezed(b"\n".join([w.words[i] for i in w.order[a:z].tolist()])), _planes(learned[w.order[a:z]])) for p, a, z in w.spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        part, names = table["part"][0].as_py(), table["block"].to_pylist()
        if part < 0:
            total: Counter = Counter()
            for words, counts in zip(table["keys"], table["counts"], strict=True):
                for w, c in zip(_whole(words.as_py()).split(b"\n"), _from_planes(counts.as_py(), "<i4").tolist(), strict=True):
                    total[w] += c
            given = [_planes(np.fromiter((total[w] for w in _whole(words.as_py()).split(b"\n")), "<i8")) for words in table["keys"]]
            names, given = [*names, None], [*given, sum(c > 0 for c in total.values()).to_bytes(8, "little")]
        else:
            keys = [_from_planes(x.as_py(), "<u8") for x in table["keys"]]
            counts = [_from_planes(x.as_py(), "<u4") for x in table["counts"]]
            known, times = _summed(keys, counts)
            on = times > 0
            values = np.empty(len(known), "<f4")
            trie = Trie(router.value.levels(known[on], times[on], head.value))
            for at in range(0, len(known), 1 << 18):
                values[at : at + (1 << 18)] = trie.log10(known[at : at + (1 << 18)])
            given = [_planes(values[np.searchsorted(known, k)]) for k in keys]
        return pa.table({"block": pa.array(names, pa.string()), "part": pa.array([part] * len(names), pa.int64()), "given": pa.array(given, pa.binary())})

    def sums(key: tuple, block: pa.Table, given: pa.Table) -> pa.Table:
        if key[0].as_py() is None:  # how many words differ, by part
            v = sum(int.from_bytes(x.as_py(), "little") for x in given["given"])
            return pa.table({"row": pa.array([None], pa.int64()), "doc_id": pa.array([None], pa.int64()), "n_tokens": [v], "n_known": [0], "base": [0.0], "score": [0.0], "bytes": [0]})
        packed, reply = pickle.loads(block["data"][0].as_py()), dict(zip(given["part"].to_pylist(), given["given"], strict=True))
        pieces, contexts = _pieces(packed, order)
        encoded = [pa.array(g).dictionary_encode() for g in _slices(pieces, contexts, order)]
        keys = np.concatenate([e.dictionary.to_numpy() for e in encoded])
        keys.sort()
        keys = runs(keys)[0]
        by_part, spans = _dealt(router.value.part(keys, router.value.depth(keys)))
        values = np.empty(len(keys), np.float32)
        for p, a, z in spans:
            values[by_part[a:z]] = _from_planes(reply[p].as_py(), "<f4")
        each = np.concatenate([values[np.searchsorted(keys, e.dictionary.to_numpy())][e.indices.to_numpy()] for e in encoded])
        total = np.add.reduceat(each, np.cumsum([0, *packed["sizes"][:-1]]), dtype=float)

        w = _Words(pieces, parts)
        c = np.zeros(len(w.words))
        for p, a, z in w.spans:
            c[w.order[a:z]] = _from_planes(reply[-1 - p].as_py(), "<i8")
        cumulated = np.zeros((3, len(pieces)))
        own = np.flatnonzero(np.diff(w.ends))  # texts without words add nothing
        if len(own):
            cumulated[:, own] = np.add.reduceat(np.stack([w.times.astype(float), w.times * (c[w.word] > 0), w.times * np.log10(c[w.word] + 0.5)]), w.ends[:-1][own], axis=1)
        ended = np.array([p.endswith(b"\n") for p in pieces])
        return pa.table({"row": pa.array(packed["row"], pa.int64()), "doc_id": pa.array(packed["doc"], pa.int64()), "n_tokens": pa.array(cumulated[0].astype(np.int64) + ended), "n_known": pa.array(cumulated[1].astype(np.int64)), "base": pa.array(cumulated[2]), "score": pa.array(total), "bytes": pa.array(packed["sizes"], pa.int64())})

    asked = blocks.mapInArrow(ask, "part long, block string, keys binary, counts binary")
    given = asked.groupBy("part").applyInArrow(answer, "block string, part long, given binary")
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, bytes long"
    told = cut(blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(sums, schema))
    texts = base.agg(F.count(F.when(F.col("training"), 1))).first()[0]
    v = (told.where("row IS NULL").agg(F.sum("n_tokens")).first()[0] or 0) + (texts > 0)
    whole = told.where("row IS NOT NULL").groupBy("row").agg(F.min("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "bytes")])
    per_token = math.log10(n + 0.5 * (v + 1))
    return whole.select("doc_id", "n_tokens", (F.col("n_known") + int(texts > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.lit(math.log10(texts + 0.5)) - F.col("n_tokens") * per_token).alias("base_score"), "score", "bytes")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of sorted lists, and the sums of their counts."""
    known = np.concatenate([np.empty(0, np.uint64), *keys])
    known.sort()
    known = runs(known)[0]
    total = np.zeros(len(known), np.int64)
    for k, c in zip(keys, counts, strict=True):  # the keys of one list differ
        total[np.searchsorted(known, k)] += c
    return known, total
