"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS, NGRAM, SEED = 512, 3, 20
#: Code points handled at once, about; and the largest table of n-gram codes that is counted directly.
BLOCK, DIRECT = 2_000_000, 1 << 22
#: n-grams of a block up to which their vectors are kept; n-grams whose vectors are added up at once.
FEW, STEP = 1 << 16, 1 << 13


class Letters:
    """Letters in lower case, and their random vectors of -1 and 1; all else is a gap, which has a vector too."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.lower = np.full(0x110000, -1, np.int32)
        self.vectors: dict[int, np.ndarray] = {}

    def of(self, points: np.ndarray) -> np.ndarray:
        for c in np.unique(points[self.lower[points] < 0]).tolist():
            small = chr(c).lower()
            self.lower[c] = ord(small[0]) if chr(c).isalpha() else 0
        return self.lower[points]

    def vector(self, letter: int) -> np.ndarray:
        if letter not in self.vectors:
            self.vectors[letter] = np.random.Generator(np.random.PCG64([SEED, letter])).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.vectors[letter]


class Profiles:
    """n-gram vectors: the product of the letters' vectors, each rotated by its distance from the last."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = NGRAM):
        self.letters, self.n = Letters(dimensions), n

    def counted(self, texts: list[str]) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
        """(the distinct n-grams, number of the n-gram at each place, text at each place, letters per text).

        Each run of what is no letter is one gap; a text begins and ends with one."""
        points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        letter = self.letters.of(points)
        found = np.bincount(text[letter > 0], minlength=len(texts))
        keep = (letter > 0) | np.r_[True, (letter[:-1] > 0) | (text[1:] != text[:-1])]
        letter, text = letter[keep], text[keep]
        known, at = np.unique(letter, return_inverse=True)
        m, n = len(known), self.n
        code = np.zeros(max(0, len(at) - n + 1), np.int64)
        for i in range(n):
            code = code * m + at[i : i + len(code)]
        same = text[: len(code)] == text[n - 1 :][: len(code)]
        code, text = code[same], text[: len(code)][same]
        if m**n <= DIRECT:
            there = np.flatnonzero(np.bincount(code, minlength=m**n))
            number = np.zeros(m**n, np.int64)
            number[there] = np.arange(len(there))
            number = number[code]
        else:  # where m**n is beyond 63 bits, codes may coincide: n-grams then share a vector
            there, number = np.unique(code, return_inverse=True)
        return Grams(there, np.array([self.letters.vector(c) for c in known.tolist()], np.int8).reshape(m, -1), n), number, text, found


class Grams:
    """Distinct n-grams, as codes over the letters of base. Their vectors are kept only where there are few of them."""

    def __init__(self, codes: np.ndarray, base: np.ndarray, n: int):
        self.codes, self.base, self.n = codes, base, n
        self.table = self._vectors(codes) if len(codes) <= FEW else None

    def _vectors(self, rest: np.ndarray) -> np.ndarray:
        out = np.ones((len(rest), self.base.shape[1]), np.int8)
        for shift in range(self.n):
            rest, last = rest // len(self.base), rest % len(self.base)
            out *= np.roll(self.base, shift, 1)[last]
        return out

    def bundle(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sums of the vectors of the n-grams numbered by which, each as often as counts (the last axis) says."""
        out = np.zeros((*counts.shape[:-1], self.base.shape[1]))
        for at in range(0, len(which), STEP):
            some = which[at : at + STEP]
            vectors = self.table[some] if self.table is not None else self._vectors(self.codes[some])
            out += counts[..., at : at + STEP].astype(np.float32) @ vectors.astype(np.float32)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BLOCK characters; the text comes first."""
    for b in batches:
        ends = np.cumsum(pc.utf8_length(b.column(0)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            yield b.slice(at, end - at)
            at = end


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, n: int = NGRAM) -> dict[str, np.ndarray]:
    """The prototype of each language: all n-gram vectors of its texts (text, lang) added up.

    Each task adds up its own; what is dealt and what reaches the driver is a number for each language and dimension.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions, n), {}
        for rows in _blocks(batches):
            found, number, text, _ = profiles.counted(rows.column(0).to_pylist())
            names, of = np.unique(rows.column(1).to_pylist(), return_inverse=True)
            own = of[text]
            by_name = np.argsort(own.astype(np.uint16) if len(names) < 1 << 16 else own, kind="stable")
            for name, places in zip(names.tolist(), np.split(number[by_name], np.cumsum(np.bincount(own, minlength=len(names)))[:-1]), strict=True):
                counts = np.bincount(places, minlength=len(found.codes))
                sums[name] = sums.get(name, 0) + found.bundle(np.arange(len(counts)), counts)
        for name, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(own)], ["lang", "at", "v"])

    rows = labelled.select("text", "lang").mapInArrow(task, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for lang, own in rows.groupby("lang"):
        out[lang] = own.sort_values("at")["v"].to_numpy()
    return out


def identify(docs: DataFrame, training: Column, dimensions: int = DIMENSIONS, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, lang_pred, score, cosine and, if whole, the row itself as the struct row.

    training picks the rows to learn from, those with a text and a language. A text's vector is the sum of its n-grams'
    vectors, over the whole text; the language whose prototype has the largest cosine with it is predicted (of equal
    ones, the first by name). score is (1 + cosine) / 2. A null text and one without letters give 'und', score 0 and a
    null cosine, as does every text if there is nothing to learn from. Very long texts are read whole, with memory by their
    length; rows alike are told alike, and all are kept. Other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).cast("long").alias("doc_id"), training.alias("training"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * whole)
    learned = learn(base.where("training AND text IS NOT NULL AND lang IS NOT NULL"), dimensions, n)
    names = sorted(k for k, v in learned.items() if v.any())
    prototypes = np.array([learned[k] / np.linalg.norm(learned[k]) for k in names]).reshape(len(names), dimensions).astype(np.float32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions, n)
        for rows in _blocks(batches):
            grams, number, text, letters = profiles.counted(rows.column(0).to_pylist())
            many = rows.num_rows
            edges = np.searchsorted(text, np.arange(many + 1))
            cosine, best = np.full(many, np.nan), np.zeros(many, np.int64)
            for i in np.flatnonzero(letters > 0).tolist() if names else ():
                counts = np.bincount(number[edges[i] : edges[i + 1]])
                there = np.flatnonzero(counts)
                own = grams.bundle(there, counts[there])
                if norm := float(np.sqrt(own @ own)):
                    near = prototypes @ own / norm
                    best[i] = near.argmax()
                    cosine[i] = min(1.0, max(-1.0, float(near[best[i]])))
            sure = ~np.isnan(cosine)
            lang = [names[k] if s else "und" for k, s in zip(best.tolist(), sure.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(lang, pa.string()), pa.array(np.where(sure, (1 + cosine) / 2, 0.0)), pa.array(cosine, from_pandas=True), *rows.columns[2:]], ["doc_id", "lang_pred", "score", "cosine", *["row"] * whole])

    given = base.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", *["row"] * whole)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cosine", T.DoubleType()), *[f for f in given.schema if f.name == "row"]])
    return given.mapInArrow(task, schema)
