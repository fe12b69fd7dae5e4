"""Longest shared runs of characters, for a batch of pairs at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs are taken together as long as a table of them has no more cells than this (one pair always is).
CELLS = 1 << 20


def _codes(texts: Sequence[str], fill: int) -> np.ndarray:
    """A row of code points for each text, filled up to the longest."""
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, dtype=np.uint32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out


def longest_runs(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """For each pair, the length of the longest run of characters that both have.

    Pairs of like lengths are worked on together: for each place in the shorter texts, the runs that end there grow by one
    where the characters agree and fall to nothing where they don't. Memory is bounded by CELLS, or by the longer text of
    one pair; time is the product of the two lengths.
    """
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    out = np.zeros(len(pairs), dtype=np.int32)
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(pairs[order[stop]][1]) <= CELLS:
            stop += 1
        some = order[at:stop]
        short, long = _codes([pairs[i][0] for i in some], 0xFFFFFFFF), _codes([pairs[i][1] for i in some], 0xFFFFFFFE)
        run = np.zeros((len(some), long.shape[1] + 1), dtype=np.int32)
        best = np.zeros(len(some), dtype=np.int32)
        for i in range(short.shape[1] if long.shape[1] else 0):
            run[:, 1:] = (run[:, :-1] + 1) * (long == short[:, i : i + 1])
            np.maximum(best, run.max(axis=1), out=best)
        out[some] = best
        at = stop
    return out


def longest_run(a: Column, b: Column) -> Column:
    """longest_runs() of two columns of texts, by Arrow batches; nulls count as empty."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(longest_runs(x.fillna("").tolist(), y.fillna("").tolist()))

    return F.pandas_udf(of, "int")(a, b)
