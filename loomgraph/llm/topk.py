"""Exact top-k search by inner product: every query is scored against every row, one term at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut
from loomgraph.llm.vectors import EXACT, as_longs, largest, numbered, scaled, whole

#: Rows of a block of candidates, and of a block of queries: a pair of blocks is scored by one task.
CANDIDATES, QUERIES = 8192, 4096
#: Of a block's rows, the share above which a term's postings are one weight for each row, zeros included.
DENSE = 0.5


class Block:
    """A block's vectors as sparse rows: where each row begins, then terms and weights, zeros left out."""

    def __init__(self, table: pa.Table, scale: int):
        lists = table["x"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        n, weights = np.diff(lists.offsets.to_numpy()), scaled(lists.flatten().to_numpy(zero_copy_only=False), scale)
        ends = np.cumsum(n)
        terms = np.arange(len(weights)) - np.repeat(ends - n, n)
        on = weights != 0
        self.row = table["row"].to_numpy()
        self.id, self.unnamed = table["vec_id"].fill_null(0).to_numpy(), table["vec_id"].is_null().to_numpy()
        self.starts = np.r_[0, np.cumsum(on)][np.r_[0, ends]]
        self.terms, self.weights = terms[on], weights[on]
        self.most, self.longest = largest(weights), int(n.max(initial=0))

    def postings(self, kind: np.dtype) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
        """Of each term: the places of the rows that have it, and their weights."""
        at = np.repeat(np.arange(len(self.row)), np.diff(self.starts))
        order = np.argsort(self.terms, kind="stable")
        terms, first = np.unique(self.terms[order], return_index=True)
        out = {}
        for term, own in zip(terms.tolist(), np.split(order, first[1:]), strict=True):
            place, weight = at[own], as_kind(self.weights[own], kind)
            if len(place) >= DENSE * len(self.row):
                column = np.zeros(len(self.row), kind)
                column[place] = weight
                place, weight = slice(None), column
            out[term] = place, weight
        return out


def as_kind(weights: np.ndarray, kind: np.dtype) -> np.ndarray:
    return whole(weights) if kind == object else weights.astype(kind)


def kind_of(queries: Block, block: Block) -> np.dtype:
    """Numbers in which no score of these blocks, nor any sum on the way to it, overflows or is rounded."""
    bound = queries.most * block.most * max(1, min(queries.longest, block.longest))
    return np.dtype(np.int32 if bound < 2**31 else np.int64 if bound < EXACT else object)


def best(scores: np.ndarray, block: Block, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores but those of own; ties to the smaller vec_id, null last, then to the earlier row.

    A partition finds the k-th score; all that reach it, ties too, are sorted.
    """
    free = np.ones(len(scores), bool)
    free[own] = False
    left = np.flatnonzero(free)
    if len(left) > k:
        there = scores[left]
        left = left[there >= np.partition(there, len(left) - k)[len(left) - k]]
    order = np.lexsort((block.row[left], block.id[left], block.unnamed[left], as_longs(-scores[left])))
    return left[order[:k]]


def found(queries: Block, block: Block, k: int) -> dict[str, pa.Array]:
    kind = kind_of(queries, block)
    postings, weights = block.postings(kind), as_kind(queries.weights, kind)
    by_row = np.argsort(block.row)
    at = np.minimum(np.searchsorted(block.row[by_row], queries.row), len(by_row) - 1)
    out: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "row": [], "score": []}
    scores = np.zeros(len(block.row), kind)
    for q in range(len(queries.row)):
        scores[:] = 0
        for i in range(queries.starts[q], queries.starts[q + 1]):
            held = postings.get(int(queries.terms[i]))
            if held:
                scores[held[0]] += weights[i] * held[1]
        own = by_row[at[q]]
        top = best(scores, block, np.array([own] if block.row[own] == queries.row[q] else [], int), k)
        out["query"].append(np.full(len(top), queries.row[q]))
        out["query_id"].append(np.full(len(top), queries.id[q]))
        out["vec_id"].append(pa.array(block.id[top], mask=block.unnamed[top]))
        out["row"].append(block.row[top])
        out["score"].append(as_longs(scores[top]))
    return {c: pa.concat_arrays(v) if c == "vec_id" else pa.array(np.concatenate(v)) for c, v in out.items()}


def top_products(df: DataFrame, asks: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of df that asks, the k rows with the highest inner product.

    A component x counts as floor(scale * x). Candidates are all rows but the query's own, rows with its very vec_id and vector
    among them if they are repeated. Ties go to the smaller vec_id (null last), then to one of the rows alike. Queries and
    candidates are dealt to blocks of bounded size by a hash, so no vector is too common; each block of queries meets
    each block of candidates in one task, which holds the candidates' postings term by term and, for a query, one array of
    scores: nothing is skipped or estimated. Of each pair of blocks k rows a query are left, which are ranked.

    Vectors that are null or hold a null or a component that is not finite take no part; empty ones score 0. Vectors of
    different length are taken as ending with zeros. Rows with a null vec_id can be found but don't ask. Scores are exact;
    one that a long can't hold comes as the nearest long. A repeated query row has ranks of its own. Other columns are
    ignored. An empty table, or one without queries, gives an empty result.
    """
    vectors = cut(numbered(df, id_col, vector_col, F.lit(True), F.coalesce(asks, F.lit(False)).alias("asks")))
    n, queries = vectors.agg(F.count("*"), F.count_if(F.col("asks") & F.col("vec_id").isNotNull())).first()
    blocks, groups = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(queries / QUERIES))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    candidates = dealt.select("block", each(groups).alias("group"), "row", "vec_id", "x")
    asking = dealt.where("asks AND vec_id IS NOT NULL").select(each(blocks).alias("block"), "group", "row", "vec_id", "x")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "row", "score")})
        return pa.table(found(Block(left, scale), Block(right, scale), k))

    kind = "query long, query_id long, vec_id long, row long, score long"
    partial = asking.groupBy("block", "group").cogroup(candidates.groupBy("block", "group")).applyInArrow(task, kind)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
