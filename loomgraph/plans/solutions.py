"""Solutions of graph patterns and how they are joined when variables may be unbound.

An unbound variable is compatible with any term, which no equality says. Where the two sides share a variable that both always
bind, that one is the key and the rest is checked on what meets. Where they don't, each side is divided by which of the
shared variables it leaves unbound: the parts that bind one in common are joined on it, and only what is left unbound by
one side meets all of the other, dealt by a salt.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a side are dealt to, if the other side's rows must meet them all.
SALTS = 32
#: Shared variables that may be unbound, up to which sides are divided: four make 16 pairs of parts at most.
DIVIDED = 4


@dataclass
class Solutions:
    """df has a column for each name; those in bound are never null."""

    df: DataFrame
    bound: set[str]
    maybe: set[str]

    @property
    def names(self) -> set[str]:
        return self.bound | self.maybe


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def other(name: str) -> Column:
    """A column of the right side of a join."""
    return F.col(f"`r {name}`")


def renamed(side: Solutions, names: list[str]) -> DataFrame:
    return side.df.select(*[column(n).alias(f"r {n}") for n in names] or [F.lit(1).alias("r _")])


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def compatible(a: Solutions, b: Solutions, names: list[str], exact: frozenset[str] = frozenset()) -> Column:
    """exact: names whose unbound values are equal to each other and to nothing else."""
    out = []
    for n in names:
        same = column(n) == other(n)
        if n in exact:
            same = column(n).eqNullSafe(other(n))
        elif n in a.maybe or n in b.maybe:
            same = same | column(n).isNull() | other(n).isNull()
        out.append(same)
    return all_of(out)


def _subsets(names: list[str]):
    return chain.from_iterable(combinations(names, k) for k in range(len(names) + 1))


def _divided(df: DataFrame, names: list[str], of) -> list[tuple[frozenset[str], DataFrame]]:
    """df by which of the names it leaves unbound."""
    return [(frozenset(u), df.where(all_of([of(n).isNull() if n in u else of(n).isNotNull() for n in names]))) for u in _subsets(names)]


def _parts(a: Solutions, b: Solutions, shared: list[str]) -> tuple[list, list] | None:
    """Both sides divided; None if a key is there without that, or if it would take too many parts."""
    ours, theirs = [n for n in shared if n in a.maybe], [n for n in shared if n in b.maybe]
    if not shared or any(n in a.bound and n in b.bound for n in shared) or len(ours) + len(theirs) > DIVIDED:
        return None
    return _divided(a.df, ours, column), _divided(renamed(b, sorted(b.names)), theirs, other)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str, on: Column | None) -> DataFrame:
    if keys:
        same = all_of([column(n) == other(n) for n in keys])
        return left.join(right, same if on is None else same & on, how)
    if how != "inner":  # whether there is anything at all on the right
        return left.join(right.limit(1) if on is None else right, F.lit(True) if on is None else on, how)
    left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = right.withColumn("r _salt", F.pmod(F.xxhash64(*right.columns), F.lit(SALTS)).cast("int"))
    met = F.col("_salt") == F.col("`r _salt`")
    return left.join(right, met if on is None else met & on).drop("_salt", "r _salt")


def _anti(left: DataFrame, right_parts: list, unbound: frozenset[str], shared: list[str], minus: bool, on: Column | None) -> DataFrame:
    for gone, right in right_parts:
        keys = [n for n in shared if n not in unbound | gone]
        if keys or not minus:
            left = _meet(left, right, keys, "left_anti", on)
    return left


def joined(a: Solutions, b: Solutions, how: str = "inner", on: Column | None = None) -> Solutions:
    """how: inner or left; on: a further condition on columns of both sides."""
    shared, parts = sorted(a.names & b.names), None
    names = sorted(a.names | b.names)
    bound = a.bound | b.bound if how == "inner" else a.bound
    if how == "inner" or on is None or shared:
        parts = _parts(a, b, shared)
    shown = [(F.coalesce(column(n), other(n)) if n in shared and n in a.maybe else column(n) if n in a.names else other(n)).alias(n) for n in names]
    if parts is None:
        right = renamed(b, sorted(b.names))
        condition = compatible(a, b, shared) if on is None else compatible(a, b, shared) & on
        df = a.df.join(right, condition, how) if shared or on is not None else a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        return Solutions(df.select(*shown or [F.lit(1).alias("_")]), bound, set(names) - bound)
    df = None
    for unbound, left in parts[0]:
        found = [_meet(left, right, [n for n in shared if n not in unbound | gone], "inner", on).select(*shown) for gone, right in parts[1]]
        if how == "left":
            alone = _anti(left, parts[1], unbound, shared, False, on)
            found.append(alone.select(*[(column(n) if n in a.names else F.lit(None).cast("string")).alias(n) for n in names]))
        for f in found:
            df = f if df is None else df.unionByName(f)
    return Solutions(df, bound, set(names) - bound)


def kept(a: Solutions, b: Solutions, how: str, minus: bool = False, on: Column | None = None, exact: frozenset[str] = frozenset()) -> Solutions:
    """Solutions of a that a compatible one of b keeps (left_semi) or takes away (left_anti); minus: those that bind nothing in
    common take nothing away."""
    shared = sorted(a.names & b.names)
    if minus and not shared:
        return a
    parts = None if exact else _parts(a, b, shared)
    if parts is None:
        condition = compatible(a, b, shared, exact)
        if minus and not any(n in a.bound and n in b.bound for n in shared):
            common = F.lit(False)
            for n in shared:
                common = common | F.coalesce(column(n) == other(n), F.lit(False))
            condition = condition & common
        right = renamed(b, sorted(b.names))
        if not shared and on is None:
            right = right.limit(1)
        return Solutions(a.df.join(right, condition if on is None else condition & on, how), a.bound, a.maybe)
    df = None
    for unbound, left in parts[0]:
        found = []
        if how == "left_anti":
            found.append(_anti(left, parts[1], unbound, shared, minus, on))
        else:
            for gone, right in parts[1]:
                keys = [n for n in shared if n not in unbound | gone]
                found.append(_meet(left, right, keys, "left_semi", on))
                left = _meet(left, right, keys, "left_anti", on)
        for f in found:
            df = f if df is None else df.unionByName(f)
    return Solutions(df, a.bound, a.maybe)
