"""SPARQL as DataFrame plans over a triple table: Catalyst picks the joins, filters reach the scan.

A solution is a row with a column for each variable that holds a term in one string: <iri>, _:blank, or "text" with @lang
or ^^<datatype>; null is unbound. Joins compare those strings, so a literal's datatype and language count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators.views import closure, reachable
from loomgraph.plans.solutions import Solutions, joined, kept, other
from loomgraph.plans.solutions import column as _c
from loomgraph.plans.sparql_parser import Parser, Query, SparqlError
from loomgraph.plans.spread import spread


def _key(kind: Column, o: Column, dt: Column, lang: Column) -> Column:
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(dt.isNotNull(), F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise("")
    return F.when(kind == "iri", F.concat(F.lit("<"), o, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), o)).otherwise(F.concat(F.lit('"'), o, F.lit('"'), tail))


def _constant(term: tuple) -> str:
    if term[0] == "iri":
        return f"<{term[1]}>"
    return f'"{term[1]}"' + (f"@{term[3]}" if term[3] else f"^^<{term[2]}>" if term[2] else "")


def _is_iri(k: Column) -> Column:
    return k.startswith("<")


def _text(k: Column) -> Column:
    """A term's own text: an IRI without brackets, a literal without its datatype and language."""
    return F.when(_is_iri(k), k.substr(F.lit(2), F.length(k) - 2)).when(k.startswith('"'), F.regexp_extract(k, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)).otherwise(k)


def _datatype(k: Column) -> Column:
    dt = F.regexp_extract(k, r'"\^\^<([^>]*)>$', 1)
    return F.when(k.startswith('"'), F.when(dt != "", dt).when(k.rlike(r'"@[A-Za-z0-9-]+$'), X.RDF + "langString").otherwise(X.XSD + "string"))


def _number(k: Column) -> Column:
    """The value of a numeric literal, told by what follows its text: no pattern is matched."""
    end = F.substring_index(k, '"^^<', -1)
    return F.when(end.isin(*[f"{dt}>" for dt in X.NUMERIC]), k.substr(F.lit(2), F.length(k) - F.length(end) - 5).try_cast("decimal(38,10)"))


class Value:
    """An expression's value: its term as a string, or what it is made of."""

    def __init__(self, key: Column | None = None, number: Column | None = None, text: Column | None = None, boolean: Column | None = None):
        self._key, self._number, self._text, self._boolean = key, number, text, boolean

    @property
    def number(self) -> Column:
        return self._number if self._number is not None else _number(self._key) if self._key is not None else F.lit(None).cast("decimal(38,10)")

    @property
    def text(self) -> Column:
        if self._text is not None:
            return self._text
        return _text(self.key)

    @property
    def boolean(self) -> Column:
        if self._boolean is not None:
            return self._boolean
        k = self.key
        return F.when(_datatype(k) == X.XSD + "boolean", _text(k) == "true").when(_number(k).isNotNull(), _number(k) != 0).when(_datatype(k).isin(X.XSD + "string", X.RDF + "langString"), F.length(_text(k)) > 0)

    @property
    def key(self) -> Column:
        if self._key is not None:
            return self._key
        if self._boolean is not None:
            return F.when(self._boolean, F.lit(f'"true"^^<{X.XSD}boolean>')).when(~self._boolean, F.lit(f'"false"^^<{X.XSD}boolean>'))
        if self._number is not None:
            plain = F.regexp_replace(self._number.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")  # scale 10: there is a point
            kind = F.when(F.contains(plain, F.lit(".")), F.lit(X.XSD + "decimal")).otherwise(X.XSD + "integer")
            return F.concat(F.lit('"'), plain, F.lit('"^^<'), kind, F.lit(">"))
        return F.concat(F.lit('"'), self._text, F.lit('"'))


class Compiler:
    def __init__(self, triples: DataFrame | Callable[[str | None], DataFrame], prefixes: dict[str, str] | None = None, counts: dict[str, int] | None = None, most: int = 0):
        """triples: a table, or what gives the triples of one predicate (all of them for None), where that takes less than to
        look for them in a table. counts: triples by predicate, where they are known; patterns are then joined from the
        fewest on. most: how many of a predicate there are at most, where that isn't counted; patterns of one subject are then
        dealt by it to so many tasks."""
        self.most = most
        self.prefixes = {**(prefixes or {}), **X.STANDARD}
        self.counts = counts or {}
        self.of = triples if not isinstance(triples, DataFrame) else lambda p: triples if p is None else triples.where(F.col("p") == p)
        self.spark: SparkSession = triples.sparkSession if isinstance(triples, DataFrame) else SparkSession.active()
        self.flags = 0

    # patterns
    def triple(self, s: tuple, p: tuple, o: tuple, known: Solutions | None = None) -> Solutions:
        if p[0] not in ("iri", "var"):
            return self.along(s, p, o, known)
        df = self.of(p[1] if p[0] == "iri" else None)
        if s[0] == "iri":
            df = df.where(F.col("s") == s[1])
        if o[0] == "iri":
            df = df.where((F.col("o") == o[1]) & (F.col("o_kind") == "iri"))
        elif o[0] == "lit":
            df = df.where((F.col("o") == o[1]) & (F.col("o_kind") == "literal") & F.col("o_dt").eqNullSafe(F.lit(o[2])) & F.col("o_lang").eqNullSafe(F.lit(o[3])))
        parts = {0: _key(F.col("s_kind"), F.col("s"), F.lit(None), F.lit(None)), 1: F.concat(F.lit("<"), F.col("p"), F.lit(">")), 2: _key(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))}
        return self.named(df, [(t, parts[i]) for i, t in enumerate((s, p, o)) if t[0] == "var"])

    @staticmethod
    def named(df: DataFrame, parts: list[tuple[tuple, Column]]) -> Solutions:
        seen: dict[str, Column] = {}
        for (_, name), c in parts:
            if name in seen:
                df = df.where(seen[name] == c)
            else:
                seen[name] = c
        return Solutions(df.select(*[c.alias(n) for n, c in seen.items()]) if seen else df.select(F.lit(1).alias("_")), set(seen), set())

    def pairs(self, path: tuple) -> DataFrame:
        """(a, b) term pairs that a path links; of star, plus and opt each pair once."""
        kind = path[0]
        if kind == "iri":
            return self.triple(("var", "a"), path, ("var", "b")).df
        if kind == "inv":
            return self.pairs(path[1]).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "seq":
            first, then = path[1], path[2]
            if then[0] in ("star", "opt"):  # what the first part reaches reaches itself: no other term needs to
                left = self.pairs(first)
                on = self.beyond(then).where("a <> b").select(F.col("a").alias("m"), F.col("b").alias("c"))
                return left.unionByName(left.join(on, F.col("b") == F.col("m")).select("a", F.col("c").alias("b")))
            return self.pairs(first).select("a", F.col("b").alias("m")).join(self.pairs(then).select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        if kind == "alt":
            return self.pairs(path[1]).unionByName(self.pairs(path[2]))
        if kind == "not":
            ahead, back = [i for i, b in path[1] if not b], [i for i, b in path[1] if b]
            every = self.triple(("var", "a"), ("var", "p"), ("var", "b")).df
            out = every.where(~F.col("p").isin([f"<{i}>" for i in ahead])).select("a", "b") if ahead or not back else every.select("a", "b").limit(0)
            return out.unionByName(every.where(~F.col("p").isin([f"<{i}>" for i in back])).select(F.col("b").alias("a"), F.col("a").alias("b"))) if back else out
        if kind == "plus":
            return self.beyond(path)
        own = self.triple(("var", "a"), ("var", "p"), ("var", "b")).df.select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"))
        return self.beyond(path).unionByName(own).distinct()

    def beyond(self, path: tuple) -> DataFrame:
        """(a, b) for what a path of any length (or of one step, if optional) reaches by one step or more."""
        step = self.pairs(path[1])
        return step.distinct() if path[0] == "opt" else closure(step, "a", "b", reflexive=False).select(F.col("desc").alias("a"), F.col("anc").alias("b"))

    def led(self, path: tuple, seeds: DataFrame | str, ahead: bool) -> DataFrame:
        """(a, b) term pairs that a path links and that begin (or end, if not ahead) at a seed (t), or at that constant: nothing
        is followed that no seed leads to. A seed reaches itself by no step, even if no triple has it."""
        kind = path[0]
        as_rows = self.spark.range(1).select(F.lit(seeds).alias("t")) if isinstance(seeds, str) else seeds
        near, far = ("a", "b") if ahead else ("b", "a")
        if kind == "inv":
            return self.led(path[1], seeds, not ahead).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "alt":
            return self.led(path[1], seeds, ahead).unionByName(self.led(path[2], seeds, ahead))
        if kind == "seq":
            first, then = (path[1], path[2]) if ahead else (path[2], path[1])
            one = self.led(first, seeds, ahead).select(F.col(near).alias("seed"), F.col(far).alias("m"))
            two = self.led(then, one.select(F.col("m").alias("t")).distinct(), ahead) if self.endless(then) else self.pairs(then)
            two = two.select(F.col(near).alias("m"), F.col(far).alias("end"))
            return one.join(two, "m").select(F.col("seed").alias(near), F.col("end").alias(far))
        if kind in ("star", "plus"):
            out = reachable(self.pairs(path[1]), as_rows, near, far)
            out = out.select(F.col("seed").alias(near), F.col("node").alias(far))
        elif kind == "opt":
            out = self.led(path[1], seeds, ahead).distinct()
        elif isinstance(seeds, str):
            return self.pairs(path).where(F.col(near) == seeds)
        else:
            return self.pairs(path).join(seeds.select(F.col("t").alias(near)).distinct(), near, "left_semi").select("a", "b")
        if kind == "plus":
            return out
        return out.unionByName(as_rows.select(F.col("t").alias("a"), F.col("t").alias("b"))).distinct()

    @staticmethod
    def endless(path: tuple) -> bool:
        return isinstance(path, tuple) and (path[0] in ("star", "plus", "opt") or path[0] in ("inv", "seq", "alt") and any(map(Compiler.endless, path[1:])))

    def along(self, s: tuple, path: tuple, o: tuple, known: Solutions | None = None) -> Solutions:
        """known: solutions that the path's will be joined with; a path of any length starts from what they bind."""
        seeds, ahead = None, True
        for at, end in ((True, s), (False, o)):
            if seeds is None and end[0] != "var":
                seeds, ahead = _constant(end), at
        if seeds is None and known is not None and self.endless(path):
            for at, end in ((True, s), (False, o)):
                if seeds is None and end[1] in known.bound:
                    seeds, ahead = known.df.select(_c(end[1]).alias("t")).distinct(), at
        df = self.pairs(path) if seeds is None else self.led(path, seeds, ahead)
        if s[0] != "var":
            df = df.where(F.col("a") == _constant(s))
        if o[0] != "var":
            df = df.where(F.col("b") == _constant(o))
        return self.named(df, [(t, F.col(c)) for t, c in ((s, "a"), (o, "b")) if t[0] == "var"])

    def bgp(self, triples: list, known: Solutions | None = None) -> Solutions:
        open_path = lambda t: self.endless(t[1]) and t[0][0] == "var" == t[2][0]
        rest = sorted(triples, key=lambda t: (open_path(t), -(t[0][0] != "var") - (t[2][0] != "var"), self.counts.get(t[1][1] if t[1][0] == "iri" else "", 1 << 60)))
        first = rest.pop(0)
        out = self.triple(*first, known=known)
        alike = [t[1][1] for t in (first, *rest) if t[0] == first[0] and t[1][0] == "iri"]
        if first[0][0] == "var" and len(alike) > 1:  # joined on their subject: it stays where it is dealt to
            out = Solutions(spread(out.df, max(self.counts.get(p, self.most) for p in alike), _c(first[0][1])), out.bound, out.maybe)
        while rest:  # next to what is there already, so that no product arises where there need be none
            nxt = next((t for t in rest if {x[1] for x in t if x[0] == "var"} & out.names), rest[0])
            rest.remove(nxt)
            out = joined(out, self.triple(*nxt, known=out))
        return out

    def group(self, parts: list, seed: Solutions | None = None) -> Solutions:
        """seed: bindings of variables from outside, for parts that name them without binding them."""
        out = seed or Solutions(self.spark.range(1).select(F.lit(1).alias("_")), set(), set())
        within = lambda p: seed if seed is not None and named_in(p) & seed.names else None
        filters = []
        for i, part in enumerate(parts):
            kind = part[0]
            if kind == "filter":
                filters.append(part[1])
            elif kind == "optional":
                inner = part[1][1]
                own = [p[1] for p in inner if p[0] == "filter"]
                right = self.group([p for p in inner if p[0] != "filter"])
                on = None
                if own:  # such a filter sees both sides
                    mapping = {n: _c(n) if n in out.names else other(n) for n in out.names | right.names}
                    on = F.lit(True)
                    for e in own:
                        on = on & F.coalesce(self.value(e, mapping).boolean, F.lit(False))
                out = joined(out, right, "left", on)
            elif kind == "minus":
                out = kept(out, self.pattern(part[1]), "left_anti", minus=True)
            elif kind == "bind":
                out, e = self.marked(out, part[1])
                v = self.value(e, {n: _c(n) for n in out.names})
                where = out.bound if self.total(e, out.bound) else out.maybe
                out = Solutions(out.df.withColumn(part[2], v.key), out.bound, out.maybe)
                (out.bound if where is out.bound else out.maybe).add(part[2])
            elif kind == "bgp" and out.names:
                out = joined(out, self.bgp(part[1], out))
            else:
                right = self.pattern(part, within(part))
                out = right if seed is None and not out.names and out.df.columns == ["_"] and i == 0 else joined(out, right)
        for e in filters:
            out = self.filtered(out, e)
        return out

    def filtered(self, out: Solutions, e: tuple) -> Solutions:
        if e[0] == "and":
            return self.filtered(self.filtered(out, e[1]), e[2])
        if e[0] == "not" and e[1][0] == "exists":
            e = ("exists", e[1][1], not e[1][2])
        if e[0] == "exists":
            return self.existing(out, e[1], "left_anti" if e[2] else "left_semi")
        out, e = self.marked(out, e)
        return Solutions(out.df.where(self.value(e, {n: _c(n) for n in out.names}).boolean), out.bound, out.maybe)

    def existing(self, out: Solutions, p: tuple, how: str) -> Solutions:
        """Solutions for which the pattern p has a match (left_semi) or none (left_anti).

        Variables of out that p names in a filter but doesn't bind are free in p. A filter at the top of p that has some is a
        further condition of the join; if it compares one of them with what p binds, one extreme of that a group tells.
        Where p names them deeper inside, it is matched once for each of their distinct bindings.
        """
        parts = p[1] if p[0] == "group" else [p]
        inner = self.group([x for x in parts if x[0] != "filter"])
        filters = [c for x in parts if x[0] == "filter" for c in conjuncts(x[1])]
        free = (named_in(p) & out.names) - inner.names
        outer = [c for c in filters if named_in(c) & free]
        deep = free & set().union(*[named_in(x) for x in parts if x[0] != "filter"], *[named_in(c) for c in outer if has_exists(c)])
        if deep:
            named = named_in(p) & out.names
            seed = Solutions(out.df.select(*[_c(n) for n in sorted(named)]).distinct(), named & out.bound, named & out.maybe)
            return kept(out, self.group(parts, seed), how, exact=frozenset(free & out.maybe))
        for c in filters:
            if c not in outer:
                inner = self.filtered(inner, c)
        on = None
        if len(outer) == 1 and (extreme := self.extreme(outer[0], out, inner)):
            inner, on = extreme
        else:
            scope = {n: other(n) for n in inner.names} | {n: _c(n) for n in out.names}
            for c in outer:
                told = F.coalesce(self.value(c, scope).boolean, F.lit(False))
                on = told if on is None else on & told
        return kept(out, inner, how, on=on)

    def extreme(self, e: tuple, out: Solutions, inner: Solutions) -> tuple[Solutions, Column] | None:
        """For an inequality between what is outside and what is inside: inner with a row for each binding of what it shares
        with out, and the condition on its least or greatest value; None if e is something else."""
        if e[0] not in ("<", "<=", ">", ">="):
            return None
        shared = sorted(out.names & inner.names)
        sides = [named_in(x) for x in e[1:3]]
        turned = sides[0] <= inner.names - out.names and sides[1] <= out.names
        if not turned and not (sides[1] <= inner.names - out.names and sides[0] <= out.names) or not all(sides) or set(shared) - (out.bound & inner.bound):
            return None
        mine, theirs = (e[2], e[1]) if turned else (e[1], e[2])
        op = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[e[0]] if turned else e[0]
        v = self.value(theirs, {n: _c(n) for n in inner.names})
        best = F.max if op in ("<", "<=") else F.min
        plain = ~_is_iri(v.key) & v.number.isNull()
        made = [best(v.number).alias(" n"), best(F.when(plain, v.text)).alias(" t")]  # no variable has such a name
        df = inner.df.groupBy(*[_c(n) for n in shared]).agg(*made) if shared else inner.df.agg(*made)
        x = self.value(mine, {n: _c(n) for n in out.names})
        apply = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
        told = F.coalesce(apply(x.number, other(" n")), F.lit(False)) | F.coalesce(~_is_iri(x.key) & x.number.isNull() & apply(x.text, other(" t")), F.lit(False))
        return Solutions(df, set(shared), {" n", " t"}), told

    def marked(self, out: Solutions, e) -> tuple[Solutions, tuple]:
        """out with a column for each EXISTS inside the expression e, and e with those columns in their place.

        The distinct bindings that the pattern can depend on are told apart by whether they have a match, and joined back.
        """
        if isinstance(e, list):
            made = []
            for x in e:
                out, x = self.marked(out, x)
                made.append(x)
            return out, made
        if not isinstance(e, tuple):
            return out, e
        if e[:1] != ("exists",):
            made = []
            for x in e:
                out, x = self.marked(out, x)
                made.append(x)
            return out, tuple(made)
        name, self.flags = f"_exists{self.flags}", self.flags + 1
        keys = sorted(named_in(e[1]) & out.names)
        if not keys:
            there = self.pattern(e[1]).df.limit(1).agg((F.count("*") > 0).alias(name))
            return Solutions(out.df.crossJoin(there), out.bound, out.maybe), ("flag", name, e[2])
        alone = Solutions(out.df.select(*[_c(n) for n in keys]).distinct(), out.bound & set(keys), out.maybe & set(keys))
        hits = self.existing(alone, e[1], "left_semi").df.select(*[_c(n).alias(f"r {n}") for n in keys], F.lit(True).alias("_hit"))
        on = F.lit(True)
        for n in keys:
            on = on & _c(n).eqNullSafe(other(n))
        df = out.df.join(hits, on, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"r {n}" for n in keys])
        return Solutions(df, out.bound, out.maybe), ("flag", name, e[2])

    def total(self, e: tuple, bound: set[str], grouped: bool = False) -> bool:
        """Whether an expression has a value in every solution that binds those variables."""
        kind = e[0]
        if kind == "var":
            return e[1] in bound
        if kind in ("iri", "lit", "flag"):
            return True
        if kind == "agg":
            return e[1] in ("COUNT", "SUM", "AVG", "GROUP_CONCAT") or grouped and e[3] is not None and self.total(e[3], bound)
        if kind != "call":
            return False
        if e[1] == "COALESCE":
            return any(self.total(x, bound) for x in e[2])
        return e[1] == "BOUND" or e[1] in ("STR", "LCASE", "UCASE", "CONCAT") and all(self.total(x, bound) for x in e[2])

    def pattern(self, p: tuple, seed: Solutions | None = None) -> Solutions:
        kind = p[0]
        if kind == "group":
            return self.group(p[1], seed)
        if kind == "bgp":
            return self.bgp(p[1])
        if kind == "union":
            sides = [self.pattern(x, seed) for x in p[1]]
            df = sides[0].df
            for s in sides[1:]:
                df = df.unionByName(s.df, allowMissingColumns=True)
            bound = set.intersection(*[s.bound for s in sides])
            names = set().union(*[s.names for s in sides])
            return Solutions(df.select(*[_c(n) for n in sorted(names)] or ["*"]), bound, names - bound)
        if kind == "values":
            rows = [tuple(None if t is None else _constant(t) for t in row) for row in p[2]]
            df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in p[1]))
            maybe = {n for i, n in enumerate(p[1]) if any(r[i] is None for r in rows)}
            return Solutions(df, set(p[1]) - maybe, maybe)
        if kind == "select":
            return self.selected(p[1])
        raise SparqlError(f"{kind} is not supported here")

    # expressions
    def value(self, e: tuple, scope: dict[str, Column]) -> Value:
        kind = e[0]
        if kind == "column":
            return Value(key=e[1])
        if kind == "numeric":
            return Value(number=e[1])
        if kind == "var":
            return Value(key=scope.get(e[1], F.lit(None).cast("string")))
        if kind in ("iri", "lit"):
            return Value(key=F.lit(_constant(e)))
        if kind == "or":
            return Value(boolean=self.value(e[1], scope).boolean | self.value(e[2], scope).boolean)
        if kind == "and":
            return Value(boolean=self.value(e[1], scope).boolean & self.value(e[2], scope).boolean)
        if kind == "not":
            return Value(boolean=~self.value(e[1], scope).boolean)
        if kind in ("=", "!=", "<", "<=", ">", ">="):
            return Value(boolean=self.compared(kind, self.value(e[1], scope), self.value(e[2], scope)))
        if kind == "in":
            a, out = self.value(e[1], scope), F.lit(False)
            for x in e[2]:
                out = out | self.compared("=", a, self.value(x, scope))
            return Value(boolean=out)
        if kind in ("+", "-", "*", "/"):
            a, b = self.value(e[1], scope).number, self.value(e[2], scope).number
            made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[kind]()
            return Value(number=made)
        if kind == "call":
            return self.call(e[1], e[2], scope)
        if kind == "flag":
            return Value(boolean=~_c(e[1]) if e[2] else _c(e[1]))
        if kind == "exists":
            raise SparqlError("EXISTS is not supported in the filter of an OPTIONAL, in HAVING or within an aggregate")
        raise SparqlError(f"{kind} is not supported in an expression")

    @staticmethod
    def compared(op: str, a: Value, b: Value) -> Column:
        apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        numbers = a.number.isNotNull() & b.number.isNotNull()
        if op in ("=", "!="):
            return F.when(numbers, apply(a.number, b.number)).otherwise(apply(a.key, b.key))
        unlike = _is_iri(a.key) | _is_iri(b.key) | a.number.isNotNull() | b.number.isNotNull()
        return F.when(numbers, apply(a.number, b.number)).when(~unlike, apply(a.text, b.text))

    def call(self, name: str, args: list, scope: dict[str, Column]) -> Value:
        v = [self.value(a, scope) for a in args]
        t = lambda i: v[i].text
        if name == "BOUND":
            return Value(boolean=v[0].key.isNotNull())
        if name == "COALESCE":
            return Value(key=F.coalesce(*[x.key for x in v]))
        if name == "IF":
            return Value(key=F.when(v[0].boolean, v[1].key).when(~v[0].boolean, v[2].key))
        if name == "STR":
            return Value(text=t(0))
        if name == "LANG":
            return Value(text=F.when(v[0].key.startswith('"'), F.regexp_extract(v[0].key, r'"@([A-Za-z0-9-]+)$', 1)))
        if name == "LANGMATCHES":
            return Value(boolean=F.when(t(1) == "*", F.length(t(0)) > 0).otherwise((F.lower(t(0)) == F.lower(t(1))) | F.lower(t(0)).startswith(F.concat(F.lower(t(1)), F.lit("-")))))
        if name == "DATATYPE":
            return Value(key=F.concat(F.lit("<"), _datatype(v[0].key), F.lit(">")))
        if name in ("ISIRI", "ISURI"):
            return Value(boolean=_is_iri(v[0].key))
        if name == "ISLITERAL":
            return Value(boolean=v[0].key.startswith('"'))
        if name == "ISBLANK":
            return Value(boolean=v[0].key.startswith("_:"))
        if name == "ISNUMERIC":
            return Value(boolean=v[0].number.isNotNull())
        if name == "SAMETERM":
            return Value(boolean=v[0].key == v[1].key)
        if name in ("IRI", "URI"):
            return Value(key=F.concat(F.lit("<"), t(0), F.lit(">")))
        if name == "REGEX":
            flags = F.concat(F.lit("(?"), t(2), F.lit(")")) if len(v) > 2 else F.lit("")
            return Value(boolean=F.regexp(t(0), F.concat(flags, t(1))))
        if name == "REPLACE":
            return Value(text=F.regexp_replace(t(0), t(1), t(2)))
        two = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}
        if name in two:
            return Value(boolean=two[name](t(0), t(1)))
        if name == "CONCAT":
            return Value(text=F.concat(*[x.text for x in v]))
        if name == "SUBSTR":
            start = v[1].number.cast("int")
            return Value(text=F.substr(t(0), start, v[2].number.cast("int")) if len(v) > 2 else F.substr(t(0), start))
        if name == "STRBEFORE":
            at = F.instr(t(0), t(1))
            return Value(text=F.when(at > 0, F.substr(t(0), F.lit(1), at - 1)).otherwise(""))
        if name == "STRAFTER":
            at = F.instr(t(0), t(1))
            return Value(text=F.when(at > 0, F.substr(t(0), at + F.length(t(1)))).otherwise(""))
        one = {"LCASE": F.lower, "UCASE": F.upper}
        if name in one:
            return Value(text=one[name](t(0)))
        if name == "STRLEN":
            return Value(number=F.length(t(0)).cast("decimal(38,10)"))
        math = {"ABS": F.abs, "ROUND": lambda x: F.round(x, 0), "CEIL": lambda x: F.ceil(x), "FLOOR": lambda x: F.floor(x)}
        if name in math:
            return Value(number=math[name](v[0].number).cast("decimal(38,10)"))
        dates = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}
        if name in dates:
            return Value(number=dates[name](t(0).try_cast("timestamp_ntz")).cast("decimal(38,10)"))
        if name in (X.XSD + "integer", X.XSD + "decimal", X.XSD + "double"):
            n = t(0).try_cast("decimal(38,10)")
            return Value(number=F.floor(n).cast("decimal(38,10)") if name.endswith("integer") else n)
        if name == X.XSD + "string":
            return Value(text=t(0))
        raise SparqlError(f"function {name} is not supported")

    # queries
    def aggregate(self, e: tuple, scope: dict[str, Column]) -> Column:
        """An aggregate's result as a term."""
        _, name, distinct, arg, sep = e
        if name == "COUNT":
            if arg is None:
                n = F.count_distinct(F.struct(*scope.values())) if distinct else F.count("*")
            else:
                k = self.value(arg, scope).key
                n = F.count_distinct(k) if distinct else F.count(k)
            return Value(number=n.cast("decimal(38,10)")).key
        v = self.value(arg, scope)
        if name in ("SUM", "AVG"):
            x = F.sum_distinct(v.number) if distinct and name == "SUM" else F.sum(v.number)
            n = F.count_distinct(v.number) if distinct else F.count(v.number)
            if name == "AVG":
                x = F.try_divide(F.sum_distinct(v.number) if distinct else F.sum(v.number), n)
            return Value(number=F.coalesce(x.cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))).key
        if name in ("MIN", "MAX"):
            pair = F.struct(v.number.alias("n"), v.text.alias("t"), v.key.alias("k"))
            known = F.when(v.key.isNotNull(), pair)
            return (F.min(known) if name == "MIN" else F.max(known))["k"]
        if name == "SAMPLE":
            return F.min(v.key)
        texts = F.sort_array(F.collect_set(v.text) if distinct else F.collect_list(v.text))
        return Value(text=F.array_join(texts, sep)).key

    def selected(self, q: Query) -> Solutions:
        body = self.pattern(q.where)
        scope = {n: _c(n) for n in body.names}
        df, keys = body.df, []

        def has(e) -> bool:
            return isinstance(e, tuple) and (e[:1] == ("agg",) or any(has(x) or isinstance(x, list) and any(has(y) for y in x) for x in e))

        grouped = bool(q.group) or any(has(e) for _, e in q.items if e) or any(has(e) for e in q.having)
        order = list(q.order)
        if grouped:
            for i, (e, name) in enumerate(q.group):
                name = name or (e[1] if e[0] == "var" else f"_g{i}")
                df = df.withColumn(name, self.value(e, scope).key)
                keys.append(name)
            aggs: dict[str, Column] = {}

            def lifted(e):
                if not isinstance(e, tuple):
                    return [lifted(x) for x in e] if isinstance(e, list) else e
                if e[:1] == ("agg",):
                    name = f"_a{len(aggs)}"
                    aggs[name] = self.aggregate(e, scope)
                    return ("var", name)
                return tuple(lifted(x) for x in e)

            items = [(n, lifted(e) if e else None) for n, e in q.items]
            having = [lifted(e) for e in q.having]
            order = [(lifted(e), d) for e, d in order]
            df = df.groupBy(*[_c(k) for k in keys]).agg(*[c.alias(n) for n, c in (aggs or {"_n": F.count("*")}).items()])
            scope = {n: _c(n) for n in df.columns}
            for e in having:
                df = df.where(self.value(e, scope).boolean)
        else:
            items = []
            for n, e in q.items:
                if e is not None:
                    body, e = self.marked(body, e)
                items.append((n, e))
            df = body.df
        always = {k for k in keys if k in body.bound} if grouped else set(body.bound)
        for (n, e), (_, plain) in zip(items, q.items, strict=True):
            if e is not None:
                df = df.withColumn(n, self.value(e, scope).key)
                scope[n] = _c(n)
                if self.total(plain if grouped and plain[0] == "agg" else e, body.bound if grouped and plain[0] == "agg" else always, bool(q.group)):
                    always = always | {n}
        names = [n for n, _ in items] or sorted(n for n in scope if not n.startswith("_"))
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        by = []
        for i, (e, down) in enumerate(order):
            v = self.value(e, scope)
            df = df.withColumns({f"_o{i}n": v.number, f"_o{i}t": v.text})
            for c in (f"_o{i}n", f"_o{i}t"):
                by.append(F.desc_nulls_last(c) if down else F.asc_nulls_first(c))
        keep = [c for c in df.columns if c.startswith("_o")]
        df = df.select(*[_c(n) for n in names], *keep)
        if q.distinct:
            df = df.dropDuplicates(names)
        if by or q.limit is not None or q.offset:  # what the order leaves open, the terms decide
            df = df.orderBy(*by, *[F.asc_nulls_first(_c(n)) for n in names])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df.select(*[_c(n) for n in names]), always & set(names), set(names) - always)


def named_in(x) -> set[str]:
    """Variables that a pattern or an expression names; of a subselect, what it returns."""
    if isinstance(x, Query):
        return {n for n, _ in x.items}
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
        return {x[1]}
    if isinstance(x, tuple) and x[:1] in (("bind",), ("values",)):
        return named_in(x[1]) | {x[2]} if x[0] == "bind" else set(x[1])
    return set().union(*map(named_in, x)) if isinstance(x, (tuple, list)) else set()


def conjuncts(e: tuple) -> list[tuple]:
    return [*conjuncts(e[1]), *conjuncts(e[2])] if e[0] == "and" else [e]


def has_exists(e) -> bool:
    return isinstance(e, (tuple, list)) and (e[:1] == ("exists",) or any(map(has_exists, e)))


def run(triples: DataFrame | Callable[[str | None], DataFrame], text: str, prefixes: dict[str, str] | None = None, limit: int | None = None, counts: dict[str, int] | None = None, terms: bool = False, most: int = 0) -> DataFrame:
    """A SELECT's solutions, one string column for each variable: a literal's text, an IRI's qualified name, null where it is
    unbound; with terms, whole terms. An ASK has one row (ask boolean). limit goes into the plan. counts, most: as in Compiler."""
    query = Parser(text, prefixes).parse()
    compiler = Compiler(triples, prefixes, counts, most)
    if query.form == "ASK":
        body = compiler.pattern(query.where).df.limit(1)
        return body.agg((F.count("*") > 0).alias("ask"))
    df = compiler.selected(query).df
    if limit is not None:
        df = df.limit(limit)
    if terms:
        return df
    known = compiler.prefixes
    return df.select(*[F.when(_is_iri(_c(n)), X.qname(_text(_c(n)), known)).otherwise(_text(_c(n))).alias(n) for n in df.columns])

