"""Turtle files as a data source, and N-Triples files as a sink."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.terms import RDF, TRIPLES, TYPE, XSD, distinct_triples

_NAME = r"(?:[^\W]|[-.:%·]|\\[_~.\-!$&'()*+,;=/?#@%])*"
_TOKENS = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{{}}|^`\\\s]*(?:\\[uU][0-9A-Fa-f]+[^<>"{{}}|^`\\\s]*)*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w][\w.\-]*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>[^\W\d_]?[\w.\-]*:{_NAME}|[A-Za-z]+)
    |(?P<mark>\^\^|[;,.\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


class TurtleError(ValueError):
    pass


class TurtleReader:
    """One document. Triples come out as rows of TRIPLES in the order in which they are written."""

    def __init__(self, text: str, name: str):
        self.text, self.name, self.at = text, name, 0
        self.prefixes: dict[str, str] = {}
        self.base, self.made = "", 0
        self.kind, self.token = "", ""
        self.out: list[tuple] = []

    def _next(self) -> None:
        while self.at < len(self.text):
            m = _TOKENS.match(self.text, self.at)
            if m is None:
                raise TurtleError(f"{self.name}: cannot read {self.text[self.at : self.at + 30]!r} at {self.at}")
            self.at, self.kind, self.token = m.end(), m.lastgroup, m[0]
            if self.kind == "name":  # a name never ends with a dot: that one ends the statement
                short = self.token.rstrip(".")
                self.at -= len(self.token) - len(short)
                self.token = short
            if self.kind != "skip":
                return
        self.kind, self.token = "end", ""

    def _take(self, mark: str) -> None:
        if self.token != mark:
            raise TurtleError(f"{self.name}: {mark!r} expected, not {self.token!r} at {self.at}")
        self._next()

    def rows(self) -> list[tuple]:
        self._next()
        while self.kind != "end":
            word = self.token.lower()
            if word in ("@prefix", "prefix", "@base", "base"):
                self._directive(word)
                continue
            s = self._subject()
            if self.token != "." or s[0] != "bnode":
                self._predicates(s)
            self._take(".")
        return self.out

    def _directive(self, word: str) -> None:
        self._next()
        if "prefix" in word:
            prefix = self.token.rstrip(":")
            self._next()
            self.prefixes[prefix] = self._iri()
        else:
            self.base = self._iri()
        if word[0] == "@":
            self._take(".")

    def _iri(self) -> str:
        if self.kind == "iri":
            iri = _plain(self.token[1:-1])
            if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri):
                from urllib.parse import urljoin

                iri = urljoin(self.base, iri) if self.base else iri
        elif self.kind == "name" and ":" in self.token:
            prefix, local = self.token.split(":", 1)
            if prefix not in self.prefixes:
                raise TurtleError(f"{self.name}: prefix {prefix!r} is not declared")
            iri = self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        else:
            raise TurtleError(f"{self.name}: an IRI is expected, not {self.token!r} at {self.at}")
        self._next()
        return iri

    def _fresh(self) -> tuple[str, str]:
        self.made += 1
        return "bnode", f"{self.name}#{self.made}"

    def _subject(self) -> tuple[str, str]:
        if self.kind == "bnode":
            node = "bnode", f"{self.name}#{self.token[2:]}"
            self._next()
            return node
        if self.token == "[":
            return self._anonymous()
        if self.token == "(":
            return self._list()
        return "iri", self._iri()

    def _anonymous(self) -> tuple[str, str]:
        node = self._fresh()
        self._next()
        if self.token != "]":
            self._predicates(node)
        self._take("]")
        return node

    def _list(self) -> tuple[str, str]:
        self._next()
        items = []
        while self.token != ")":
            items.append(self._object())
        self._next()
        rest = ("iri", RDF + "nil", None, None)
        for item in reversed(items):
            node = self._fresh()
            self._add(node, RDF + "first", item)
            self._add(node, RDF + "rest", rest)
            rest = (*node, None, None)
        return rest[:2]

    def _add(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((s[1], s[0], p, o[1], o[0], o[2], o[3]))

    def _predicates(self, s: tuple[str, str]) -> None:
        while True:
            if self.token == "a" and self.kind == "name":
                p = TYPE
                self._next()
            else:
                p = self._iri()
            self._add(s, p, self._object())
            while self.token == ",":
                self._next()
                self._add(s, p, self._object())
            while self.token == ";":
                self._next()
            if self.token in (".", "]", ""):
                return

    def _object(self) -> tuple:
        kind, token = self.kind, self.token
        if kind in ("text", "long"):
            value = _plain(token[3:-3] if kind == "long" else token[1:-1])
            self._next()
            if self.kind == "lang":
                lang = self.token[1:].lower()
                self._next()
                return "literal", value, None, lang
            if self.token == "^^":
                self._next()
                dt = self._iri()
                return "literal", value, None if dt == XSD + "string" else dt, None
            return "literal", value, None, None
        if kind == "number":
            self._next()
            return "literal", token, XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"), None
        if kind == "name" and token in ("true", "false"):
            self._next()
            return "literal", token, XSD + "boolean", None
        return (*self._subject(), None, None)


def read_turtle(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """The triples of Turtle files, as a set. paths: files, folders or patterns that Spark can read.

    Files are read by Spark's own reader, so they can be in any store; a task parses the files it gets, one at a time. A
    file that can't be read stops the job; in mode PERMISSIVE it gives no triples but a row of read_errors() instead.
    """
    return distinct_triples(_parsed(spark, paths, mode).where("error IS NULL").select(*TRIPLES.fieldNames()))


def read_errors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, error) for the files that can't be read."""
    return _parsed(spark, paths, "PERMISSIVE").where("error IS NOT NULL").select("source_file", "error")


def prefixes(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """The prefixes that the files declare, by name; those of the first file by name count."""
    found = _files(spark, paths).select("path", F.regexp_extract_all("text", F.lit(r"(?im)^\s*@?prefix\s+([\w.\-]*:\s*<[^>]*>)"), F.lit(1)).alias("p")).orderBy("path").collect()
    out: dict[str, str] = {}
    for row in found:
        for line in row["p"]:
            prefix, _, ns = line.partition(":")
            out.setdefault(prefix, ns.strip()[1:-1])
    return {k: v for k, v in out.items() if k}


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    read = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ttl")
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _parsed(spark: SparkSession, paths: str | list[str], mode: str) -> DataFrame:
    import pandas as pd

    names = [*TRIPLES.fieldNames(), "source_file", "error"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    rows = [(*r, path, None) for r in TurtleReader(text, path.rsplit("/", 1)[-1]).rows()]
                except TurtleError as e:
                    if mode == "FAILFAST":
                        raise
                    rows = [(None,) * 7 + (path, str(e))]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return _files(spark, paths).mapInPandas(task, ", ".join(f"{n} string" for n in names))


def ntriples(triples: DataFrame) -> Column:
    """A row of TRIPLES as a line of N-Triples."""

    def escaped(c: Column) -> Column:
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def node(c: Column, kind: Column) -> Column:
        return F.when(kind == "bnode", F.concat(F.lit("_:b"), F.md5(c.cast("binary")))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), tail)).otherwise(node(F.col("o"), F.col("o_kind")))
    return F.concat(node(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str, mode: str = "error") -> None:
    """Text files, one line for each triple: valid N-Triples, so valid Turtle too."""
    triples.select(ntriples(triples).alias("value")).write.mode(mode).text(path)
