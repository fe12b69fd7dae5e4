"""N-Triples files as a source: lines, so that Spark splits files by bytes, read with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.terms import TRIPLES, XSD, distinct_triples

#: The escapes of N-Triples.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'"}
_NODE = r"<[^<>\s]*>|_:[^\s<>\"]+"
_HEAD = rf"^\s*({_NODE})\s*<([^<>\s]*)>\s*(.*)$"


def unescaped(text: Column) -> Column:
    """text with its escapes resolved."""

    def part(x: Column) -> Column:
        for mark, char in ESCAPES.items():
            x = F.replace(x, F.lit("\\" + mark), F.lit(char))
        codes = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"), F.lit(1)))
        char = lambda c: F.decode(F.unhex(F.lpad(F.substr(c, F.lit(2)), 8, "0")), "UTF-32")
        return F.aggregate(codes, x, lambda made, c: F.replace(made, F.concat(F.lit("\\"), c), char(c)))

    # an escaped backslash begins no other escape
    parts = F.split(text, r"\\\\", -1)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, part), "\\")).otherwise(text)


def _terms(lines: DataFrame) -> DataFrame:
    """lines (path, line) with the columns of a triple; s is null where a line can't be read."""
    head = lambda i: F.regexp_extract("line", _HEAD, i)
    d = lines.withColumns({"_s": head(1), "p": unescaped(head(2)), "_o": head(3)})
    # escapes as two other characters: the quote that ends a literal is then the next one, at the same place
    masked = F.regexp_replace("_o", r"\\.", "__")
    end = F.locate('"', masked, 2)
    tail = F.when(F.startswith("_o", F.lit('"')), F.substr("_o", end + 1)).otherwise(F.regexp_replace("_o", rf"^({_NODE})", ""))
    d = d.withColumns({"_end": end, "_tail": tail})
    dt, lang = F.regexp_extract("_tail", r"^\^\^<([^<>\s]*)>", 1), F.lower(F.regexp_extract("_tail", r"^@([A-Za-z]+(?:-[A-Za-z0-9]+)*)", 1))
    rest = F.regexp_replace("_tail", r"^(?:\^\^<[^<>\s]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)", "")
    literal = F.startswith("_o", F.lit('"'))
    closed = F.when(literal, F.col("_end") > 0).otherwise(F.col("_o").rlike(rf"^(?:{_NODE})"))
    ends = F.when(literal, rest).otherwise(F.col("_tail")).rlike(r"^\s*\.\s*(?:#.*)?$")
    scope = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)

    def node(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit("_:")), F.concat(scope, F.lit("#"), F.regexp_replace(F.substr(x, F.lit(3)), r"\.+$", ""))).otherwise(unescaped(F.substring(x, 2, F.length(x) - 2)))

    kind = lambda x: F.when(F.startswith(x, F.lit("_:")), "bnode").otherwise("iri")
    o_node = F.regexp_extract("_o", rf"^({_NODE})", 1)
    value = F.substr("_o", F.lit(2), F.col("_end") - 2)
    type_ = F.when(literal & (dt != "") & (dt != XSD + "string"), unescaped(dt))
    good = (F.col("_s") != "") & closed & ends
    return d.select(
        "path", "line", F.when(good, node(F.col("_s"))).alias("s"), kind(F.col("_s")).alias("s_kind"), "p",
        F.when(literal, unescaped(value)).otherwise(node(o_node)).alias("o"),
        F.when(literal, "literal").otherwise(kind(o_node)).alias("o_kind"), type_.alias("o_dt"), F.when(literal & (lang != ""), lang).alias("o_lang"),
    )


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    read = spark.read.text(paths, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return read.where(~F.col("line").rlike(r"^\s*(?:#|$)"))


def read_ntriples(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST", predicates: list[str] | None = None) -> DataFrame:
    """The triples of N-Triples files, as a set. paths: files, folders or patterns that Spark can read, of any size.

    Files of one folder are one document, as the sink writes them, so they share their blank nodes. A line that can't be
    read stops the job; in mode PERMISSIVE it is left out, and read_errors() gives it. predicates: IRIs; the lines of
    others are left before their objects are looked at. Empty lines and comments give nothing.
    """
    lines = _lines(spark, paths)
    if predicates is not None:
        own = unescaped(F.regexp_extract("line", _HEAD, 2))
        lines = lines.where(own.isin(predicates) | (own == ""))
    rows = _terms(lines)
    if mode == "FAILFAST":
        fault = F.raise_error(F.concat(F.lit("cannot read "), F.left("line", F.lit(200)), F.lit(" in "), "path"))
        rows = rows.withColumn("s", F.coalesce("s", fault.cast("string")))
    return distinct_triples(rows.where("s IS NOT NULL").select(*TRIPLES.fieldNames()))


def read_errors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, line) for the lines that can't be read."""
    return _terms(_lines(spark, paths)).where("s IS NULL").select(F.col("path").alias("source_file"), "line")
