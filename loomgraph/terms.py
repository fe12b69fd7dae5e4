"""RDF terms as columns: the triple table, namespaces, qualified names and typed values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans.spread import spread

#: One row for each triple. Subjects and objects of kind bnode are `file#number`.
TRIPLES = T.StructType(
    [T.StructField("s", T.StringType(), False), T.StructField("s_kind", T.StringType()), T.StructField("p", T.StringType(), False), T.StructField("o", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("o_kind", "o_dt", "o_lang")]
)

#: Vocabularies of the W3C.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
XSD, SKOS, SH = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/ns/shacl#"
TYPE, LABEL, DEFINITION, SUBCLASS = RDF + "type", RDFS + "label", SKOS + "definition", RDFS + "subClassOf"
DOMAIN, RANGE, SEE_ALSO = RDFS + "domain", RDFS + "range", RDFS + "seeAlso"
CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY, ONTOLOGY = OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "Ontology"
STANDARD = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": SKOS}
NUMERIC = [XSD + x for x in ("decimal", "integer", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")]


@dataclass
class Vocabulary:
    """What a graph calls things: its base namespace, prefixes in lookup order, and the predicates that name entities."""

    base: str
    prefixes: dict[str, str] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def known(self) -> dict[str, str]:
        return {**self.prefixes, **STANDARD}


class Made(NamedTuple):
    """A triple that a row makes: its predicate, null if the row decides on that, and a struct with the fields of TRIPLES."""

    p: str | None
    column: Callable[[], Column]


def triple(s: Column, p: str | Column, o: Column, dt: str | None = None, lang: str | None = None, kind: str | None = None) -> Made:
    def column() -> Column:
        terms = [s.alias("s"), F.lit("iri").alias("s_kind"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"), F.lit(kind or "literal").alias("o_kind")]
        return F.struct(*terms, F.lit(dt).cast("string").alias("o_dt"), F.lit(lang).cast("string").alias("o_lang"))

    return Made(p if isinstance(p, str) else None, column)


def as_triples(df: DataFrame, *made: Made, only: str | None = None) -> DataFrame | None:
    """The triples that `made` gives for each row of df; those without an object or with an empty one are left out.

    only: a predicate; what can't have it is not made, and if nothing can, there is no table.
    """
    wanted = [m.column() for m in made if only is None or m.p in (None, only)]
    if not wanted:
        return None
    rows = df.select(F.explode(F.array(*wanted)).alias("t")) if len(wanted) > 1 else df.select(wanted[0].alias("t"))
    rows = rows.select("t.*").where("s IS NOT NULL AND o IS NOT NULL AND o <> ''")
    return rows if only is None else rows.where(F.col("p") == only)


def distinct_triples(df: DataFrame, rows: int = 0) -> DataFrame:
    """A graph is a set: equal terms in all three places count once; a literal's datatype and language are part of it.

    rows: how many df has at most, where that is known; a task then holds its share, however many there are.
    """
    return spread(df, rows, "s", "p", "o").dropDuplicates([f.name for f in TRIPLES])


def qname(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local by the longest namespace that begins the IRI and leaves a plain local name; else <iri>.

    The prefixes are few and known when the plan is made, so they are part of the expression.
    """
    longest_first = sorted(prefixes.items(), key=lambda x: (-len(x[1]), x[0]))
    if not longest_first:
        return F.concat(F.lit("<"), iri, F.lit(">"))
    known = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(ns).alias("ns")) for p, ns in longest_first])
    local = lambda ns: F.substr(iri, F.length(ns) + 1)
    hit = F.get(F.filter(known, lambda x: F.startswith(iri, x["ns"]) & local(x["ns"]).rlike(r"^[\p{L}\p{N}_][\p{L}\p{N}_.\-]*$")), F.lit(0))
    return F.coalesce(F.concat(hit["prefix"], F.lit(":"), local(hit["ns"])), F.concat(F.lit("<"), iri, F.lit(">")))


def shown(o: Column, kind: Column, prefixes: dict[str, str]) -> Column:
    """A term as results show it: a literal's own text, an IRI's qualified name."""
    return F.when(kind == "iri", qname(o, prefixes)).otherwise(o)


def typed(triples: DataFrame) -> DataFrame:
    """triples with o_num, o_date, o_ts and o_bool next to the text as it was written; null where they don't apply."""
    return triples.withColumns(
        {
            "o_num": F.when(F.col("o_dt").isin(*NUMERIC), F.expr("try_cast(o AS DECIMAL(38,10))")),
            "o_date": F.when(F.col("o_dt") == XSD + "date", F.expr("try_cast(o AS DATE)")),
            "o_ts": F.when(F.col("o_dt") == XSD + "dateTime", F.expr("try_cast(o AS TIMESTAMP_NTZ)")),
            "o_bool": F.when(F.col("o_dt") == XSD + "boolean", F.expr("try_cast(o AS BOOLEAN)")),
        }
    )
