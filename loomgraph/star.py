"""The star-schema tables as a knowledge graph: triples, class tree, offers and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as X

BASE = "urn:star:"
CLS, DATA, P = BASE + "class/", BASE + "data/", BASE + "p/"
VOCABULARY = X.Vocabulary(BASE, {"cls": CLS, "data": DATA, "p": P}, [P + "hasName"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iri(kind: str, key: str):
    return F.concat(F.lit(f"{DATA}{kind}_"), F.col(key).cast("string"))


def slugged(c: str):
    return F.regexp_replace(F.col(c), "[^0-9A-Za-z]+", "_")


def schema_triples(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """Thing > Product > type > type and brand, Thing > Party > Customer > segment, Party > Supplier; properties with their
    domains and ranges. only: of one predicate, and no table is read for what can't have it."""
    fixed = [("Thing", None), ("Product", "Thing"), ("Party", "Thing"), ("Customer", "Party"), ("Supplier", "Party"), ("Nation", "Thing"), ("Region", "Thing"), ("Order", "Thing"), ("Offer", "Thing")]
    rows = []
    for name, above in fixed:
        rows.append((CLS + name, "iri", X.TYPE, X.CLASS, "iri", None, None))
        rows.append((CLS + name, "iri", X.LABEL, name, "literal", None, "en"))
        if name != "Offer":
            rows.append((CLS + name, "iri", X.LABEL, f"{name} (ko)", "literal", None, "ko"))
        if above:
            rows.append((CLS + name, "iri", X.SUBCLASS, CLS + above, "iri", None, None))
    for name, domain, rng, kind in [("hasName", "Thing", None, "d"), ("size", "Product", None, "d"), ("price", "Product", None, "d"), ("balance", "Party", None, "d"), ("locatedIn", "Party", "Nation", "o"), ("partOf", "Nation", "Region", "o"), ("placedBy", "Order", "Customer", "o"), ("ofPart", "Offer", "Product", "o"), ("bySupplier", "Offer", "Supplier", "o"), ("rate", "Offer", None, "d"), ("status", "Order", None, "d")]:
        rows.append((P + name, "iri", X.TYPE, X.DATATYPE_PROPERTY if kind == "d" else X.OBJECT_PROPERTY, "iri", None, None))
        rows.append((P + name, "iri", X.DOMAIN, CLS + domain, "iri", None, None))
        if rng:
            rows.append((P + name, "iri", X.RANGE, CLS + rng, "iri", None, None))
    rows = [r for r in rows if only in (None, r[2])]
    quoted = lambda v: "CAST(NULL AS STRING)" if v is None else f"'{v}'"
    listed = ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    parts = [spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(f.name for f in X.TRIPLES)})")] if rows else []
    if only not in (None, X.TYPE, X.SUBCLASS, X.LABEL):
        return united(spark, parts)
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    types = part.select("p_type").distinct()
    t = F.concat(F.lit(CLS), slugged("p_type"))
    by_type = X.as_triples(types, X.triple(t, X.TYPE, F.lit(X.CLASS), kind="iri"), X.triple(t, X.SUBCLASS, F.lit(CLS + "Product"), kind="iri"), X.triple(t, X.LABEL, F.col("p_type"), lang="en"), only=only)
    brands = part.select("p_type", "p_brand").distinct()
    b = F.concat(F.lit(CLS), slugged("p_type"), F.lit("__"), slugged("p_brand"))
    by_brand = X.as_triples(brands, X.triple(b, X.TYPE, F.lit(X.CLASS), kind="iri"), X.triple(b, X.SUBCLASS, t, kind="iri"), only=only)
    segments = customer.select("c_mktsegment").distinct()
    s = F.concat(F.lit(CLS), slugged("c_mktsegment"))
    by_segment = X.as_triples(segments, X.triple(s, X.TYPE, F.lit(X.CLASS), kind="iri"), X.triple(s, X.SUBCLASS, F.lit(CLS + "Customer"), kind="iri"), X.triple(s, X.LABEL, F.col("c_mktsegment"), lang="en"), only=only)
    return united(spark, [*parts, by_type, by_brand, by_segment])


def united(spark: SparkSession, parts: list[DataFrame | None]) -> DataFrame:
    """All that there is of the parts."""
    out = None
    for p in parts:
        out = p if out is None else out if p is None else out.unionByName(p)
    return out if out is not None else spark.range(0).select(*[F.lit("").alias(f.name) for f in X.TRIPLES])


def entity_triples(spark: SparkSession, sf_dir: str, *kinds: str, only: str | None = None) -> DataFrame:
    """Instances of the wanted kinds: part, customer, supplier, nation, region, orders, offer. only: as in schema_triples()."""
    dec = X.XSD + "decimal"
    money = lambda c: F.col(c).cast("decimal(18,2)")
    type_of = lambda s, cls: X.triple(s, X.TYPE, cls if not isinstance(cls, str) else F.lit(CLS + cls), kind="iri")

    def made(kind: str) -> DataFrame | None:
        if kind == "part":
            s = _iri("part", "p_partkey")
            return X.as_triples(table(spark, sf_dir, "part"), type_of(s, F.concat(F.lit(CLS), slugged("p_type"), F.lit("__"), slugged("p_brand"))), X.triple(s, P + "hasName", F.col("p_name")), X.triple(s, P + "size", F.col("p_size"), dt=X.XSD + "integer"), X.triple(s, P + "price", money("p_retailprice"), dt=dec), only=only)
        if kind == "customer":
            s = _iri("customer", "c_custkey")
            return X.as_triples(table(spark, sf_dir, "customer"), type_of(s, F.concat(F.lit(CLS), slugged("c_mktsegment"))), X.triple(s, P + "hasName", F.col("c_name")), X.triple(s, P + "balance", money("c_acctbal"), dt=dec), X.triple(s, P + "locatedIn", _iri("nation", "c_nationkey"), kind="iri"), only=only)
        if kind == "supplier":
            s = _iri("supplier", "s_suppkey")
            return X.as_triples(table(spark, sf_dir, "supplier"), type_of(s, "Supplier"), X.triple(s, P + "hasName", F.col("s_name")), X.triple(s, P + "balance", money("s_acctbal"), dt=dec), X.triple(s, P + "locatedIn", _iri("nation", "s_nationkey"), kind="iri"), only=only)
        if kind == "nation":
            s = _iri("nation", "n_nationkey")
            return X.as_triples(table(spark, sf_dir, "nation"), type_of(s, "Nation"), X.triple(s, X.LABEL, F.col("n_name"), lang="en"), X.triple(s, P + "partOf", _iri("region", "n_regionkey"), kind="iri"), only=only)
        if kind == "region":
            s = _iri("region", "r_regionkey")
            return X.as_triples(table(spark, sf_dir, "region"), type_of(s, "Region"), X.triple(s, X.LABEL, F.col("r_name"), lang="en"), only=only)
        if kind == "orders":
            s = _iri("order", "o_orderkey")
            return X.as_triples(table(spark, sf_dir, "orders"), type_of(s, "Order"), X.triple(s, P + "placedBy", _iri("customer", "o_custkey"), kind="iri"), X.triple(s, P + "status", F.col("o_orderstatus")), only=only)
        s = F.concat(F.lit(f"{DATA}offer_"), F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))  # order and line alone are not unique
        return X.as_triples(table(spark, sf_dir, "lineitem"), type_of(s, "Offer"), X.triple(s, P + "ofPart", _iri("part", "l_partkey"), kind="iri"), X.triple(s, P + "bySupplier", _iri("supplier", "l_suppkey"), kind="iri"), X.triple(s, P + "rate", F.col("l_discount").cast("decimal(10,2)"), dt=dec), only=only)

    return united(spark, [made(kind) for kind in kinds])


def graph(spark: SparkSession, sf_dir: str, *kinds: str, only: str | None = None) -> DataFrame:
    return schema_triples(spark, sf_dir, only).unionByName(entity_triples(spark, sf_dir, *kinds, only=only))
