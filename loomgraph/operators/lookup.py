"""Looking things up: terms, concepts, hierarchies, instances. Every order is explicit, so results don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators.views import closure, definitions, kinds, objects, subclass_edges


def resolve(triples: DataFrame, wanted: DataFrame, vocabulary: X.Vocabulary) -> DataFrame:
    """(term, s) for each row of wanted (term): what it names, null if nothing.

    In this order: a full IRI; prefix:local; a local name in each namespace, in the order in which they are declared; a
    label, in any language. Of several nodes with one label, the first IRI counts.
    """
    subjects = triples.where("s_kind = 'iri'").select("s").distinct()
    t = wanted.select("term").distinct()
    spaces = F.array(*[F.struct(F.lit(i + 2).alias("rank"), F.concat(F.lit(ns), F.col("term")).alias("iri")) for i, ns in enumerate(vocabulary.prefixes.values())]) if vocabulary.prefixes else F.array().cast("array<struct<rank:int,iri:string>>")
    prefixed = F.lit(None).cast("string")
    for prefix, ns in vocabulary.prefixes.items():
        prefixed = F.when(F.col("term").startswith(prefix + ":"), F.concat(F.lit(ns), F.substr("term", F.lit(len(prefix) + 2)))).otherwise(prefixed)
    full = F.when(F.col("term").startswith("http") | F.col("term").startswith("urn:"), F.struct(F.lit(0).alias("rank"), F.col("term").alias("iri")))
    tried = F.concat(F.array(full, F.when(prefixed.isNotNull(), F.struct(F.lit(1).alias("rank"), prefixed.alias("iri")))), spaces)
    by_iri = t.select("term", F.explode(F.filter(tried, lambda x: x.isNotNull())).alias("x")).select("term", "x.rank", F.col("x.iri").alias("s")).join(subjects, "s", "left_semi")
    by_label = t.join(objects(triples, X.LABEL).select("s", F.col("o").alias("term")), "term").join(subjects, "s", "left_semi").select("s", "term", F.lit(1 << 20).alias("rank"))
    best = by_iri.select("s", "term", "rank").unionByName(by_label).groupBy("term").agg(F.min(F.struct("rank", "s")).alias("b"))
    return t.join(best, "term", "left").select("term", F.col("b.s").alias("s"))


def search(triples: DataFrame, query: str, limit: int = 10, base: str | None = None) -> DataFrame:
    """(s, score): 0 if a label is the query, 1 if one contains it, 2 if the definition does, whatever the case.

    Only labelled IRIs below base count. A node's score is its best; ties by IRI.
    """
    q = query.lower()
    named = objects(triples, X.LABEL).where(F.col("s").startswith(base or ""))
    score = F.when(F.lower("o") == q, 0).when(F.contains(F.lower("o"), F.lit(q)), 1)
    by_label = named.groupBy("s").agg(F.min(score).alias("by_label"))
    scored = by_label.join(definitions(triples), "s", "left").select("s", F.coalesce("by_label", F.when(F.contains(F.lower("definition"), F.lit(q)), 2)).alias("score"))
    return scored.where("score IS NOT NULL").orderBy("score", "s").limit(limit)


def describe(triples: DataFrame, nodes: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(s, facts, referenced_by) for each node: arrays sorted by property, then value or subject."""
    out = triples.select("s", F.struct(X.qname(F.col("p"), prefixes).alias("property"), X.shown(F.col("o"), F.col("o_kind"), prefixes).alias("value")).alias("fact"))
    back = triples.where("o_kind <> 'literal' AND s_kind = 'iri'").select(F.col("o").alias("s"), F.struct(X.qname(F.col("s"), prefixes).alias("subject"), X.qname(F.col("p"), prefixes).alias("property")).alias("ref"))
    wanted = nodes.select("s").distinct()
    facts = out.join(wanted, "s", "left_semi").groupBy("s").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    refs = back.join(wanted, "s", "left_semi").groupBy("s").agg(F.sort_array(F.collect_list("ref")).alias("referenced_by"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return wanted.join(facts, "s", "left").join(refs, "s", "left").select("s", none("facts", "array<struct<property:string,value:string>>").alias("facts"), none("referenced_by", "array<struct<subject:string,property:string>>").alias("referenced_by"))


def instances(triples: DataFrame, classes: DataFrame, limit: int | None = 20) -> DataFrame:
    """(root, s, cls): IRIs typed by the class root (column s of classes) or by a class below it, the first `limit` of each
    root by (s, cls)."""
    roots = classes.select(F.col("s").alias("root")).distinct()
    below = closure(subclass_edges(triples), nodes=roots).join(roots, F.col("anc") == F.col("root"), "left_semi").select(F.col("desc").alias("cls"), F.col("anc").alias("root"))
    typed = objects(triples.where("s_kind = 'iri'"), X.TYPE).where("o_kind = 'iri'").select("s", F.col("o").alias("cls"))
    found = typed.join(below, "cls").select("root", "s", "cls")
    if limit is None:
        return found
    return found.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("s", "cls"))).where(F.col("n") <= limit).drop("n")


def inherited_properties(triples: DataFrame) -> DataFrame:
    """(cls, property, kind, via, ranges): properties whose domain is the class or one above it; via is the nearest such
    class (ties by IRI), ranges sorted."""
    types = objects(triples, X.TYPE).where(F.col("o").isin(X.OBJECT_PROPERTY, X.DATATYPE_PROPERTY)).groupBy(F.col("s").alias("property")).agg(F.min(F.when(F.col("o") == X.OBJECT_PROPERTY, "object_property").otherwise("datatype_property")).alias("k")).select("property", F.col("k").alias("kind"))
    ranges = objects(triples, X.RANGE).groupBy(F.col("s").alias("property")).agg(F.sort_array(F.collect_set("o")).alias("ranges"))
    domains = objects(triples, X.DOMAIN).select(F.col("s").alias("property"), F.col("o").alias("anc"))
    classes = objects(triples, X.TYPE).where(F.col("o") == X.CLASS).select("s")
    up = closure(subclass_edges(triples), nodes=classes)
    via = domains.join(up, "anc").groupBy("desc", "property").agg(F.min(F.struct("depth", "anc")).alias("v"))
    return via.join(types, "property").join(ranges, "property", "left").select(F.col("desc").alias("cls"), "property", "kind", F.col("v.anc").alias("via"), F.coalesce("ranges", F.array().cast("array<string>")).alias("ranges"))


def concept(triples: DataFrame, node: str, vocabulary: X.Vocabulary) -> dict | None:
    """All about one concept, as a nested dictionary: a few small results for one node."""
    one = triples.where(F.col("s") == node)
    rows = one.select("p", "o", "o_kind").collect()
    if not rows:
        return None
    kind = kinds(one).first()["kind"]
    of = lambda p: sorted(r["o"] for r in rows if r["p"] == p)
    spark = triples.sparkSession

    def names(iris: list[str]) -> list[str]:
        frame = spark.createDataFrame([(i, x) for i, x in enumerate(iris)], "i int, x string")
        return [r[0] for r in frame.orderBy("i").select(X.qname(F.col("x"), vocabulary.known())).collect()]

    out = {"uri": names([node])[0], "kind": kind, "labels": of(X.LABEL), "definition": (of(X.DEFINITION) or [None])[0], "see_also": of(X.SEE_ALSO), "types": names(sorted(r["o"] for r in rows if r["p"] == X.TYPE and r["o_kind"] == "iri"))}
    if kind == "class":
        edges = subclass_edges(triples)
        out["superclasses"] = names(sorted(r["sup"] for r in edges.where(F.col("sub") == node).collect()))
        out["subclasses"] = names(sorted(r["sub"] for r in edges.where(F.col("sup") == node).collect()))
        props = inherited_properties(triples).where(F.col("cls") == node).orderBy("kind", "property").collect()
        labelled = {r["s"]: r["l"] for r in objects(triples, X.LABEL).where(F.col("s").isin([p["property"] for p in props])).groupBy("s").agg(F.sort_array(F.collect_list("o")).alias("l")).collect()}
        out["properties"] = [{"property": names([p["property"]])[0], "labels": labelled.get(p["property"], []), "range": names(p["ranges"])} for p in props]
    elif kind != "individual":
        out["properties"] = [{"domain": names(of(X.DOMAIN)), "range": names(of(X.RANGE))}]
    return out


def hierarchy(triples: DataFrame, root: str, depth: int = 3) -> list[tuple[str, str, int]]:
    """(parent, child, level) below root, at most depth levels: the tree's size bounds what is collected."""
    edges = subclass_edges(triples)
    out, level = [], [root]
    for d in range(1, depth + 1):
        rows = edges.where(F.col("sup").isin(level)).orderBy("sup", "sub").collect()
        out += [(r["sup"], r["sub"], d) for r in rows]
        level = sorted({r["sub"] for r in rows})
        if not level:
            break
    return out
