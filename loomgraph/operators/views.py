"""Views of a triple table: labels, kinds, classes, properties and the class tree's closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.plans.materialize import settled


def objects(triples: DataFrame, p: str) -> DataFrame:
    """(s, o, o_kind, o_dt, o_lang) of one predicate: a filter that reaches the scan."""
    return triples.where(F.col("p") == p).select("s", "o", "o_kind", "o_dt", "o_lang")


def definitions(triples: DataFrame) -> DataFrame:
    """(s, definition): of several definitions, the first in code point order."""
    return objects(triples, X.DEFINITION).groupBy("s").agg(F.min("o").alias("definition"))


def labels(triples: DataFrame, vocabulary: X.Vocabulary) -> DataFrame:
    """(node, label) for each IRI that occurs: its first ko label, else its first label, else its first name, by the order
    of the naming predicates; else its qualified name. One pass over the naming triples, one join."""
    names = vocabulary.names
    rank = F.when(F.col("p") == X.LABEL, F.when(F.col("o_lang") == "ko", 0).otherwise(1))
    for i, name in enumerate(names):
        rank = rank.when(F.col("p") == name, i + 2)
    named = triples.where(F.col("p").isin(X.LABEL, *names)).groupBy("s").agg(F.min(F.struct(rank.alias("r"), "o")).alias("best")).select(F.col("s").alias("node"), F.col("best.o").alias("label"))
    nodes = triples.select(F.explode(F.array(F.when(F.col("s_kind") == "iri", F.col("s")), "p", F.when(F.col("o_kind") == "iri", F.col("o")))).alias("node")).where("node IS NOT NULL").distinct()
    return nodes.join(named, "node", "left").select("node", F.coalesce("label", X.qname(F.col("node"), vocabulary.known())).alias("label"))


def kind_of() -> Column:
    """An aggregate over a subject's triples: class, object_property, datatype_property or individual, in that order."""

    def has(iri: str) -> Column:
        return F.coalesce(F.bool_or((F.col("p") == X.TYPE) & (F.col("o") == iri)), F.lit(False))

    return F.when(has(X.CLASS), "class").when(has(X.OBJECT_PROPERTY), "object_property").when(has(X.DATATYPE_PROPERTY), "datatype_property").otherwise("individual")


def kinds(triples: DataFrame) -> DataFrame:
    """(s, kind) for each IRI subject."""
    return triples.where("s_kind = 'iri'").groupBy("s").agg(kind_of().alias("kind"))


def subclass_edges(triples: DataFrame) -> DataFrame:
    """(sub, sup) between IRIs; restrictions, which are blank, are no classes of the tree."""
    return objects(triples, X.SUBCLASS).where("o_kind = 'iri'").select(F.col("s").alias("sub"), F.col("o").alias("sup")).distinct()


def closure(edges: DataFrame, a: str = "sub", b: str = "sup", max_depth: int | None = None, reflexive: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """(desc, anc, depth): what leads from one node to another and in how many steps at least.

    Each round doubles nothing and repeats nothing: it joins the pairs found last with the edges and keeps the new ones,
    so a cycle ends it. reflexive adds each node to itself; nodes (node) adds those that no edge has. Rounds are written
    to the shared folder, so a lost executor costs a read.
    """
    e = settled(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct())
    found = step = e.select(F.col("x").alias("desc"), F.col("y").alias("anc"), F.lit(1).alias("depth"))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        more = step.join(e, F.col("anc") == F.col("x")).select("desc", F.col("y").alias("anc"), F.lit(depth).alias("depth")).distinct()
        step = settled(more.join(found.select("desc", "anc"), ["desc", "anc"], "left_anti"))
        if step.isEmpty():
            break
        found = found.unionByName(step)
    if not reflexive:
        return found
    own = e.select(F.explode(F.array("x", "y")).alias("n"))
    own = (own.unionByName(nodes.select(F.col(nodes.columns[0]).alias("n"))) if nodes is not None else own).distinct()
    return found.where("desc <> anc").unionByName(own.select(F.col("n").alias("desc"), F.col("n").alias("anc"), F.lit(0).alias("depth")))


#: Steps that are followed one by one from what was found last, before steps are doubled.
LEVELS = 6


def reachable(edges: DataFrame, seeds: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(seed, node), distinct: what each seed (first column) leads to along the edges from a to b, in one step or more.

    Only what seeds lead to is followed. Past LEVELS steps each round doubles the length of the steps that it takes (pairs
    of nodes exactly so many steps apart, as many as edges in a tree), so a chain of 1,000 ends after 10 more rounds; a
    cycle ends when a round finds nothing new. Rounds are written to the shared folder.
    """
    e = settled(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct())
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    along = lambda step, jump: step.join(jump, F.col("node") == F.col("x")).select("seed", F.col("y").alias("node")).distinct()
    found = step = settled(along(start.withColumn("node", F.col("seed")), e))
    for _ in range(LEVELS):
        if step.isEmpty():
            return found
        step = settled(along(step, e).join(found, ["seed", "node"], "left_anti"))
        found = found.unionByName(step)
    if step.isEmpty():
        return found
    # step: what was first found LEVELS + 1 steps away; jump: how far the next round goes.
    beyond, jump = step, e
    while True:
        more = settled(along(beyond, jump).join(beyond, ["seed", "node"], "left_anti"))
        if more.isEmpty():
            return found.unionByName(beyond).distinct()
        beyond = beyond.unionByName(more)
        jump = settled(jump.join(jump.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y")).distinct())


def typed_or_declared(triples: DataFrame) -> DataFrame:
    """(s): IRIs that something says the type of."""
    return triples.where((F.col("p") == X.TYPE) & (F.col("s_kind") == "iri")).select("s").distinct()


def schema_statistics(triples: DataFrame, base: str | None = None) -> DataFrame:
    """One row: triples, classes, object_properties, datatype_properties, ontologies, individuals.

    Individuals are typed IRI subjects that are no schema things.
    """

    def typed_as(*iris: str) -> Column:
        return (F.col("p") == X.TYPE) & F.col("o").isin(*iris)

    schema = [X.CLASS, X.OBJECT_PROPERTY, X.DATATYPE_PROPERTY, X.ONTOLOGY, X.OWL + "Restriction"]
    per = triples.groupBy("s", "s_kind").agg(F.count("*").alias("n"), *[F.bool_or(typed_as(i)).alias(c) for c, i in zip(("cls", "op", "dp", "onto"), schema, strict=False)], F.bool_or(F.col("p") == X.TYPE).alias("typed"), F.bool_or(typed_as(*schema)).alias("schema"))
    iri = F.col("s_kind") == "iri"
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triples"), F.count_if(F.col("cls")).alias("classes"), F.count_if(F.col("op")).alias("object_properties"), F.count_if(F.col("dp")).alias("datatype_properties"), F.count_if(F.col("onto")).alias("ontologies"), F.count_if(iri & F.col("typed") & ~F.col("schema")).alias("individuals"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], X.TRIPLES)
