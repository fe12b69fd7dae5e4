"""The property graph of a triple table, and capped expansions from many seeds of many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators.views import definitions, labels, objects
from loomgraph.plans.materialize import settled


def individuals(triples: DataFrame, base: str) -> DataFrame:
    """(s): IRI subjects below base that are no class, property or ontology."""
    schema = objects(triples, X.TYPE).where(F.col("o").isin(X.CLASS, X.OBJECT_PROPERTY, X.DATATYPE_PROPERTY, X.ONTOLOGY)).select("s").distinct()
    return triples.where((F.col("s_kind") == "iri") & F.col("s").startswith(base)).select("s").distinct().join(schema, "s", "left_anti")


def property_graph(triples: DataFrame, vocabulary: X.Vocabulary) -> tuple[DataFrame, DataFrame]:
    """nodes (key, name, labels, props, definition) and edges (src, type, dst, ord).

    Classes are nodes labelled Category with SUBCLASS_OF edges; individuals have their classes' local names as labels,
    INSTANCE_OF edges, an edge for each fact about another individual and a property for each literal. Of several
    literals of one property, the last by (predicate, value) counts. ord is the order in which a reader of the sorted graph
    meets the edges: classes first, then individuals, each by IRI, predicate and object.
    """
    base, known = vocabulary.base, vocabulary.known()
    name = labels(triples, vocabulary)
    classes = objects(triples, X.TYPE).where((F.col("o") == X.CLASS) & F.col("s").startswith(base)).select("s").distinct()
    own = individuals(triples, base)
    facts = triples.join(own, "s", "left_semi")
    cls, ind = classes.select(F.col("s").alias("o"), F.lit(True).alias("is_class")), own.select(F.col("s").alias("o"), F.lit(True).alias("is_ind"))
    named = facts.join(name.select(F.col("node").alias("p"), F.col("label").alias("pname")), "p").join(cls, "o", "left").join(ind, "o", "left")
    iri = F.col("o_kind") == "iri"
    instance = iri & F.col("is_class") & (F.col("p") == X.TYPE)
    up = triples.where((F.col("p") == X.SUBCLASS) & (F.col("o_kind") == "iri")).join(classes, "s", "left_semi").join(cls, "o", "left_semi")
    edges = up.select("s", F.lit("SUBCLASS_OF").alias("type"), "o", F.struct(F.lit(0).alias("part"), "s", "p", "o").alias("ord"))
    edges = edges.unionByName(named.where(instance | (iri & F.col("is_ind"))).select("s", F.when(instance, "INSTANCE_OF").otherwise(F.col("pname")).alias("type"), "o", F.struct(F.lit(1).alias("part"), "s", "p", "o").alias("ord")))
    edges = edges.select(X.qname(F.col("s"), known).alias("src"), "type", X.qname(F.col("o"), known).alias("dst"), "ord")
    props = named.where((F.col("o_kind") == "literal") & ~F.col("p").isin(X.LABEL, X.DEFINITION)).groupBy("s", "pname").agg(F.max(F.struct("p", "o")).alias("last"), F.min(F.struct("p", "o")).alias("first")).groupBy("s").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "pname", "last.o"))), lambda x: F.struct(x["pname"], x["o"]))).alias("props"))
    types = named.where(instance).groupBy("s").agg(F.sort_array(F.collect_list(F.regexp_extract("o", r"([^/]*)$", 1))).alias("labels"))
    texts = definitions(triples)
    nodes = classes.withColumn("labels", F.array(F.lit("Category"))).withColumn("props", F.expr("map_from_arrays(array(), array())").cast("map<string,string>"))
    nodes = nodes.unionByName(own.join(types, "s", "left").join(props, "s", "left").select("s", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("props", F.expr("map_from_arrays(array(), array())").cast("map<string,string>")).alias("props")))
    return nodes.join(texts, "s", "left").join(name.select(F.col("node").alias("s"), "label"), "s").select(X.qname(F.col("s"), known).alias("key"), F.col("label").alias("name"), "labels", "props", "definition"), edges


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, ord, src, type, dst): each edge from both its ends, once if they are the same."""
    both = F.array_distinct(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select(F.explode(both).alias("x"), "ord", "src", "type", "dst").select("x.node", "x.other", "ord", "src", "type", "dst")


def heads(near: DataFrame, cap: int, order: str = "ord") -> DataFrame:
    """(node, other, ord): each node's first 2 x cap different neighbours by (order, other).

    A walk of at most cap nodes takes at most cap new ones from a node and passes over at most cap that it has, so it
    never needs more. The limit is applied before rows are dealt by node, so a hub's neighbours never meet in one task.
    """
    once = near.groupBy("node", "other").agg(F.min(order).alias("ord"))
    return once.withColumn("_place", F.row_number().over(Window.partitionBy("node").orderBy("ord", "other"))).where(F.col("_place") <= 2 * cap).drop("_place")


def expand(near: DataFrame, seeds: DataFrame, depth: int, cap: int, order: str = "ord") -> DataFrame:
    """(qid, seed, seed_rank, node, rank): what each seed of each question reaches, in the order of a breadth-first walk.

    near: (node, other, ord); seeds: (qid, seed, seed_rank). A level's nodes come in the order of the node they are reached
    from, then of ord; each seed has `cap` nodes at most, itself included (rank 0), and `depth` levels. All seeds of
    all questions take a level together, and each has its own budget, so a seed next to a hub starves no other. Of a hub's
    neighbours only those are followed that a seed could keep, see heads().
    """
    near = settled(heads(near, cap, order))
    order = "ord"
    walk = settled(seeds.select("qid", "seed", "seed_rank", F.col("seed").alias("node"), F.lit(0).alias("rank"), F.lit(0).alias("level")))
    key = ["qid", "seed", "seed_rank"]
    for level in range(1, depth + 1):
        front = walk.where(F.col("level") == level - 1).select(*key, "node", F.col("rank").alias("from_rank"))
        step = front.join(near.select("node", "other", F.col(order).alias("by")), "node")
        first = step.groupBy(*key, F.col("other").alias("node")).agg(F.min(F.struct("from_rank", "by")).alias("at"))
        new = first.join(walk.select(*key, "node"), [*key, "node"], "left_anti")
        full = walk.groupBy(*key).agg(F.count("*").alias("n"))
        ranked = new.join(full, key).withColumn("rank", (F.col("n") - 1 + F.row_number().over(Window.partitionBy(*key).orderBy("at", "node"))).cast("int")).where(F.col("rank") < cap)
        step = ranked.select(*key, "node", "rank", F.lit(level).alias("level"))
        bigger = settled(walk.unionByName(step))
        if bigger.where(F.col("level") == level).isEmpty():
            break
        walk = bigger
    return walk.select(*key, "node", "rank", "level")


def khop(edges: DataFrame, seeds: DataFrame, hops: int = 4, cap: int = 30) -> DataFrame:
    """expand() over a property graph's edges in their own order."""
    return expand(adjacency(edges), seeds, hops, cap)


def individual_walk(triples: DataFrame, seeds: DataFrame, base: str, depth: int = 4, cap: int = 25) -> DataFrame:
    """expand() over facts between individuals, both ways, neighbours in the order of their IRIs.

    An IRI below base that is only ever an object is an individual too.
    """
    schema = objects(triples, X.TYPE).where(F.col("o").isin(X.CLASS, X.OBJECT_PROPERTY, X.DATATYPE_PROPERTY)).select(F.col("s").alias("n")).distinct()
    facts = triples.where((F.col("o_kind") == "iri") & (F.col("s_kind") == "iri"))
    both = facts.select(F.explode(F.array(F.struct(F.col("s").alias("node"), F.col("o").alias("other")), F.struct(F.col("o").alias("node"), F.col("s").alias("other")))).alias("x")).select("x.*")
    near = both.where(F.col("other").startswith(base)).join(schema, F.col("other") == F.col("n"), "left_anti").distinct().withColumn("ord", F.col("other"))
    return expand(near, seeds, depth, cap)


def merged(walk: DataFrame) -> DataFrame:
    """(qid, node, rank): a question's seeds one after the other, each node where it comes first."""
    first = walk.groupBy("qid", "node").agg(F.min(F.struct("seed_rank", "rank")).alias("at"))
    return first.select("qid", "node", (F.row_number().over(Window.partitionBy("qid").orderBy("at", "node")) - 1).alias("rank"))


def kept_edges(walk: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, src, type, dst, ord): edges whose two ends a question's walk has reached."""
    reached = walk.select("qid", "node").distinct()
    return edges.join(reached.select("qid", F.col("node").alias("src")), "src").join(reached.select("qid", F.col("node").alias("dst")), ["qid", "dst"]).select("qid", "src", "type", "dst", "ord").distinct()


def node_units(nodes: DataFrame) -> DataFrame:
    """(key, text): a node with its labels, definition and properties, one below the other."""
    head = F.concat(F.lit("("), F.col("name"), F.lit(":"), F.when(F.size("labels") > 0, F.array_join("labels", ":")).otherwise("Node"), F.lit(")"))
    props = F.transform(F.map_entries("props"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"]))
    definition = F.when(F.col("definition").isNotNull(), F.array(F.concat(F.lit("  정의: "), F.col("definition")))).otherwise(F.array().cast("array<string>"))
    return nodes.select("key", F.array_join(F.concat(F.array(head), definition, props), "\n").alias("text"))


def edge_unit(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, text): the kept edges of a question as lines, in their order."""
    name = nodes.select("key", "name")
    lines = kept.join(name.select(F.col("key").alias("src"), F.col("name").alias("a")), "src", "left").join(name.select(F.col("key").alias("dst"), F.col("name").alias("b")), "dst", "left")
    line = F.concat(F.lit("("), F.coalesce("a", "src"), F.lit(") -["), F.col("type"), F.lit("]-> ("), F.coalesce("b", "dst"), F.lit(")"))
    return lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
