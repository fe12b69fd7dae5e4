"""A knowledge base: a triple table with its vocabulary, and what can be asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators import lookup, quality, rules, views
from loomgraph.plans import sparql
from loomgraph.sources import turtle


class KnowledgeBase:
    def __init__(self, triples: DataFrame, vocabulary: X.Vocabulary):
        self.triples, self.vocabulary = triples, vocabulary
        self.spark: SparkSession = triples.sparkSession
        self._counts: dict[str, int] | None = None

    @classmethod
    def load(cls, spark: SparkSession, paths: str | list[str], base: str, names: tuple[str, ...] = (), mode: str = "FAILFAST") -> KnowledgeBase:
        """From Turtle files; prefixes are those that the files declare below base; names: local parts of the predicates,
        such as prefix:name, that name entities."""
        declared = turtle.prefixes(spark, paths)
        own = {k: v for k, v in declared.items() if v.startswith(base)}
        known = {**declared, **X.STANDARD}
        full = [known[n.split(":", 1)[0]] + n.split(":", 1)[1] if n.split(":", 1)[0] in known else n for n in names]
        return cls(turtle.read_turtle(spark, paths, mode).cache(), X.Vocabulary(base, own, full))

    @property
    def prefixes(self) -> dict[str, str]:
        return self.vocabulary.known()

    def counts(self) -> dict[str, int]:
        """Triples by predicate: one row for each predicate of the schema."""
        if self._counts is None:
            self._counts = {r["p"]: r["n"] for r in self.triples.groupBy("p").agg(F.count("*").alias("n")).collect()}
        return self._counts

    def resolve(self, term: str) -> str | None:
        row = lookup.resolve(self.triples, self.spark.createDataFrame([(term,)], "term string"), self.vocabulary).first()
        return row["s"] if row else None

    def search(self, query: str, limit: int = 10) -> DataFrame:
        found = lookup.search(self.triples, query, limit, self.vocabulary.base)
        labels = views.objects(self.triples, X.LABEL).groupBy("s").agg(F.sort_array(F.collect_list("o")).alias("labels"))
        return found.join(labels, "s", "left").join(views.definitions(self.triples), "s", "left").select(X.qname(F.col("s"), self.prefixes).alias("uri"), "score", "labels", "definition").orderBy("score", "uri")

    def concept(self, term: str) -> dict | None:
        node = self.resolve(term)
        return lookup.concept(self.triples, node, self.vocabulary) if node else None

    def hierarchy(self, term: str, depth: int = 3) -> dict | None:
        node = self.resolve(term)
        if node is None:
            return None
        edges = lookup.hierarchy(self.triples, node, depth)
        iris = sorted({node, *[c for _, c, _ in edges]})
        rows = self.spark.createDataFrame([(i,) for i in iris], "s string").join(views.objects(self.triples, X.LABEL).groupBy("s").agg(F.sort_array(F.collect_list("o")).alias("labels")), "s", "left")
        shown = {r["s"]: {"uri": r["uri"], "labels": r["labels"] or []} for r in rows.select("s", "labels", X.qname(F.col("s"), self.prefixes).alias("uri")).collect()}

        def tree(n: str, level: int) -> dict:
            below = [tree(c, level + 1) for p, c, d in edges if p == n and d == level + 1]
            return {**shown[n], **({"subclasses": below} if below else {})}

        return tree(node, 0)

    def instances(self, term: str, limit: int = 20) -> DataFrame | None:
        node = self.resolve(term)
        if node is None:
            return None
        found = lookup.instances(self.triples, self.spark.createDataFrame([(node,)], "s string"), limit)
        labels = views.objects(self.triples, X.LABEL).groupBy("s").agg(F.sort_array(F.collect_list("o")).alias("labels"))
        return found.join(labels, "s", "left").select(X.qname(F.col("s"), self.prefixes).alias("uri"), X.qname(F.col("cls"), self.prefixes).alias("type"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels")).orderBy("uri", "type")

    def describe(self, term: str) -> dict | None:
        node = self.resolve(term)
        if node is None:
            return None
        row = lookup.describe(self.triples, self.spark.createDataFrame([(node,)], "s string"), self.prefixes).select(X.qname(F.col("s"), self.prefixes).alias("uri"), "facts", "referenced_by").first()
        return row.asDict(recursive=True)

    def sparql(self, query: str, limit: int | None = 50) -> DataFrame:
        return sparql.run(self.triples, query, self.vocabulary.prefixes, limit, self.counts())

    def statistics(self) -> DataFrame:
        return views.schema_statistics(self.triples)

    def violations(self, shapes: DataFrame) -> DataFrame:
        return quality.violations(self.triples, quality.shapes(shapes))

    def rule_book(self, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
        """(rules, rates) from the graph; names as rules.from_graph() takes them."""
        products, options = rules.from_graph(self.triples, names)
        return rules.extract(products), rules.top_rates(options)
