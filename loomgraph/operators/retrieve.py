"""Retrievers and their scenarios: ranked units (qid, rank, text) for all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators import context as C
from loomgraph.operators import graph as G
from loomgraph.operators import text as R
from loomgraph.operators.prefix import ordinals
from loomgraph.operators.lookup import inherited_properties
from loomgraph.operators.views import definitions, kinds, labels, objects, subclass_edges
from loomgraph.plans.materialize import settled

NONE = "array<string>"


def _lines(df: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, lines): lines of a key in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]).alias("lines"))


def _titled(kind: str) -> Column:
    return F.concat(F.lit(f"[{kind}] "), F.col("label"), F.lit(" ("), F.col("key"), F.lit(")"))


class Units:
    """Texts of a graph's nodes: classes, properties and individuals."""

    def __init__(self, triples: DataFrame, vocabulary: X.Vocabulary):
        self.triples, self.vocabulary = triples, vocabulary
        self.known = vocabulary.known()
        self.labels = settled(labels(triples, vocabulary))
        self.kinds = settled(kinds(triples))

    def q(self, c: str) -> Column:
        return X.qname(F.col(c), self.known)

    def named(self, df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(self.labels.select(F.col("node").alias(column), F.col("label").alias(out)), column, "left").withColumn(out, F.coalesce(out, self.q(column)))

    def heads(self, nodes: DataFrame, kind: str) -> DataFrame:
        h = self.named(nodes.select("s").distinct(), "s", "label").withColumn("key", self.q("s")).join(definitions(self.triples), "s", "left")
        definition = F.when(F.col("definition").isNotNull(), F.array(F.concat(F.lit("정의: "), F.col("definition")))).otherwise(F.array().cast(NONE))
        return h.select("s", F.concat(F.array(_titled(kind)), definition).alias("head"))

    @staticmethod
    def joined(heads: DataFrame, *parts: DataFrame) -> DataFrame:
        out, columns = heads, [F.col("head")]
        for i, p in enumerate(parts):
            out = out.join(p.select("s", F.col("lines").alias(f"l{i}")), "s", "left")
            columns.append(F.coalesce(F.col(f"l{i}"), F.array().cast(NONE)))
        return out.select("s", F.array_join(F.concat(*columns), "\n").alias("text"))

    def classes(self, nodes: DataFrame, properties: int = 12, items: int = 15) -> DataFrame:
        """A class with the two levels below it, the classes above, its first properties and instances."""
        edges = subclass_edges(self.triples)
        one = edges.select(F.col("sup").alias("s"), F.col("sub").alias("a"))
        two = one.join(edges.select(F.col("sup").alias("a"), F.col("sub").alias("b")), "a").select("s", "a", "b")
        below = one.select("s", F.col("a").alias("node"), F.concat("a").alias("path"), F.lit(1).alias("level")).unionByName(two.select("s", F.col("b").alias("node"), F.concat("a", F.lit(" "), "b").alias("path"), F.lit(2).alias("level")))
        below = self.named(below.join(nodes.select("s").distinct(), "s", "left_semi"), "node", "label")
        tree = _lines(below, "s", ["path"], F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- 하위: "), F.col("label"), F.lit(" ("), self.q("node"), F.lit(")")))
        above = _lines(edges.select(F.col("sub").alias("s"), F.col("sup").alias("node")).join(nodes.select("s").distinct(), "s", "left_semi"), "s", ["node"], F.concat(F.lit("상위 개념: "), self.q("node")))
        props = inherited_properties(self.triples).withColumnRenamed("cls", "s").join(nodes.select("s").distinct(), "s", "left_semi")
        props = props.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("kind"), "property"))).where(F.col("n") <= properties)
        ranges = F.coalesce(F.nullif(F.array_join(F.transform("ranges", lambda r: X.qname(r, self.known)), ", "), F.lit("")), F.lit("-"))
        related = _lines(self.named(props, "property", "label"), "s", ["n"], F.concat(F.lit("관련 속성: "), F.col("label"), F.lit(" ("), self.q("property"), F.lit(", 범위: "), ranges, F.lit(")")))
        typed = objects(self.triples.where("s_kind = 'iri'"), X.TYPE).select(F.col("s").alias("item"), F.col("o").alias("s")).join(nodes.select("s").distinct(), "s", "left_semi")
        typed = typed.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("item"))).where(F.col("n") <= items)
        listed = _lines(self.named(typed, "item", "label"), "s", ["n"], F.concat(F.lit("항목: "), F.col("label"), F.lit(" ("), self.q("item"), F.lit(")")))
        return self.joined(self.heads(nodes, "개념"), tree, above, related, listed)

    def value(self, df: DataFrame) -> DataFrame:
        """df (o, o_kind) with value: a literal's text, or another node's label."""
        out = df.join(self.labels.select(F.col("node").alias("o"), F.col("label").alias("ol")), "o", "left")
        return out.withColumn("value", F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(F.coalesce("ol", "o")))

    def properties(self, nodes: DataFrame, uses: int = 15) -> DataFrame:
        """A property with its first uses."""
        used = self.triples.select(F.col("p").alias("prop"), F.col("s").alias("subj"), "o", "o_kind").join(nodes.select(F.col("s").alias("prop")).distinct(), "prop", "left_semi")
        used = used.withColumn("n", F.row_number().over(Window.partitionBy("prop").orderBy("subj", "o"))).where(F.col("n") <= uses)
        used = self.named(self.value(used), "subj", "sl").withColumnRenamed("prop", "s")
        return self.joined(self.heads(nodes, "속성"), _lines(used, "s", ["n"], F.concat(F.lit("- "), F.col("sl"), F.lit(" ("), self.q("subj"), F.lit(") → "), F.col("value"))))

    def individuals(self, nodes: DataFrame) -> DataFrame:
        """An individual with its facts and the nodes below the base that refer to it."""
        wanted = nodes.select("s").distinct()
        facts = self.named(self.value(self.triples.where(F.col("p") != X.LABEL).join(wanted, "s", "left_semi")), "p", "pl")
        shown = F.when(F.col("o_kind") == "literal", F.col("value")).otherwise(F.concat("value", F.lit(" ("), self.q("o"), F.lit(")")))
        own = _lines(facts, "s", ["p", "o"], F.concat(F.lit("- "), F.col("pl"), F.lit(": "), shown))
        back = self.triples.where((F.col("o_kind") == "iri") & (F.col("s_kind") == "iri") & F.col("s").startswith(self.vocabulary.base)).select(F.col("s").alias("subj"), "p", F.col("o").alias("s")).join(wanted, "s", "left_semi")
        back = self.named(self.named(back, "subj", "sl"), "p", "pl")
        refs = _lines(back, "s", ["subj", "p"], F.concat(F.lit("- (역참조) "), F.col("sl"), F.lit(" ("), self.q("subj"), F.lit(") ["), F.col("pl"), F.lit("] 관계로 참조")))
        return self.joined(self.heads(nodes, "개체"), own, refs)


def ranked(df: DataFrame) -> DataFrame:
    """(qid, ord..., text) as (qid, rank, text), ranks from 1."""
    return df.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("ord")).alias("rank"), "text")


def ontology_units(triples: DataFrame, vocabulary: X.Vocabulary, questions: DataFrame, matches: int = 8, depth: int = 4, cap: int = 25) -> DataFrame:
    """Units of what a question names: a headline of the matches, their classes and properties, then the individuals around
    the matched ones. A question that names nothing has no units."""
    u = Units(triples, vocabulary)
    found = R.match(R.name_index(triples, vocabulary), questions, matches).select("qid", F.col("node").alias("s"), F.col("rank").alias("m")).join(u.kinds, "s", "left").withColumn("kind", F.coalesce("kind", F.lit("individual")))
    found = settled(found)
    head = _lines(u.named(found, "s", "label").withColumnRenamed("qid", "k"), "k", ["m"], F.concat("label", F.lit("("), u.q("s"), F.lit(")"))).select(F.col("k").alias("qid"), F.struct(F.lit(0).alias("part"), F.lit(0).cast("int").alias("n")).alias("ord"), F.concat(F.lit("[매칭된 개념] "), F.array_join("lines", ", ")).alias("text"))
    schema = found.where("kind <> 'individual'")
    texts = u.classes(schema.where("kind = 'class'")).unionByName(u.properties(schema.where("kind <> 'class'")))
    middle = schema.join(texts, "s").select("qid", F.struct(F.lit(1).alias("part"), F.col("m").alias("n")).alias("ord"), "text")
    seeds = found.where("kind = 'individual'").select("qid", F.col("s").alias("seed"), F.col("m").alias("seed_rank"))
    reached = settled(G.merged(G.individual_walk(triples, seeds, vocabulary.base, depth, cap)).withColumnRenamed("node", "s"))
    last = reached.join(u.individuals(reached), "s").select("qid", F.struct(F.lit(2).alias("part"), F.col("rank").cast("int").alias("n")).alias("ord"), "text")
    return ranked(head.unionByName(middle).unionByName(last))


def graph_units(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 4, cap: int = 30) -> DataFrame:
    """Units of a property graph around seeds (qid, seed, seed_rank), the edges last."""
    walk = G.khop(edges, seeds, hops, cap)
    units = G.merged(walk).join(G.node_units(nodes).withColumnRenamed("key", "node"), "node").select("qid", F.struct(F.lit(0).alias("part"), F.col("rank").cast("int").alias("n")).alias("ord"), "text")
    last = G.edge_unit(G.kept_edges(walk, edges), nodes).select("qid", F.struct(F.lit(1).alias("part"), F.lit(0).cast("int").alias("n")).alias("ord"), "text")
    return ranked(units.unionByName(last))


def graph_seeds(nodes: DataFrame, questions: DataFrame, limit: int = 6) -> DataFrame:
    """The nodes of a property graph that a question names; names of one character don't count."""
    names = R.with_aliases(nodes.select("name", F.col("key").alias("node")))
    return R.match(names, questions, limit, shortest=2).select("qid", F.col("node").alias("seed"), F.col("rank").alias("seed_rank"))


class Scenarios:
    """Nine ways to put a context together, by name, over one graph; indexes are built when they are first needed.

    S1 chunks, S2 entities, S3 relations, S4 both, S5 entities as seeds of a walk, S6 property graph, S7 ontology, S8 and S9
    the last two with their units engineered. Each takes (qid, question) and gives (qid, rank, text).
    """

    TOGETHER = 5
    ENGINEERED = {"S8": "S6", "S9": "S7"}
    DEPTHS = {"S1": 20, "S2": 20, "S3": 40, "S4": 30, "S5": 3}

    def __init__(self, triples: DataFrame, vocabulary: X.Vocabulary):
        self.triples, self.vocabulary = triples, vocabulary
        self._made: dict[object, Future] = {}
        self._lock = Lock()
        self.by_name: dict[str, Callable[[DataFrame], DataFrame]] = {
            **{s: (lambda q, s=s: self.search(q, s, self.DEPTHS[s])) for s in ("S1", "S2", "S3", "S4")},
            "S5": self.hybrid,
            "S6": lambda q: graph_units(*self.graph(), graph_seeds(self.graph()[0], q)),
            "S7": lambda q: ontology_units(triples, vocabulary, q),
            **{s: (lambda q, of=of: C.engineered(self.by_name[of](q))) for s, of in self.ENGINEERED.items()},
        }

    def _once(self, key: object, make: Callable[[], object]) -> object:
        """What make() gives, made by the first thread that asks for that key; others wait for it."""
        with self._lock:
            own = key not in self._made
            known = self._made.setdefault(key, Future())
        if own:
            try:
                known.set_result(make())
            except BaseException as e:
                known.set_exception(e)
        return known.result()

    def corpus(self, name: str) -> DataFrame:
        """(doc, key, text) of S1 to S4; doc is the document's place."""
        return self._once((name, "corpus"), lambda: self._corpus(name))

    def _corpus(self, name: str) -> DataFrame:
        no_key = F.lit(None).cast("string").alias("key")
        entities = self._once("entities", lambda: settled(R.entity_documents(self.triples, self.vocabulary)))
        placed = lambda: self._once("placed", lambda: ordinals(entities.select("s", "key", "text"), ["s"], "doc"))
        facts = lambda: self._once("facts", lambda: ordinals(R.relation_documents(entities).select("s", "line", "text"), ["s", "line"], "doc"))
        if name == "S1":
            return settled(R.chunks(placed(), "doc").select(F.col("chunk").cast("long").alias("doc"), no_key, "text"))
        if name == "S2":
            return settled(placed().select("doc", "key", "text"))
        if name == "S3":
            return settled(facts().select("doc", no_key, "text"))
        first = self.corpus("S2")
        return first.unionByName(self.corpus("S3").withColumn("doc", F.col("doc") + first.count()))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return self._once("graph", lambda: tuple(settled(x) for x in G.property_graph(self.triples, self.vocabulary)))

    def index(self, name: str) -> R.TfIdf:
        return self._once((name, "index"), lambda: R.TfIdf(self.corpus(name), "doc"))

    def search(self, questions: DataFrame, name: str, k: int) -> DataFrame:
        best = self.index(name).top(questions.select("qid", "question"), "qid", "question", k)
        return best.join(self.corpus(name), "doc").select("qid", "rank", "text")

    def hybrid(self, questions: DataFrame) -> DataFrame:
        best = self.index("S2").top(questions.select("qid", "question"), "qid", "question", self.DEPTHS["S5"])
        seeds = best.join(self.corpus("S2"), "doc").select("qid", F.col("key").alias("seed"), F.col("rank").alias("seed_rank"))
        return graph_units(*self.graph(), seeds)

    def evaluate(self, questions: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Mean metrics of each scenario over questions (qid, question, gold).

        Scenarios are made and written side by side, by TOGETHER threads that hand in their jobs; S8 and S9 take the units
        of S6 and S7. All units then go through one grouping by scenario and question.
        """
        names, out, run = names or list(self.by_name), None, object()

        def units(name: str) -> DataFrame:
            of = self.ENGINEERED.get(name)
            return self._once((run, name), lambda: settled(C.engineered(units(of)) if of else self.by_name[name](questions)))

        with ThreadPoolExecutor(self.TOGETHER) as pool:
            made = list(pool.map(inheritable_thread_target(self.triples.sparkSession)(units), names))
        key = F.struct("scenario", "qid").alias("key")
        for name, rows in zip(names, made, strict=True):
            row = rows.withColumn("scenario", F.lit(name))
            out = row if out is None else out.unionByName(row)
        asked = questions.select(F.explode(F.array(*map(F.lit, names))).alias("scenario"), "qid", "gold").select(key, "gold")
        metrics = C.retrieval_metrics(out.select(key, "rank", "text"), asked, "key")
        return C.macro(metrics.select("key.scenario", "key.qid", *[c for c in metrics.columns if c != "key"]), "scenario")


def report(metrics: DataFrame, title: str = "Scenarios") -> str:
    """A Markdown table of a small frame of metrics."""
    rows = metrics.orderBy("scenario").collect()
    names = ["scenario", *[c for c in metrics.columns if c != "scenario"]]
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in names) + " |" for r in rows]) + "\n"

