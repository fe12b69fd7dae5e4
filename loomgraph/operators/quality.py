"""Data contracts: references, labels and SHACL shapes, each one a frame of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators.views import closure, objects, subclass_edges, typed_or_declared
from loomgraph.plans.materialize import settled
from loomgraph.plans.spread import spread


def undefined_references(triples: DataFrame, base: str) -> DataFrame:
    """(class, used_by): classes below base that a type, subclass, domain or range names and that nothing defines.

    used_by is the first predicate, in code point order, that names the class.
    """
    named = triples.where(F.col("p").isin(X.TYPE, X.SUBCLASS, X.DOMAIN, X.RANGE) & (F.col("o_kind") == "iri") & F.col("o").startswith(base))
    used = named.groupBy(F.col("o").alias("class")).agg(F.min("p").alias("used_by"))
    return used.join(typed_or_declared(triples).withColumnRenamed("s", "class"), "class", "left_anti")


def missing_labels(triples: DataFrame, lang: str = "ko") -> DataFrame:
    """(s): classes that are IRIs and have no label in the language."""
    classes = triples.where((F.col("p") == X.TYPE) & (F.col("o") == X.CLASS) & (F.col("s_kind") == "iri")).select("s").distinct()
    return classes.join(objects(triples, X.LABEL).where(F.col("o_lang") == lang).select("s"), "s", "left_anti")


def shapes(graph: DataFrame) -> DataFrame:
    """One row for each property of each node shape of a graph of shapes: shape, target (class or subjects_of), target_iri,
    path, min_count, datatype, min_length, min_inclusive, max_inclusive, cls, message."""
    rows = graph.select("s", "p", "o")
    value = lambda name: F.max(F.when(F.col("p") == X.SH + name, F.col("o")))
    props = rows.groupBy(F.col("s").alias("prop")).agg(*[value(n).alias(c) for n, c in (("path", "path"), ("minCount", "min_count"), ("datatype", "datatype"), ("minLength", "min_length"), ("minInclusive", "min_inclusive"), ("maxInclusive", "max_inclusive"), ("class", "cls"), ("message", "message"))]).where("path IS NOT NULL")
    targets = rows.where(F.col("p").isin(X.SH + "targetClass", X.SH + "targetSubjectsOf")).select(F.col("s").alias("shape"), F.when(F.col("p") == X.SH + "targetClass", "class").otherwise("subjects_of").alias("target"), F.col("o").alias("target_iri"))
    links = rows.where(F.col("p") == X.SH + "property").select(F.col("s").alias("shape"), F.col("o").alias("prop"))
    numbers = {c: F.col(c).try_cast(k) for c, k in (("min_count", "int"), ("min_length", "int"), ("min_inclusive", "decimal(38,10)"), ("max_inclusive", "decimal(38,10)"))}
    return targets.join(links, "shape").join(props, "prop").withColumns(numbers).drop("prop")


def violations(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """(focus, shape, path, constraint, value, message), one row for each value or focus node that breaks a rule.

    A class target takes the subclasses' instances too, and so does a class constraint. Constraints: min_count, datatype
    (a plain literal is a string), min_length, min_inclusive, max_inclusive (what is no number breaks both), class.
    All rules are checked in one pass: rules are joined with targets, targets with values. Focus nodes carry a rule's number,
    not the rule, and are dealt to as many tasks as the triples ask for.
    """
    triples = settled(triples)
    rows = triples.count()
    numbered = settled(rules.distinct().withColumn("rule", F.monotonically_increasing_id()))
    r = F.broadcast(numbered)  # the shapes of a schema, which are written by hand
    named = numbered.select(F.explode(F.array(F.when(F.col("target") == "class", F.col("target_iri")), "cls")).alias("anc")).distinct()
    below = closure(subclass_edges(triples), nodes=objects(triples, X.TYPE).select("o").distinct()).join(F.broadcast(named), "anc", "left_semi")
    types = objects(triples, X.TYPE).where("o_kind = 'iri'").select("s", "o")
    full = types.join(F.broadcast(below.select(F.col("desc").alias("o"), F.col("anc").alias("cls"))), "o").select("s", "cls")  # classes of the schema
    by_class = full.withColumnRenamed("cls", "of").join(r.where("target = 'class'"), F.col("of") == F.col("target_iri")).select("s", "rule", "path")
    by_use = triples.select("s", "p").join(r.where("target = 'subjects_of'"), F.col("p") == F.col("target_iri")).select("s", "rule", "path")
    focus = spread(by_class.unionByName(by_use).withColumnRenamed("s", "focus"), rows, "focus", "path").distinct()
    values = triples.select(F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "o_dt", "o_lang").join(F.broadcast(numbered.select("path").distinct()), "path", "left_semi")
    pairs = focus.join(spread(values, rows, "focus", "path"), ["focus", "path"], "left")
    rule = r.drop("path")
    few = pairs.groupBy("focus", "path", "rule").agg(F.count("o").alias("n")).join(rule, "rule").where("n < min_count").select("focus", "shape", "path", F.lit("min_count").alias("constraint"), F.col("n").cast("string").alias("value"), "message")
    pairs = pairs.where("o IS NOT NULL").join(rule, "rule")
    number = F.when(F.col("o_kind") == "literal", F.col("o").try_cast("decimal(38,10)"))
    dt = F.when(F.col("o_kind") != "literal", "").when(F.col("o_lang").isNotNull(), X.RDF + "langString").otherwise(F.coalesce("o_dt", F.lit(X.XSD + "string")))
    breaks = {
        "datatype": F.col("datatype").isNotNull() & (dt != F.col("datatype")),
        "min_length": F.length("o") < F.col("min_length"),
        "min_inclusive": F.col("min_inclusive").isNotNull() & F.coalesce(number < F.col("min_inclusive"), F.lit(True)),
        "max_inclusive": F.col("max_inclusive").isNotNull() & F.coalesce(number > F.col("max_inclusive"), F.lit(True)),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in breaks.items()]), lambda x: x.isNotNull())
    bad = pairs.withColumn("constraint", F.explode(found)).select("focus", "shape", "path", "constraint", F.col("o").alias("value"), "message")
    of_class = full.join(F.broadcast(numbered.select("cls").distinct()), "cls", "left_semi").select(F.col("s").alias("o"), "cls")
    wrong = pairs.where("cls IS NOT NULL").select("focus", "shape", "path", "o", "cls", "message").join(of_class, ["o", "cls"], "left_anti").select("focus", "shape", "path", F.lit("class").alias("constraint"), F.col("o").alias("value"), "message")
    return few.unionByName(bad).unionByName(wrong)


def question_set(questions: DataFrame, total: int = 1000, least_per_category: int = 20) -> DataFrame:
    """One row of checks (check_name, passed) on a question set (id, qtype, category, answer_type, answer, question)."""
    yes = F.count_if((F.col("answer_type") == "boolean") & (F.col("answer") == "YES"))
    booleans = F.count_if(F.col("answer_type") == "boolean")
    small = questions.groupBy("category").count().agg(F.coalesce(F.min("count"), F.lit(0)).alias("least"))
    one = questions.agg((F.count("*") == total).alias("rows"), (F.count_distinct("id") == F.count("*")).alias("unique_ids"), (F.count_distinct("question") == F.count("*")).alias("unique_questions"), F.coalesce((yes / F.nullif(booleans, F.lit(0))).between(0.4, 0.6), F.lit(True)).alias("balanced"), F.coalesce(F.bool_and(F.col("answer_type").isin("boolean", "numeric", "span", "abstain")), F.lit(True)).alias("answer_types"))
    both = one.crossJoin(small.select((F.col("least") >= least_per_category).alias("category_sizes")))  # a row and a row
    return both.unpivot([], both.columns, "check_name", "passed")
