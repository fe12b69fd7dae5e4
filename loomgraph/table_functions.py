"""Table functions of a knowledge base for SQL: FROM class_instances('x:Y'), or LATERAL with a column of another table.

They are functions written in SQL over views, so Catalyst puts their bodies into the query: a lateral use becomes a join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.kb import KnowledgeBase
from loomgraph.operators.views import labels
from loomgraph.plans import sparql
from loomgraph.plans.materialize import settled


def register(kb: KnowledgeBase, prefix: str = "") -> list[str]:
    """Makes the functions of that prefix in the session of kb, and the views they read; returns the functions' names.

    class_instances(class): uri, label, also of classes below it. describe_instance(uri): predicate, object, kind.
    find_concepts(label): uri of what has that label, whatever its case. Names are qualified as results show them; what isn't
    known gives no rows, and so do nulls.
    """
    spark, known = kb.spark, kb.prefixes
    shown = lambda c, kind: X.shown(F.col(c), F.col(kind), known)
    facts = kb.triples.select(shown("s", "s_kind").alias("uri"), X.qname(F.col("p"), known).alias("predicate"), shown("o", "o_kind").alias("object"), F.col("o_kind").alias("kind"))
    named = labels(kb.triples, kb.vocabulary).select(X.qname(F.col("node"), known).alias("uri"), "label")
    below = sparql.run(kb.triples, "SELECT DISTINCT ?uri ?class WHERE { ?uri a/rdfs:subClassOf* ?class }", kb.vocabulary.prefixes, None, kb.counts())
    every = kb.triples.where(F.col("p") == X.LABEL).select(shown("s", "s_kind").alias("uri"), F.lower("o").alias("name")).distinct()
    for view, df in {"facts": facts, "members": below.join(named, "uri", "left"), "called": every}.items():
        settled(df).createOrReplaceTempView(f"{prefix}kb_{view}")
    bodies = {
        "class_instances": ("uri STRING, label STRING", f"SELECT m.uri, m.label FROM {prefix}kb_members m WHERE m.class = wanted"),
        "describe_instance": ("predicate STRING, object STRING, kind STRING", f"SELECT f.predicate, f.object, f.kind FROM {prefix}kb_facts f WHERE f.uri = wanted"),
        "find_concepts": ("uri STRING", f"SELECT c.uri FROM {prefix}kb_called c WHERE c.name = lower(wanted)"),
    }
    for name, (columns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(wanted STRING) RETURNS TABLE({columns}) RETURN {body}")
    return [prefix + name for name in bodies]
