from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph import terms as X
from loomgraph.operators import etl, quality
from loomgraph.operators import text as R
from loomgraph.plans import sparql
from loomgraph.plans import spread as S

SF = "/root/testdata/sf0.001"


def fullest(df):
    """Rows in the fullest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 200)


def test_triples_of_disclosures_are_told_apart_in_tasks_of_so_many_rows(spark, few):
    spaces = {"market": queries.P, "data": queries.DATA, "products": queries.CLS, "parties": queries.CLS}
    records = queries._records(spark, SF)
    triples = etl.disclosures_to_triples(*records, spaces)
    assert triples.count() == triples.distinct().count() > 5000
    assert fullest(triples) < 1000


def test_an_index_sums_in_tasks_of_so_many_rows(spark, few, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    docs = spark.createDataFrame([(i, f"red widget {i} {i * 7 % 100}") for i in range(400)], "doc int, text string")
    asked = spark.createDataFrame([(i, f"widget {i}") for i in range(10)], "item int, text string")
    index = R.TfIdf(docs, "doc")
    assert fullest(index.bounds) < 1000 < index.bounds.count()
    assert fullest(R.term_frequencies(docs, "doc", rows=index.grams)) < 3000
    found = index.top(asked, "item", k=1)
    assert {r["item"]: r["rank"] for r in found.collect()} == dict.fromkeys(range(10), 1)
    assert fullest(index.scored(asked, "item", k=1)) < 1000


def test_shapes_are_checked_in_tasks_of_so_many_rows(spark, few):
    n = 1000
    triples = spark.range(n).select(F.explode(F.array(*[F.struct(F.concat(F.lit("x"), F.col("id").cast("string")).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"), F.lit(d).alias("o_dt"), F.lit(None).cast("string").alias("o_lang")) for p, o, k, d in ((X.TYPE, F.lit("C"), "iri", None), ("v", F.col("id").cast("string"), "literal", X.XSD + "integer"))])).alias("t")).select("t.*", F.lit("iri").alias("s_kind"))
    kind = "shape string, target string, target_iri string, path string, min_count int, datatype string, min_length int, min_inclusive decimal(38,10), max_inclusive decimal(38,10), cls string, message string"
    rules = [("a", "class", "C", "v", 1, None, None, None, 500, None, "v"), ("a", "class", "C", "v", 1, None, None, None, 500, None, "v"), ("b", "subjects_of", "v", "w", 1, None, None, None, None, None, "w")]
    found = quality.violations(triples, spark.createDataFrame([(*r[:8], Decimal(r[8]) if r[8] else None, *r[9:]) for r in rules], kind))
    assert {tuple(r) for r in found.groupBy("constraint").count().collect()} == {("max_inclusive", n - 501), ("min_count", n)}
    assert fullest(found) < 600


def test_patterns_of_one_subject_are_joined_in_tasks_of_so_many_rows(spark, few):
    triples = spark.range(1000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("s"), F.lit("iri").alias("s_kind"), F.explode(F.array(F.lit("p:a"), F.lit("p:b"))).alias("p"), F.col("id").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = sparql.run(triples, "SELECT ?s ?a ?b WHERE { ?s <p:a> ?a ; <p:b> ?b }", most=1000)
        assert found.count() == 1000 and fullest(found) < 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
