"""A query for each operator, over graphs and records derived from the star-schema tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import star
from loomgraph import terms as X
from loomgraph.functions import text as T
from loomgraph.operators import context as C
from loomgraph.operators import etl, imports, lookup, quality, reports, rules, views, workload
from loomgraph.operators import graph as G
from loomgraph.operators import retrieve as V
from loomgraph.operators import text as R
from loomgraph.plans import sparql
from loomgraph.plans.materialize import scratch, settled
from loomgraph.plans.spread import spread
from loomgraph.sources import ntriples, records, turtle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VOC, CLS, DATA, P = star.VOCABULARY, star.CLS, star.DATA, star.P


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ask(spark: SparkSession, sf_dir: str, text: str, *kinds: str, schema: bool = True) -> DataFrame:
    made = star.graph if schema else star.entity_triples
    of = lru_cache(None)(lambda p: made(spark, sf_dir, *kinds, only=p))
    most = sum(star.table(spark, sf_dir, "lineitem" if k == "offer" else k).count() for k in kinds)
    return sparql.run(of, text, VOC.prefixes, most=most)


# -- graph patterns ----------------------------------------------------------------------------------------------------


@query("""
SELECT 'data:customer_' || c_custkey AS s, c_name AS name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance FROM customer
UNION ALL SELECT 'data:supplier_' || s_suppkey, s_name, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM supplier
""")
def class_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of a class and of those below it, with a name and an optional value."""
    return _ask(spark, sf_dir, "SELECT ?s ?name ?balance WHERE { ?s a/rdfs:subClassOf* cls:Party ; p:hasName ?name . OPTIONAL { ?s p:balance ?balance } }", "customer", "supplier")


@query("""SELECT 'data:part_' || p_partkey AS s, p_name AS name, CAST(p_size AS VARCHAR) AS size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM part""")
def bgp_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?s ?name ?size ?price WHERE { ?s p:hasName ?name ; p:size ?size ; p:price ?price }", "part", schema=False)


@query("""
SELECT s_name AS supplier, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def bgp_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?supplier ?nation ?region WHERE { ?s a cls:Supplier ; p:hasName ?supplier ; p:locatedIn ?n . ?n rdfs:label ?nation ; p:partOf/rdfs:label ?region }", "supplier", "nation", "region", schema=False)


@query("""
SELECT c_name AS name, n_name AS nation, r_name AS region FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') ON c_nationkey = n_nationkey
""")
def optional_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OPTIONAL group with an inner join and a constant: all of it or nothing."""
    return _ask(spark, sf_dir, 'SELECT ?name ?nation ?region WHERE { ?c p:hasName ?name ; p:locatedIn ?n . OPTIONAL { ?n rdfs:label ?nation ; p:partOf ?r . ?r rdfs:label ?region . FILTER(?region = "ASIA"@en) } }', "customer", "nation", "region", schema=False)


@query("""SELECT DISTINCT n_name AS nation, CAST(p_size AS VARCHAR) AS size FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE CAST(l_discount AS DECIMAL(10,2)) >= 0.09""")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT DISTINCT ?nation ?size WHERE { ?o p:ofPart ?p ; p:bySupplier ?s ; p:rate ?rate . ?p p:size ?size . ?s p:locatedIn/rdfs:label ?nation . FILTER(?rate >= 0.09) }", "part", "supplier", "nation", "offer", schema=False)


@query("""
SELECT s_name AS name, CAST(count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS VARCHAR) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name HAVING count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) > 5
""")
def count_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?name (COUNT(DISTINCT ?o) AS ?n) WHERE { ?o p:bySupplier ?s . ?s p:hasName ?name } GROUP BY ?name HAVING(COUNT(DISTINCT ?o) > 5)", "supplier", "offer", schema=False)


@query("""
SELECT p_name AS name, CAST(min(CAST(l_discount AS DECIMAL(10,2))) AS VARCHAR) AS least, CAST(max(CAST(l_discount AS DECIMAL(10,2))) AS VARCHAR) AS most
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY p_name
""")
def min_rate_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?name (MIN(?rate) AS ?least) (MAX(?rate) AS ?most) WHERE { ?o p:ofPart ?p ; p:rate ?rate . ?p p:hasName ?name ; p:size 7 } GROUP BY ?name ORDER BY ?least", "part", "offer", schema=False)


@query("""
SELECT 'data:part_' || p_partkey AS p, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM part ORDER BY CAST(p_retailprice AS DECIMAL(18,2)) DESC, '<urn:star:data/part_' || p_partkey || '>' LIMIT 1
""")
def top1_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?p ?price WHERE { ?p p:price ?price } ORDER BY DESC(?price) LIMIT 1", "part", schema=False)


@query("""
SELECT 'data:customer_' || c_custkey AS x, 'low' AS band FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0
UNION ALL SELECT 'data:supplier_' || s_suppkey, 'high' FROM supplier WHERE CAST(s_acctbal AS DECIMAL(18,2)) > 9000
""")
def union_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?x ?band WHERE { { ?x p:balance ?b . FILTER(?b < 0 && CONTAINS(STR(?x), 'customer')) BIND('low' AS ?band) } UNION { ?x a cls:Supplier ; p:balance ?b . FILTER(?b > 9000) BIND('high' AS ?band) } }", "customer", "supplier", schema=False)


@query("""SELECT 'data:customer_' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def filter_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?c WHERE { ?c p:balance ?b . FILTER NOT EXISTS { ?o p:placedBy ?c ; p:status 'F' } }", "customer", "orders", schema=False)


@query("""
SELECT 'data:customer_' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
""")
def exists_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, 'SELECT ?c WHERE { ?c p:balance ?b . FILTER EXISTS { ?o p:placedBy ?c ; p:status "F" } MINUS { ?x p:placedBy ?c ; p:status "O" } }', "customer", "orders", schema=False)


@query("""
SELECT 'data:part_' || p_partkey AS s, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM part
QUALIFY CAST(p_retailprice AS DECIMAL(18,2)) = max(CAST(p_retailprice AS DECIMAL(18,2))) OVER (PARTITION BY p_type, p_brand)
""")
def correlated_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest of each class: an inequality between what is outside and what is inside."""
    text = "SELECT ?s ?price WHERE { ?s a ?t ; p:price ?price . FILTER NOT EXISTS { ?o a ?t ; p:price ?y FILTER(?y > ?price) } }"
    return _ask(spark, sf_dir, text, "part", schema=False)


@query("""
SELECT 'data:customer_' || c_custkey AS c FROM customer WHERE EXISTS (
  SELECT 1 FROM orders o JOIN customer d ON d.c_custkey = o.o_custkey WHERE o_custkey = customer.c_custkey AND 'F' <> o_orderstatus AND CAST(customer.c_acctbal AS DECIMAL(18,2)) > length(o_orderstatus))
""")
def correlated_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT ?c WHERE { ?c p:balance ?b . FILTER EXISTS { ?o p:placedBy ?c ; p:status ?s FILTER(?s != 'F') FILTER(?b > STRLEN(?s)) } }"
    return _ask(spark, sf_dir, text, "customer", "orders", schema=False)


@query("""
SELECT 'data:customer_' || c_custkey AS c, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'yes' ELSE 'no' END AS closed
FROM customer WHERE c_acctbal < 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
""")
def exists_in_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS within an alternative and within a value."""
    text = """SELECT ?c ?closed WHERE { ?c p:balance ?b . FILTER(?b < 0 || NOT EXISTS { ?o p:placedBy ?c ; p:status 'P' })
              BIND(IF(EXISTS { ?q p:placedBy ?c ; p:status 'F' }, 'yes', 'no') AS ?closed) }"""
    return _ask(spark, sf_dir, text, "customer", "orders", schema=False)


@query("""
SELECT 'data:region_' || r_regionkey AS r FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND NOT EXISTS (
  SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND CAST(c_acctbal AS DECIMAL(18,2)) > 9700))
""")
def nested_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in all of whose nations some customer is rich."""
    text = "SELECT ?r WHERE { ?r a cls:Region . FILTER NOT EXISTS { ?n p:partOf ?r FILTER NOT EXISTS { ?c p:locatedIn ?n ; p:balance ?b FILTER(?b > 9700) } } }"
    return _ask(spark, sf_dir, text, "customer", "nation", "region", schema=False)


@query("""
SELECT 'data:customer_' || c_custkey AS c, CAST(count(*) AS VARCHAR) AS n, CAST(CAST(any_value(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) AS balance FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def subselect_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT ?c ?n ?balance WHERE { ?c p:balance ?balance . { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o p:placedBy ?c } GROUP BY ?c } }"
    return _ask(spark, sf_dir, text, "customer", "orders", schema=False)


@query("""
SELECT 'data:customer_' || c_custkey AS c, 'data:nation_' || n_nationkey AS n, 'data:region_' || n_regionkey AS r
FROM customer JOIN nation ON CAST(c_acctbal AS DECIMAL(18,2)) <= 0 OR n_nationkey = c_nationkey
""")
def join_after_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern on a variable that an OPTIONAL may have left unbound: it is then compatible with every term."""
    text = "SELECT ?c ?n ?r WHERE { ?c p:balance ?b . OPTIONAL { ?c p:locatedIn ?n FILTER(?b > 0) } ?n p:partOf ?r }"
    return _ask(spark, sf_dir, text, "customer", "nation", schema=False)


@query("""
SELECT 'data:part_' || p_partkey AS s, 'cls:' || up AS up FROM part, LATERAL (SELECT unnest(['Product', 'Thing', regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g')]) AS up)
WHERE CAST(p_retailprice AS DECIMAL(18,2)) < 920
""")
def ancestors_of_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of any length that starts from what other patterns bind."""
    text = "SELECT ?s ?up WHERE { { SELECT ?s ?t WHERE { ?s p:price ?x ; a ?t FILTER(?x < 920) } } ?t rdfs:subClassOf+ ?up }"
    return _ask(spark, sf_dir, text, "part")


@query("""
SELECT r_name AS region, CAST(count(*) AS VARCHAR) AS n, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, "SELECT ?region (COUNT(*) AS ?n) (GROUP_CONCAT(?name; SEPARATOR='|') AS ?names) WHERE { ?r ^p:partOf ?x ; rdfs:label ?region . ?x rdfs:label ?name } GROUP BY ?region", "nation", "region", schema=False)


_TREE = """WITH RECURSIVE e(sub, sup) AS (
  SELECT * FROM (VALUES ('Product', 'Thing'), ('Party', 'Thing'), ('Customer', 'Party'), ('Supplier', 'Party'), ('Nation', 'Thing'), ('Region', 'Thing'), ('Order', 'Thing'), ('Offer', 'Thing'))
  UNION SELECT regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g'), 'Product' FROM part
  UNION SELECT regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g') || '__' || regexp_replace(p_brand, '[^0-9A-Za-z]+', '_', 'g'), regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g') FROM part
  UNION SELECT regexp_replace(c_mktsegment, '[^0-9A-Za-z]+', '_', 'g'), 'Customer' FROM customer),
c(d, a, depth) AS (SELECT sub, sub, 0 FROM e UNION SELECT 'Thing', 'Thing', 0 UNION SELECT c.d, e.sup, depth + 1 FROM c JOIN e ON c.a = e.sub)
"""


@query(_TREE + "SELECT 'urn:star:class/' || d AS \"desc\", 'urn:star:class/' || a AS anc, depth FROM c")
def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.closure(views.subclass_edges(star.schema_triples(spark, sf_dir)))


_PROPS = """p(property, domain) AS (VALUES ('hasName', 'Thing'), ('size', 'Product'), ('price', 'Product'), ('balance', 'Party'), ('locatedIn', 'Party'), ('partOf', 'Nation'), ('placedBy', 'Order'), ('ofPart', 'Offer'), ('bySupplier', 'Offer'), ('rate', 'Offer'), ('status', 'Order'))"""


@query(_TREE + ", " + _PROPS + " SELECT 'urn:star:class/' || d AS cls, 'urn:star:p/' || property AS property, 'urn:star:class/' || a AS via FROM c JOIN p ON a = domain")
def inherited_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.inherited_properties(star.schema_triples(spark, sf_dir)).select("cls", "property", "via")


@query("""
SELECT 'urn:star:class/Party' AS root, s, cls FROM (
  SELECT 'urn:star:data/customer_' || c_custkey AS s, 'urn:star:class/' || regexp_replace(c_mktsegment, '[^0-9A-Za-z]+', '_', 'g') AS cls FROM customer
  UNION ALL SELECT 'urn:star:data/supplier_' || s_suppkey, 'urn:star:class/Supplier' FROM supplier) ORDER BY s, cls LIMIT 20
""")
def first_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 instances of a class: the limit is the lookup's own."""
    return lookup.instances(star.graph(spark, sf_dir, "customer", "supplier"), spark.createDataFrame([(CLS + "Party",)], "s string"), 20)


# -- lookups -----------------------------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT 'urn:star:data/nation_' || n_nationkey AS s, n_name AS o FROM nation UNION ALL SELECT 'urn:star:data/region_' || r_regionkey, r_name FROM region)
SELECT s, min(CASE WHEN lower(o) = 'nation_1' THEN 0 WHEN contains(lower(o), 'nation_1') THEN 1 END) AS score FROM l GROUP BY s HAVING score IS NOT NULL ORDER BY score, s LIMIT 10
""")
def search_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.search(star.entity_triples(spark, sf_dir, "nation", "region"), "Nation_1", 10, star.BASE)


@query("""SELECT * FROM (VALUES ('urn:star:data/nation_3', 'urn:star:data/nation_3'), ('data:region_2', 'urn:star:data/region_2'), ('Customer', 'urn:star:class/Customer'), ('NATION_7', 'urn:star:data/nation_7'), ('price', 'urn:star:p/price'), ('no such thing', NULL)) AS t(term, s)""")
def resolve_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(t,) for t in ("urn:star:data/nation_3", "data:region_2", "Customer", "NATION_7", "price", "no such thing")], "term string")
    return lookup.resolve(star.graph(spark, sf_dir, "nation", "region"), wanted, VOC)


@query("""
SELECT 'urn:star:data/customer_' || c_custkey AS node, c_name AS label FROM customer UNION ALL SELECT 'urn:star:data/nation_' || n_nationkey, n_name FROM nation
UNION ALL SELECT DISTINCT 'urn:star:data/region_' || n_regionkey, 'data:region_' || n_regionkey FROM nation
""")
def label_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.labels(star.entity_triples(spark, sf_dir, "customer", "nation"), VOC).where(F.col("node").startswith(DATA))


@query("""
SELECT 'urn:star:data/nation_' || n_nationkey AS s, 3 + (SELECT count(*) * 0 FROM region) AS facts,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS referenced_by FROM nation
""")
def describe_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = star.entity_triples(spark, sf_dir, "nation", "customer", "supplier")
    nations = triples.where((F.col("p") == X.TYPE) & (F.col("o") == CLS + "Nation")).select("s")
    return lookup.describe(triples, nations, VOC.known()).select("s", F.size("facts").cast("long").alias("facts"), F.size("referenced_by").cast("long").alias("referenced_by"))


@query("""
SELECT (SELECT 9 + count(DISTINCT p_type) + count(DISTINCT (p_type, p_brand)) FROM part) + (SELECT count(DISTINCT c_mktsegment) FROM customer) AS classes,
  5 AS object_properties, 6 AS datatype_properties, 0 AS ontologies, (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) AS individuals
""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.schema_statistics(star.graph(spark, sf_dir, "part", "nation")).drop("triples")


@query("""SELECT 'urn:star:data/nation_' || n_nationkey AS s, 'individual' AS kind FROM nation UNION ALL SELECT 'urn:star:class/' || x, 'class' FROM (VALUES ('Thing'), ('Nation')) AS t(x) UNION ALL SELECT 'urn:star:p/' || x, y FROM (VALUES ('rate', 'datatype_property'), ('partOf', 'object_property')) AS t(x, y)""")
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.kinds(star.graph(spark, sf_dir, "nation")).where(F.col("s").startswith(DATA) | F.col("s").isin(CLS + "Thing", CLS + "Nation", P + "rate", P + "partOf"))


@query("""SELECT count(*) AS triples, count(DISTINCT line) AS lines FROM (SELECT '<urn:star:data/nation_' || n_nationkey || '> <urn:star:p/partOf> <urn:star:data/region_' || n_regionkey || '> .' AS line FROM nation UNION ALL SELECT '<urn:star:data/nation_' || n_nationkey || '> label ' || n_name FROM nation UNION ALL SELECT '<urn:star:data/nation_' || n_nationkey || '> type' FROM nation)""")
def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.entity_triples(spark, sf_dir, "nation").select(turtle.ntriples(F.lit(None)).alias("line"))
    return lines.agg(F.count("*").alias("triples"), F.count_distinct("line").alias("lines"))


# -- contracts ---------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT 'urn:star:class/' || regexp_replace(c_mktsegment, '[^0-9A-Za-z]+', '_', 'g') AS class, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS used_by FROM customer""")
def undefined_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that no class declares: customers' segments, next to a schema without them."""
    schema = star.schema_triples(spark, sf_dir).where(~((F.col("p") == X.SUBCLASS) & (F.col("o") == CLS + "Customer")))
    segments = star.entity_triples(spark, sf_dir, "customer").where(F.col("p") == X.TYPE).select(F.col("o").alias("s")).distinct()
    return quality.undefined_references(schema.join(segments, "s", "left_anti").select(*X.TRIPLES.fieldNames()).unionByName(star.entity_triples(spark, sf_dir, "customer")), star.BASE)


@query("""
SELECT 'urn:star:class/Offer' AS s UNION ALL SELECT DISTINCT 'urn:star:class/' || regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g') FROM part
UNION ALL SELECT DISTINCT 'urn:star:class/' || regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g') || '__' || regexp_replace(p_brand, '[^0-9A-Za-z]+', '_', 'g') FROM part
UNION ALL SELECT DISTINCT 'urn:star:class/' || regexp_replace(c_mktsegment, '[^0-9A-Za-z]+', '_', 'g') FROM customer
""")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_labels(star.schema_triples(spark, sf_dir))


@query("""
SELECT 'urn:star:data/customer_' || c_custkey AS focus, 'min_inclusive' AS "constraint", CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS value FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0
UNION ALL SELECT 'urn:star:data/customer_' || c_custkey, 'max_inclusive', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 9000
UNION ALL SELECT 'urn:star:data/supplier_' || s_suppkey, 'min_count', '0' FROM supplier
UNION ALL SELECT 'urn:star:data/supplier_' || s_suppkey, 'min_length', s_name FROM supplier
UNION ALL SELECT 'urn:star:data/supplier_' || s_suppkey, 'datatype', s_name FROM supplier
UNION ALL SELECT 'urn:star:data/customer_' || c_custkey, 'class', 'urn:star:data/nation_' || c_nationkey FROM customer WHERE c_nationkey >= 20
""")
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, counts, lengths, datatypes and classes, by class target (subclasses too) and by use of a property."""
    triples = star.graph(spark, sf_dir, "customer", "supplier", "nation").where(~((F.col("p") == X.TYPE) & F.regexp_extract("s", r"data/nation_(\d+)$", 1).try_cast("int").isNotNull() & (F.regexp_extract("s", r"data/nation_(\d+)$", 1).try_cast("int") >= 20)))
    kind = "shape string, target string, target_iri string, path string, min_count int, datatype string, min_length int, min_inclusive decimal(38,10), max_inclusive decimal(38,10), cls string, message string"
    from decimal import Decimal

    rows = [("a", "class", CLS + "Customer", P + "balance", 1, X.XSD + "decimal", None, Decimal(0), Decimal(9000), None, "balance"), ("b", "class", CLS + "Supplier", P + "rating", 1, None, None, None, None, None, "rating"), ("c", "class", CLS + "Supplier", P + "hasName", 1, X.XSD + "integer", 40, None, None, None, "name"), ("d", "subjects_of", P + "balance", P + "locatedIn", 1, None, None, None, None, CLS + "Nation", "nation")]
    found = quality.violations(triples, spark.createDataFrame(rows, kind))
    return found.where(~((F.col("shape") == "d") & F.col("focus").startswith(DATA + "supplier"))).select("focus", "constraint", "value")


# -- property graph and walks ------------------------------------------------------------------------------------------


@query("""SELECT 'data:nation_' || n_nationkey AS key, n_name AS name, 'Nation' AS labels, 0 AS props FROM nation UNION ALL SELECT 'data:customer_' || c_custkey, c_name, regexp_replace(c_mktsegment, '[^0-9A-Za-z]+', '_', 'g'), 2 FROM customer""")
def lpg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = G.property_graph(star.graph(spark, sf_dir, "nation", "customer"), VOC)
    return nodes.where(F.col("key").startswith("data:")).select("key", "name", F.array_join("labels", ":").alias("labels"), F.size("props").alias("props"))


@query("""
SELECT 'data:customer_' || c_custkey AS src, 'p:locatedIn' AS type, 'data:nation_' || c_nationkey AS dst FROM customer
UNION ALL SELECT 'data:nation_' || n_nationkey, 'p:partOf', 'data:region_' || n_regionkey FROM nation
UNION ALL SELECT 'data:nation_' || n_nationkey, 'INSTANCE_OF', 'cls:Nation' FROM nation
UNION ALL SELECT 'data:region_' || r_regionkey, 'INSTANCE_OF', 'cls:Region' FROM region
UNION ALL SELECT 'data:customer_' || c_custkey, 'INSTANCE_OF', 'cls:' || regexp_replace(c_mktsegment, '[^0-9A-Za-z]+', '_', 'g') FROM customer
""")
def lpg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = G.property_graph(star.graph(spark, sf_dir, "nation", "customer", "region"), VOC)
    return edges.where("type <> 'SUBCLASS_OF'").select("src", "type", "dst")


@query("""
WITH e AS (SELECT 'nation_' || n_nationkey AS a, 'region_' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier),
n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
l0 AS (SELECT 'supplier_' || s_suppkey AS seed, 'supplier_' || s_suppkey AS node, 0 AS rank FROM supplier),
c1 AS (SELECT seed, y AS node, min((rank, y)) AS k FROM l0 JOIN n ON node = x GROUP BY seed, y),
l1 AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY k, node) AS rank FROM c1 WHERE (seed, node) NOT IN (SELECT (seed, node) FROM l0)),
a1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 WHERE rank < 25),
c2 AS (SELECT seed, y AS node, min((rank, y)) AS k FROM l1 JOIN n ON node = x WHERE rank < 25 GROUP BY seed, y),
s1 AS (SELECT seed, max(rank) AS m FROM a1 GROUP BY seed),
l2 AS (SELECT c2.seed, node, s1.m + row_number() OVER (PARTITION BY c2.seed ORDER BY k, node) AS rank FROM c2 JOIN s1 USING (seed) WHERE (c2.seed, node) NOT IN (SELECT (seed, node) FROM a1)),
a2 AS (SELECT * FROM a1 UNION ALL SELECT * FROM l2 WHERE rank < 25)
SELECT 'urn:star:data/' || seed AS seed, 'urn:star:data/' || node AS node, CAST(rank AS INTEGER) AS rank FROM a2
""")
def bfs_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels around each supplier, 25 nodes each at most: the cap is the operator's own."""
    triples = star.entity_triples(spark, sf_dir, "supplier", "nation").where(F.col("p").isin(P + "locatedIn", P + "partOf"))
    seeds = star.table(spark, sf_dir, "supplier").select(F.lit(1).alias("qid"), F.concat(F.lit(DATA + "supplier_"), F.col("s_suppkey").cast("string")).alias("seed"), F.col("s_suppkey").cast("int").alias("seed_rank"))
    return G.individual_walk(triples, seeds, star.BASE, depth=2, cap=25).select("seed", "node", "rank")


@query()
def khop_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a four-hop walk over the property graph from two nations: nodes in their order, edges last."""
    nodes, edges = map(settled, G.property_graph(star.graph(spark, sf_dir, "nation", "region", "supplier"), VOC))
    seeds = spark.createDataFrame([(1, "data:nation_1", 0), (1, "data:nation_2", 1), (2, "data:region_1", 0)], "qid int, seed string, seed_rank int")
    walk = G.khop(edges, seeds)
    units = G.merged(walk).join(G.node_units(nodes).withColumnRenamed("key", "node"), "node").select("qid", F.col("rank").cast("int").alias("rank"), "text")
    return units.unionByName(G.edge_unit(G.kept_edges(walk, edges), nodes).select("qid", F.lit(1 << 20).alias("rank"), "text"))


# -- text --------------------------------------------------------------------------------------------------------------


@query("""
SELECT 'data:nation_' || n_nationkey AS key, '## ' || n_name || ' (data:nation_' || n_nationkey || ')' || chr(10) || '- rdf:type: Nation (ko)' || chr(10) || '- p:partOf: ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.entity_documents(star.graph(spark, sf_dir, "nation", "region"), VOC)
    return docs.where(F.col("key").startswith("data:nation")).select("key", "text")


@query("""
SELECT 'urn:star:data/nation_' || n_nationkey AS s, 1 AS line, n_name || ' — rdf:type: Nation (ko)' AS text FROM nation
UNION ALL SELECT 'urn:star:data/nation_' || n_nationkey, 2, n_name || ' — p:partOf: ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def relation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.entity_documents(star.graph(spark, sf_dir, "nation", "region"), VOC)
    return R.relation_documents(docs.where(F.col("key").startswith("data:nation")))


@query("""
WITH t AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY item_id) AS t FROM benchmark)
SELECT i AS chunk, substring(t, CAST(i * 320 + 1 AS BIGINT), 400) AS text FROM t, unnest(range(0, CAST(ceil(length(t) / 320.0) AS BIGINT))) AS u(i)
""")
def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunks(star.table(spark, sf_dir, "benchmark"), "item_id")


@query("""
WITH g AS (SELECT DISTINCT item_id, substring(lower(text), CAST(i + 1 AS BIGINT), n) AS gram FROM benchmark, (VALUES (2), (3)) AS s(n), unnest(range(0, length(text) - n + 1)) AS u(i))
SELECT gram, count(*) AS df FROM g GROUP BY gram
""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_frequencies(star.table(spark, sf_dir, "benchmark"), "item_id").groupBy("gram").agg(F.count("*").alias("df"))


@query("""
WITH d AS (SELECT p_partkey AS doc, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part),
q AS (SELECT item_id, text AS t FROM benchmark UNION ALL SELECT 1000 + n_nationkey, 'small widget economy brand ' || n_nationkey FROM nation),
g AS (SELECT doc, gram, count(*) AS tf FROM (SELECT doc, substring(lower(t), CAST(i + 1 AS BIGINT), n) AS gram FROM d, (VALUES (2), (3)) AS s(n), unnest(range(0, length(t) - n + 1)) AS u(i)) GROUP BY ALL),
h AS (SELECT item_id, gram, count(*) AS tf FROM (SELECT item_id, substring(lower(t), CAST(i + 1 AS BIGINT), n) AS gram FROM q, (VALUES (2), (3)) AS s(n), unnest(range(0, length(t) - n + 1)) AS u(i)) GROUP BY ALL),
m AS (SELECT count(*) AS n FROM d), idf AS (SELECT gram, ln(n / (1.0 + count(*))) + 1 AS idf FROM g, m GROUP BY gram, n),
w AS (SELECT doc, g.gram, tf * idf AS w FROM g JOIN idf USING (gram)), nd AS (SELECT doc, sqrt(sum(w * w)) AS nd FROM w GROUP BY doc),
v AS (SELECT item_id, h.gram, tf * coalesce(idf, ln(n * 1.0) + 1) AS v FROM h CROSS JOIN m LEFT JOIN idf USING (gram)), nq AS (SELECT item_id, sqrt(sum(v * v)) AS nq FROM v GROUP BY item_id),
s AS (SELECT item_id, doc, round(sum(v * w) / (nq * nd), 6) AS score FROM v JOIN w USING (gram) JOIN nq USING (item_id) JOIN nd USING (doc) GROUP BY item_id, doc, nq, nd HAVING sum(v * w) > 0)
SELECT item_id, doc, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 5
""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of a catalogue of short descriptions for each question."""
    docs = star.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    asked = star.table(spark, sf_dir, "benchmark").select("item_id", "text")
    more = star.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("item_id"), F.concat(F.lit("small widget economy brand "), F.col("n_nationkey").cast("string")).alias("text"))
    return R.TfIdf(docs, "p_partkey").top(asked.unionByName(more), "item_id", k=5, decimals=6)


@query("""
WITH q(qid, q) AS (SELECT item_id, lower(text) FROM benchmark UNION ALL SELECT 10000, 'which small rings and red widgets are there' UNION ALL SELECT 10001, 'a'),
n AS (SELECT DISTINCT p_name AS node, lower(p_name) AS n FROM part UNION SELECT 'r' || r_regionkey, lower(r_name) FROM region UNION SELECT 'short', 'the'),
s AS (SELECT qid, node, CAST(CASE WHEN length(n) < 4 THEN CASE WHEN contains(q, n) THEN length(n) ELSE 0 END ELSE list_max(list_transform(range(1, length(n) + 1), lambda i: list_max(list_transform(range(1, length(n) - i + 2), lambda k: CASE WHEN contains(q, substring(n, CAST(i AS BIGINT), CAST(k AS BIGINT))) THEN k ELSE 0 END)))) END AS INTEGER) AS lcs, length(n) AS len FROM q, n),
b AS (SELECT qid, node, lcs, lcs / len AS score FROM s WHERE (len < 4 AND lcs > 0) OR (len >= 4 AND lcs >= 4))
SELECT qid, node, round(score, 6) AS score, lcs, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, lcs DESC, node) AS INTEGER) AS rank FROM b QUALIFY rank <= 8
""")
def lcs_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in questions by their longest shared run, the eight best of each question."""
    parts = star.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("node")).distinct()
    regions = star.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    names = parts.unionByName(regions).unionByName(spark.createDataFrame([("the", "short")], "name string, node string"))
    asked = star.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")).unionByName(spark.createDataFrame([(10000, "which small rings and red widgets are there"), (10001, "a")], "qid long, question string"))
    return R.match(names, asked).select("qid", "node", F.round("score", 6).alias("score"), F.col("lcs").cast("int").alias("lcs"), "rank")


@query("""
WITH n AS (SELECT 'p' || p_partkey AS node, p_name || CASE WHEN p_partkey % 3 = 0 THEN '(' || p_brand || ')' WHEN p_partkey % 3 = 1 THEN '(x)' ELSE '' END AS name FROM part)
SELECT DISTINCT name, node FROM (SELECT name, node FROM n UNION ALL SELECT trim(split_part(rtrim(name, ')'), '(', 1)), node FROM n WHERE contains(name, '(') AND ends_with(name, ')')
UNION ALL SELECT trim(split_part(rtrim(name, ')'), '(', 2)), node FROM n WHERE contains(name, '(') AND ends_with(name, ')') AND length(trim(split_part(rtrim(name, ')'), '(', 2))) >= 2)
""")
def name_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("("), F.col("p_brand"), F.lit(")"))).when(F.col("p_partkey") % 3 == 1, F.lit("(x)")).otherwise("")
    return R.with_aliases(star.table(spark, sf_dir, "part").select(F.concat("p_name", tail).alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")))


@query()
def ontology_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of what three questions name, in the graph of nations and suppliers."""
    triples = settled(star.graph(spark, sf_dir, "nation", "region", "supplier"))
    asked = spark.createDataFrame([(1, "Which suppliers are in NATION_1 (ASIA)?"), (2, "What is a Supplier?"), (3, "zzzz")], "qid int, question string")
    return V.ontology_units(triples, VOC, asked)


@query()
def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all nine scenarios on a question for each nation, whose evidence is its region."""
    triples = settled(star.graph(spark, sf_dir, "nation", "region"))
    n, r = star.table(spark, sf_dir, "nation"), star.table(spark, sf_dir, "region")
    asked = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"), F.array("n_name", "r_name").alias("gold"))
    return V.Scenarios(triples, VOC).evaluate(asked)


# -- contexts ----------------------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star.table(spark, sf_dir, "conversations")
    one = t.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))  # a turn that is there twice counts once
    return one.select(F.col("conv_id").alias("qid"), F.col("turn").cast("int").alias("rank"), F.coalesce("text", F.lit("")).alias("text"))


_UNITS = "u AS (SELECT conv_id AS qid, CAST(turn AS INTEGER) AS rank, coalesce(min(text), '') AS text FROM conversations GROUP BY ALL)"


@query(f"""
WITH {_UNITS}, p AS (SELECT *, row_number() OVER w AS n, sum(length(text) + 2) OVER w - 2 AS used FROM u WINDOW w AS (PARTITION BY qid ORDER BY rank))
SELECT qid, string_agg(CASE WHEN used > 2000 THEN substring(text, 1, 2000) ELSE text END, chr(10) || chr(10) ORDER BY n) AS context FROM p WHERE used <= 2000 OR n = 1 GROUP BY qid
""")
def assemble_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assemble(_turns(spark, sf_dir), 2000)


@query("""
WITH u AS (SELECT conv_id AS qid, CAST(turn AS INTEGER) AS rank, CASE CAST(turn AS INTEGER) % 3 WHEN 0 THEN '[개념] ' WHEN 1 THEN '[속성] ' ELSE '' END || CAST(turn // 4 AS VARCHAR) AS text FROM conversations GROUP BY ALL),
o AS (SELECT qid, text, min((CASE WHEN starts_with(text, '[개념]') THEN 2 WHEN starts_with(text, '[속성]') THEN 1 ELSE 0 END, rank)) AS k FROM u GROUP BY qid, text)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY k) AS INTEGER) AS rank, text FROM o
""")
def engineered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("rank", F.lit(3))
    head = F.when(kind == 0, "[개념] ").when(kind == 1, "[속성] ").otherwise("")
    return C.engineered(_turns(spark, sf_dir).withColumn("text", F.concat(head, F.floor(F.col("rank") / 4).cast("string"))))


@query(f"""
WITH {_UNITS}, n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM u), g AS (SELECT DISTINCT qid, unnest(['en', 'que', 'the ']) AS g FROM u),
f AS (SELECT qid, g, min(r) AS seen FROM g JOIN n USING (qid) WHERE contains(text, g) GROUP BY ALL),
k AS (SELECT qid, max(seen) AS complete, count(*) AS found FROM f GROUP BY qid),
a AS (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY r) AS c, min_by(text, r) AS first FROM n GROUP BY qid)
SELECT qid, CASE WHEN contains(first, 'en') AND contains(first, 'que') AND contains(first, 'the ') THEN 1.0 ELSE 0.0 END::DOUBLE AS hit1,
  CASE WHEN found = 3 THEN 1.0 / complete ELSE 0 END::DOUBLE AS mrr, length(c) AS chars, round((contains(c, 'en')::INT + contains(c, 'que')::INT + contains(c, 'the ')::INT) / 3, 12) AS recall_inf
FROM a LEFT JOIN k USING (qid)
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _turns(spark, sf_dir)
    gold = units.select("qid").distinct().withColumn("gold", F.array(F.lit("en"), F.lit("que"), F.lit("the ")))
    return C.retrieval_metrics(units, gold).select("qid", "hit1", "mrr", F.col("chars").cast("long").alias("chars"), "recall_inf")


@query(f"""
WITH {_UNITS}, a AS (SELECT qid, string_agg(text, ' ') AS c FROM u GROUP BY qid), f AS (SELECT contains(c, 'en')::INT + contains(c, 'que')::INT AS found FROM a)
SELECT sum(found) / sum(2) AS recall, count(*) FILTER (found = 2) AS perfect, count(*) AS questions FROM f
""")
def micro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _turns(spark, sf_dir)
    gold = units.select("qid").distinct().withColumn("gold", F.array(F.lit("en"), F.lit("que")))
    return C.micro(C.assemble(units, None), gold).select("recall", "perfect", "questions")


@query()
def compact_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units compacted: patterns that look behind, which DuckDB's don't."""
    unit = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("[속성] x\n- ")).otherwise(""), F.col("html"), F.lit("\n- (역참조) y (p:z) \n\nend  (p:z)"))
    return star.table(spark, sf_dir, "pages").select("page_id", T.compact(unit).alias("text"))


@query("""
WITH a AS (SELECT doc_id, quality, toxic, CASE doc_id % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'numeric' WHEN 2 THEN 'span' ELSE 'abstain' END AS kind FROM labels)
SELECT doc_id, CASE kind WHEN 'boolean' THEN quality = 1 WHEN 'numeric' THEN toxic = 0 WHEN 'span' THEN quality = 1 ELSE toxic = 0 END AS right_answer FROM a
""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star.table(spark, sf_dir, "labels")
    kind = F.element_at(F.array(*map(F.lit, ("boolean", "numeric", "span", "abstain"))), (F.col("doc_id") % 4 + 1).cast("int"))
    said = F.when(kind == "boolean", F.when(F.col("quality") == 1, "because\n정답: YES").otherwise("정답: 아니오")).when(kind == "numeric", F.when(F.col("toxic") == 0, "답: 1,250.50원").otherwise("답: 1,251원")).when(kind == "span", F.when(F.col("quality") == 1, "정답: '제 3 조'").otherwise("정답: 제4조")).otherwise(F.when(F.col("toxic") == 0, "공시에 없음: 확인할 수 없습니다").otherwise("정답: 3"))
    gold = F.when(kind == "boolean", "YES").when(kind == "numeric", "1250.5").when(kind == "span", "제3조").otherwise("")
    return t.select("doc_id", C.answer_score(kind, said, gold).alias("right_answer"))


@query("""SELECT doc_id, (doc_id % 3 = 0) AS right_choice FROM labels""")
def choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("(B) it is", "answer: c", "?"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return star.table(spark, sf_dir, "labels").select("doc_id", C.choice_score(said, F.lit(1)).alias("right_choice"))


# -- rules -------------------------------------------------------------------------------------------------------------


def _rule_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    age = F.when(k % 3 == 0, F.concat(F.lit("만 "), (F.col("p_size") + 10).cast("string"), F.lit("세 이상 개인")))
    way = F.when(k % 2 == 0, F.lit("스마트폰, 영업점,기타"))
    note = F.when(k % 5 == 0, F.concat(F.lit("최저 "), F.col("p_size").cast("string"), F.lit("만원 이상")))
    return star.table(spark, sf_dir, "part").select(F.concat(F.lit("주식회사 "), F.col("p_brand"), F.lit("은행")).alias("bank"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), age.alias("join_member"), way.alias("join_way"), note.alias("etc_note"), k.alias("k"), "p_size")


@query("""
SELECT '주식회사 ' || p_brand || '은행' AS bank, p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 10 END::DOUBLE AS age,
  CASE WHEN p_partkey % 2 = 0 THEN '영업점,스마트폰' END AS channels, CASE WHEN p_partkey % 5 = 0 THEN p_size * 10000 END::DOUBLE AS amount FROM part
""")
def rules_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.extract(_rule_products(spark, sf_dir))
    of = lambda attr: F.get(F.filter("conditions", lambda c: c["attr"] == attr), F.lit(0))
    return r.select("bank", "name", of("age")["number"].alias("age"), F.array_join(of("channel")["options"], ",").alias("channels"), of("amount")["number"].alias("amount"))


@query("""
WITH a AS (SELECT p_partkey AS id, p_size, p_partkey % 3 = 0 AS has_age, p_partkey % 2 = 0 AS has_way, p_partkey % 5 = 0 AS has_amount, p_partkey % 7 = 0 AS no_facts, p_partkey % 11 = 0 AS unknown_age FROM part)
SELECT id, CASE WHEN NOT (has_age OR has_way OR has_amount) THEN 'NOT_APPLICABLE' WHEN no_facts THEN 'UNKNOWN'
  WHEN (has_age AND NOT unknown_age AND 30 < p_size + 10) OR (has_way AND id % 4 = 0) THEN 'DENIED' WHEN has_age AND unknown_age THEN 'UNKNOWN' ELSE 'CONFIRMED' END AS verdict,
  CASE WHEN (has_age OR has_way OR has_amount) AND no_facts THEN has_age::INT + has_way::INT + has_amount::INT
       WHEN has_age AND unknown_age AND NOT (has_way AND id % 4 = 0) THEN 1 + has_amount::INT ELSE 0 END AS missing FROM a
""")
def rules_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on facts of which some are missing or asked for without being known."""
    p = _rule_products(spark, sf_dir)
    facts = F.create_map(F.lit("age"), F.when(F.col("k") % 11 == 0, None).otherwise("30"), F.lit("channel"), F.when(F.col("k") % 4 == 0, F.lit("인터넷")).otherwise("스마트폰"))
    none = F.expr("map_from_arrays(array(), array())").cast("map<string,string>")
    asked = p.select(F.col("k").alias("id"), F.substring("bank", 6, 100).alias("bank"), F.col("name").alias("product"), F.when(F.col("k") % 7 == 0, none).otherwise(facts).alias("facts"))
    return rules.judge(rules.extract(p), asked).select("id", "verdict", F.size("missing_slots").alias("missing"))


@query("""
WITH r AS (SELECT l_partkey, CAST([6, 12, 24, 36][l_linenumber % 4 + 1] AS INTEGER) AS months, max(CAST(l_discount AS DECIMAL(10,2)) * 100) AS rate FROM lineitem GROUP BY ALL)
SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'NOT_APPLICABLE' WHEN rate IS NULL THEN 'UNKNOWN' WHEN rate >= 8 THEN 'CONFIRMED' ELSE 'DENIED' END AS verdict FROM part LEFT JOIN r ON l_partkey = p_partkey AND months = 12
""")
def rate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rule_products(spark, sf_dir)
    months = F.element_at(F.array(*map(F.lit, (6, 12, 24, 36))), F.col("l_linenumber") % 4 + 1)
    offers = star.table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("k")).select("bank", "name", months.alias("months"), (F.col("l_discount").cast("decimal(10,2)") * 100).alias("rate"))
    asked = p.select(F.col("k").alias("id"), F.when(F.col("k") % 9 == 0, F.lit("다른 곳")).otherwise(F.col("bank")).alias("bank"), F.col("name").alias("product"), F.lit(12).alias("months"), F.lit(8).cast("decimal(10,2)").alias("claimed"))
    return rules.judge_rates(rules.extract(p), rules.top_rates(offers), asked).select("id", "verdict")


# -- records and questions ---------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Disclosure records: a product for each part, options from its offers, one for each term."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, records.KINDS)), (k % 5 + 1).cast("int"))
    p = star.table(spark, sf_dir, "part").select(
        kind.alias("kind"), k.cast("int").alias("pos"), F.regexp_replace("p_brand", "Brand#", "00").alias("fin_co_no"), F.concat("p_brand", F.lit("은행")).alias("kor_co_nm"), F.concat(F.lit("C"), F.lpad(k.cast("string"), 8, "0")).alias("fin_prdt_cd"), F.concat(F.lit(" "), F.col("p_name"), F.lit("  "), k.cast("string")).alias("fin_prdt_nm"),
        F.lit("202601").alias("dcls_month"), F.when(k % 2 == 0, F.lit("스마트폰, 영업점")).alias("join_way"), F.when(k % 3 == 0, F.concat(F.lit("만 "), (F.col("p_size") % 40 + 10).cast("string"), F.lit("세 이상"))).alias("join_member"), F.when(k % 4 == 0, F.lit("급여 이체")).alias("spcl_cnd"), (k % 4).cast("string").alias("join_deny"), F.lit(None).cast("string").alias("etc_note"), F.when(k % 7 == 0, (F.col("p_size") * 1000000).cast("string")).alias("max_limit"), F.lit(None).cast("string").alias("loan_lmt"), F.when(k % 5 == 4, F.when(k % 2 == 0, F.lit("2")).otherwise("1")).alias("crdt_prdt_type"), F.when(k % 5 == 4, F.when(k % 2 == 0, F.lit("마이너스한도대출")).otherwise("일반신용대출")).alias("crdt_prdt_type_nm"),
    )
    term = F.element_at(F.array(*map(F.lit, ("6", "12", "24", "36"))), F.col("l_linenumber") % 4 + 1)
    offers = star.table(spark, sf_dir, "lineitem")
    o = offers.groupBy(F.col("l_partkey").alias("pk"), term.alias("save_trm")).agg(F.min(F.col("l_tax").cast("decimal(20,6)") * 100).cast("decimal(20,6)").alias("intr_rate"), (F.max(F.col("l_tax") + F.col("l_discount") / 100).cast("decimal(20,6)") * 100).cast("decimal(20,6)").alias("intr_rate2"))
    kind = F.element_at(F.array(*map(F.lit, records.KINDS)), (F.col("pk") % 5 + 1).cast("int"))
    o = spread(o, offers.count(), "pk").join(star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.regexp_replace("p_brand", "Brand#", "00").alias("fin_co_no")), "pk")
    none = F.lit(None).cast("string")
    o = o.select(kind.alias("kind"), (F.col("pk") * 4 + F.array_position(F.array(*map(F.lit, ("6", "12", "24", "36"))), F.col("save_trm"))).cast("int").alias("pos"), "fin_co_no", F.concat(F.lit("C"), F.lpad(F.col("pk").cast("string"), 8, "0")).alias("fin_prdt_cd"), "save_trm", "intr_rate", "intr_rate2", F.when(F.col("pk") % 10 < 8, F.lit("단리")).otherwise("복리").alias("intr_rate_type_nm"), none.alias("rsrv_type_nm"), F.when(F.col("pk") % 5 == 2, F.lit("아파트")).alias("mrtg_type_nm"), F.when(F.col("save_trm").isin("6", "12"), F.lit("고정금리")).otherwise("변동금리").alias("lend_rate_type_nm"), none.alias("rpay_type_nm"), F.col("intr_rate").alias("lend_rate_min"), F.col("intr_rate2").alias("lend_rate_max"), F.col("intr_rate").alias("lend_rate_avg"), F.when(kind == "credit", F.when(F.col("save_trm") == "6", F.lit("A")).otherwise("B")).alias("crdt_lend_rate_type"), F.when(kind == "credit", F.col("intr_rate2")).alias("crdt_grad_avg"))
    return p, o


_REC = """
p AS (SELECT p_partkey AS k, ['deposit', 'saving', 'mortgage', 'rent', 'credit'][p_partkey % 5 + 1] AS kind, p_brand || '은행' AS bank, 'C' || lpad(p_partkey::VARCHAR, 8, '0') AS code, p_name || ' ' || p_partkey AS name, p_size, p_partkey % 2 = 0 AS ways FROM part),
o AS (SELECT l_partkey AS k, ['6', '12', '24', '36'][l_linenumber % 4 + 1] AS term, min(CAST(l_tax AS DECIMAL(20,6)) * 100) AS r, CAST(CAST(max(l_tax + l_discount / 100) AS DECIMAL(20,6)) * 100 AS DECIMAL(20,6)) AS r2 FROM lineitem GROUP BY ALL)
"""


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return workload.load(*_records(spark, sf_dir))


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select("kind", F.to_json("parts").alias("parts"), "answer")


@query(f"""WITH {_REC} SELECT kind, bank, code, answer FROM (SELECT kind, bank, code, format('{{:g}}', r::DOUBLE) AS answer FROM p JOIN o USING (k) WHERE kind = 'deposit' AND term = '12' AND r <> 0)""")
def base_rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.rates(_loaded(spark, sf_dir)[1])["base_rate_lookup"]
    key = F.from_json("ord", "array<string>")
    return rows.select("kind", key[1].alias("bank"), key[2].alias("code"), "answer")


@query(f"""
WITH {_REC}, f AS (SELECT p.*, o.*, row_number() OVER (PARTITION BY p.k ORDER BY (term = '12') DESC, r, r2, term) AS n FROM p JOIN o USING (k) WHERE kind IN ('deposit', 'saving'))
SELECT kind, bank, code, probe.at::VARCHAR AS probe, probe.says AS answer FROM (SELECT *, unnest([{{'at': CAST(r2 - 0.2 AS DECIMAL(10,2)), 'says': 'YES', 'x': r2 - 0.2}}, {{'at': CAST(r2 + 0.2 AS DECIMAL(10,2)), 'says': 'NO', 'x': r2 + 0.2}}]) AS probe FROM f WHERE n = 1 AND r2 <> 0) WHERE probe.x > 0
""")
def rate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.rates(_loaded(spark, sf_dir)[1])["rate_threshold"]
    key = F.from_json("ord", "array<string>")
    return rows.select("kind", key[1].alias("bank"), key[2].alias("code"), F.get("parts", F.lit(2)).alias("probe"), "answer")


@query(f"""WITH {_REC} SELECT kind, bank, code, x.c AS channel, x.says AS answer FROM (SELECT *, unnest(CASE WHEN ways THEN [{{'c': '영업점', 'says': 'YES'}}, {{'c': '인터넷', 'says': 'NO'}}] ELSE [{{'c': '영업점', 'says': 'NO'}}] END) AS x FROM p)""")
def join_way_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.conditions(_loaded(spark, sf_dir)[0])["join_way"]
    key = F.from_json("ord", "array<string>")
    return rows.select("kind", key[1].alias("bank"), key[2].alias("code"), F.get("parts", F.lit(1)).alias("channel"), "answer")


@query(f"""
WITH {_REC}, t AS (SELECT kind, bank, code, name, r2 FROM p JOIN o USING (k) WHERE kind IN ('deposit', 'saving') AND term = '12' AND r2 <> 0),
l AS (SELECT *, lead(name) OVER w AS name2, lead(r2) OVER w AS s2 FROM t WINDOW w AS (PARTITION BY bank, kind ORDER BY code, name))
SELECT kind, bank, name AS first, name2 AS second, CASE WHEN r2 > s2 THEN name ELSE name2 END AS answer FROM l WHERE s2 IS NOT NULL AND r2 <> s2
""")
def compare_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.aggregates(*_loaded(spark, sf_dir))["compare_two_products"]
    part = lambda i: F.get("parts", F.lit(i))
    return rows.select("kind", part(0).alias("bank"), part(1).alias("first"), part(2).alias("second"), "answer")


@query(f"""WITH {_REC} SELECT kind, bank, count(*)::VARCHAR AS answer, string_agg(name, '; ' ORDER BY name) AS text FROM p WHERE kind <> 'credit' GROUP BY ALL HAVING count(*) >= 2""")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.aggregates(*_loaded(spark, sf_dir))["agg_count"]
    return rows.select("kind", F.get("parts", F.lit(0)).alias("bank"), "answer", "text")


@query(f"""WITH {_REC}, t AS (SELECT kind, name, rank() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'deposit' THEN r2 + k::DECIMAL(20,6) ELSE r2 END DESC) AS n FROM p JOIN o USING (k) WHERE kind IN ('deposit', 'saving') AND term = '12' AND r2 <> 0) SELECT kind, min(name) AS answer FROM t WHERE n = 1 GROUP BY kind HAVING count(*) = 1""")
def superlative_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits, told apart by their codes, have a highest rate of their own; savings have ties and so no answer."""
    p, o = _loaded(spark, sf_dir)
    own = F.when(F.col("kind") == "deposit", F.regexp_extract("code", r"([0-9]+)$", 1).cast("decimal(20,6)")).otherwise(0)
    return workload.aggregates(p, o.withColumn("intr_rate2", F.col("intr_rate2") + own))["agg_superlative"].select("kind", "answer")


@query(f"""WITH {_REC} SELECT kind, bank || '-' || (k // 10) % 10 AS bank, string_agg(name, ', ' ORDER BY name) AS answer FROM p WHERE kind IN ('deposit', 'saving') GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5""")
def enumerate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of a bank with two to five products of a kind."""
    p, o = _loaded(spark, sf_dir)
    rows = workload.aggregates(p.withColumn("bank", F.concat("bank", F.lit("-"), F.substring("code", 8, 1))), o)["enumerate_products"]
    return rows.select("kind", F.get("parts", F.lit(0)).alias("bank"), "answer")


def _by_key(rows: DataFrame, *more: Column) -> DataFrame:
    key = F.from_json("ord", "array<string>")
    return rows.select("kind", key[1].alias("bank"), key[2].alias("code"), *more, "answer")


@query(f"""
WITH {_REC}, f AS (SELECT p.*, o.*, row_number() OVER (PARTITION BY p.k ORDER BY (term = '12') DESC, r, r2, term) AS n FROM p JOIN o USING (k) WHERE kind = 'saving')
SELECT kind, bank, code, term, format('{{:g}}', r2::DOUBLE) AS answer FROM f WHERE n = 1 AND r2 <> 0
""")
def max_rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(workload.rates(_loaded(spark, sf_dir)[1])["max_rate_lookup"], F.get("parts", F.lit(1)).alias("term"))


@query(f"""
WITH {_REC}, a AS (SELECT *, p_size % 40 + 10 AS age FROM p WHERE k % 3 = 0)
SELECT kind, bank, code, x.v::VARCHAR AS age, x.says AS answer FROM (SELECT *, unnest([{{'v': age + 3, 'says': 'YES'}}, {{'v': age - 3, 'says': 'NO'}}]) AS x FROM a) WHERE x.v > 0
""")
def age_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(workload.conditions(_loaded(spark, sf_dir)[0])["age_condition"], F.get("parts", F.lit(1)).alias("age"))


@query(f"""WITH {_REC} SELECT DISTINCT kind, bank, code, CASE WHEN k % 10 < 8 THEN '단리' ELSE '복리' END AS answer FROM p JOIN o USING (k) WHERE kind IN ('deposit', 'saving')""")
def interest_calc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(workload.option_facts(_loaded(spark, sf_dir)[1])["interest_calc_type"])


@query(f"""
WITH {_REC}, t AS (SELECT kind, bank, code, bool_or(term IN ('6', '12')) AS fix, bool_or(term NOT IN ('6', '12')) AS free FROM p JOIN o USING (k) WHERE kind IN ('mortgage', 'rent') GROUP BY ALL)
SELECT kind, bank, code, CASE WHEN fix THEN '고정금리' ELSE '변동금리' END AS type, 'YES' AS answer FROM t
UNION ALL SELECT kind, bank, code, CASE WHEN fix THEN '변동금리' ELSE '고정금리' END, 'NO' FROM t WHERE NOT (fix AND free)
""")
def loan_rate_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(workload.option_facts(_loaded(spark, sf_dir)[1])["loan_rate_type"], F.get("parts", F.lit(1)).alias("type"))


@query(f"""WITH {_REC} SELECT kind, bank, code, format('{{:g}}', r2::DOUBLE) AS answer FROM p JOIN o USING (k) WHERE kind = 'credit' AND term = '6' AND r2 <> 0""")
def credit_avg_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(workload.option_facts(_loaded(spark, sf_dir)[1])["credit_avg_rate"])


@query(f"""WITH {_REC} SELECT kind, bank, code, format('{{:,}}', p_size * 1000000) || '원' AS answer FROM p WHERE k % 7 = 0""")
def max_limit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(workload.conditions(_loaded(spark, sf_dir)[0])["max_limit_lookup"])


@query(f"""WITH {_REC} SELECT kind, bank, code, CASE WHEN k % 7 <> 0 THEN '최고 한도' ELSE '우대금리 조건' END AS field, '공시에 해당 정보 없음' AS answer FROM p WHERE k % 7 <> 0 OR k % 4 <> 0""")
def abstain_missing_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(workload.conditions(_loaded(spark, sf_dir)[0])["abstain_missing_field"], F.get("parts", F.lit(1)).alias("field"))


@query("""SELECT p_partkey, CAST(round(CAST(10000000 AS DECIMAL(20,0)) * CAST(p_size AS DECIMAL(10,2)) / 7 * 3 / 100, 0) AS BIGINT) * 0 + CAST(round(100000 * CAST(p_size AS DECIMAL(12,2)) + 0, 0) AS BIGINT) AS interest, CAST(round(CAST(p_size AS DECIMAL(12,2)) * 100000 * 0.846, 0) AS BIGINT) AS after_tax FROM part""")
def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ten = F.lit(10_000_000)
    return star.table(spark, sf_dir, "part").select("p_partkey", workload.rounded(workload.pretax(ten, F.col("p_size"))).cast("long").alias("interest"), workload.after_tax(ten, F.col("p_size")).cast("long").alias("after_tax"))


@query(f"""
WITH {_REC}, d AS (SELECT bank, code, name, r FROM p JOIN o USING (k) WHERE kind = 'deposit' AND term = '12' AND r <> 0 AND k % 10 < 8),
l AS (SELECT *, lead(r) OVER w AS s, lead(code) OVER w AS code2 FROM d WINDOW w AS (ORDER BY bank, code, name))
SELECT bank, code, code2, CAST(abs(round(r * 100000, 0) - round(s * 100000, 0)) AS BIGINT)::VARCHAR AS answer FROM l WHERE s <> r
""")
def interest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.calculations(_loaded(spark, sf_dir)[1])["calc_interest_diff"]
    key = F.from_json("ord", "array<string>")
    return rows.select(key[1].alias("bank"), key[2].alias("code"), F.regexp_extract("locator", r",[^:]*:([^:]*):", 1).alias("code2"), "answer")


@query(f"""
WITH {_REC}, l AS (SELECT p.k, kind, bank, code, CASE WHEN kind = 'mortgage' THEN '아파트' ELSE '' END AS m, CASE WHEN term IN ('6', '12') THEN '고정금리' ELSE '변동금리' END AS t, r, r2, term FROM p JOIN o USING (k) WHERE kind IN ('mortgage', 'rent') AND r <> 0)
SELECT kind, bank, code, m, t, format('{{:g}}', min_by(r, (r, r2, term))::DOUBLE) AS answer FROM l GROUP BY ALL
""")
def loan_least_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.option_facts(_loaded(spark, sf_dir)[1])["loan_min_rate"]
    key = F.from_json("ord", "array<string>")
    return rows.select("kind", key[1].alias("bank"), key[2].alias("code"), F.get("parts", F.lit(1)).alias("m"), F.get("parts", F.lit(2)).alias("t"), "answer")


@query("""SELECT p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= greatest(1, 100 // (SELECT count(DISTINCT p_type) FROM part))""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each stratum: a sampling operator."""
    return workload.stratified(star.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 100)


@query("""
WITH t AS (SELECT o_orderstatus AS template, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')),
k AS (SELECT *, CASE template WHEN 'F' THEN CASE WHEN n <= 30 THEN (0, 0) END WHEN 'O' THEN CASE WHEN n <= 50 THEN (0, 1) ELSE (1, 0) END ELSE CASE WHEN n <= 10 THEN (0, 2) ELSE (1, 1) END END AS part FROM t)
SELECT template, o_orderkey, CAST(row_number() OVER (ORDER BY part, n) AS INTEGER) AS seq FROM k WHERE part IS NOT NULL QUALIFY seq <= 200
""")
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas by template and overflow to an exact total: a selection operator."""
    rows = star.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("template"), "o_orderkey", F.col("o_orderkey").alias("ord"))
    return workload.take_quota(rows, {"F": 30, "O": 50, "P": 10}, ["O", "P"], 200).select("template", "o_orderkey", "seq")


@query()
def variant_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wording for each part by a CRC-32, which DuckDB doesn't have, and particles after its name."""
    return star.table(spark, sf_dir, "part").select("p_partkey", T.variant([F.lit("seed"), F.col("p_partkey")], 4).alias("variant"), workload.with_particle(F.lit("금리"), "subject").alias("word"))


@query("""SELECT n_nationkey, ['을', '를', '을(를)'][n_nationkey % 3 + 1] AS object, ['이', '가', '이(가)'][n_nationkey % 3 + 1] AS subject, ['과', '와', '과(와)'][n_nationkey % 3 + 1] AS together FROM nation""")
def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("적금", "금리", "LTV"))), F.col("n_nationkey") % 3 + 1)
    return star.table(spark, sf_dir, "nation").select("n_nationkey", T.particle(word, "object").alias("object"), T.particle(word, "subject").alias("subject"), T.particle(word, "with").alias("together"))


@query("""SELECT o_orderkey, format('{:g}', (CAST(floor(o_totalprice)::BIGINT % 1000000 AS DECIMAL(18,2)) / 100)::DOUBLE) AS g FROM orders""")
def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "orders").select("o_orderkey", T.short_number(F.pmod(F.floor("o_totalprice"), F.lit(1000000)).cast("decimal(18,2)") / 100).alias("g"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n FROM orders GROUP BY ALL""")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "orders").select(T.iso_date(F.date_format("o_orderdate", "yyyyMMdd")).cast("string").alias("d")).groupBy("d").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS triples, count(DISTINCT p_brand) AS banks, (SELECT count(*) FROM part) AS products FROM part""".replace("count(*) AS triples, ", ""))
def disclosure_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosures as triples, read back by a graph query."""
    triples = etl.disclosures_to_triples(*_records(spark, sf_dir), {"market": P, "data": DATA, "products": CLS, "parties": CLS})
    return triples.agg(F.count_if((F.col("p") == X.TYPE) & (F.col("o") == CLS + "Bank")).alias("banks"), F.count_if(F.col("p") == CLS + "hasProductName").alias("products"))


@query("""SELECT CASE WHEN p_partkey % 5 = 4 AND p_partkey % 2 = 0 THEN 'OverdraftProduct' ELSE ['TimeDepositProduct', 'InstallmentSavingsProduct', 'MortgageLoanProduct', 'JeonseLoanProduct', 'CreditLoanProduct'][p_partkey % 5 + 1] END AS cls, count(*) AS n FROM part GROUP BY ALL""")
def disclosure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = etl.disclosures_to_triples(*_records(spark, sf_dir), {"market": P, "data": DATA, "products": CLS, "parties": CLS + "x/"})
    return triples.where((F.col("p") == X.TYPE) & F.col("s").startswith(DATA + "prdt_") & ~F.col("s").contains("_opt")).groupBy(F.regexp_extract("o", r"([^/]*)$", 1).alias("cls")).agg(F.count("*").alias("n"))


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes: one for each region, an article for each of its nations."""
    n = star.table(spark, sf_dir, "nation").join(star.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    title = F.when(k % 4 == 0, "정의").when(k % 4 == 1, "벌칙").otherwise(F.concat(F.lit("제목 "), "n_name"))
    body = F.when(k % 4 == 0, F.concat(F.lit('"용어'), k.cast("string"), F.lit('"이란 이 법에서 정하는 바에 따라 금융회사가 고객에게 제공하는 모든 종류의 상품을 말한다.'))).when(k % 4 == 1, F.concat(F.lit("3년 이하의 징역 또는 1억원 이하의 벌금에 처한다. "), (k + 4).cast("string"), F.lit("년 이하의 징역, 5천만원 이하의 과태료"))).otherwise(F.lit("본문"))
    body = F.regexp_replace(body, "5천만원", "5억원")
    article = F.struct(F.concat(F.lit("제"), k.cast("string"), F.lit("조")).alias("label"), title.alias("title"), body.alias("text"), F.lit("").alias("effective"))
    rows = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), article.alias("a")))).alias("x"))
    return rows.select(F.col("r_name").alias("name"), F.concat(F.lit("law"), F.col("r_regionkey").cast("string")).alias("slug"), F.lit("공통").alias("category"), F.lit("법률").alias("law_type"), F.lit("20240102").alias("effective_date"), F.lit("금융위원회").alias("ministry"), F.transform("x", lambda e: e["a"]).alias("articles"))


@query("""SELECT r_name AS law, '제' || n_nationkey || '조' AS label, '5억원' AS fine, CAST(n_nationkey + 4 AS VARCHAR) AS years FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 1""")
def penalty_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.regulations(_laws(spark, sf_dir))["penalty_amount"]
    part = lambda i: F.get("parts", F.lit(i))
    return rows.groupBy(part(0).alias("law"), part(1).alias("label")).agg(F.max(F.when(part(2) == "벌금", F.col("answer"))).alias("fine"), F.max(F.when(part(2) == "징역", F.col("answer"))).alias("years"))


@query("""SELECT r_name AS law, '용어' || n_nationkey AS answer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0""")
def definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.regulations(_laws(spark, sf_dir))["definition_term"].select(F.get("parts", F.lit(0)).alias("law"), "answer")


@query("""SELECT count(*) AS articles, (SELECT count(*) FROM region) AS statutes FROM nation""")
def statute_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = etl.statutes_to_triples(_laws(spark, sf_dir), {"regs": P, "data": DATA})
    return triples.agg(F.count_if(F.col("p") == P + "hasArticle").alias("articles"), F.count_if((F.col("p") == X.TYPE) & (F.col("o") == P + "Statute")).alias("statutes"))


@query("""SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM orders UNION ALL SELECT 'qtype', o_orderstatus, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'category', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'template', 't', count(*) FROM orders UNION ALL SELECT 'answer_type', 'span', count(*) FROM orders""")
def statistics_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("qtype"), F.col("o_orderpriority").alias("category"), F.lit("t").alias("template"), F.lit("span").alias("answer_type"))
    return records.statistics_sheet(q)


@query("""SELECT * FROM (VALUES ('rows', TRUE), ('unique_ids', TRUE), ('unique_questions', FALSE), ('balanced', TRUE), ('answer_types', TRUE), ('category_sizes', TRUE)) AS t(check_name, passed)""")
def question_set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star.table(spark, sf_dir, "supplier")
    q = s.select(F.col("s_suppkey").alias("id"), F.lit("x").alias("category"), F.lit("boolean").alias("answer_type"), F.when(F.col("s_suppkey") % 2 == 0, "YES").otherwise("NO").alias("answer"), F.lit("same").alias("question"))
    return quality.question_set(q, q.count(), 1)


@query("""SELECT r_name AS law, '제목 ' || n_name AS title, '제' || n_nationkey || '조' AS answer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 > 1""")
def article_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.regulations(_laws(spark, sf_dir))["article_locate"]
    return rows.select(F.get("parts", F.lit(0)).alias("law"), F.get("parts", F.lit(1)).alias("title"), "answer")


@query("""SELECT r_name AS law, what, v AS answer FROM region, (VALUES ('시행일자', '2024-01-02'), ('소관부처', '금융위원회')) AS t(what, v)""")
def law_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.regulations(_laws(spark, sf_dir))["law_meta"]
    return rows.select(F.get("parts", F.lit(0)).alias("law"), F.get("parts", F.lit(1)).alias("what"), "answer")


def _asked(p: DataFrame) -> DataFrame:
    """A question made elsewhere for each product."""
    k = F.col("pos")
    own = F.concat(F.lit("x:"), F.col("kor_co_nm"), F.lit(":"), F.col("fin_prdt_cd"))
    other = F.element_at(F.array(F.lit("x:law:a:1"), F.lit("amend:a:b:c"), F.lit("x:가저축은행:c:1"), own, F.lit("x:없는은행:c:1")), k % 11 + 1)
    doc = F.when(k % 11 < 5, other).otherwise(F.concat(own, F.lit(":202601")))
    return p.select(
        k.cast("string").alias("qid"), F.lit("Q1").alias("group"), F.when(k % 2 == 0, "이 상품은 상속되는가?").otherwise("상속 가능한가?").alias("question"),
        F.array(doc).alias("doc_ids"), F.when(k % 5 == 0, "ABSTAIN").otherwise("YES").alias("gold_verdict"), F.when(k % 3 == 0, "'급여 이체' 와 '제한없음'").otherwise("'서민전용'").alias("gold_basis"),
    )


@query("""
WITH p AS (SELECT p_partkey AS k, p_brand || '은행' AS bank, 'C' || lpad(p_partkey::VARCHAR, 8, '0') AS code, p_name || ' ' || p_partkey AS name, p_partkey % 5 = 0 AS abstains FROM part WHERE p_partkey % 11 >= 3),
q AS (SELECT *, CASE WHEN k % 3 = 0 THEN ['급여 이체', '제한없음'] ELSE ['서민전용'] END AS said, ['급여 이체', '제한없음', '서민전용', ''][k % 4 + 1] AS there FROM p),
d AS (SELECT *, list_filter(said, lambda x: x = there) AS decisive FROM q),
r AS (SELECT *, CASE WHEN k % 11 = 3 THEN 'doc_id' WHEN k % 11 = 4 THEN 'no_product' WHEN abstains AND k % 10 = 0 THEN 'not_absent' WHEN NOT abstains AND len(decisive) = 0 THEN 'no_evidence' END AS reason FROM d)
SELECT k::VARCHAR AS id, reason,
CASE reason WHEN 'doc_id' THEN 'x:' || bank || ':' || code WHEN 'no_product' THEN '없는은행|c' WHEN 'not_absent' THEN '상속' WHEN 'no_evidence' THEN array_to_string(said, '|') END AS detail,
CASE WHEN reason IS NULL THEN CASE WHEN k % 2 = 0 THEN bank || ' \'\'' || name || '\'\'은 상속되는가?' ELSE bank || ' \'\'' || name || '\'\' 상품에 대해: 상속 가능한가?' END END AS question,
CASE WHEN reason IS NULL THEN CASE WHEN abstains THEN '' ELSE array_to_string([name] || decisive, '|') END END AS gold
FROM r
""".replace("\\'", "'"))
def carried_over_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions hold for what is disclosed, and why others don't."""
    p = _records(spark, sf_dir)[0].withColumn("etc_note", F.when(F.col("pos") % 10 == 0, "상속 시 해지"))
    made = imports.carried_over(imports.about_banks(_asked(p)), p)
    return made.select("id", "reason", F.array_join("detail", "|").alias("detail"), "question", F.array_join("gold", "|").alias("gold"))


@query("""
SELECT ['공통', '외환', '예금', '퇴직연금', '공통'][o_orderkey % 5 + 1] AS kind, ['은행법 개정', '외국환거래법', '예금자보호와 은행', '퇴직연금 규정', '그 밖'][o_orderkey % 5 + 1] || ' ' || o_orderkey AS question,
CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS answer, 'amend:' || o_orderkey AS locator, 200 AS chars FROM orders WHERE o_orderstatus = 'F'
""")
def temporal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    subject = F.element_at(F.array(*map(F.lit, ("은행법 개정", "외국환거래법", "예금자보호와 은행", "퇴직연금 규정", "그 밖"))), (k % 5 + 1).cast("int"))
    asked = star.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("qid"), F.when(F.col("o_orderstatus") == "F", "Q2_시간").otherwise("Q1").alias("group"), F.concat(subject, F.lit(" "), k.cast("string")).alias("question"),
        F.array(F.concat(F.lit("amend:"), k.cast("string"))).alias("doc_ids"), F.when(k % 2 == 0, "YES").otherwise("NO").alias("gold_verdict"), F.repeat(F.lit("근거"), F.lit(150)).alias("gold_basis"),
    )
    return workload.word(imports.temporal_validity(asked)).select("kind", "question", "answer", "locator", F.length("text").alias("chars"))


@query("""
SELECT CAST(row_number() OVER (ORDER BY hits / total, l_orderkey) AS INTEGER) AS place, l_orderkey, hits, total FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM lineitem GROUP BY ALL) QUALIFY place <= 10
""")
def worst_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten orders with the least share of lines sent back: a report of ten rows."""
    lines = star.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count("*").alias("total"))
    return reports.worst(lines, "hits", "total", "l_orderkey").select("place", "l_orderkey", "hits", "total")


@query("""SELECT o_custkey, string_agg('o_orderkey: ' || o_orderkey || ' | o_orderstatus: ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey""")
def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.render_rows(star.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey", "o_orderstatus")


@query("""
SELECT 'data:customer_' || c_custkey AS s, c_name AS o FROM customer UNION ALL SELECT 'data:supplier_' || s_suppkey, s_name FROM supplier
""")
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples through the sink and back, those of one predicate."""
    path = scratch(spark)
    turtle.write_ntriples(star.entity_triples(spark, sf_dir, "customer", "supplier"), path)
    return ntriples.read_ntriples(spark, path, predicates=[P + "hasName"]).select(X.qname(F.col("s"), VOC.known()).alias("s"), "o")
