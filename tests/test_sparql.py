import pytest

from loomgraph import terms as X
from loomgraph.plans.sparql import run
from loomgraph.plans.sparql_parser import SparqlError, split_queries

P = {"": "urn:x/"}


@pytest.fixture(scope="module")
def triples(spark):
    iri = lambda s, p, o: ("urn:x/" + s, "iri", p if ":" in p else "urn:x/" + p, "urn:x/" + o, "iri", None, None)
    lit = lambda s, p, o, dt=None, lang=None: ("urn:x/" + s, "iri", "urn:x/" + p, o, "literal", dt and X.XSD + dt, lang)
    rows = [iri("a", "knows", "b"), iri("b", "knows", "c"), iri("c", "knows", "a"), iri("d", "likes", "a"), lit("a", "age", "30", "integer"), lit("b", "age", "30.0", "decimal"), lit("c", "age", "old"), lit("a", "name", "Ann"), lit("b", "name", "Bob", None, "en"), lit("b", "name", "Bob"), lit("d", "born", "2001-05-06", "date")]
    return spark.createDataFrame(rows, X.TRIPLES).cache()


def ask(triples, text, **kw):
    return sorted(tuple(r) for r in run(triples, text, P, **kw).fillna("-").collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?o { :a :knows+ ?o }", [("a",), ("b",), ("c",)]),
        ("SELECT ?o { :zz :knows* ?o }", [("zz",)]),
        ("SELECT ?o { :d (:likes|^:likes)/:knows? ?o }", [("a",), ("b",)]),
        ("SELECT ?s { ?s :age 30 }", [("a",)]),
        ("SELECT ?s { ?s :age ?x FILTER(?x = 30) }", [("a",), ("b",)]),
        ("SELECT ?s { ?s :age ?x FILTER(?x < 31 || !BOUND(?x)) }", [("a",), ("b",)]),
        ("SELECT ?s ?n { ?s :knows ?x OPTIONAL { ?s :name ?n FILTER(LANG(?n) = 'en') } }", [("a", "-"), ("b", "Bob"), ("c", "-")]),
        ("SELECT ?n (COUNT(*) AS ?c) { ?s :name ?n } GROUP BY ?n HAVING(COUNT(*) = 1) ORDER BY ?n", [("Ann", "1"), ("Bob", "1"), ("Bob", "1")]),
        ("SELECT (SUM(?x) AS ?t) (AVG(?x) AS ?m) { ?s :age ?x FILTER(isNumeric(?x)) }", [("60", "30")]),
        ("SELECT ?s { ?s ?p ?o MINUS { ?s :age ?x } } ", [("d",), ("d",)]),
        ("SELECT DISTINCT ?s { ?s ?p ?o FILTER NOT EXISTS { ?s :age ?x } }", [("d",)]),
        ("SELECT ?s ?y { ?s :born ?d BIND(YEAR(?d) + 1 AS ?y) }", [("d", "2002")]),
        ("SELECT ?s { VALUES (?s ?n) { (:a UNDEF) (:b 'Bob') } ?s :name ?n }", [("a",), ("b",)]),
        ("SELECT ?s { { SELECT ?s { ?s :age ?x } ORDER BY ?s LIMIT 2 } ?s :name ?n }", [("a",), ("b",), ("b",)]),
        ("SELECT ?s { ?s :name ?n . FILTER(REGEX(?n, '^b', 'i') && STRLEN(?n) IN (3, 4)) }", [("b",), ("b",)]),
        ("SELECT ?s { ?s !(:knows|:age|:name) ?o }", [("d",), ("d",)]),
        ("SELECT ?o { :a !(^:knows) ?o }", [("d",)]),
        ("ASK { :a :knows :b }", [(True,)]),
    ],
)
def test_queries(triples, text, want):
    got = ask(triples, text)
    assert [tuple(x.lstrip(":").removeprefix("<urn:x/").rstrip(">") if isinstance(x, str) else x for x in r) for r in got] == want


V = {"": "urn:v/"}


@pytest.fixture(scope="module")
def values(spark):
    iri = lambda s, p, o: ("urn:v/" + s, "iri", "urn:v/" + p, "urn:v/" + o, "iri", None, None)
    num = lambda s, p, o: ("urn:v/" + s, "iri", "urn:v/" + p, o, "literal", X.XSD + "integer", None)
    chain = [iri(f"n{i}", "next", f"n{i + 1}") for i in range(100)] + [iri("n100", "next", "n0")]
    rows = [num("a", "v", "1"), num("b", "v", "2"), num("c", "v", "3"), iri("a", "k", "b"), iri("b", "k", "c"), iri("b", "w", "c")]
    return spark.createDataFrame(rows + chain, X.TRIPLES).cache()


@pytest.mark.parametrize(
    ("text", "want", "product"),
    [
        ("SELECT ?s { ?s :v ?x FILTER NOT EXISTS { ?o :v ?y FILTER(?y > ?x) } }", "c", None),
        ("SELECT ?s { ?s :v ?x FILTER EXISTS { ?o :v ?y FILTER(?x < ?y) } }", "a b", None),
        ("SELECT ?s { ?s :v ?x FILTER EXISTS { ?s :k ?o . ?o :v ?y FILTER(?y = ?x + 1 && ?y < 3) } }", "a", False),
        ("SELECT ?s { ?s :v ?x FILTER(?x = 1 || EXISTS { ?s :w ?z }) }", "a b", False),
        ("SELECT ?s { ?s :v ?x FILTER(!(EXISTS { ?s :w ?z } && ?x > 1)) }", "a c", False),
        ("SELECT ?s { ?s :v ?x FILTER(EXISTS { :a :k :b } && ?x > 1) }", "b c", None),
        ("SELECT ?s { ?s :v ?x FILTER NOT EXISTS { ?s :k ?o FILTER NOT EXISTS { ?o :v ?y FILTER(?y > ?x + 1) } } }", "c", False),
        ("SELECT ?s { ?s :v ?x FILTER EXISTS { { ?s :k ?o FILTER(?x = 2) } UNION { ?s :w ?o } } }", "b", False),
        ("SELECT ?s { ?s :v ?x . { SELECT ?s WHERE { ?s :k ?o } } }", "a b", False),
        ("SELECT ?z { ?s :k ?o BIND(?o AS ?z) ?z :v ?x }", "b c", False),
        ("SELECT ?x { ?s :k ?o BIND(COALESCE(?u, ?o) AS ?z) ?z :v ?x }", "2 3", False),
        ("SELECT ?x { ?s :v ?w OPTIONAL { ?s :k ?y } ?y :v ?x }", "1 2 2 3 3", False),
        ("SELECT ?s { ?s :v ?w OPTIONAL { ?s :k ?y } OPTIONAL { ?y :v ?x } FILTER(?x > 1) }", "a b c c", False),
        ("SELECT ?s { ?s :v ?x OPTIONAL { ?s :k ?y } MINUS { ?y :v 3 } }", "a c", False),
        ("SELECT ?s { ?s :v ?x OPTIONAL { ?s :w ?y } FILTER EXISTS { ?y :v ?z } }", "a b c", None),
        ("SELECT ?s { ?s :v ?x OPTIONAL { ?s :w ?y } FILTER NOT EXISTS { ?y :v ?z } }", "", None),
        ("SELECT ?n { :a :k+ ?n }", "b c", False),
        ("SELECT ?n { ?n :k* :c }", "a b c", False),
        ("SELECT ?n { ?n (:k|:w)+/:k* :c }", "a a b", False),
        ("SELECT ?n { :c ^:k/^:k? ?n }", "a b", False),
        ("SELECT ?n { ?s :w ?q . ?s :k* ?n }", "b c", False),
        ("SELECT (COUNT(*) AS ?n) { :n3 :next+ ?m }", "101", None),
        ("SELECT (COUNT(*) AS ?n) { ?m :next* :n3 }", "101", None),
    ],
)
def test_joins_of_what_may_be_unbound(values, spark, text, want, product):
    """product: whether the plan may hold one; without broadcasts none is hidden."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = run(values, text, V)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r[0].lstrip(":") for r in df.collect()) == want.split()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert product is None or ("CartesianProduct" in plan or "NestedLoop" in plan) == product


def test_limit_order_offset(triples):
    df = run(triples, "SELECT ?s ?o { ?s :knows ?o } ORDER BY DESC(?s) OFFSET 1", P, limit=1, terms=True)
    assert [tuple(r) for r in df.collect()] == [("<urn:x/b>", "<urn:x/c>")]


@pytest.mark.parametrize("bad", ["SELECT ?s", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SELECT ?s { ?s no:p ?o }", "SELECT ?s { ?s :p ?o FILTER(FOO(?s)) }"])
def test_errors(triples, bad):
    with pytest.raises(SparqlError):
        run(triples, bad, P)


def test_splitting():
    text = "# Title\n# Q1. First\n# more\nSELECT ?a { ?a ?b ?c }\n\n# Q2. No query\nPREFIX x: <y>\n# 3. Third\nselect * { ?a ?b ?c }"
    assert [t for t, _ in split_queries(text)] == ["Q1. First", "3. Third"]
