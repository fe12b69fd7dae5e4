import pytest

from loomgraph import terms as X
from loomgraph.kb import KnowledgeBase
from loomgraph.sources.turtle import TurtleError, TurtleReader, prefixes, read_errors, read_turtle, write_ntriples

DOC = '''@prefix : <urn:x/> . # comment with "quotes" and <brackets>
@prefix owl: <http://www.w3.org/2002/07/owl#> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
:A a owl:Class ; rdfs:label "가"@ko , "A \\"a\\""@en ; rdfs:subClassOf :B , [ a owl:Restriction ; owl:minCardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> ] .
:B a owl:Class ; :n 1 , 1.50 , 2e3 , -4 ; :t true ; :long """two
lines""" ; :list ( :A "x" ) ; .
:x.y :p :A.
'''


def test_reader():
    rows = TurtleReader(DOC, "d").rows()
    s = {(r[0], r[2].rsplit("/", 1)[-1].rsplit("#", 1)[-1], r[3], r[5], r[6]) for r in rows}
    assert ("urn:x/A", "label", "가", None, "ko") in s and ("urn:x/A", "label", 'A "a"', None, "en") in s
    assert ("urn:x/B", "n", "1.50", X.XSD + "decimal", None) in s and ("urn:x/B", "n", "2e3", X.XSD + "double", None) in s and ("urn:x/B", "n", "-4", X.XSD + "integer", None) in s
    assert ("urn:x/B", "t", "true", X.XSD + "boolean", None) in s and ("urn:x/B", "long", "two\nlines", None, None) in s
    assert ("urn:x/x.y", "p", "urn:x/A", None, None) in s
    assert sum(r[1] == "bnode" for r in rows) == 2 + 4 and len(rows) == 20


@pytest.mark.parametrize("bad", ["x:a x:b x:c .", ":a", "@prefix a: <u> . a:b a:c 'x", "@prefix a: <u> . a:b a:c ; ; ]"])
def test_reader_says_what_is_wrong(bad):
    with pytest.raises(TurtleError):
        TurtleReader(bad, "d").rows()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ttl").write_text(DOC)
    (tmp_path / "in/b.ttl").write_text("@prefix : <urn:x/> . :x.y :p :A . :z :p \"it's\\n\" .")
    (tmp_path / "in/c.ttl").write_text(":broken")
    folder = str(tmp_path / "in")
    assert prefixes(spark, folder)["owl"] == X.OWL
    good = read_turtle(spark, folder, "PERMISSIVE")
    assert good.count() == 21 and [r["source_file"].endswith("c.ttl") for r in read_errors(spark, folder).collect()] == [True]
    write_ntriples(good, str(tmp_path / "out"))
    (tmp_path / "again").mkdir()
    (tmp_path / "again/x.ttl").write_text("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    again = read_turtle(spark, str(tmp_path / "again"))
    names = ["p", "o_kind", "o_dt", "o_lang"]
    assert sorted(map(str, again.select(names).collect())) == sorted(map(str, good.select(names).collect()))
    (tmp_path / "in/c.ttl").unlink()
    kb = KnowledgeBase.load(spark, folder, "urn:x/", ("rdfs:label",))
    assert kb.triples.count() == 21 and kb.resolve("가") == "urn:x/A" and kb.concept("가")["superclasses"] == ["<urn:x/B>"]
