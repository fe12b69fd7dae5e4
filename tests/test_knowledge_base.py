import json

import pytest
from pyspark.sql import functions as F

from loomgraph.kb import KnowledgeBase
from loomgraph.operators.retrieve import Scenarios, report
from loomgraph.sources import records
from loomgraph.tools import tools

TURTLE = """@prefix ex: <http://x.test/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .
ex:Thing a owl:Class ; rdfs:label "Thing"@en . ex:Account a owl:Class ; rdfs:subClassOf ex:Thing ; rdfs:label "Account"@en, "계좌"@ko ; rdfs:comment "A place for money"@en .
ex:Saving a owl:Class ; rdfs:subClassOf ex:Account ; rdfs:label "Saving"@en . ex:heldAt a owl:ObjectProperty ; rdfs:domain ex:Account ; rdfs:range ex:Bank . ex:Bank a owl:Class ; rdfs:label "Bank"@en .
ex:one a ex:Saving ; rdfs:label "First saving"@en ; ex:heldAt ex:kiwi . ex:two a ex:Account ; rdfs:label "Second account"@en ; ex:heldAt ex:kiwi ; ex:rate 3.5 . ex:kiwi a ex:Bank ; rdfs:label "Kiwi bank"@en .
"""


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("kb")
    (folder / "a.ttl").write_text(TURTLE, encoding="utf-8")
    return KnowledgeBase.load(spark, str(folder), "http://x.test/")


def test_tools_answer_in_json(kb):
    call = {k: (lambda *a, f=f, **kw: json.loads(f(*a, **kw))) for k, f in tools(kb).items()}
    assert set(call) >= {"search_concepts", "concept_details", "class_hierarchy", "class_instances", "describe_instance", "run_sparql"} and len(call) == 8
    assert [x["uri"] for x in call["search_concepts"]("account")][0] == "ex:Account"
    assert "definition" not in call["search_concepts"]("bank")[0]  # null fields are left out
    tree = call["class_hierarchy"]("Thing")
    assert tree["uri"] == "ex:Thing" and tree["subclasses"][0]["uri"] == "ex:Account" and tree["subclasses"][0]["subclasses"][0]["uri"] == "ex:Saving"
    assert "subclasses" not in call["class_hierarchy"]("Account", 1)["subclasses"][0]
    assert sorted(x["uri"] for x in call["class_instances"]("계좌")) == ["ex:one", "ex:two"]
    assert call["describe_instance"]("Kiwi bank")["uri"] == "ex:kiwi"
    assert "error" in call["concept_details"]("nothing of the sort") and "error" in call["run_sparql"]("SELECT WHERE {")
    rows = call["run_sparql"]("SELECT ?a WHERE { ?a ex:heldAt ex:kiwi ; ex:rate ?r . FILTER(?r > 3) }")
    assert len(rows) == 1 and "two" in json.dumps(rows)


def test_every_scenario_finds_its_evidence(kb, spark):
    asked = spark.createDataFrame([(1, "Where is First saving held?", ["First saving"]), (2, "What is the rate of Second account?", ["Second account", "3.5"]), (3, "zzz", ["nothing"])], "qid int, question string, gold array<string>")
    found = Scenarios(kb.triples, kb.vocabulary).evaluate(asked)
    rows = {r["scenario"]: r.asDict() for r in found.collect()}
    assert sorted(rows) == [f"S{i}" for i in range(1, 10)]
    for r in rows.values():
        assert all(0 <= v <= 1 for k, v in r.items() if k.startswith(("hit", "mrr", "recall")))
    assert all(rows[s]["recall_inf"] == pytest.approx(2 / 3) for s in ("S2", "S5", "S6", "S7"))
    assert report(found).count("\n| S") == 9


def test_readers(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    (folder / "deposit.json").write_text(json.dumps({"_note": "x", "baseList": [{"fin_co_no": "1", "fin_prdt_cd": "A", "fin_prdt_nm": "a", "max_limit": 5}], "optionList": [{"fin_co_no": "1", "fin_prdt_cd": "A", "save_trm": "12", "intr_rate": 3.15, "intr_rate2": None}]}))
    (folder / "other.json").write_text(json.dumps({"baseList": [{"fin_co_no": "9"}]}))
    products, options = records.disclosures(spark, str(folder))
    p, o = products.collect(), options.collect()
    assert len(p) == 1 and (p[0]["kind"], p[0]["pos"], p[0]["max_limit"], p[0]["join_way"]) == ("deposit", 0, "5", None)
    assert len(o) == 1 and str(o[0]["intr_rate"]) == "3.150000" and o[0]["intr_rate2"] is None

    laws = tmp_path / "laws"
    laws.mkdir()
    (laws / "l.json").write_text(json.dumps({"name": "법", "slug": "l", "effective_date": "20240101", "articles": [{"label": "제1조", "title": "목적", "text": "본문"}]}, ensure_ascii=False), encoding="utf-8")
    law = records.statutes(spark, str(laws)).first()
    assert law["name"] == "법" and law["ministry"] is None and law["articles"][0]["label"] == "제1조"

    path = str(tmp_path / "q")
    records.write_jsonl(spark.createDataFrame([("1", "span", None)], "id string, qtype string, unit string"), path)
    q = records.questions(spark, path).first()
    assert (q["id"], q["qtype"], q["unit"], q["evidence"]) == ("1", "span", None, None)

    sheets = tmp_path / "sheets"
    records.write_sheets({"all": spark.createDataFrame([(1, ["a", 'b"c'])], "id int, gold array<string>")}, str(sheets))
    back = spark.read.option("header", True).option("escape", '"').csv(f"{sheets}/all").first()
    assert json.loads(back["gold"]) == ["a", 'b"c']


def test_articles_are_flattened(spark):
    schema = "text string, `항` array<struct<text string, `호` array<struct<text string, `목` array<struct<text string>>>>>>"
    row = spark.createDataFrame([(("머리", [("①", [("1.", [("가.",)]), ("2.", None)]), ("② ", None)]),)], f"a struct<{schema.replace(' string', ': string').replace('` array', '`: array')}>")
    one = row.select(records.flattened(F.col("a")).alias("t"), records.article_label(F.lit("3"), F.lit("2")).alias("l"), records.article_label(F.lit("3"), F.lit("")).alias("m"), records.is_deleted(F.lit("제3조 삭제 <2020.1.1>")).alias("d")).first()
    assert one["t"].split("\n") == ["머리", "①", "1.", "가.", "2.", "② "] and (one["l"], one["m"], one["d"]) == ("제3조의2", "제3조", True)
