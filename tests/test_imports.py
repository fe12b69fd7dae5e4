import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators import imports, reports, workload
from loomgraph.sources import ntriples, records
from loomgraph.sources.turtle import TurtleReader, write_ntriples

QUESTION = "qid string, group string, question string, doc_ids array<string>, gold_verdict string, gold_basis string"


def products(spark, *rows):
    names = "kind string, pos int, " + ", ".join(f"{n} string" for n in records.BASE)
    blank = dict.fromkeys(records.BASE)
    return spark.createDataFrame([(r["kind"], r["pos"], *{**blank, **{k: v for k, v in r.items() if k in blank}}.values()) for r in rows], names)


def test_questions_are_carried_over_or_left_out_for_a_reason(spark):
    p = products(
        spark,
        {"kind": "deposit", "pos": 0, "kor_co_nm": "가은행", "fin_prdt_cd": "A", "fin_prdt_nm": " 첫  예금 ", "join_member": "만 19세 이상", "join_deny": "2", "spcl_cnd": "급여 이체"},
        {"kind": "saving", "pos": 0, "kor_co_nm": "가은행", "fin_prdt_cd": "A", "fin_prdt_nm": "새 적금", "join_deny": "1", "etc_note": "상속 시 해지"},
        {"kind": "deposit", "pos": 1, "kor_co_nm": "나은행", "fin_prdt_cd": "A", "fin_prdt_nm": "나 예금"},
    )
    rows = [
        ("1", "Q1", "이 상품은 제한이 있는가? 이 상품", ["x:가은행:A:1"], "NO", "'제한없음', '없는 말'"),
        ("2", "Q1", "상속되는가?", ["x:가은행:A:1"], "ABSTAIN", None),
        ("3", "Q1", "상속되는가?", ["x:나은행:A:1"], "ABSTAIN", "'x'"),
        ("4", "Q1", "?", ["x:나은행:A:1"], "YES", "'급여 이체' 와 '둘'"),
        ("5", "Q1", "?", ["x:나은행:B:1"], "YES", ""),
        ("6", "Q1", None, ["나은행:B"], None, None),
        ("7", "Q1", "?", [], "YES", None),
        ("8", "Q1", "?", None, "YES", None),
    ]
    got = {r["id"]: r for r in imports.carried_over(spark.createDataFrame(rows, QUESTION), p).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"1": None, "2": "not_absent", "3": None, "4": "no_evidence", "5": "no_product", "6": "doc_id", "7": "doc_id", "8": "doc_id"}
    assert got["1"]["question"] == "가은행 '새 적금'은 제한이 있는가? 가은행 '새 적금'" and got["1"]["gold"] == ["새 적금", "제한없음"]
    assert got["3"]["question"] == "나은행 '나 예금' 상품에 대해: 상속되는가?" and got["3"]["gold"] == []
    assert got["2"]["detail"] == ["상속"] and got["4"]["detail"] == ["급여 이체", "둘"] and got["5"]["detail"] == ["나은행", "B"] and got["6"]["detail"] == ["나은행:B"]


def test_questions_about_banks(spark):
    ids = [["x:law:a:1"], ["amend:b"], ["x:가저축은행:a:1"], ["x:가은행:a:1", "x:나보험:b:1"], ["x:가은행:a:1"], ["law"], [], None, [None]]
    d = spark.createDataFrame([(str(i), "Q1", "?", x, "YES", None) for i, x in enumerate(ids)], QUESTION)
    assert {r["qid"] for r in imports.about_banks(d).collect()} == {"4", "5", "6", "7", "8"}


def test_wordings(spark):
    assert all(len(v) == 3 and len(set(v)) == 3 for k, v in workload.WORDINGS.items() if k != "temporal_validity")
    d = spark.createDataFrame([(f"{i}", "Q2_시간" if i % 2 else "Q1", f"은행 퇴직급여 {i}", ["a:1"], "YES", "b" * 300) for i in range(4)], QUESTION)
    rows = workload.word(imports.temporal_validity(d)).orderBy("ord").collect()
    assert [(r["question"], r["kind"], r["locator"], len(r["text"])) for r in rows] == [("은행 퇴직급여 1", "퇴직연금", "a:1", 200), ("은행 퇴직급여 3", "퇴직연금", "a:1", 200)]
    made = spark.range(30).select(F.lit("agg_count").alias("template"), F.array(F.concat(F.lit("은행"), F.col("id").cast("string")), F.lit("예금")).alias("parts"))
    got = {r["parts"][0]: r["question"] for r in workload.word(made).collect()}
    for name, text in got.items():
        wording = workload.WORDINGS["agg_count"][zlib.crc32(f"agg_count:{name}:예금".encode()) % 3]
        assert text == wording.replace("{0}", name).replace("{1}", "예금")
    assert len({t.replace(n, "") for n, t in got.items()}) == 3


def test_reports(spark):
    d = spark.createDataFrame([(1, "a", 1, 2), (2, "b", 0, 5), (3, None, 0, 0), (4, "d", 0, 9)], "id int, name string, hits int, total int")
    assert [(r["place"], r["id"], r["share"]) for r in reports.worst(d, "hits", "total", "id", 3).orderBy("place").collect()] == [(1, 2, 0.0), (2, 4, 0.0), (3, 1, 0.5)]
    assert reports.worst(d.limit(0), "hits", "total", "id").count() == 0
    text = reports.render_rows(d.withColumn("q", F.lit(1)), "q", "id", "id", "name").first()["text"]
    assert text == "id: 1 | name: a\nid: 2 | name: b\nid: 3\nid: 4 | name: d"
    assert {r["name"]: r["hits"] for r in reports.recall_by(d.where("id < 3"), "name", ["hits"], "total").collect()} == {"a": 0.5, "b": 0.0}


LINES = r"""# a comment
<urn:a> <urn:p> <urn:b> .
_:x.1 <urn:p> _:x.1 . # it's "so"
<urn:a>	<urn:q>	"a \"q\" \\t \t \u00e9 \U0001F600 . # no"@EN-us .

<urn:a> <urn:q> "\\"^^<http://www.w3.org/2001/XMLSchema#string>.
<urn:\u00e9> <urn:q> "1"^^<urn:t> .
<urn:a> <urn:q> "" ."""


def test_ntriples_lines_are_what_the_turtle_reader_makes_of_them(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.nt").write_text(LINES)
    got = {tuple(r) for r in ntriples.read_ntriples(spark, str(folder)).collect()}
    assert got == set(TurtleReader(LINES, "in").rows())
    assert {r["o"] for r in ntriples.read_ntriples(spark, str(folder), predicates=["urn:p"]).collect()} == {"urn:b", "in#x.1"}
    bad = ['<urn:a> <urn:p> "x .', "<urn:a> <urn:p> .", "<urn:a> <urn:p> <urn:b>", "<urn:a> <urn:p> <urn:b> x .", "nothing"]
    (folder / "b.nt").write_text("\n".join(bad) + "\n<urn:z> <urn:p> <urn:z> .\n")
    assert ntriples.read_ntriples(spark, str(folder), "PERMISSIVE").count() == len(got) + 1
    assert sorted(r["line"] for r in ntriples.read_errors(spark, str(folder)).collect()) == sorted(bad)
    with pytest.raises(Exception, match="cannot read"):
        ntriples.read_ntriples(spark, str(folder)).count()


def test_one_file_is_read_by_many_tasks_and_comes_back_from_the_sink(spark, tmp_path):
    text = F.concat(F.lit('"\\\n\t\\u0041 \r é😀 '), F.col("id").cast("string"))
    d = spark.range(5000).select(F.concat(F.lit("urn:"), F.col("id").cast("string")).alias("s"), F.lit("iri").alias("s_kind"), F.lit("urn:p").alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.when(F.col("id") % 2 == 0, "ko").alias("o_lang"))
    write_ntriples(d.coalesce(1), str(tmp_path / "out"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65536)
    try:
        read = ntriples._lines(spark, str(tmp_path / "out"))
        assert read.rdd.getNumPartitions() > 3
        again = ntriples.read_ntriples(spark, str(tmp_path / "out"))
        names = X.TRIPLES.fieldNames()
        assert again.count() == 5000 and again.select(names).exceptAll(d.select(names)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
