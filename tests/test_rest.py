import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from loomgraph.kb import KnowledgeBase
from loomgraph.sources import records, rest
from loomgraph.table_functions import register

BASES = [{"fin_co_no": "1", "kor_co_nm": "가은행", "fin_prdt_cd": f"A{i}", "fin_prdt_nm": f"예금 {i}", "max_limit": 5} for i in range(7)]
OPTIONS = [{"fin_co_no": "1", "fin_prdt_cd": f"A{i}", "save_trm": "12", "intr_rate": 2.35, "intr_rate2": None} for i in range(5)]
UNITS = [
    {"조문여부": "전문", "조문번호": "1", "조문내용": "제1장"},
    {"조문여부": "조문", "조문번호": "2", "조문가지번호": "3", "조문제목": " 정의 ", "조문내용": "뜻<개정>", "항": [{"항내용": "①", "호": {"호내용": "1.", "목": [{"목내용": "가."}]}}, {"항내용": "②"}], "조문시행일자": 20240101},
    {"조문여부": "조문", "조문번호": "4", "조문내용": "제4조 삭제 <2020>"},
]


@pytest.fixture(scope="module")
def server():
    tries = {}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):
            url = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            tries[self.path] = tries.get(self.path, 0) + 1
            page = int(q.get("pageNo", 1))
            if q.get("auth") == "bad":
                body = {"result": {"err_cd": "010", "err_msg": "key"}}
            elif url.path.endswith("depositProductsSearch.json"):
                if page == 2 and tries[self.path] == 1:
                    self.send_error(503)
                    return
                body = {"result": {"err_cd": "000", "max_page_no": "3", "baseList": BASES[(page - 1) * 3 : page * 3], "optionList": OPTIONS[(page - 1) * 2 : page * 2]}}
            elif url.path.endswith("lawSearch.do"):
                law = {"법령명한글": "가 법", "현행연혁코드": "현행", "법령일련번호": 77, "법령상세링크": "/x"}
                body = {"LawSearch": {"law": [{**law, "현행연혁코드": "연혁"}, law] if q["query"] == "가 법" else law}}
            elif url.path.endswith("lawService.do"):
                body = {"법령": {"기본정보": {"법령명_한글": "가 법", "법종구분": {"content": "법률"}, "시행일자": 20240101, "공포일자": "20230101", "소관부처": {"content": "부"}}, "조문": {"조문단위": UNITS}}}
            else:
                body = {"result": {"err_cd": "000", "max_page_no": None, "baseList": None}}
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/api"
    made.shutdown()


def test_pages_give_what_files_give(spark, server, tmp_path):
    (tmp_path / "deposit.json").write_text(json.dumps({"baseList": BASES, "optionList": OPTIONS}))
    for a, b in zip(rest.fetched_disclosures(spark, server, "k", "020000"), records.disclosures(spark, str(tmp_path)), strict=True):
        assert sorted(a.columns) == sorted(b.columns) and a.count() == b.count() > 0
        assert a.select(b.columns).exceptAll(b).count() == 0


def test_an_error_code_stops_the_job(spark, server):
    with pytest.raises(Exception, match="010"):
        rest.fetched_disclosures(spark, server, "bad", kinds=["deposit"])


def test_statutes(spark, server):
    row = rest.fetched_statutes(spark, server, "u", [("가 법", "a", "공통")]).first()
    assert (row["name"], row["slug"], row["law_type"], row["effective_date"], row["ministry"], row["mst"]) == ("가 법", "a", "법률", "20240101", "부", "77")
    assert [tuple(a) for a in row["articles"]] == [("제2조의3", "정의", "뜻\n①\n1.\n가.\n②", "20240101")]
    with pytest.raises(Exception, match="no statute in force"):
        rest.fetched_statutes(spark, server, "u", [("나 법", "b", "공통")])


def test_table_functions(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix x: <urn:x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . x:B rdfs:subClassOf x:A . x:A rdfs:label \"Thing\" . x:one a x:B ; rdfs:label \"One\" ; x:n 3 . x:two a x:A .")
    assert register(KnowledgeBase.load(spark, str(tmp_path), "urn:x/"), "t_") == ["t_class_instances", "t_describe_instance", "t_find_concepts"]
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    assert [r[0] for r in rows("SELECT uri FROM t_class_instances('x:A')")] == ["x:one", "x:two"] and rows("SELECT * FROM t_class_instances(NULL)") == []
    lateral = "SELECT c.k, i.uri FROM VALUES (1, 'thing'), (2, 'nothing') AS c(k, name), LATERAL t_find_concepts(c.name) f, LATERAL t_class_instances(f.uri) i"
    assert rows(lateral) == [(1, "x:one"), (1, "x:two")]
    assert "CartesianProduct" not in spark.sql(lateral)._jdf.queryExecution().executedPlan().toString()
    assert ("x:n", "3", "literal") in rows("SELECT * FROM t_describe_instance('x:one')")
