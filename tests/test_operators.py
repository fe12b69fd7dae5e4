import os
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import context as C
from loomgraph.operators import rules, workload
from loomgraph.operators import graph as G
from loomgraph.operators import text as R
from loomgraph.operators.prefix import ordinals, prefix_sums
from loomgraph.sources import records

ROOT = Path(__file__).resolve().parent.parent


def _units(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "qid int, rank int, text string")


def test_budget(spark):
    u = _units(spark, "a" * 10, "b" * 10, "c" * 3)
    one = lambda b: C.assemble(u, b).first()["context"]
    assert one(22) == "a" * 10 + "\n\n" + "b" * 10 and one(21) == "a" * 10 and one(4) == "aaaa" and one(None).count("\n\n") == 2


def test_engineering(spark):
    u = _units(spark, "[매칭된 개념] x(p:x)", "[개념] c", "[속성] p", "fact (p:y)\n\n- (역참조) z\nend", "fact\nend", "[개념] c")
    assert [r["text"] for r in C.engineered(u).orderBy("rank").collect()] == ["[매칭된 개념] x", "fact\nend", "[속성] p", "[개념] c"]


def test_metrics(spark):
    u = _units(spark, "alpha", "beta", "gamma")
    g = spark.createDataFrame([(1, ["alpha", "gamma"]), (2, ["x"])], "qid int, gold array<string>")
    m = {r["qid"]: r.asDict() for r in C.retrieval_metrics(u, g, budgets=(5,)).collect()}
    assert m[1] == {"qid": 1, "hit1": 0.0, "mrr": 1 / 3, "chars": 18, "recall_5": 0.5, "recall_inf": 1.0}
    assert m[2]["mrr"] == 0 and m[2]["chars"] == 0 and m[2]["recall_inf"] == 0
    empty = spark.createDataFrame([(1, [])], "qid int, gold array<string>")
    twice = spark.createDataFrame([(1, ["alpha", "alpha"])], "qid int, gold array<string>")
    a, b = C.retrieval_metrics(u, empty).first(), C.retrieval_metrics(u, twice).first()
    assert (a["hit1"], a["mrr"], a["recall_inf"]) == (1, 1, 0) and (b["hit1"], b["mrr"], b["recall_inf"]) == (1, 0, 1)


def test_verdicts(spark):
    p = spark.createDataFrame([("주식회사 가은행", "예금", "만 19세 이상", "영업점, 스마트폰", "최저 1백만원 이상"), ("나은행", "적금", "", "", "")], "bank string, name string, join_member string, join_way string, etc_note string")
    r = rules.extract(p)
    cases = [("가은행", "예금", {}, "UNKNOWN"), ("가은행", "예금", {"age": "15"}, "DENIED"), ("가은행", "예금", {"age": "20"}, "CONFIRMED"), ("가은행", "예금", {"age": None, "channel": "영업점"}, "UNKNOWN"), ("가은행", "예금", {"amount": "999999"}, "DENIED"), ("다은행", "예금", {}, "NOT_APPLICABLE"), ("나은행", "적금", {"age": "20"}, "NOT_APPLICABLE"), ("가은행", "예금", {"hair": "red"}, "CONFIRMED")]
    asked = spark.createDataFrame([(i, b, n, f) for i, (b, n, f, _) in enumerate(cases)], "id int, bank string, product string, facts map<string,string>")
    got = {x["id"]: x for x in rules.judge(r, asked).collect()}
    assert [got[i]["verdict"] for i in range(len(cases))] == [c[3] for c in cases]
    assert got[0]["missing_slots"] == ["age", "channel", "amount"] and "channel" in got[2]["note"] and got[2]["product"] == "주식회사 가은행:예금"


def test_scalar_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    lit = lambda x: F.lit(x)
    assert one(T.squeezed(lit(" a  b\n")), T.slug(lit("--가 A/1.")), T.decimal_of(lit("")), T.iso_date(lit("20240230"))) == ("a b", "가_A_1", None, None)
    assert one(*[T.short_number(lit(Decimal(x))) for x in ("3.50", "0", "-2.0", "100000", "12.345678", "0.0010")]) == ("3.5", "0", "-2", "100000", "12.3457", "0.001")
    assert one(T.particle(lit("적금"), "object"), T.particle(lit("금리"), "topic"), T.particle(lit("LTV"), "with"), T.particle(lit(""), "with")) == ("을", "는", "과(와)", "과(와)")
    assert one(T.least_age(lit("만 19세 이상")), T.least_age(lit("none")), T.least_amount(lit("최소 가입금액 1,000만원 이상")), T.least_amount(lit("x"))) == (19, None, 10_000_000, None)
    assert one(T.thousands(lit("1234567")), T.thousands(lit("123")), T.quoted(lit("a 'b' c 'd e'"))) == ("1,234,567", "123", ["b", "d e"])
    import zlib

    assert one(T.variant([lit("x"), lit(7)], 5)) == (zlib.crc32(b"x:7") % 5,)


def test_chunks_are_those_of_the_joined_text(spark):
    texts = ["a" * 30, "", "bc" * 50, "d", "e" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    whole = "\n\n".join(texts)
    got = {r["chunk"]: r["text"] for r in R.chunks(df, "i", size=40, overlap=8).collect()}
    assert got == {k: whole[k * 32 : k * 32 + 40] for k in range(-(-len(whole) // 32))}


def test_walk_caps_each_seed(spark):
    edges = spark.createDataFrame([("hub", f"n{i}", f"n{i:02d}") for i in range(9)] + [("n3", "far", "x")], "node string, other string, ord string")
    seeds = spark.createDataFrame([(1, "hub", 0), (1, "n3", 1)], "qid int, seed string, seed_rank int")
    got = G.expand(edges, seeds, 2, 4)
    assert [r["node"] for r in got.where("seed = 'hub'").orderBy("rank").collect()] == ["hub", "n0", "n1", "n2"]
    assert [r["node"] for r in got.where("seed = 'n3'").orderBy("rank").collect()] == ["n3", "far"]
    assert [r["node"] for r in G.merged(got).orderBy("rank").collect()] == ["hub", "n0", "n1", "n2", "n3", "far"]


def test_display_names_and_quota(spark):
    rows = [("credit", "1", " 신용 대출 ", "마이너스"), ("credit", "1", "신용 대출", "일반신용 대출"), ("deposit", "1", "신용 대출", "x")]
    df = spark.createDataFrame(rows, "kind string, fin_co_no string, fin_prdt_nm string, crdt_prdt_type_nm string")
    assert sorted(r["display_name"] for r in records.display_names(df).collect()) == ["신용 대출", "신용 대출(마이너스)", "일반신용 대출"]
    q = spark.createDataFrame([(t, i) for t in "ab" for i in range(9)], "template string, ord int")
    got = workload.take_quota(q, {"a": 3, "b": 2}, ["b", "a"], 9).orderBy("seq").collect()
    assert [(r["template"], r["ord"]) for r in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("b", 5)]


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'class_instances' in q and set(o) <= set(q); assert not any(re.match(r'op\\d', n) or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def _walk(near, seed, depth, cap):
    """A breadth-first walk of one seed, by the definition: level by level, neighbours in order."""
    walk, front = [seed], [seed]
    for _ in range(depth):
        found = []
        for n in front:
            for _, other in sorted(near.get(n, ())):
                if other not in walk and other not in found:
                    found.append(other)
        front = found[: cap - len(walk)]
        walk += front
    return walk


def test_walks_past_hubs_follow_what_a_seed_can_keep(spark):
    hub = [("hub", f"n{i:05d}", i) for i in range(5000)] + [(f"n{i:05d}", "hub", 7) for i in range(5000)]
    more = [(f"n{i:05d}", f"m{i % 40:02d}", i) for i in range(0, 5000, 3)] + [("hub", "n00003", 9000)]
    edges = spark.createDataFrame(hub + more, "node string, other string, ord int")
    assert G.heads(edges, 6).groupBy("node").count().agg(F.max("count")).first()[0] == 12
    near = {}
    for a, b, o in hub + more:
        near.setdefault(a, set()).add((o, b))
    seeds = [(1, "hub", 1), (1, "n00009", 2), (2, "n04999", 1), (2, "m01", 2)]
    got = G.expand(edges, spark.createDataFrame(seeds, "qid int, seed string, seed_rank int"), 3, 6)
    by_seed = {}
    for r in got.collect():
        by_seed.setdefault((r["qid"], r["seed"]), []).append((r["rank"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in by_seed.items()} == {(q, s): _walk(near, s, 3, 6) for q, s, _ in seeds}


def test_prefix_sums_over_ranges(spark):
    rows = [(i * 7919 % 1000, f"x{i % 7}", None if i % 11 == 0 else i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, s string, n int").repartition(5)
    want, total = {}, 0
    for k, _, n in sorted(rows):
        want[k] = total
        total += n or 0
    assert {r["k"]: r["before"] for r in prefix_sums(df, ["k"], F.col("n"), "before").collect()} == want
    assert [r["k"] for r in ordinals(df, ["k"], "place").orderBy("place").collect()] == list(range(1000))
    places = ordinals(df, ["s"], "place").orderBy("place").collect()
    assert [r["place"] for r in places] == list(range(1, 1001)) and [r["s"] for r in places] == sorted(s for _, s, _ in rows)
    assert ordinals(df.where("false"), ["s"], "place").count() == 0


def test_metrics_of_budgets_are_those_of_assembled_contexts(spark):
    rows = [(q, r, f"u{q}x{r} " + "y" * (3 * ((q * 7 + r * 5) % 9))) for q in range(6) for r in range(1, 7)] + [(9, 1, "z" * 50), (9, 2, "u9x2"), (8, 1, None), (8, 2, "u8x2")]
    units = spark.createDataFrame(rows, "qid long, rank int, text string")
    gold = spark.createDataFrame([(q, [f"u{q}x{r}" for r in (1, 2, 4, 6)]) for q in (*range(6), 7, 8, 9)], "qid long, gold array<string>")
    budgets = (5, 20, 44, 70)
    got = {r["qid"]: r for r in C.retrieval_metrics(units, gold, budgets=budgets).collect()}
    for b in budgets:
        contexts = {r["qid"]: r["context"] for r in C.assemble(units, b).collect()}
        for r in gold.collect():
            assert got[r["qid"]][f"recall_{b}"] == sum(p in contexts.get(r["qid"], "") for p in r["gold"]) / 4
