import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import text as R
from loomgraph.operators.runs import longest_runs


def run_of(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def test_longest_runs_of_a_batch():
    rng = random.Random(5)
    made = lambda: "".join(rng.choice("ab가😀") for _ in range(rng.randint(0, 30)))
    a, b = [made() for _ in range(400)] + ["", "x" * 3000], [made() for _ in range(400)] + ["abc", "y" + "x" * 2500]
    assert longest_runs(a, b).tolist() == [run_of(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("common", [0, 3, 256])
def test_match_with_grams_that_all_names_share(spark, monkeypatch, common):
    monkeypatch.setattr(R, "COMMON", common)
    monkeypatch.setattr(R, "DEALT", 10)
    names = [(f"Customer#{i:04d}", f"c{i}") for i in range(60)] + [("ab", "s1"), ("Acme Tools", "a"), ("tools acme", "a"), ("customer#0007", "twin")]
    asked = [(1, "is customer#0007 late?"), (2, "customer# what"), (3, "ab acme tool"), (4, ""), (5, None), (6, "customer#0007 is customer#0007")]
    found = R.match(spark.createDataFrame(names, "name string, node string"), spark.createDataFrame(asked, "qid int, question string"), 5)
    want = []
    for qid, q in asked:
        best = {}
        for name, node in names:
            n, t = name.lower(), (q or "").lower()
            size = (len(n) if n in t else 0) if len(n) < 4 else run_of(n, t)
            if size and (len(n) < 4 or size >= 4):
                best[node] = max(best.get(node, (0, 0)), (1.0 if len(n) < 4 else size / len(n), size))
        want += [(qid, node, *b, i + 1) for i, (node, b) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:5])]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_top_of_an_index_scores_only_blocks_that_can_reach_it(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    monkeypatch.setattr(R, "SALTED", 2)
    rng = random.Random(3)
    topics = ["".join(rng.choice("bcdfghjklm") for _ in range(12)) for _ in range(30)]
    docs = [(i, f"the {topics[i % 30]} {topics[i % 30][:6]} {i}") for i in range(600)] + [(600, ""), (601, None)]
    asked = [(i, f"the {topics[i]} of {i}") for i in range(30)] + [(30, "the"), (31, ""), (32, None), (33, "zzz")]
    d, q = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(asked, "item int, text string")
    index = R.TfIdf(d, "doc")
    # all pairs, by definition
    tf = R.term_frequencies(d, "doc").join(R.term_frequencies(d, "doc").groupBy("gram").count(), "gram")
    weight = F.log(F.lit(602.0) / (F.col("count") + 1)) + 1
    w = tf.select("doc", "gram", (F.col("tf") * weight).alias("w"))
    qs = R.term_frequencies(q, "item").join(tf.select("gram", "count").distinct(), "gram", "left")
    v = qs.select("item", "gram", (F.col("tf") * F.coalesce(weight, F.log(F.lit(602.0)) + 1)).alias("v"))
    a, b = {}, {}
    for x in w.collect():
        a.setdefault(x.doc, {})[x.gram] = x.w
    for x in v.collect():
        b.setdefault(x.item, {})[x.gram] = x.v
    want = []
    for item, grams in b.items():
        size = sum(x * x for x in grams.values()) ** 0.5
        scores = [(-round(sum(grams[g] * x for g, x in have.items() if g in grams) / size / sum(x * x for x in have.values()) ** 0.5, 6), doc) for doc, have in a.items() if grams.keys() & have.keys()]
        want += [(item, doc, -s, i + 1) for i, (s, doc) in enumerate(sorted(scores)[:5])]
    assert sorted(map(tuple, index.top(q, "item", k=5, decimals=6).collect())) == sorted(want)
    pairs = sum(1 for grams in b.values() for have in a.values() if grams.keys() & have.keys())
    assert index.scored(q.where("item < 30"), "item", k=5, decimals=6).count() < pairs / 4
