import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomgraph.llm.queries import QUERIES


def test_stages(spark, odd):
    odd = odd.withColumns({c: F.lit(i) for i, c in enumerate(("_id", "id", "_sha", "own", "tie", "_took", "Part", "twin"))})
    docs = odd
    kept = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, "")
        kept.append((name, docs.count()))
        if name != P.STAGES[-1][0]:
            assert docs.columns == odd.columns
    assert [n for n, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    first = {r["doc_id"] for r in P.language(spark, odd, "").collect()}
    assert first == {1, 2, 5, 7, None, 10}


def test_stages_of_no_documents(spark, none):
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_mixed_documents_come_in_the_order_of_their_slots(spark, tmp_path):
    """Files in the order of their names, and their rows in turn, have each source's share all along, whole texts first."""
    from loomgraph.llm.mixing import mix

    rows = [(i, " ".join(f"d{i}w{k}" for k in range(200 + i % 700)), "en", "abc"[i % 7 % 3], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r for r in mix(docs).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        P.mixed(spark, docs, "").write.parquet(str(tmp_path / "made"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "made").glob("part-*.parquet"))
    seen: dict[int, int] = {}
    got = []
    for file in files:
        for r in pq.read_table(file).to_pylist():
            k = seen[r["doc_id"]] = seen.get(r["doc_id"], -1) + 1
            got.append((taken[r["doc_id"]]["turns"][k], r["source"], len(r["text"].split())))
    assert len(files) > 1 and [g[0] for g in got] == sorted(g[0] for g in got)
    assert seen == {i: len(r["turns"]) - 1 for i, r in taken.items() if r["taken"]}
    total = sum(g[2] for g in got)
    assert total == sum(r["taken"] for r in taken.values())
    for source in "abc":
        share = sum(g[2] for g in got if g[1] == source) / total
        run = part = 0
        for _, s, n in got:
            run, part = run + n, part + n * (s == source)
            assert abs(part - share * run) < 8 * 1024


def test_near_copies_go_and_clean_documents_stay(spark):
    words = [[f"w{k}x{i}" for i in range(400)] for k in range(4)]
    near = list(words[0])
    near[50], near[250] = "changed", "again"
    rows = [(k, " ".join(w), "en", "s", 0) for k, w in enumerate(words)] + [(10, " ".join(near), "en", "s", 0), (11, " ".join(words[1]).upper(), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = P.exact(spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, 2, 3, 10}
    assert {r["doc_id"] for r in P.near(spark, docs, "").collect()} == {0, 1, 2, 3}


def test_run_and_registration(spark):
    packed = P.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(packed) and (packed["bin_offset"] + packed["length"] <= packed["bin_size"]).all()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
