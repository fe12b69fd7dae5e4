import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.llm.mixing import mix, schedule
from loomgraph.llm import packing
from loomgraph.llm.packing import best_fit as best_fit_lengths
from loomgraph.llm.packing import cost_of, pack, plan, price
from loomgraph.llm.sharding import best_fit, shard
from loomgraph.llm.sharding import pack as pack_shards


def one_by_one(sizes, capacity):
    rest = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(rest) if r >= s]
        if fit:
            rest[min(fit)[1]] -= s
        else:
            rest.append(capacity - s)
    return sorted(rest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(30, 60))
def test_classes_pack_like_single_groups(sizes, capacity):
    classes = sorted({(s, sizes.count(s)) for s in sizes}, reverse=True)
    rest = {}
    for s, n, b in best_fit(classes, capacity):
        rest[b] = rest.get(b, capacity) - s * n
    assert sorted(rest.values()) == one_by_one(sizes, capacity)


def test_a_large_group_has_its_own_shard():
    runs = pack_shards([(1000, 1), (10, 50), (1, 20)], 4)
    load = {}
    for s, n, b in runs:
        load[b] = load.get(b, 0) + s * n
    assert max(load.values()) == 1000 and sum(load.values()) == 1520 and max(sorted(load.values())[:3]) == 174


def test_shards_of_documents(docs, texts):
    got = shard(docs).toPandas()
    assert sorted(got["doc_id"]) == sorted(texts)
    home = {}
    for r in got.itertuples():
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard and r.size == len(texts[r.doc_id].encode()) + 8
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    load = got.groupby("shard")["size"].sum()
    own = got.groupby("group_bytes")["size"].first()
    assert set(got["shard"]) <= set(range(24)) and load.max() <= max(load.sum() / 24 * 1.05, own.index.max())


def test_shards_odd_rows(odd, none):
    got = shard(odd, 3).toPandas()
    assert len(got) == odd.count() and got[got["doc_id"] == 3]["size"].tolist() == [8]
    assert got[got["doc_id"].isin([3, 4])]["shard"].nunique() == 1
    assert shard(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_plan_places_each_piece_once(lengths):
    runs = plan(lengths, (8, 16, 32, 64), 2)
    bins, placed = {}, {}
    for length, rank, n, each, first, offset in runs:
        for r in range(n):
            assert placed.setdefault((length, rank + r), True) is True
            bins.setdefault(first + r // each, []).append((offset + r % each * length, length))
    assert len(placed) == sum(lengths.values()) and {k: sum(1 for x in placed if x[0] == k) for k in lengths} == lengths
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at <= 64


def _contents(runs):
    bins = {}
    for length, _, n, each, first, _ in runs:
        for r in range(n):
            bins.setdefault(first + r // each, []).append(length)
    return sorted(map(sorted, bins.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64)]))
def test_ranges_of_bins_are_those_of_single_pieces(pieces, sizes):
    """Best fit one piece after the other: into the tightest bin that takes it, else a new one of least cost per token."""
    rest, bins, order = sum(pieces), [], sorted(pieces, reverse=True)
    for k, p in enumerate(order):
        fit = [(s - sum(own), i) for i, (s, own) in enumerate(bins) if s - sum(own) >= p]
        if fit:
            bins[min(fit)[1]][1].append(p)
            continue
        left = sum(1 for x in order[k:] if x == p) * p
        rest = sum(x for x in order if x <= p)
        size = min((s for s in sizes if s >= p), key=lambda s: (price(s, 2, 64) / min(s // p * p if rest - order.count(p) * p <= 0 else s, rest), -s))
        bins += [(size, []) for _ in range(-(-(left // p) // (size // p)))]
        bins[min((s - sum(own), i) for i, (s, own) in enumerate(bins) if s - sum(own) >= p)[1]][1].append(p)
    runs, opened = best_fit_lengths(Counter(pieces), sizes, 2, 64)
    assert _contents(runs) == sorted(sorted(own) for _, own in bins if own)
    assert sum(many for _, _, many, _ in opened) == len(_contents(runs))


def _least(pieces, sizes):
    """The least cost of all ways to put pieces into bins."""
    best = math.inf

    def place(k, bins):
        nonlocal best
        if k == len(pieces):
            best = min(best, sum(price(min(s for s in sizes if s >= b), 2, 64) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + pieces[k] <= sizes[-1]:
                place(k + 1, [*bins[:i], bins[i] + pieces[k], *bins[i + 1 :]])
        place(k + 1, [*bins, pieces[k]])

    place(0, [])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=6))
def test_plan_against_all_ways_and_single_sizes(pieces):
    sizes = (16, 32, 64)
    cost = sum(price(min(s for s in sizes if s >= sum(b)), 2, 64) for b in _contents(plan(Counter(pieces), sizes, 2, 64)))
    assert _least(pieces, sizes) - 1e-9 <= cost <= 1.25 * _least(pieces, sizes)
    for s in sizes:
        if s >= max(pieces):
            alone = sum(price(min(t for t in sizes if t >= sum(b)), 2, 64) for b in _contents(best_fit_lengths(Counter(pieces), (s,), 2, 64)[0]))
            assert cost <= alone + 1e-9


def test_several_sizes_beat_one():
    rng = np.random.default_rng(4)
    lengths = Counter(np.minimum(8192, rng.lognormal(6.2, 1.1, 5000).astype(int) + 1).tolist())
    costs = {s: cost_of(best_fit_lengths(lengths, s, 32, 8192)[1], packing.SIZES, 32, 8192) for s in [(8192,), packing.SIZES]}
    bins = _contents(plan(lengths))
    chosen = sum(price(min(s for s in packing.SIZES if s >= sum(b)), 32, 8192) for b in bins)
    assert chosen <= 0.9 * costs[8192,] and len({min(s for s in packing.SIZES if s >= sum(b)) for b in bins}) > 2


def test_packing_of_documents(docs, texts):
    got = pack(docs, (64, 256)).toPandas().sort_values(["bin_id", "bin_offset"])
    assert (got["bin_offset"] == got.groupby("bin_id")["length"].cumsum() - got["length"]).all()
    assert (got["bin_filled"] <= got["bin_size"]).all() and set(got["bin_size"]) <= {64, 256} and (got[got["bin_size"] == 256]["bin_filled"] > 64).all()
    tokens = got.groupby("doc_id")["length"].sum()
    assert tokens.to_dict() == {i: len(t.encode().split()) + 1 for i, t in texts.items()}


def test_packing_odd_rows(odd, none):
    got = pack(odd, (32, 64)).toPandas()
    assert got["length"].sum() == sum(len((r["text"] or "").encode().split()) + 1 for r in odd.select("text").collect())
    assert pack(none).count() == 0


def test_mix_against_its_rules(docs, texts):
    got = mix(docs).toPandas()
    assert len(got) == len(texts) and (got["taken"] <= 3 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(per["target"].sum() - per["size"].sum()) < 1e-6 * per["size"].sum()
    assert (per["target"] <= 3 * per["size"] + 1e-6).all()
    assert ((per["taken"] - per["target"]).abs() <= 1).all()
    again = mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=6), st.sampled_from([7, 64, 1024]))
def test_slots_of_sources(spark, words, block):
    """Each block of each source has one slot, each slot one block, and any first slots hold the sources by weight."""
    goal = spark.createDataFrame(list(enumerate(words)), "rank int, words long")
    got = schedule(goal, block).toPandas().sort_values("slot")
    want = {(r, k): min(block, w - k * block) for r, w in enumerate(words) for k in range(-(-w // block))}
    assert {(r, k): n for r, k, n in zip(got["rank"], got["block"], got["words"], strict=True)} == want and got["slot"].tolist() == list(range(len(want)))
    for r in range(len(words)):
        share = sum(1 for x in want if x[0] == r) / len(want)
        assert ((got["rank"] == r).cumsum() - share * np.arange(1, len(got) + 1)).abs().max() < 8


def test_slots_reach_the_documents(spark, docs):
    """Each taken document has the slot of its first block, and the words of any first slots are near the targets."""
    got = mix(docs).toPandas()
    taken = got[got["taken"] > 0]
    slots = int(got["slots"].iloc[0])
    assert got["slots"].nunique() == 1 and taken["slot"].between(0, slots - 1).all() and got[got["taken"] == 0]["slot"].isna().all()
    assert [t[0] for t in taken["turns"]] == taken["slot"].tolist() and (taken["turns"].map(len) == -(-taken["taken"] // taken["size"])).all()
    blocks = {s: -(-int(g["target"].iloc[0] + 0.5) // 1024) for s, g in got.groupby("source", dropna=False) if g["target"].iloc[0] >= 0.5}
    assert slots == sum(blocks.values())


def test_mix_takes_small_sources_to_the_word(spark):
    rows = [(i, "w " * 500, f"big{i % 2}") for i in range(200)] + [(900, "five words are all here", "tiny"), (901, "one", "zero"), (902, None, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert per.loc["tiny", "target"] == 15 and per.loc["tiny", "taken"] == 15 and per.loc["zero", "taken"] == 3 and per.loc["zzz", "taken"] == 0
    assert ((per["taken"] - per["target"]).abs() <= 0.5).all() and (got["taken"] <= 3 * got["size"]).all()


@pytest.mark.parametrize("weights", [(1, 2, 3), (1,)])
def test_targets_reshare_what_a_limit_cuts(spark, weights):
    rows = [(i, "w " * 10, "tiny") for i in range(2)] + [(100 + i, "w " * 50, "large") for i in range(200)] + [(900 + i, "w " * 5, None) for i in range(3)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights).toPandas()
    target = {s: t for s, t in zip(got["source"], got["target"], strict=True)}
    total, size, w = 10035.0, {"large": 10000, "tiny": 20, None: 15}, {s: weights[i % len(weights)] for i, s in enumerate(["large", "tiny", None])}
    want, free = {}, set(size)
    while True:
        level = (total - sum(want.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
        free -= over
    want |= {s: level * w[s] for s in free}
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)


def test_mix_odd_rows(odd, none):
    got = mix(odd).toPandas()
    assert len(got) == odd.count() and (got["taken"] <= 3 * got["size"]).all() and (got[got["size"] == 0]["taken"] == 0).all()
    long = got[got["doc_id"] == 5].iloc[0]
    assert long["size"] == 80_000 and (got["source_size"] >= got["size"]).all() and len(set(got["slots"])) == 1
    assert mix(none).count() == 0
