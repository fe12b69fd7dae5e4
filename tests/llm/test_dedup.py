import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import simhash
from loomgraph.llm.exact_dedup import DigestIndex, exact_dedup
from loomgraph.llm.line_dedup import LINES, PARAGRAPHS, SENTENCES, dedup_units, digest, units
from loomgraph.llm.simhash import components, fingerprint, forest, forests, links, near_duplicates, reach_of, shingled


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(-5, 5)), max_size=300), st.booleans())
def test_index_keeps_the_best_of_each_digest(items, largest):
    index = DigestIndex(largest, memtable=16, fanout=3)
    want = {}
    for n, (key, ident) in enumerate(items):
        row = np.zeros(1, [("hi", "u8"), ("lo", "u8"), ("id", "i8"), ("row", "i8"), ("n", "i8")])
        row["hi"], row["lo"], row["id"], row["row"], row["n"] = key * 2**58 + key, key % 3, ident, n, 1
        index.add(row)
        k = (int(row["hi"][0]), key % 3)
        best, count = want.get(k, (None, 0))
        better = best is None or (ident > best if largest else ident < best)
        want[k] = (ident if better else best, count + 1)
    got = {(int(r["hi"]), int(r["lo"])): (int(r["id"]), int(r["n"])) for a in index.results() for r in a}
    assert got == want


def test_exact_dedup_odd_rows(odd):
    got = exact_dedup(odd, keep="largest").collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert {r["keep_id"] for r in by_id[1]} == {10} and by_id[10][0]["kept"] and not by_id[2][0]["kept"] and by_id[1][0]["group_size"] == 3
    assert by_id[3][0]["keep_id"] == 4 and by_id[3][0]["group_size"] == 3 and not by_id[3][0]["kept"]  # null equals empty
    assert sum(r["kept"] for r in by_id[7]) == 1  # of rows alike, one stays
    assert by_id[6][0]["kept"]


def test_exact_dedup_of_nothing(none):
    assert exact_dedup(none).count() == 0


def test_bytes_are_compared(spark):
    """A digest that takes few values: texts that share one are told apart by their bytes."""
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    weak = lambda norm: F.unhex(F.concat(F.substring(F.sha2(norm.cast("binary"), 256), 1, 1), F.lit("0" * 31)))
    got = {r["doc_id"]: r for r in exact_dedup(df, digest=lambda n: F.unhex(F.lit("00" * 16))).collect()}
    assert len(got) == 40 and all(got[i]["keep_id"] == i % 7 and got[i]["kept"] == (i < 7) for i in got)
    got = {r["doc_id"]: r for r in exact_dedup(df, digest=weak).collect()}
    assert all(got[i]["keep_id"] == i % 7 and got[i]["group_size"] == len(range(i % 7, 40, 7)) for i in got)


def test_exact_dedup_against_brute_force(docs, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t.encode().lower(), []).append(i)
    for r in exact_dedup(docs, keep="largest").collect():
        own = groups[texts[r["doc_id"]].encode().lower()]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode().lower()).hexdigest()


def _fp(text, words=3):
    return int(fingerprint(text, words)[0])


def test_fingerprint_bits():
    import xxhash

    words = "One two three four five".lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 3)
    assert _fp("One  two three\nfour five") == want
    assert _fp("a b") == xxhash.xxh64_intdigest("a b", 42)
    assert _fp("") == _fp(None) == _fp(" \n") == 0


@pytest.mark.parametrize("reach", [3, 10])
def test_tree_finds_all_pairs(reach):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 700, np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near]))[:, None]
    every = np.arange(len(fp))
    got = links(fp, every, every, reach)
    d = np.bitwise_count(fp[:, 0][:, None] ^ fp[:, 0][None])

    def roots(pairs):
        up = list(range(len(fp)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in up]

    assert roots(got.tolist()) == roots(np.argwhere((d <= reach) & (d >= 0)).tolist())


def _components(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15), st.integers(0, 5)).filter(lambda e: e[0] != e[1]), max_size=80))
def test_forest_spans_at_each_distance(edges):
    hits = np.array(sorted(edges, key=lambda e: e[2]), np.int64).reshape(-1, 3)
    got = hits[forest(hits)].tolist()
    for d in range(6):
        assert _components(16, [e[:2] for e in got if e[2] <= d]) == _components(16, [e[:2] for e in edges if e[2] <= d])
    assert len(got) == 16 - len(set(_components(16, [e[:2] for e in edges])))
    more = forests(hits, 3).tolist()
    assert sorted(more[: len(got)]) == sorted(got) and all(more.count(e) <= edges.count(tuple(e)) for e in more)


def test_checked_near_duplicates_link_by_exact_similarity(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(30):
        base = [f"t{k}w{i}" for i in range(300)]
        texts.append(base)
        for edits in (1, 3, 5, 12, 40):
            other = list(base)
            for at in rng.choice(300, edits, replace=False):
                other[at] = f"e{rng.integers(1 << 40)}"
            texts.append(other)
    hub = [f"hub{i}" for i in range(300)]  # one text with many copies, each with a word of its own
    texts += [hub] + [[*hub[:i], f"own{i}", *hub[i + 1 :]] for i in range(0, 300, 2)]
    texts = [" ".join(t) for t in texts] + ["short text", "short text", "", " ", "same words " * 300, "same words " * 500]
    sets = [set(shingled(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _components(len(texts), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 5, reach_of(0.8, 128), 128, 0.8).collect()}
    assert all(want[i] == want[got[i]] for i in got)  # nothing is linked that isn't alike
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("one_fingerprint, small, leaf", [(False, 32, 16384), (False, 4, 16384), (True, 4, 40)])
def test_no_pair_within_reach_is_left_unchecked(spark, monkeypatch, one_fingerprint, small, leaf):
    """Templated documents, whose nearest neighbours are false pairs, and texts that share a fingerprint; shingles that few
    share, and ones that go to trees of one leaf or several."""
    template = [f"t{i}" for i in range(404)]
    texts = []
    for k in range(50):
        own = [f"o{k}x{i}" for i in range(96)]
        texts.append(template + own)
        if k < 15:  # the planted pair: J about 0.82
            texts.append(template[:-1] + [f"c{k}"] + own[:48] + [f"p{k}x{i}" for i in range(48)])
    texts = [" ".join(t) for t in texts]
    for name, value in (("CHECKS", 2000), ("GIVEN", 4000), ("THIN", 8), ("SMALL", small), ("LEAF", leaf), ("COMMON", 1000 if small == 4 else 3)):
        monkeypatch.setattr(simhash, name, value)
    if one_fingerprint:
        monkeypatch.setattr(simhash, "sketch", lambda t, words, bits: (np.zeros(bits // 64, np.uint64), shingled(t, words)))
    sets = [set(shingled(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) >= 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 5, reach_of(0.8, 128), 128, 0.8).collect()}
    assert got == dict(enumerate(_components(len(texts), near)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 400), st.integers(0, 400), st.integers(0, 100))
def test_histograms_bound_what_is_shared(both, a, b, seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 1 << 62, both + a + b, dtype=np.uint64) & np.uint64((1 << 62) - 1 - (0xF000 if seed % 2 else 0))
    x, y = (np.frombuffer(simhash.histogram(np.concatenate([h[:both], own])), np.uint8).astype(int) for own in (h[both : both + a], h[both + a :]))
    lesser = np.minimum(x, y)
    assert lesser.sum() >= both or (lesser == simhash.FULL).any()


def test_short_texts_lose_no_link(spark):
    """Pairs of 4 to 28 shingles that are as alike as they must be, or just not, most of them far apart in bits."""
    texts, near = [], []
    for k in range(1500):
        n = (4, 5, 8, 12, 20, 28)[k % 6]
        words = [f"w{k}x{i}" for i in range(n + 5)]
        change = max(1, (n + 5) // 9)  # 1 of 5, 5 shingles of 25, and so on
        texts += [" ".join(words[:-1]), " ".join(words if k % 12 < 9 else words[change:])]
    sets = [set(shingled(t, 5).tolist()) for t in texts]
    near = [(i, i + 1) for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    fps = [simhash.sketch(t, 5, 128)[0] for t in texts]
    assert len(near) > 500 and sum(np.bitwise_count(fps[i] ^ fps[j]).sum() > 33 for i, j in near) >= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 5, reach_of(0.8, 128), 128, 0.8).collect()}
    assert got == dict(enumerate(_components(len(texts), near)))


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    plain = simhash.F.xxhash64
    monkeypatch.setattr(simhash.F, "xxhash64", lambda *c: plain(*c) if len(c) > 1 else plain(*c) % 4)
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    got = {}
    for r in docs.withColumn("twin", simhash.twins(docs)).collect():
        got.setdefault(r["twin"], set()).add(r["text"] or "")
    assert sorted(map(sorted, got.values())) == sorted([""] if i < 0 else [f"text {i}"] for i in range(-1, 20))


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), max_size=6), st.lists(st.integers(0, 60), unique=True, max_size=20))
def test_alike_sets_share_one_of_their_rarest(a, change, common):
    b = a ^ change
    known = np.array(sorted(common), np.uint64), np.array([3 + c % 4 for c in sorted(common)])
    x, y = (set(simhash.rarest(np.array(sorted(s), np.uint64), 0.8, *known).tolist()) for s in (a, b or a))
    if len(a & b) >= 0.8 * len(a | b):
        assert x & y


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 50)), max_size=150))
def test_what_meets_by_shingles(spark, rows):
    by = {}
    for s, t in rows:
        by.setdefault(s, set()).add(t)
    few = {s: t for s, t in by.items() if len(t) <= simhash.SMALL}
    want = {(a, b) for t in few.values() for a in t for b in t if a < b}, {(s, a) for s, t in by.items() if s not in few for a in t}
    got = simhash.met(spark.createDataFrame(rows, "shingle long, twin long")).collect()
    assert ({(r["a"], r["b"]) for r in got if r["shingle"] is None}, {(r["shingle"], r["a"]) for r in got if r["shingle"] is not None}) == want


def test_repeats_do_not_move_candidates_apart(spark):
    """A passage of 100 words that one copy has ten times and the other once: nearly the same distinct shingles."""
    texts = []
    for k in range(12):
        passage = [f"p{k}x{i}" for i in range(100)]
        rest = [f"r{k}x{i}" for i in range(500)]
        texts += [" ".join(rest + passage), " ".join(rest + passage * 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 5, reach_of(0.8, 128), 128, 0.8).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_checked_near_duplicates_odd_rows(odd, none):
    got = near_duplicates(odd, 5, reach_of(0.8, 128), 128, 0.8).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by_id[10]["component_id"] == by_id[2]["component_id"] == 1
    assert by_id[4]["component_id"] == by_id[6]["component_id"] == 3 and by_id[5]["component_id"] == 5
    assert near_duplicates(none, 5, reach_of(0.8, 128), 128, 0.8).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(bytearray([i]), bytearray([i + 1])) for i in range(30)], "a binary, b binary")
    assert {bytes(r["root"]) for r in components(edges).collect()} == {b"\0"}


def test_near_duplicates_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10]["component_id"] == by_id[2]["component_id"] == 1
    assert by_id[4]["component_id"] == by_id[6]["component_id"] == 3  # no words at all
    assert near_duplicates(none).count() == 0


def test_near_duplicates_against_brute_force(docs, texts):
    fp = {i: _fp(t) for i, t in texts.items()}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            least = min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
            if least < root[i]:
                root[i], changed = least, True
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert all(int.from_bytes(r["fp"], "big") == fp[i] for i, r in got.items())


def test_near_copies_of_similar_length(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, text), (2, text + " and two more"), (3, " ".join(f"v{i}" for i in range(300)))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 5, reach_of(0.8, 128), 128, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_units_cover_the_text():
    import re

    for pattern in (LINES, PARAGRAPHS, SENTENCES):
        for text in ("", "a", "a\n\nb. C? d", "\n\n", "x. y.\n"):
            assert "".join(text[a:b] for a, b in units(text, re.compile(pattern))) == text
    assert digest("A  b\nc", 3) == digest("a B c ", 3) and digest("a b", 3) is None


def test_units_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in dedup_units(odd.where("doc_id IS NULL OR doc_id <> 7"), LINES).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "" and got[10]["n_removed"] == 2
    assert [(s["start"], s["end"], s["first_id"]) for s in got[2]["removed"]] == [(0, 39, 1), (39, 70, 1)]
    assert got[3]["text"] is None and got[4]["text"] == "" and got[6]["text"] == "   \n\t "
    assert dedup_units(none).count() == 0
    assert dedup_units(odd).count() == odd.count()


def test_units_against_brute_force(docs, texts):
    import re

    seen, want = set(), {}
    for i in sorted(texts):
        out = []
        for a, b in units(texts[i], re.compile(SENTENCES)):
            d = digest(texts[i][a:b], 5)
            if d is None or d not in seen:
                out.append(texts[i][a:b])
            seen.add(d)
        want[i] = "".join(out)
    assert {r["doc_id"]: r["text"] for r in dedup_units(docs, SENTENCES).collect()} == want


def test_repeated_passages_go_and_common_lines_stay(spark, tmp_path):
    from loomgraph.llm.line_dedup import WITHIN
    from loomgraph.llm.queries import op9_repeated_units

    boiler, han = "They said the anea. Eriner thanea and all.", "".join(f"这是第{c}个在两篇文章里重复的句子。" for c in "一二三四五")
    line = " ".join(f"w{i}" for i in range(30))
    some = ["one two three four five six.", "Seven eight nine ten eleven twelve.", "Ok.", "A sentence of the passage has these words.", "And the last one has seven more."]
    rows = [(1, f"first of all texts here\n{line}\n{boiler}\n{han}\n{' '.join(some)}"), (2, f"second of all the texts\n{line.upper()}\n{boiler}\nnew words are in here. {boiler}\nOk\n\nend"), (3, f"前言不同。{han}\nBefore it come some other words. {' '.join(some)} After it come some more words.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op9_repeated_units(spark, str(tmp_path)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == f"second of all the texts\nnew words are in here. {boiler}\nOk\n\nend"  # the line and the one after it are a run
    assert got[3]["text"] == "前言不同。Before it come some other words. Ok. After it come some more words."
    assert {s["first_id"] for r in got.values() for s in r["removed"]} == {1}
    once = spark.createDataFrame([(1, "One line of five words or more. \r\nAnd another of as many words! \n")], "doc_id long, text string")
    assert dedup_units(once, LINES, min_words=1, inner=WITHIN).first()["n_removed"] == 0


def test_runs_against_brute_force(spark, docs, texts):
    import re

    from loomgraph.llm.line_dedup import WITHIN, n_words

    seen, want = set(), {}
    for i in sorted(texts):
        flags = []  # (start, end, True: repeats, False: doesn't, None: always stays)
        for a, b in units(texts[i], re.compile(LINES)):
            d = digest(texts[i][a:b], 5)
            parts = list(units(texts[i][a:b], re.compile(WITHIN)))
            if d in seen or len(parts) == 1:
                flags.append((a, b, None if d is None else d in seen))
                seen |= {d} - {None}
                continue
            seen |= {d} - {None}
            for x, y in parts:
                e = digest(texts[i][a + x : a + y], 5)
                flags.append((a + x, a + y, None if e is None else e in seen))
                seen |= {e} - {None}
        gone, run = set(), []
        for k, (a, b, again) in [*enumerate(flags), (-1, (0, 0, False))]:
            if again:
                run.append(k)
            elif again is False:
                gone |= set(run) if sum(n_words(texts[i][flags[r][0] : flags[r][1]]) for r in run) >= 25 else set()
                run = []
        want[i] = "".join(texts[i][a:b] for k, (a, b, _) in enumerate(flags) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in dedup_units(docs, LINES, inner=WITHIN, run_words=25).collect()} == want


def test_two_levels_against_brute_force(spark, docs, texts):
    import re

    from loomgraph.llm.line_dedup import WITHIN

    seen, want = set(), {}
    for i in sorted(texts):
        out = []
        for a, b in units(texts[i], re.compile(LINES)):
            line = texts[i][a:b]
            d = digest(line, 1)
            whole = d is not None and d in seen
            seen.add(d)
            parts = [line[x:y] for x, y in units(line, re.compile(WITHIN))]
            for part in [line] if len(parts) == 1 and not whole else [] if whole else parts:
                e = digest(part, 5)
                if len(parts) == 1 or e is None or e not in seen:
                    out.append(part)
                seen.add(e)
        want[i] = "".join(out)
    assert {r["doc_id"]: r["text"] for r in dedup_units(docs, LINES, min_words=1, inner=WITHIN).collect()} == want
