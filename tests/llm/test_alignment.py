import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import alignment
from loomgraph.llm.alignment import BYTE_LEVEL, PIECES, align, overlaps, pair_counts, packed, unpacked
from loomgraph.llm.tokens import loaded


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=20), st.lists(st.integers(1, 5), min_size=1, max_size=20))
def test_overlaps_by_the_definition(a, b):
    a, b = (x + [max(0, sum(y) - sum(x))] * (sum(y) > sum(x)) for x, y in ((a, b), (b, a)))
    ends = [np.cumsum(x) for x in (a, b)]
    spans = [[(e - n, e) for e, n in zip(np.cumsum(x).tolist(), x, strict=True)] for x in (a, b)]
    at_a, at_b, _, groups = overlaps(*ends)
    assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    assert groups.tolist() == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


def test_pairs_come_back_from_their_packed_form():
    pairs = np.array([0, 1, 5 << 32, (5 << 32) + 70_000, 50_256 << 32 | 31_999], np.int64)
    got = unpacked(packed(pairs, np.array([1, 2, 3, 70_000, 5])))
    assert got[0].tolist() == pairs.tolist() and got[1].tolist() == [1, 2, 3, 70_000, 5]
    assert [len(x) for x in unpacked(b"")] == [0, 0]


def brute(texts):
    """What align() tells of (doc_id, text), from the tokenizers' own libraries and the definitions."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    byte = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def spans(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs = []
    for _, t in texts:
        x = a.encode(" " + t, add_special_tokens=False) if t else None
        own = [[(i, bytes(symbol[c] for c in p)) for i, p in zip(x.ids, x.tokens, strict=True)], [(i, byte(b.id_to_piece(i))) for i in b.encode(t)]] if t else [[], []]
        if t and any(b"".join(r for _, r in side) != (" " + t).encode() for side in own):
            own = [[], []]
        docs.append([spans(side) for side in own])
    links, groups = [], []
    for left, right in docs:
        j, own = 0, []
        for i, s, e in left:
            while j and right[j - 1][2] > s:
                j -= 1
            while j < len(right) and right[j][1] < e:
                if right[j][2] > s:
                    own.append((i, right[j][0]))
                j += 1
        links.append(own)
        both = sorted({x[2] for x in left} & {x[2] for x in right})
        own = [([], []) for _ in both]
        for k, side in enumerate((left, right)):
            for i, _, end in side:
                own[bisect_left(both, end)][k].append(str(i))
        groups.append(";".join("|".join(map(",".join, g)) for g in own))
    count = Counter(p for own in links for p in set(own))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    rows = [(d, len(left), len(right), 0 if not g else g.count(";") + 1, len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "") for (d, _), (left, right), own, g in zip(texts, docs, links, groups, strict=True)]
    return rows, count


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_documents_against_brute_force(spark, docs):
    from loomgraph.llm.queries import QUERIES

    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, count = brute(texts)
    got = QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001").select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {(r["a"], r["b"]): r["n"] for r in pair_counts(docs).collect()} == count


def test_odd_rows_in_small_shards(spark, odd, none, monkeypatch):
    for name, n in (("HELD", 50), ("KEPT", 20), ("RANGE", 30), ("SHARD", 16), ("TOGETHER", 3), ("CHARACTERS", 100)):
        monkeypatch.setattr(alignment, name, n)
    more = [(20, "<|endoftext|> <s> and </s>"), (21, "a▁b is not told"), (22, "tab\tand\x00nul  two"), (23, "  　ﬁ é"), (24, "x"), (24, "x"), (25, "1234567890" * 300)]
    texts = [(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NULL OR doc_id <> 5").select("doc_id", "text").collect()] + more
    df = spark.createDataFrame([(i, t, 1, "p", "s") for i, t in texts], "doc_id long, text string, pair int, pairs string, first string")
    got = align(df).select(*COLUMNS)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(texts)[0], key=key)
    assert align(none).collect() == []
    assert [tuple(r) for r in align(df.where("text IS NULL OR text = ''")).select(*COLUMNS[1:]).distinct().collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_long_texts_have_the_same_ids_by_either_encoder():
    a, _ = loaded(BYTE_LEVEL, PIECES)
    for text in (" " + "alpha beta 12 !? \n\n" * 3000, " " + "a" * 50_000, " " * 30_000 + "x", " <|endoftext|> it's we'll"):
        assert a.quick.encode_ordinary(text) == a.slow.encode(text, add_special_tokens=False).ids == a.ids(text)
