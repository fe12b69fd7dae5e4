import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import ctph, html_extract, ppm
from loomgraph.llm.ctph import edit_distance, edited, fingerprint, fingerprints_with_next, likeness
from loomgraph.llm.html_extract import SUPPORT, blocks, extract, host, parse, read, template_of, tokens_of
from loomgraph.llm.language_id import identify
from loomgraph.llm.ppm import Router, Trie, _from_planes, _planes, grams, score, stream


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert edit_distance(a, b) == row[-1]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_rolling_hash_depends_on_eight_bytes(data):
    whole = ctph._contexts(np.frombuffer(data, np.uint8))
    for i in range(7, len(data)):
        assert ctph._contexts(np.frombuffer(data[i - 7 : i + 1], np.uint8))[-1] == whole[i]


def test_fingerprints_of_alike_texts():
    rng = np.random.default_rng(3)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(900))
    other = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(900))
    a, b = fingerprint(text), fingerprint(edited(text, other))
    assert a == fingerprint(text) and likeness(a, a) == 1
    assert likeness(a, b) > 0.6 and likeness(a, fingerprint(other)) < 0.3
    assert likeness(a, fingerprint(text[:3000] + "inserted" + text[3000:])) > 0.8
    assert fingerprint("") == "4::" and likeness("4::", a) == 0
    assert len(fingerprint("a" * 5000)) < 400


def test_pieces_are_hashed_wherever_they_stand():
    data = b"some piece of text" * 3
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(ctph._BYTES[np.frombuffer(data, np.uint8)] * ctph._UP.upto(len(data))[: len(data)], out=sums[1:])
    assert ctph._signature(sums, np.array([18, 36]), 54)[0] == ctph._signature(sums, np.array([18, 36]), 54)[1]


def test_next_documents(docs, texts):
    order = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprints_with_next(docs.repartition(5)).collect()}
    for i, doc in enumerate(order):
        t, after = texts[doc], texts[order[(i + 1) % len(order)]]
        changed, r = edited(t, after), got[doc]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(t) and r["edited_fingerprint"] == fingerprint(changed)
        assert r["near_edited"] == likeness(fingerprint(t), fingerprint(changed)) and r["near_next"] == likeness(fingerprint(t), fingerprint(after))


def test_next_documents_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ctph, "BUCKET_BYTES", 50)
    df = spark.createDataFrame([(i, f"text number {i} " * 3) for i in range(0, 120, 3)], "doc_id long, text string")
    t = {r["doc_id"]: r["text"] for r in df.collect()}
    order = sorted(t)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints_with_next(df).collect()}
    assert got == {d: hashlib.sha256(edited(t[d], t[order[(i + 1) % len(order)]]).encode()).hexdigest() for i, d in enumerate(order)}


def test_next_documents_odd_rows(odd, none):
    got = fingerprints_with_next(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprints_with_next(none).count() == 0
    one = fingerprints_with_next(odd.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def _held(n):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, _held(3) != 1).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]]
    assert len(got) == docs.count() and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in identify(odd, F.lit(True), whole=True).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[9]["lang_pred"] == "und" and got[9]["score"] == 0
    assert got[1]["lang_pred"] == "en" and got[1]["row"]["digest"] == "d"
    assert {r["lang_pred"] for r in identify(odd, F.lit(False)).collect()} == {"und"}
    assert identify(none, F.lit(True)).count() == 0


def _counts(texts, order):
    """Counts of each order by their definition: below the longest, how many longer grams end alike."""
    out = [Counter((bytes([10]) * order + t)[i : i + order + 1] for t in texts for i in range(len(t)))]
    for _ in range(order):
        out.append(Counter(g[1:] for g in out[-1]))
    return out[::-1]


def _trie(texts, order):
    of = lambda c: (np.array([int.from_bytes(g, "big") for g in sorted(c)], np.uint64), np.array([c[g] for g in sorted(c)]))
    return Trie([of(c) for c in _counts(texts, order)])


def _brute(counts, order, context, symbol):
    """log10 of the probability by the definition: escapes weigh ESCAPE for a child, exclusion of all that longer contexts had."""
    seen, p = set(), 1.0
    for k in range(order, -1, -1):
        c = context[len(context) - k :]
        follow = {g[-1]: n for g, n in counts[k].items() if g[:-1] == c}
        if not follow:
            continue
        left = {s: n for s, n in follow.items() if s not in seen}
        total, escape = sum(left.values()), ppm.ESCAPE * len(left)
        if symbol in left:
            return math.log10(p * left[symbol] / (total + escape))
        if left:
            p *= escape / (total + escape)
        seen |= set(follow)
    return math.log10(p / (256 - len(seen)))


TEXTS = [stream(t) for t in ("the cat sat on the mat", "the dog", "a cat and a dog sat", "")]


def test_trie_against_its_definition():
    for order in (0, 2, 3):
        trie, counts = _trie(TEXTS, order), _counts(TEXTS, order)
        for text in (b"the cat ran\n", b"zq the\n", b"\n"):
            want = [_brute(counts, order, (b"\n" * order + text)[i : i + order], text[i]) for i in range(len(text))]
            assert np.allclose(trie.log10(grams([text], order=order)), want, atol=1e-9)
        context = np.uint64(int.from_bytes(b"the"[:order], "big") << 8)
        assert math.isclose((10 ** trie.log10(context | np.arange(256, dtype=np.uint64))).sum(), 1, abs_tol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab \u00e9", max_size=40), max_size=8), st.integers(0, 6), st.integers(1, 5), st.integers(1, 9))
def test_parts_know_what_the_whole_trie_knows(texts, order, parts, least):
    """Dealt to parts, with contexts seen `least` times divided, each gram gets the value that the whole trie gives."""
    streams = [stream(t) for t in texts]
    asked = np.unique(grams([*streams, b"abba baab\n"], order=order))
    keys, n = ppm.runs(np.sort(grams(streams, order=order)))
    every = keys >> np.uint64(8)
    divided = {k: np.array([c for c, m in zip(*ppm.runs(np.sort(every & ppm._mask(k))), strict=True) if m >= least], np.uint64) for k in range(2, order)}
    router = Router(parts, order, divided)
    head = router.head(router.nodes(keys))
    want = _trie(streams, order).log10(asked)
    home, own = router.part(asked, router.depth(asked)), router.part(keys, router.depth(keys))
    for p in range(parts):
        trie = Trie(router.levels(keys[own == p], n[own == p], head))
        assert np.allclose(trie.log10(asked[home == p]), want[home == p], atol=1e-12)


def test_grams_of_pieces():
    text = stream("one two three four five")
    whole = grams([text])
    assert (np.concatenate([grams([text[:9]]), grams([text[9:]], [text[3:9]])]) == whole).all() and len(whole) == len(text)
    assert stream(" A\tb \x0b\x0cC\u00c9 \n") == "a b cÉ\n".encode() and stream(None) == b"\n"
    some = list(ppm.pieces_of(b"ab cde f longerword g h\n", 3))
    assert some == [(0, b"ab cde "), (7, b"f longerword "), (20, b"g h\n")] and list(ppm.pieces_of(b"\n", 3)) == [(0, b"\n")]


def test_planes():
    a = np.array([0, 1, -3, 70000, 5], np.int32)
    assert (_from_planes(_planes(a), "<i4") == a).all() and len(_from_planes(_planes(a[:0]), "<i4")) == 0


def test_scores_over_blocks_and_parts(spark, monkeypatch):
    """Small blocks, many parts and divided contexts: texts longer than a block are scored whole."""
    for name, value in (("BLOCK", 300), ("PART", 200), ("SEEN", 3)):
        monkeypatch.setattr(ppm, name, value)
    rng = np.random.default_rng(5)
    some = ["".join(chr(97 + c) for c in rng.integers(0, 5, rng.integers(1, 6))) for _ in range(60)]
    texts = {i: " ".join(some[k] for k in rng.integers(0, 60, 4 + 40 * (i % 5))) for i in range(40)} | {40: "a" * 700, 41: None}
    got = {r["doc_id"]: r for r in score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), F.col("doc_id") % 3 > 0).collect()}
    trie = _trie([stream(t) for i, t in texts.items() if i % 3], 6)
    for i, t in texts.items():
        assert math.isclose(got[i]["score"], trie.log10(grams([stream(t)])).sum(), rel_tol=1e-5) and got[i]["bytes"] == len(stream(t))
        assert got[i]["n_tokens"] == len((t or "").split()) + 1


def test_scores_of_documents(docs, texts):
    got = {r["doc_id"]: r for r in score(docs, _held(5) != 1).collect()}
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    training = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in training for w in words[i])
    n, v = sum(c.values()) + len(training), len(c) + 1
    base = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words[i]) + 1, 1 + sum(c[w] > 0 for w in words[i]), n)
        assert math.isclose(r["base_score"], sum(base(c[w]) for w in words[i]) + base(len(training)), rel_tol=1e-9)
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1]  # far better than bytes that are all alike
    assert sum(got[i]["score"] for i in held) > -0.45 * math.log10(256) * sum(got[i]["bytes"] for i in held)


def test_scores_odd_rows(odd, none):
    got = score(odd, F.lit(True)).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 6)} == {1}
    untrained = score(odd, F.lit(False)).collect()
    assert {r["n_known"] for r in untrained} == {0} and all(math.isclose(r["score"], -r["bytes"] * math.log10(256), rel_tol=1e-6) for r in untrained)
    assert score(none, F.lit(True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x:y}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Links</p></div>
<%s><h1>Tom &amp; Jerry&nbsp;%d</h1><p><b>First<br>line<p>Second  &lt;b&gt;
 part</p><form><input><p>Sign up</p></form><aside>Ad</aside><ul><li>One<li>Two</ul><div class="comments"><p>Reader</p></div></%s>
<div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_article_of_one_page():
    text = blocks(parse(PAGE % ("article", 1, "article")), None)
    assert text == "Tom & Jerry 1\n\nFirst line\n\nSecond <b> part\n\nOne\n\nTwo"


def _pages(spark, pages):
    return spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_article_without_its_element(spark):
    """A host that has no article element: the template's deepest element with the bulk of the free text."""
    story = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    own = lambda i: (PAGE % ("div", i, "div")).replace("First", f"First {i} {story(i)}").replace("Second", f"Second {i}").replace("One", f"One {i}").replace("Two", f"Two {i}")
    got = {r["page_id"]: r["text"] for r in extract(_pages(spark, [own(i) for i in range(6)])).collect()}
    assert got == {i: f"Tom & Jerry {i}\n\nFirst {i} {story(i)} line\n\nSecond {i} <b> part\n\nOne {i}\n\nTwo {i}" for i in range(6)}


def test_template_decides_where_tags_say_nothing(spark):
    """Pages whose article, menu, footer and advert are plain divs with names that mean nothing: the slot comes from the
    classes alone, and the texts are those of the pages as they were."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    html = F.col("html")
    for tag, name in (("article", "xa"), ("nav", "xb"), ("footer", "xc")):
        html = F.replace(F.replace(html, F.lit(f"<{tag}>"), F.lit(f'<div class="{name}">')), F.lit(f"</{tag}>"), F.lit("</div>"))
    blind = pages.withColumn("html", F.replace(html, F.lit('class="ad"'), F.lit('class="xd"')))
    many = pages.withColumn("host", host(F.col("url"))).groupBy("host").count().where("count >= 5").select("host")
    got = [(r["text"], r["html"], want[r["page_id"]]) for r in extract(blind).join(blind.withColumn("host", host(F.col("url"))).join(many, "host").select("page_id", "html"), "page_id").collect()]
    assert len(got) > 100 and sum(t == w for t, _, w in got) > 0.97 * len(got)
    assert sum(blocks(parse(h), None) == w for _, h, w in got) == 0


def _tokens(pages):
    made = {}
    for k, page in enumerate(pages):
        for i, (above, token, n, free, link, off) in tokens_of(page).items():
            t = made.setdefault(i, {"id": i, "above": above, "token": token, "vector": [0] * len(pages), "each": 0, "free": 0, "link": 0, "off": False})
            t["vector"][k] = n
            t["each"], t["free"], t["link"], t["off"] = max(t["each"], n), t["free"] + free, t["link"] + link, t["off"] or off
    return made


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>same</p>", "<p>%d</p>", "<div class='box'><b>b</b><i>%d</i></div>", "<ul><li>%d<li>x</ul>", "<h1>%d</h1>"]), max_size=6), min_size=4, max_size=7))
def test_classes_against_brute_force(lists):
    """Texts of the template: those whose occurrence vector at least three tokens share, as are all elements' around them."""
    pages = ["<html><body><main>" + "".join(x % (100 * i + k) if "%" in x else x for k, x in enumerate(own)) + f"<p>{'word ' * 9}{i}</p></main></body></html>" for i, own in enumerate(lists)]
    made, many = _tokens(pages), len(pages)
    of = lambda t: tuple(t["vector"])
    likely = {i: t for i, t in made.items() if sum(n > 0 for n in t["vector"]) >= SUPPORT * many}
    sizes = Counter(of(t) for t in likely.values())

    want = sorted(i for i, t in likely.items() if t["token"] is None and sizes[of(t)] >= 3 and sum(n > 0 for n in t["vector"]) >= 0.6 * many)
    rows = [{**t, "pages": sum(n > 0 for n in t["vector"]), "a": hash(of(t)), "b": 0} for t in likely.values()]
    got = template_of(rows, many)
    assert got is None or got["texts"] == want


def test_recurring_texts_go_and_rare_ones_stay(spark):
    """In the article, a line of the site that every page has goes; one that a few stories have stays, as does the story of
    pages that are copies of one another."""
    story = lambda i: f"<h1>Title {i}</h1><p>" + " ".join(f"w{i}x{k}" for k in range(50)) + "</p>"
    made = lambda inner: f"<html><body><div class='a'><a href='/'>Home</a></div><article>{inner}<p>Read our terms</p></article></body></html>"
    pages = [made(story(i) + ("<p>Under a free license</p>" if i % 3 == 0 else "")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract(_pages(spark, pages)).collect()}
    assert all("terms" not in t and "Home" not in t and f"Title {i}" in t and ("license" in t) == (i % 3 == 0) for i, t in got.items())
    copies = [made(story(0))] * 9 + [made(story(i)) for i in range(1, 4)]
    got = {r["page_id"]: r["text"] for r in extract(_pages(spark, copies)).collect()}
    assert all("w0x0" in got[i] for i in range(9)) and all(f"w{i}x0" in got[8 + i] for i in range(1, 4))


def test_names_that_only_sound_like_furniture():
    for name in ("social-history", "related-work", "notice-period", "search-result", "has-sidebar", "adverb"):
        assert read(f'<article><p>One</p><div class="{name}"><p>Two</p></div></article>', None) == "One\n\nTwo", name
    for name in ("comments", "cookie-notice", "share-buttons", "related-posts", "ad"):
        assert read(f'<article><p>One</p><div class="{name}"><p>Two</p></div></article>', None) == "One", name
    teaser = f"<body><p>{'story ' * 40}</p><article>Teaser</article></body>"
    assert read(teaser, None).startswith("story") and read(teaser, None).endswith("Teaser")


def test_deep_and_long_pages_take_time_by_length():
    deep = "<div>" * 20_000 + "<p>deep" + "</div>" * 20_000 + "<p>end"
    began = time.process_time()
    assert read(deep, None) == "deep\n\nend"
    assert len(tokens_of("<ul><li>" * 20_000)) == 40_000 and read("<p>word<b>" * 20_000, None).count("word") == 20_000
    assert time.process_time() - began < 10


def test_pages_odd_rows(spark):
    deep = "<div>" * 300 + "<article><p>deep</p>" + "<p " * 50
    pages = [(1, None, None, 1), (2, "", "", 1), (3, "not a url", "plain text", 1), (4, "http://x/", deep, 1), (4, "http://x/", deep, 1), (None, "http://y/", "<article><p>a<p>b</article", 1), (6, "http://y/", "<article>" + "<p>word word</p>" * 20000, 1), (7, "http://z/", "<p>a < b & c &#x41;</p><br/><p/>", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path int")
    got = {r["page_id"]: r for r in extract(df).collect()}
    assert extract(df).count() == 8
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "plain text" and got[4]["text"] == "deep"
    assert got[None]["text"] == "a\n\nb" and got[6]["n_chars"] == 20000 * 9 + 19999 * 2
    assert got[7]["text"] == "a < b & c A"
    assert extract(df.limit(0)).count() == 0


def test_classes_of_wrappers_hide_no_article():
    for name in ("layout has-sidebar", "no-sidebar", "with-ads", "post-comments-open", "search-result", "sidebar", "widget-area"):
        assert read(f'<body><div class="{name}"><article><p>Text</p></article></div>', None) == "Text", name
    page = '<main><p>Text</p><div class="comments"><article><p>Reader</p></article></div><div class="cookie-notice">We</div></main><aside><article><p>Card</p></article></aside>'
    assert read(page, None) == "Text"


def test_templates_beyond_what_is_sent(spark, monkeypatch):
    """Joined by host and part instead of sent to all tasks, templates give the same texts."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(tuple(r) for r in extract(pages).collect())
    monkeypatch.setattr(html_extract, "SENT", 0)
    assert sorted(tuple(r) for r in extract(pages).collect()) == want


def test_profiles_in_steps(monkeypatch):
    """The vectors of many n-grams, added up in steps without being kept, are those of the definition."""
    from loomgraph.llm import language_id

    rng = np.random.default_rng(2)
    text = "".join(chr(0x4E00 + c) for c in rng.integers(0, 900, 3000)) + " ab, abc"
    want = None
    for few, step in ((1 << 16, 1 << 13), (10, 100)):
        monkeypatch.setattr(language_id, "FEW", few)
        monkeypatch.setattr(language_id, "STEP", step)
        profiles = language_id.Profiles()
        found, number, _, letters = profiles.counted([text])
        counts = np.bincount(number)
        got = found.bundle(np.arange(len(counts)), counts)
        want = got if want is None else want
        assert np.allclose(got, want) and letters[0] == 3005
    chars, total = [0, *(ord(c) for c in text[:3000]), 0, 97, 98, 0, 97, 98, 99, 0], np.zeros(512)
    for a, b, c in zip(chars, chars[1:], chars[2:], strict=False):
        x, y, z = (profiles.letters.vector(k).astype(int) for k in (a, b, c))
        total += z * np.roll(y, 1) * np.roll(x, 2)
    assert np.allclose(want, total)
