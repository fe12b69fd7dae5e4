"""HTML extraction by equivalence classes of tokens over the pages of a host.

A token is an element at its place (the path of tags and names from the page's root) or a text at such a place. Tokens that
occur equally often on every page of a host, their occurrence vectors being equal, are a class. Classes that are large
enough, on enough pages and nested in one another are the host's template. Its texts belong to the site, not to the page;
of its elements, the deepest that holds the bulk of what remains is the slot of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut

#: Elements by what they mean for the text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style noscript template iframe object svg math canvas audio video select datalist textarea button".split())
ASIDE = set("nav aside form dialog menu footer".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes, up to the nearest of the elements behind it.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select"), "body": ("head", "html")}
CLOSES = {k: (set(a.split()), set(b.split())) for k, (a, b) in CLOSES.items()}
_PARAGRAPH = ({"p"}, {"td", "th", "li", "table", "body", "button"})
#: Words of names and roles of what is not the article, and words that say nothing beside them. A name marks only if all
#: its words are of these, so related-work and social-history don't.
MARKS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations comment comments reply replies respond disqus discussion footer masthead topbar toolbar skip search complementary contentinfo".split())
PLAIN = set("area articles bar block bottom box button buttons container form group icons inner item items left links list outer panel posts right section stories thread top wrap wrapper".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)|[^<]++|<", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_LETTER = re.compile(r"[^\W\d_]")

#: Share of a host's pages that a token of its template is on at least, and that a text of it is on; tokens that a class has
#: at least; pages that a host with a template has at least.
SUPPORT, TEXT_SUPPORT, LEAST, PAGES = 0.3, 0.6, 3, 4
#: Share of a host's text that the article's slot holds; share of links from which a recurring block is a menu.
BULK, LINKS = 0.8, 0.8
#: Bytes of all templates up to which they are sent to every task; beyond, they are joined.
SENT = 32 << 20
#: Places that a task remembers the numbers of.
_PLACES = 1 << 18


class Node:
    __slots__ = ("id", "above", "tag", "token", "off", "fenced", "hidden", "link", "main")

    def __init__(self, id_: int, above: Node | None, tag: str, token: str, marked: bool, main: bool):
        self.id, self.above, self.tag, self.token = id_, above, tag, token
        self.fenced = tag in ASIDE
        self.off = self.fenced or marked
        self.hidden = tag in HIDDEN or bool(above and above.hidden)
        self.link = tag == "a" or bool(above and above.link)
        self.main = main


_places: dict[tuple[int, str], int] = {}


def place(above: int, token: str) -> int:
    """The number of a token below another: 64 bits of their hash."""
    key = (above, token)
    if key not in _places:
        if len(_places) >= _PLACES:
            _places.clear()
        _places[key] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), above & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
    return _places[key]


def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(token, whether its names mark it, whether it is an article or the page's main element)."""
    names, roles = [], []
    for m in _NAMED.finditer(attributes) if "=" in attributes else ():
        (roles if m[1].lower() == "role" else names).extend((m[2] or m[3] or m[4] or "").lower().split())
    words = [_WORD.findall(t) for t in names + roles]
    marked = any(w and MARKS.intersection(w) and all(x in MARKS or x in PLAIN for x in w) for w in words) and tag not in ("html", "body", "article", "main")
    return ".".join([tag, *sorted({"-".join(w) for w in words if w})]), marked, tag in ("article", "main") or "main" in roles or "article" in roles


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """The elements in page order, and the runs of text: (element, text, whether a block ends before it).

    Tags close as in HTML: a paragraph at the next block, list items and cells at the next of them, the rest at its own end
    tag or that of an element around it. Unknown and unmatched end tags, comments and declarations are skipped.
    """
    root = Node(0, None, "", "", False, False)
    stack, open_, nodes, texts, fresh, at = [root], Counter(), [root], [], True, 0

    def close(closed: set[str], limit: set[str]) -> None:
        if not any(open_[t] for t in closed):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in closed:
                for n in stack[i:]:
                    open_[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in limit:
                return

    while (m := _TOKEN.match(page, at)) is not None and at < len(page):
        at = m.end()
        raw, tag = m[0], m[2]
        if tag is None:
            if raw[0] != "<" or raw == "<":
                texts.append((stack[-1], raw, fresh))
                fresh = False
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                while True:
                    shut = stack.pop().tag
                    open_[shut] -= 1
                    if shut == tag:
                        break
            fresh |= tag in BLOCK
            continue
        if tag in BLOCK:
            close(*_PARAGRAPH)
        if tag in CLOSES:
            close(*CLOSES[tag])
        token, marked, main = _named(tag, m[3])
        above = stack[-1]
        node = Node(place(above.id, token), above, tag, token, marked, main)
        nodes.append(node)
        fresh |= tag in BLOCK
        if tag == "br":
            texts.append((above, "\n", fresh))
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return nodes, texts


def _text_place(node: Node, text: str) -> int:
    """The number of a text at its place; 0 for one without letters, which is no token."""
    return xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"), node.id & 0xFFFFFFFFFFFFFFFF) - (1 << 63) if _LETTER.search(text) else 0


def _kept(nodes: list[Node], template: dict | None) -> dict[Node, bool]:
    """Whether the text right below an element is of the article, by the template or, without one, by tags and names."""
    inside: dict[Node, tuple[bool, bool, bool, bool]] = {nodes[0]: (template is None, False, False, False)}  # (in the slot, dropped, fenced, below an article)
    for n in nodes[1:]:
        slot, gone, fenced, main = inside[n.above]
        if template and n.id in template["roots"]:
            slot, gone, main = True, False, True
        elif n.main and not main and not fenced and not template:  # a name around an article doesn't hide it
            gone, main = False, True
        elif n.off and not (template and n.id in template["open"]) or template and n.id in template["drop"] or n.tag == "header" and not main:
            gone, fenced = True, fenced or n.fenced
        inside[n] = slot, gone, fenced, main
    return {n: slot and not gone and not n.hidden for n, (slot, gone, _, _) in inside.items()}


def blocks(parsed: tuple[list[Node], list[tuple[Node, str, bool]]], template: dict | None) -> str:
    """The article's blocks. With a template: what its slot holds, but for blocks of nothing but its texts; else what tags
    and names leave, of article and main elements only if these hold half of it."""
    nodes, texts = parsed
    kept = _kept(nodes, template)
    size = lambda runs: sum(len(t.strip()) for _, t, _ in runs)
    own = [x for x in texts if kept[x[0]]]
    fixed: set[tuple[Node, str]] = set()
    if template and template["texts"]:
        said = [x for x in own if _text_place(x[0], x[1]) in template["texts"]]
        if 2 * size(said) <= size(own):  # else the story is a copy of that of most pages
            fixed = {x[:2] for x in said}
    only: set[Node] = set()
    if not template:
        below: set[Node] = set()
        for n in nodes:
            if n.main or n.above in below:
                below.add(n)
        if 2 * size([x for x in own if x[0] in below]) >= size(own):
            only = below
    out: list[list[str]] = []
    free: list[bool] = []  # whether a block has a text that isn't the template's
    begin = True
    for node, text, fresh in texts:
        begin |= fresh
        if not kept[node] or only and node not in only:
            continue
        if begin or not out:
            out.append([])
            free.append(False)
            begin = False
        out[-1].append(text)
        free[-1] |= (node, text) not in fixed and bool(text.strip())
    return "\n\n".join(x for x in (" ".join(html.unescape("".join(t)).split()) for t, own in zip(out, free, strict=True) if own) if x)


def template_of(tokens: list[dict], pages: int) -> dict | None:
    """The template of a host, from its tokens (id, above, token, pages, a, b, each, total, free, link, off); text tokens
    have no `token`, and free is their length. None if it has no slot for an article.

    Tokens with one occurrence vector are a class. A class is valid if it has LEAST tokens; the valid ones, each nested in
    the slots of those around it, are the template. texts are its texts on enough pages. The slot is the deepest element that occurs
    once a page and holds BULK of the free text: that neither linked nor hidden, nor the template's own, nor in an element
    marked as something else, unless that one holds the bulk itself. Where it lies within an article or main element or
    next to a heading of the template, these belong to it. drop are recurring blocks that are nearly all links.
    """
    by_vector = Counter((t["pages"], t["a"], t["b"]) for t in tokens)
    known = {t["id"]: t for t in tokens}
    valid: dict[int, dict] = {}

    for t in sorted(tokens, key=lambda t: (-t["pages"], t["id"])):
        if by_vector[t["pages"], t["a"], t["b"]] >= LEAST:
            valid[t["id"]] = t
    # elements of no class, which repeat as often as the page has something to say, are within a class's slot: what lies
    # below them hangs on the nearest element of a class
    for i, t in valid.items():
        above = t["above"]
        while above and above not in valid and above in known:
            above = known[above]["above"]
        valid[i] = {**t, "above": above}
    places = {i: t for i, t in valid.items() if t["token"] is not None}
    texts = {i for i, t in valid.items() if t["token"] is None and t["pages"] >= TEXT_SUPPORT * pages}
    free = {i: t["free"] for i, t in places.items()}

    def without(i: int, mass: int) -> None:
        while i in free:
            free[i] -= mass
            i = places[i]["above"]

    for i in texts:
        without(valid[i]["above"], valid[i]["free"])
    total = max(free.values(), default=0)
    off, opened = [], set()
    for i, t in sorted(places.items(), key=lambda x: -free[x[0]]):
        if t["off"]:
            (opened.add if 2 * free[i] >= total else off.append)(i)
    outer = set(off)

    def below(i: int, some: set[int]) -> bool:
        while i in places:
            i = places[i]["above"]
            if i in some:
                return True
        return False

    for i in off:
        if not below(i, outer):
            without(places[i]["above"], free[i])
    total = max(free.values(), default=0)
    depth = {}
    for i in places:
        chain = []
        while i in places and i not in depth:
            chain.append(i)
            i = places[i]["above"]
        at = depth.get(i, 0)
        for x in reversed(chain):
            at += 1
            depth[x] = at
    tag = lambda i: places[i]["token"].partition(".")[0]
    likely = [i for i in places if total > 0 and free[i] >= BULK * total and places[i]["each"] == 1 and tag(i) in BLOCK and i not in outer and not below(i, outer)]
    if not likely:
        return None
    root = max(likely, key=lambda i: (depth[i], i))
    i = root
    while i in places:
        if tag(i) in ("article", "main") or "main" in places[i]["token"].split(".")[1:]:
            root = i
            break
        i = places[i]["above"]
    roots = [root]
    if tag(root) not in ("article", "main", "body"):
        roots += [i for i, t in places.items() if t["above"] == places[root]["above"] and tag(i) == "h1" and t["each"] == 1]
    drop = [i for i, t in places.items() if t["link"] > LINKS * max(1, t["free"] + t["link"]) and tag(i) in BLOCK and t["pages"] >= TEXT_SUPPORT * pages and below(i, {root})]
    return {"roots": sorted(roots), "drop": sorted(drop), "open": sorted(opened), "texts": sorted(texts)}


_TOKENS = {"host": pa.string(), "page": pa.int64(), "id": pa.int64(), "above": pa.int64(), "token": pa.string(), "n": pa.int32(), "free": pa.int64(), "link": pa.int64(), "off": pa.bool_()}


def tokens_of(page: str) -> dict[int, list]:
    """By number: [above, token, occurrences, characters below it that are neither hidden nor linked, those linked, off]."""
    nodes, texts = parse(page)
    free, link = Counter(), Counter()
    out: dict[int, list] = {}
    for node, text, _ in texts:
        n = len(text.strip())
        if n and not node.hidden:
            (link if node.link else free)[node] += n
            if i := _text_place(node, text):
                out.setdefault(i, [node.id, None, 0, 0, 0, False])[2] += 1
                out[i][3 + node.link] += n
    for node in reversed(nodes[1:]):
        free[node.above] += free[node]
        link[node.above] += link[node]
    for node in nodes[1:]:
        own = out.setdefault(node.id, [node.above.id, node.token, 0, 0, 0, node.off])
        own[2] += 1
        own[3] += free[node]
        own[4] += link[node]
    return out


def deduce(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, roots, drop, open, texts) for each host of pages (page, host, html) that has a template.

    A page gives a row for each of its tokens, however often it occurs. Vectors are compared by two sums over hashes of
    (page, occurrences), so no task holds a host's pages, and a host's tokens are added up before they are dealt; of them,
    only those on enough of its pages meet in a task: at most 1 / support times the tokens of an average page.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for page, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows.extend((name, page, i, *t) for i, t in tokens_of(text.as_py()).items())
                if len(rows) >= 100_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_TOKENS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TOKENS.values(), strict=True)], list(_TOKENS))

    rows = pages.select("page", "host", "html").mapInArrow(task, "host string, page long, id long, above long, token string, n int, free long, link long, off boolean")
    h, low = F.xxhash64("page", "n"), (1 << 30) - 1
    tokens = rows.withColumn("h", h).groupBy("host", "id").agg(
        F.min("above").alias("above"), F.min("token").alias("token"), F.count("*").alias("pages"), F.sum(F.col("h").bitwiseAND(F.lit(low))).alias("a"), F.sum(F.shiftrightunsigned("h", 34)).alias("b"),
        F.max("n").alias("each"), F.sum("free").alias("free"), F.sum("link").alias("link"), F.max("off").alias("off"),
    )
    size = pages.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= PAGES)
    likely = tokens.join(size, "host").where(F.col("pages") >= F.col("of") * support)

    def template(table: pa.Table) -> pa.Table:
        own = table.to_pylist()
        made = template_of(own, own[0]["of"])
        longs = pa.list_(pa.int64())
        return pa.table({"host": pa.array([own[0]["host"]][: bool(made)], pa.string()), **{k: pa.array([made[k]] if made else [], longs) for k in ("roots", "drop", "open", "texts")}})

    return likely.groupBy("host").applyInArrow(template, "host string, roots array<long>, drop array<long>, open array<long>, texts array<long>")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _ready(template: dict | None) -> dict | None:
    return {k: set(template[k]) for k in ("roots", "drop", "open", "texts")} if template else None


def read(page: str, template: dict | None) -> str:
    """The article of a page; one that has no slot of its host's template is read by its own elements."""
    parsed = parse(page)
    return blocks(parsed, template if template and any(n.id in template["roots"] for n in parsed[0]) else None)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT) -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars.

    text is the article, whole: its blocks in page order, joined by two newlines, with character references decoded and
    white space within a block as single spaces; n_chars counts its code points. Null and empty pages give ''. Pages
    without a host share one template; hosts with fewer than PAGES pages have none. Very long and deep pages are read
    whole, in time that follows their length; rows alike are kept; other columns are ignored; an empty table gives an
    empty result. The pages themselves aren't dealt: the templates come to them, or, beyond SENT bytes, are joined with
    each host's pages in 64 parts.
    """
    text = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), text.alias("html"))
    names = ["roots", "drop", "open", "texts"]
    templates = cut(deduce(base.withColumn("page", F.xxhash64("page_id", "html")), support))
    held = templates.agg(F.sum(F.length("host") + 8 * sum(F.size(c) for c in names))).first()[0] or 0
    if held <= SENT:
        table = templates.toArrow().to_pylist()
        shared = pages.sparkSession.sparkContext.broadcast({t["host"]: t for t in table})
        joined = base.select("page_id", "url", "html", "host")
    else:
        shared = None
        part = F.pmod(F.xxhash64("page_id", "html"), F.lit(64))
        dealt = templates.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("part"), F.struct(*names).alias("template"))
        joined = base.withColumn("part", part).join(dealt, ["host", "part"], "left").select("page_id", "url", "html", "host", "template")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, dict | None] = {}
        for b in batches:
            texts = []
            for i, (page, name) in enumerate(zip(b.column(2), b.column(3).to_pylist(), strict=True)):
                if name not in ready:
                    ready = {} if len(ready) > 1000 else ready
                    ready[name] = _ready(shared.value.get(name) if shared else b.column(4)[i].as_py())
                texts.append(read(page.as_py(), ready[name]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(task, "page_id long, url string, text string, n_chars long")
