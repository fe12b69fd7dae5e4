"""REST interfaces as data sources: pages of product disclosures, and statutes by name."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.plans.materialize import settled
from loomgraph.sources.records import BASE, OPTION, RATES, STATUTE, _struct

#: The endpoints by kind of disclosure, and the code of an answer without an error.
ENDPOINTS = {
    "deposit": "depositProductsSearch.json",
    "saving": "savingProductsSearch.json",
    "mortgage": "mortgageLoanProductsSearch.json",
    "rent": "rentHouseLoanProductsSearch.json",
    "credit": "creditLoanProductsSearch.json",
}
NO_ERROR = "000"
#: Names in answers about statutes.
CURRENT, ARTICLE = "현행", "조문"
TEXTS, BELOW = ["항내용", "호내용", "목내용"], ["항", "호", "목"]
#: How often a request is tried, seconds before the second time (doubled each time), seconds until one is given up.
TRIES, PAUSE, PATIENCE = 4, 0.5, 30


def fetched(url: str, params: dict[str, str]) -> dict:
    """The JSON that a GET answers. Errors of the network and of the server (5xx) are tried again; others are raised."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}")
    for i in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=PATIENCE) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code < 500 or i + 1 == TRIES:
                raise RuntimeError(f"{url}: HTTP {e.code}") from e
        except OSError as e:
            if i + 1 == TRIES:
                raise RuntimeError(f"{url}: {e}") from e
        time.sleep(PAUSE * 2**i)
    raise AssertionError


@dataclass
class Page(InputPartition):
    kind: str
    number: int


class PagedJson(DataSource):
    """format("paged_json"): a partition for each page of each kind. Options: url, auth, group, kinds (with commas; all if
    left out). Rows: kind, page, list (baseList or optionList), at (its place on the page), record (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "kind string, page int, list string, at int, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.auth, self.group = options["url"].rstrip("/"), options.get("auth", ""), options.get("group", "")
        self.kinds = [k for k in options.get("kinds", ",".join(ENDPOINTS)).split(",") if k]

    def _page(self, kind: str, number: int) -> dict:
        answer = fetched(f"{self.url}/{ENDPOINTS[kind]}", {"auth": self.auth, "topFinGrpNo": self.group, "pageNo": str(number)})
        result = answer.get("result") or {}
        if result.get("err_cd") not in (None, "", NO_ERROR):
            raise RuntimeError(f"{kind}, page {number}: error {result['err_cd']} {result.get('err_msg') or ''}")
        return result

    def partitions(self) -> list[Page]:
        return [Page(kind, i) for kind in self.kinds for i in range(1, max(1, int(self._page(kind, 1).get("max_page_no") or 1)) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        result = self._page(partition.kind, partition.number)
        for name in ("baseList", "optionList"):
            for at, record in enumerate(result.get(name) or []):
                yield partition.kind, partition.number, name, at, json.dumps(record, ensure_ascii=False)


def fetched_disclosures(spark: SparkSession, url: str, auth: str, group: str = "", kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """products and options as records.disclosures() reads them from files: pages are fetched by tasks, once, and written;
    pos counts over a kind's pages."""
    spark.dataSource.register(PagedJson)
    raw = settled(spark.read.format("paged_json").options(url=url, auth=auth, group=group, kinds=",".join(kinds or ENDPOINTS)).load())
    # a row for each page
    before = Window.partitionBy("kind", "list").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("kind", "list", "page").agg(F.count("*").alias("n")).select("kind", "list", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = raw.join(starts, ["kind", "list", "page"]).withColumn("pos", (F.col("start") + F.col("at")).cast("int"))

    def of(name: str, type_) -> DataFrame:
        return placed.where(F.col("list") == name).select("kind", "pos", F.from_json("record", type_).alias("r")).select("kind", "pos", "r.*")

    return of("baseList", _struct(BASE)), of("optionList", _struct(OPTION, RATES))


@dataclass
class Law(InputPartition):
    name: str
    slug: str
    category: str


class StatuteApi(DataSource):
    """format("statute_api"): a partition for each statute. Options: url, user, laws (JSON: lists of name, slug, category)."""

    @classmethod
    def name(cls) -> str:
        return "statute_api"

    def schema(self):
        return STATUTE

    def reader(self, schema) -> DataSourceReader:
        return StatuteReader(dict(self.options))


def _listed(x) -> list:
    """One thing or a list of them, as answers give both."""
    return x if isinstance(x, list) else [] if x is None else [x]


def _words(node: dict) -> Iterator[str]:
    for name in TEXTS:
        if node.get(name):
            yield str(node[name])
    for name in BELOW:
        for child in _listed(node.get(name)):
            yield from _words(child)


class StatuteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.user = options["url"].rstrip("/"), options.get("user", "")
        self.laws = [Law(*x) for x in json.loads(options["laws"])]

    def partitions(self) -> list[Law]:
        return self.laws

    def read(self, partition: Law) -> Iterator[tuple]:
        common = {"OC": self.user, "target": "law", "type": "JSON"}
        found = _listed(fetched(f"{self.url}/lawSearch.do", {**common, "query": partition.name, "display": "50"})["LawSearch"].get("law"))
        now = next((x for x in found if x["법령명한글"] == partition.name and x["현행연혁코드"] == CURRENT), None)
        if now is None:
            raise LookupError(f"no statute in force is called {partition.name}")
        law = fetched(f"{self.url}/lawService.do", {**common, "MST": now["법령일련번호"]})["법령"]
        info, one = law["기본정보"], lambda x: (x or {}).get("content", "")
        articles = [a for a in map(self._article, _listed(law["조문"]["조문단위"])) if a]
        link = f"{urllib.parse.urljoin(self.url, '/').rstrip('/')}{now.get('법령상세링크', '')}"
        yield info["법령명_한글"], partition.slug, partition.category, one(info.get("법종구분")), str(info.get("시행일자", "")), str(info.get("공포일자", "")), one(info.get("소관부처")), str(now["법령일련번호"]), link, self.url, articles

    @staticmethod
    def _article(unit: dict) -> tuple | None:
        """(label, title, text, effective); none for headings and for articles that say no more than that they are deleted."""
        if unit.get("조문여부") != ARTICLE:
            return None
        branch = str(unit.get("조문가지번호") or "")
        label = f"제{unit.get('조문번호', '')}조" + (f"의{branch}" if branch not in ("", "0") else "")
        own = [str(unit.get("조문내용") or ""), *(w for x in _listed(unit.get("항")) for w in _words(x))]
        text = re.sub(r"<[^>]+>", "", "\n".join(w for w in own if w))
        if "삭제" in text[:30] and len(text) < 40:
            return None
        return label, str(unit.get("조문제목") or "").strip(), text, str(unit.get("조문시행일자") or "")


def fetched_statutes(spark: SparkSession, url: str, user: str, laws: list[tuple[str, str, str]]) -> DataFrame:
    """Statutes as records.statutes() reads them from files, each fetched by a task, once, and written."""
    spark.dataSource.register(StatuteApi)
    return settled(spark.read.format("statute_api").options(url=url, user=user, laws=json.dumps([list(x) for x in laws], ensure_ascii=False)).load())
