"""Records as triples: product disclosures and statutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.functions.text import iso_date, slug
from loomgraph.plans.materialize import settled
from loomgraph.plans.spread import spread
from loomgraph.sources.records import display_names

#: Classes by kind of disclosure, the overdraft class, and what codes of exclusion mean.
CLASSES = {"deposit": "TimeDepositProduct", "saving": "InstallmentSavingsProduct", "mortgage": "MortgageLoanProduct", "rent": "JeonseLoanProduct", "credit": "CreditLoanProduct"}
OVERDRAFT = "OverdraftProduct"
JOIN_DENY = {"1": "제한없음", "2": "서민전용", "3": "일부제한"}
#: Triples that a product (with its bank's) and an option make at most.
OF_PRODUCT, OF_OPTION = 15, 8


def _plain(s: Column, p: str, o: Column) -> Column:
    return X.triple(s, p, o)


def disclosures_to_triples(products: DataFrame, options: DataFrame, spaces: dict[str, str], source_note: str | None = None) -> DataFrame:
    """The triples of disclosures. spaces: namespaces market, data, products, parties.

    Banks and products are named after their codes, so products that share a code are one node; the first record of a
    bank names it. An option's IRI ends with its place in its file; options without a product are left out. Of credit
    options, only rows of lending rates are described, but all are linked. Records are written once and dealt to so many
    tasks that the triples that one makes, and those that one tells apart, don't grow in number with the records.
    """
    products, options = settled(products), settled(options)
    of_all, of_each = OF_PRODUCT * products.count(), OF_OPTION * options.count()
    m, d, pr, pa = spaces["market"], spaces["data"], spaces["products"], spaces["parties"]
    bank = F.concat(F.lit(f"{d}bank_"), slug(F.col("fin_co_no")))
    product = F.concat(F.lit(f"{d}prdt_"), slug(F.col("fin_co_no")), F.lit("_"), slug(F.col("fin_prdt_cd")))
    p = spread(display_names(products).withColumns({"bank": bank, "product": product}), of_all, "product", "pos")
    cls = F.when((F.col("kind") == "credit") & (F.col("crdt_prdt_type") == "2"), pr + OVERDRAFT)
    for kind, name in CLASSES.items():
        cls = cls.when(F.col("kind") == kind, pr + name)
    deny = F.element_at(F.create_map(*[F.lit(x) for kv in JOIN_DENY.items() for x in kv]), F.trim(F.coalesce("join_deny", F.lit(""))))
    s = F.col("product")
    of_products = X.as_triples(
        p,
        X.triple(s, X.TYPE, cls, kind="iri"),
        _plain(s, pr + "hasProductName", F.col("display_name")),
        _plain(s, pr + "hasProductCode", F.col("fin_prdt_cd")),
        X.triple(s, pr + "isOfferedBy", F.col("bank"), kind="iri"),
        *[_plain(s, m + name, F.col(c)) for name, c in (("disclosureMonth", "dcls_month"), ("joinWay", "join_way"), ("joinMember", "join_member"), ("preferentialCondition", "spcl_cnd"), ("etcNote", "etc_note"))],
        _plain(s, m + "joinDenyNote", deny),
        _plain(s, m + "maxLimitNote", F.coalesce(F.nullif(F.nullif("max_limit", F.lit("")), F.lit("0")), "loan_lmt")),
        _plain(s, m + "sourceNote", F.lit(source_note).cast("string")),
    )
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("kind"))
    banks = p.groupBy("bank").agg(F.min(F.struct(rank.alias("r"), "pos", "kor_co_nm", "fin_co_no")).alias("x")).select("bank", "x.*")
    b = F.col("bank")
    of_banks = X.as_triples(banks, X.triple(b, X.TYPE, F.lit(pa + "Bank"), kind="iri"), _plain(b, pa + "hasName", F.col("kor_co_nm")), _plain(b, m + "finCompanyNo", F.col("fin_co_no")))

    record = ["kind", "fin_co_no", "fin_prdt_cd"]
    known = spread(p.select(*record, "product"), of_all, *record).distinct()
    o = spread(options, of_each, *record).join(known, record).withColumn("option", F.concat("product", F.lit("_opt"), F.col("pos").cast("string")))
    o = spread(o, of_each, "option")
    links = X.as_triples(o, X.triple(s, m + "hasRateOption", F.col("option"), kind="iri"))
    x = F.col("option")
    rate = lambda name, c: X.triple(x, m + name, F.regexp_replace(F.col(c).cast("string"), r"(\.\d*?[1-9])0+$|\.0+$", "$1"), dt=X.XSD + "decimal")
    saves = X.as_triples(o.where("kind IN ('deposit', 'saving')"), X.triple(x, X.TYPE, F.lit(m + "RateOption"), kind="iri"), X.triple(x, m + "termMonths", F.col("save_trm").try_cast("int"), dt=X.XSD + "integer"), rate("baseRateValue", "intr_rate"), rate("maxPreferentialRateValue", "intr_rate2"), _plain(x, m + "interestCalcType", F.col("intr_rate_type_nm")), _plain(x, m + "reserveType", F.col("rsrv_type_nm")))
    lends = X.as_triples(o.where("kind IN ('mortgage', 'rent')"), X.triple(x, X.TYPE, F.lit(m + "LendRateOption"), kind="iri"), *[_plain(x, m + n, F.col(c)) for n, c in (("lendRateTypeName", "lend_rate_type_nm"), ("repaymentTypeName", "rpay_type_nm"), ("mortgageTypeName", "mrtg_type_nm"))], rate("lendRateMin", "lend_rate_min"), rate("lendRateMax", "lend_rate_max"), rate("lendRateAvg", "lend_rate_avg"))
    credits = X.as_triples(o.where("kind = 'credit' AND crdt_lend_rate_type = 'A'"), X.triple(x, X.TYPE, F.lit(m + "LendRateOption"), kind="iri"), rate("lendRateAvg", "crdt_grad_avg"))
    out = of_products
    for more in (of_banks, links, saves, lends, credits):
        out = out.unionByName(more)
    return X.distinct_triples(out, of_all + of_each)


def statutes_to_triples(laws: DataFrame, spaces: dict[str, str]) -> DataFrame:
    """The triples of statutes and their articles, linked both ways. spaces: namespaces regs and data."""
    r, d = spaces["regs"], spaces["data"]
    law = F.concat(F.lit(f"{d}law_"), F.col("slug"))
    heads = X.as_triples(laws, X.triple(law, X.TYPE, F.lit(r + "Statute"), kind="iri"), X.triple(law, X.LABEL, F.col("name"), lang="ko"), _plain(law, r + "lawType", F.col("law_type")), _plain(law, r + "ministry", F.col("ministry")), X.triple(law, r + "effectiveDate", iso_date(F.col("effective_date")), dt=X.XSD + "date"))
    a = laws.select("name", law.alias("law"), "slug", F.posexplode("articles").alias("pos", "a")).select("name", "law", "a.*", F.concat(F.lit(f"{d}art_"), "slug", F.lit("_"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("art"))
    n, title = F.col("art"), F.coalesce("title", F.lit(""))
    label = F.concat(F.lit("「"), F.col("name"), F.lit("」 "), F.col("label"), F.when(title != "", F.concat(F.lit("("), title, F.lit(")"))).otherwise(""))
    body = X.as_triples(a, X.triple(n, X.TYPE, F.lit(r + "LegalArticle"), kind="iri"), X.triple(n, X.LABEL, label, lang="ko"), _plain(n, r + "articleLabel", F.col("label")), _plain(n, r + "articleTitle", title), _plain(n, r + "articleText", F.col("text")), X.triple(n, r + "belongsToStatute", F.col("law"), kind="iri"), X.triple(F.col("law"), r + "hasArticle", n, kind="iri"))
    return X.distinct_triples(heads.unionByName(body))
