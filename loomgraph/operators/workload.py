"""Questions with answers that a query computes: a frame for each template, and their selection into a set.

Every template is a pipeline over products (kind, bank, name, code, join_way, join_member, spcl_cnd, etc_note, max_limit)
and their options, or over statutes. It yields (template, kind, ord, parts, answer_type, answer, unit, locator, text): ord
sorts the rows of a template, parts are what a wording is filled with. Products are in the order of (kind, bank, code), a
product's options in that of their fields, so that 'the first' is well defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import iso_date, least_age, listed, particle, short_number, squeezed, thousands, variant
from loomgraph.operators.rules import CHANNELS
from loomgraph.sources.records import display_names

TAX = "0.154"
RATE_TYPES = ["고정금리", "변동금리"]
#: How statutes write a term of prison, a fine and its kind, and a definition.
PRISON, FINE = r"(\d+)년 이하의 징역", r"(\d+(?:억|천만|백만)?원) 이하의 (벌금|과태료)"
DEFINED = r'"([^"]{2,25})"(?:이?란|이라 함은)\s*([^\n]{15,180}?)(?:를|을) 말한다'
#: Wordings: {0}, {1} ... are the parts of a row. Others can be given to word().
WORDINGS: dict[str, list[str]] = {
    "base_rate_lookup": [
        "{0}의 12개월 기본금리는 몇 %인가?",
        "12개월 만기일 때 {0}의 기본금리(%)를 답하시오.",
        "{0}, 1년을 맡기면 기본금리는 연 몇 %인가?",
    ],
    "max_rate_lookup": [
        "{0}의 {1}개월 최고 우대금리는 몇 %인가?",
        "{1}개월 만기 {0}의 우대금리는 최고 몇 %까지인가?",
        "우대 조건을 다 채우면 {0}의 {1}개월 금리는 몇 %가 되는가?",
    ],
    "rate_threshold": [
        "{0}의 {1}개월 최고 우대금리는 {2}% 이상인가?",
        "{1}개월 만기 {0}의 우대금리가 최고 {2}%에 이르는가?",
        "{0}을(를) {1}개월 유지하고 우대를 모두 받으면 {2}% 이상을 받는가?",
    ],
    "join_way": [
        "{0}에 {1}(으)로 가입할 수 있는가?",
        "{1}(으)로 {0} 가입이 되는가?",
        "{0}의 가입 경로에 {1}이(가) 들어 있는가?",
    ],
    "age_condition": [
        "만 {1}세는 {0}의 나이 요건을 충족하는가?",
        "{0}의 나이 조건에 만 {1}세가 맞는가?",
        "만 {1}세인 사람은 나이로 보아 {0}에 가입할 수 있는가?",
    ],
    "max_limit_lookup": [
        "{0}의 최고 한도는 얼마인가?",
        "{0}에는 최고 얼마까지 넣을 수 있는가?",
        "{0}의 가입 금액 한도를 답하시오.",
    ],
    "interest_calc_type": [
        "{0}의 이자 계산 방식은 무엇인가?",
        "{0}의 이자는 단리와 복리 중 어느 쪽인가?",
        "{0}의 이자를 어떤 방식으로 계산하는가?",
    ],
    "loan_min_rate": [
        "{0}의 {1} {2} 최저금리는 몇 %인가?",
        "{1} {2} 조건에서 {0}의 금리는 최저 몇 %인가?",
        "{0}, {1} {2}일 때 가장 낮은 금리(%)는?",
    ],
    "loan_rate_type": [
        "{0}에 {1} 방식이 있는가?",
        "{1} 방식으로 {0}을(를) 쓸 수 있는가?",
        "{0}의 금리 방식 가운데 {1}이(가) 있는가?",
    ],
    "credit_avg_rate": [
        "{0}의 평균 대출금리는 몇 %인가?",
        "{0}의 대출금리 평균(%)을 답하시오.",
        "{0}을(를) 쓰는 사람의 금리는 평균 몇 %인가?",
    ],
    "abstain_missing_field": [
        "{0}의 {1}은(는) 무엇인가?",
        "공시된 {0}의 {1}을(를) 답하시오.",
        "{0}에 대해 {1}이(가) 어떻게 공시되어 있는가?",
    ],
    "compare_two_products": [
        "{0}의 '{1}'와(과) '{2}' 중 12개월 최고 우대금리가 높은 것은?",
        "{0}의 두 상품 '{1}', '{2}' 중 12개월 우대금리가 최고로 더 높은 쪽은?",
        "12개월 최고 우대금리로 견주면 {0}의 '{1}', '{2}' 중 어느 것이 앞서는가?",
    ],
    "agg_count": [
        "{0}의 {1} 상품은 몇 개인가?",
        "{0}이(가) 공시한 {1} 상품의 수는?",
        "{1} 상품 가운데 {0}의 것은 모두 몇 개인가?",
    ],
    "agg_superlative": [
        "12개월 최고 우대금리가 가장 높은 {0} 상품은?",
        "{0} 상품 가운데 12개월 우대금리가 최고인 것은 무엇인가?",
        "12개월 우대금리로 보아 으뜸인 {0} 상품의 이름은?",
    ],
    "enumerate_products": [
        "{0}의 {1} 상품을 모두 쓰면?",
        "{0}이(가) 공시한 {1} 상품의 이름을 빠짐없이 쓰시오.",
        "{1} 상품 중 {0}의 것을 하나도 빼지 말고 나열하면?",
    ],
    "calc_interest": [
        "{0}에 {1}원을 12개월 맡기면 세전 이자는 얼마인가?",
        "12개월 동안 {0}에 {1}원을 넣어 두면 세금을 떼기 전 이자는 몇 원인가?",
        "{1}원을 {0}에 1년 예치할 때 기본금리로 받는 세전 이자를 구하시오.",
    ],
    "calc_interest_after_tax": [
        "{0}에 {1}원을 12개월 맡기면 세금 15.4%를 뺀 이자는 얼마인가?",
        "12개월 동안 {0}에 {1}원을 넣어 두면 15.4% 과세 후 이자는 몇 원인가?",
        "{1}원을 {0}에 1년 예치할 때 세율 15.4%를 적용한 세후 이자를 구하시오.",
    ],
    "calc_interest_diff": [
        "{0}와(과) {1}에 10,000,000원씩 12개월 맡기면 세전 이자의 차이는 얼마인가?",
        "10,000,000원을 12개월 맡길 때 {0}와(과) {1}의 세전 이자는 몇 원 차이가 나는가?",
        "{0}, {1}에 각각 10,000,000원을 1년 예치하면 세전 이자가 얼마나 다른가?",
    ],
    "joint_condition": [
        "만 {1}세가 {2}(으)로 {0}에 가입할 때 나이와 경로 요건을 모두 충족하는가?",
        "{2}(으)로 신청하는 만 {1}세는 나이와 경로 모두 {0}의 요건에 맞는가?",
        "{0}: 만 {1}세, 경로 {2}. 두 요건을 다 채우는가?",
    ],
    "article_locate": [
        "「{0}」에서 '{1}'을(를) 정한 조문은 몇 조인가?",
        "'{1}'은(는) 「{0}」의 몇 조에 있는가?",
        "「{0}」에서 제목이 '{1}'인 조문의 번호는?",
    ],
    "definition_term": [
        "「{0}」 {1}에서 “{2}”(이)라고 정의되는 용어는?",
        "「{0}」 {1}이(가) “{2}”(으)로 뜻을 정한 말은 무엇인가?",
        "“{2}” — 「{0}」 {1}에서 이 뜻으로 쓰는 용어는?",
    ],
    "law_meta": [
        "「{0}」의 {1}은(는)?",
        "「{0}」의 {1}을(를) 답하시오.",
        "「{0}」 기본정보에서 {1}은(는) 무엇인가?",
    ],
    "penalty_amount": [
        "「{0}」 {1}의 {2} 상한은?",
        "「{0}」 {1}이(가) 정한 {2}은(는) 최고 얼마인가?",
        "{2}의 상한을 「{0}」 {1}에 따라 답하시오.",
    ],
    "temporal_validity": ["{0}"],
}


def load(products: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products and options as the templates take them, from records as disclosures() reads them."""
    p = display_names(products).select("kind", F.col("kor_co_nm").alias("bank"), F.col("display_name").alias("name"), F.col("fin_co_no").alias("co"), F.col("fin_prdt_cd").alias("code"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("join_way", "join_member", "spcl_cnd", "etc_note", "max_limit")])
    fields = sorted(c for c in options.columns if c not in ("kind", "pos"))
    o = options.join(p.select("kind", F.col("co").alias("fin_co_no"), F.col("code").alias("fin_prdt_cd"), "bank", "name"), ["kind", "fin_co_no", "fin_prdt_cd"])
    n = F.row_number().over(Window.partitionBy("kind", "fin_co_no", "fin_prdt_cd", "name").orderBy(F.to_json(F.struct(*fields)), "pos"))
    return p.withColumn("max_limit", F.trim("max_limit")), o.withColumn("nth", n).withColumn("code", F.col("fin_prdt_cd"))


def _row(template: str, kind: Column, ord_: list, parts: list, answer_type: str, answer: Column, locator: Column, text: Column, unit: str = "") -> list[Column]:
    return [F.lit(template).alias("template"), kind.alias("kind"), F.to_json(F.array(*[F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit("")) for c in ord_])).alias("ord"), F.array(*[(c if isinstance(c, Column) else F.col(c)).cast("string") for c in parts]).alias("parts"), F.lit(answer_type).alias("answer_type"), answer.cast("string").alias("answer"), F.lit(unit).alias("unit"), locator.alias("locator"), text.alias("text")]


_KEY = ["kind", "bank", "code"]


def _label() -> Column:
    return F.concat(F.col("bank"), F.lit(" '"), F.col("name"), F.lit("'"))


def _at(field: str) -> Column:
    return F.concat_ws(":", "bank", "code", F.lit(field))


def term(options: DataFrame, months: int = 12, else_first: bool = False) -> DataFrame:
    """A product's first option of that term; else_first: where there is none, its first option."""
    fits = F.coalesce(F.col("save_trm") == str(months), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("kind", "fin_co_no", "code", "name").orderBy(F.desc(fits), "nth"))
    chosen = options.withColumn("fits", fits).withColumn("rank", rank).where("rank = 1")
    return chosen if else_first else chosen.where("fits")


def rates(options: DataFrame) -> dict[str, DataFrame]:
    """base_rate_lookup, max_rate_lookup, rate_threshold."""
    base = term(options.where("kind = 'deposit'")).where("intr_rate <> 0")
    top = term(options.where("kind IN ('deposit', 'saving')"), else_first=True).where("intr_rate2 <> 0")
    value = short_number(F.col("intr_rate2"))
    probe = F.explode(F.array(F.struct((F.col("intr_rate2") - F.lit("0.2").cast("decimal(3,1)")).alias("at"), F.lit("YES").alias("says")), F.struct((F.col("intr_rate2") + F.lit("0.2").cast("decimal(3,1)")).alias("at"), F.lit("NO").alias("says"))))
    pairs = top.withColumn("x", probe).where("x.at > 0")
    at = F.concat(_at("intr_rate2("), F.col("save_trm"), F.lit("개월)"))
    return {
        "base_rate_lookup": base.select(*_row("base_rate_lookup", F.col("kind"), _KEY, [_label()], "numeric", short_number(F.col("intr_rate")), _at("intr_rate(12개월)"), short_number(F.col("intr_rate")), "%")),
        "max_rate_lookup": top.where("kind = 'saving'").select(*_row("max_rate_lookup", F.col("kind"), _KEY, [_label(), "save_trm"], "numeric", value, at, value, "%")),
        "rate_threshold": pairs.select(*_row("rate_threshold", F.col("kind"), [*_KEY, F.col("x.at")], [_label(), "save_trm", F.round("x.at", 2).cast("decimal(10,2)")], "boolean", F.col("x.says"), at, value)),
    }


def _ways() -> tuple[Column, Column]:
    ways = listed(F.col("join_way"))
    universe = F.array(*map(F.lit, CHANNELS))
    return F.filter(universe, lambda c: F.array_contains(ways, c)), F.filter(universe, lambda c: ~F.array_contains(ways, c))


def _pair(present: Column, absent: Column) -> Column:
    """The first thing that is there and the first that isn't, as far as there are such."""
    return F.explode(F.filter(F.array(F.struct(F.get(present, F.lit(0)).alias("v"), F.lit("YES").alias("says"), F.lit(0).alias("k")), F.struct(F.get(absent, F.lit(0)).alias("v"), F.lit("NO").alias("says"), F.lit(1).alias("k"))), lambda x: x["v"].isNotNull()))


def conditions(products: DataFrame) -> dict[str, DataFrame]:
    """join_way, age_condition, joint_condition, max_limit_lookup, abstain_missing_field."""
    present, absent = _ways()
    age = least_age(F.col("join_member"), "2")
    p = products.withColumns({"present": present, "absent": absent, "age": age})
    ways = p.withColumn("x", _pair(F.col("present"), F.col("absent")))
    ages = p.where("age IS NOT NULL").withColumn("x", F.explode(F.array(F.struct((F.col("age") + 3).alias("v"), F.lit("YES").alias("says"), F.lit(0).alias("k")), F.struct((F.col("age") - 3).alias("v"), F.lit("NO").alias("says"), F.lit(1).alias("k"))))).where("x.v > 0")
    by_way = (F.size("absent") > 0) & (variant([F.lit("joint_no"), F.col("code")], 2) == 0)
    first = F.get("present", F.lit(0))
    no = F.when(by_way, F.struct((F.col("age") + 4).alias("v"), F.get("absent", F.lit(0)).alias("w"), F.lit("NO").alias("says"), F.lit(1).alias("k"))).otherwise(F.struct((F.col("age") - 4).alias("v"), first.alias("w"), F.lit("NO").alias("says"), F.lit(1).alias("k")))
    joint = p.where("age IS NOT NULL AND size(present) > 0").withColumn("x", F.explode(F.array(F.struct((F.col("age") + 4).alias("v"), first.alias("w"), F.lit("YES").alias("says"), F.lit(0).alias("k")), no))).where("x.v > 0")
    limit = p.where("max_limit <> '' AND lower(max_limit) NOT IN ('none', 'null')")
    won = F.when(F.col("max_limit").rlike("^[0-9]+$"), F.concat(thousands(F.regexp_replace("max_limit", r"^0+(?=\d)", "")), F.lit("원"))).otherwise(F.col("max_limit"))
    open_ = p.withColumn("field", F.when(F.col("max_limit") == "", "max_limit").when(F.trim("spcl_cnd") == "", "spcl_cnd")).where("field IS NOT NULL")
    return {
        "join_way": ways.select(*_row("join_way", F.col("kind"), [*_KEY, F.col("x.k")], [_label(), F.col("x.v")], "boolean", F.col("x.says"), _at("join_way"), F.col("join_way"))),
        "age_condition": ages.select(*_row("age_condition", F.col("kind"), [*_KEY, F.col("x.k")], [_label(), F.col("x.v")], "boolean", F.col("x.says"), _at("join_member"), F.col("join_member"))),
        "joint_condition": joint.select(*_row("joint_condition", F.col("kind"), [*_KEY, F.col("x.k")], [_label(), F.col("x.v"), F.col("x.w")], "boolean", F.col("x.says"), _at("join_member,join_way"), F.substring(F.concat("join_member", F.lit(" | "), "join_way"), 1, 200))),
        "max_limit_lookup": limit.select(*_row("max_limit_lookup", F.col("kind"), _KEY, [_label()], "span", won, _at("max_limit"), F.col("max_limit"))),
        "abstain_missing_field": open_.select(*_row("abstain_missing_field", F.col("kind"), _KEY, [_label(), F.when(F.col("field") == "max_limit", "최고 한도").otherwise("우대금리 조건")], "abstain", F.lit("공시에 해당 정보 없음"), F.concat_ws(":", "bank", "code", "field"), F.lit("(공시값 없음)"))),
    }


def option_facts(options: DataFrame) -> dict[str, DataFrame]:
    """interest_calc_type, loan_min_rate, loan_rate_type, credit_avg_rate."""
    per = [*_KEY, "name"]
    kinds = options.where("kind IN ('deposit', 'saving') AND intr_rate_type_nm <> ''").groupBy(*per).agg(F.collect_set("intr_rate_type_nm").alias("t")).where("size(t) = 1")
    one = F.get("t", F.lit(0))
    m, t = F.coalesce("mrtg_type_nm", F.lit("")), F.coalesce("lend_rate_type_nm", F.lit(""))
    loans = options.where("kind IN ('mortgage', 'rent')").withColumns({"m": m, "t": t})
    least = loans.where("t <> '' AND lend_rate_min <> 0").withColumn("k", F.row_number().over(Window.partitionBy(*per, "m", "t").orderBy("nth"))).where("k = 1")
    rate = short_number(F.col("lend_rate_min"))
    offered = loans.groupBy(*per).agg(F.sort_array(F.collect_set(F.nullif("t", F.lit("")))).alias("t"))
    universe = F.array(*map(F.lit, RATE_TYPES))
    pairs = offered.withColumn("x", _pair(F.filter(universe, lambda c: F.array_contains("t", c)), F.filter(universe, lambda c: ~F.array_contains("t", c))))
    credit = options.where("kind = 'credit' AND crdt_lend_rate_type = 'A' AND crdt_grad_avg <> 0").withColumn("k", F.row_number().over(Window.partitionBy(*per).orderBy("nth"))).where("k = 1")
    avg = short_number(F.col("crdt_grad_avg"))
    return {
        "interest_calc_type": kinds.select(*_row("interest_calc_type", F.col("kind"), _KEY, [_label()], "span", one, _at("intr_rate_type_nm"), one)),
        "loan_min_rate": least.select(*_row("loan_min_rate", F.col("kind"), [*_KEY, F.lpad(F.col("nth").cast("string"), 6, "0")], [_label(), "m", "t"], "numeric", rate, F.concat(_at("lend_rate_min("), F.coalesce(F.nullif("m", F.lit("")), F.lit("-")), F.lit("/"), F.col("t"), F.lit(")")), rate, "%")),
        "loan_rate_type": pairs.select(*_row("loan_rate_type", F.col("kind"), [*_KEY, F.col("x.k")], [_label(), F.col("x.v")], "boolean", F.col("x.says"), _at("lend_rate_type_nm"), F.coalesce(F.nullif(F.array_join("t", ", "), F.lit("")), F.lit("없음")))),
        "credit_avg_rate": credit.select(*_row("credit_avg_rate", F.col("kind"), _KEY, [_label()], "numeric", avg, _at("crdt_grad_avg"), avg, "%")),
    }


def aggregates(products: DataFrame, options: DataFrame) -> dict[str, DataFrame]:
    """compare_two_products, agg_count, agg_superlative, enumerate_products."""
    top = term(options.where("kind IN ('deposit', 'saving')")).where("intr_rate2 <> 0").select(*_KEY, "name", F.col("intr_rate2").alias("r"))
    w = Window.partitionBy("bank", "kind").orderBy("code", "name")
    both = top.withColumns({c + "2": F.lead(c).over(w) for c in ("name", "code", "r")}).where("code2 IS NOT NULL AND r <> r2")
    show = lambda n, r: F.concat(F.col(n), F.lit("="), short_number(F.col(r)))
    groups = products.groupBy("bank", "kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))
    first = top.withColumn("k", F.rank().over(Window.partitionBy("kind").orderBy(F.desc("r")))).where("k = 1").groupBy("kind").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("r").alias("r")).where("n = 1")
    listing = F.array_join("names", "; ")
    base = F.concat_ws(":", "bank", "kind", F.lit("baseList"))
    return {
        "compare_two_products": both.select(*_row("compare_two_products", F.col("kind"), ["bank", "kind", "code"], ["bank", "name", "name2"], "span", F.when(F.col("r") > F.col("r2"), F.col("name")).otherwise(F.col("name2")), F.concat("bank", F.lit(":"), "code", F.lit(","), "code2", F.lit(":intr_rate2(12개월)")), F.concat(show("name", "r"), F.lit("; "), show("name2", "r2")))),
        "agg_count": groups.where("n >= 2 AND kind <> 'credit'").select(*_row("agg_count", F.col("kind"), ["bank", "kind"], ["bank", "kind"], "numeric", F.col("n"), base, listing, "개")),
        "agg_superlative": first.select(*_row("agg_superlative", F.col("kind"), ["kind"], ["kind"], "span", F.col("name"), F.concat_ws(":", F.lit("전체"), "kind", F.lit("max(intr_rate2, 12개월)")), show("name", "r"))),
        "enumerate_products": groups.where("n BETWEEN 2 AND 5 AND kind IN ('deposit', 'saving')").select(*_row("enumerate_products", F.col("kind"), ["bank", "kind"], ["bank", "kind"], "span", F.array_join("names", ", "), base, listing)),
    }


def pretax(principal: Column, rate: Column) -> Column:
    """Simple interest of a year, exact: rates are per cent."""
    return principal.cast("decimal(20,0)") * rate.cast("decimal(12,6)") / F.lit(100).cast("decimal(3,0)")


def rounded(x: Column) -> Column:
    """To whole units, halves away from zero, as decimals round."""
    return F.round(x.cast("decimal(38,10)"), 0).cast("decimal(38,0)")


def after_tax(principal: Column, rate: Column, tax: str = TAX) -> Column:
    """Interest less tax on the unrounded interest, rounded once."""
    return rounded(pretax(principal, rate).cast("decimal(28,10)") * (F.lit(1).cast("decimal(4,3)") - F.lit(tax).cast("decimal(4,3)")))


def calculations(options: DataFrame) -> dict[str, DataFrame]:
    """calc_interest, calc_interest_after_tax, calc_interest_diff, over simple-interest deposits of a year."""
    d = term(options.where("kind = 'deposit'")).where("intr_rate <> 0 AND intr_rate_type_nm = '단리'")
    sums = lambda seed, choices: F.element_at(F.array(*map(F.lit, choices)), variant([F.lit(seed), F.col("code")], 3) + 1).cast("long")
    a = d.withColumn("principal", sums("prin", [5_000_000, 10_000_000, 30_000_000]))
    b = d.withColumn("principal", sums("prin_at", [10_000_000, 20_000_000, 50_000_000]))
    text, at = short_number(F.col("intr_rate")), _at("intr_rate(12개월,단리)")
    parts = [_label(), thousands(F.col("principal"))]
    # neighbours in the order of all deposits: those of a bank, and of its last one the first of the next bank
    own, banks = Window.partitionBy("bank").orderBy("code", "name"), Window.orderBy("bank")
    item = F.struct("bank", "code", "name", F.col("intr_rate").alias("r"))
    heads = d.groupBy("bank").agg(F.min(item).alias("head")).select("bank", F.lead("head").over(banks).alias("head"))  # a row for each bank
    both = d.withColumn("mate", F.lead(item).over(own)).join(heads, "bank").withColumn("mate", F.coalesce("mate", "head"))
    both = both.select(*_KEY, "name", "intr_rate", F.col("mate.bank").alias("b2"), F.col("mate.code").alias("c2"), F.col("mate.name").alias("n2"), F.col("mate.r").alias("r2")).where("r2 <> intr_rate")
    ten = F.lit(10_000_000)
    diff = F.abs(rounded(pretax(ten, F.col("intr_rate"))) - rounded(pretax(ten, F.col("r2"))))
    other = F.concat(F.col("b2"), F.lit(" '"), F.col("n2"), F.lit("'"))
    return {
        "calc_interest": a.select(*_row("calc_interest", F.col("kind"), _KEY, parts, "numeric", rounded(pretax(F.col("principal"), F.col("intr_rate"))), at, text, "원")),
        "calc_interest_after_tax": b.select(*_row("calc_interest_after_tax", F.col("kind"), _KEY, parts, "numeric", after_tax(F.col("principal"), F.col("intr_rate")), at, text, "원")),
        "calc_interest_diff": both.select(*_row("calc_interest_diff", F.col("kind"), _KEY, [_label(), other], "numeric", diff, F.concat("bank", F.lit(":"), "code", F.lit(","), "b2", F.lit(":"), "c2", F.lit(":intr_rate(12개월)")), F.concat("name", F.lit("="), text, F.lit("; "), "n2", F.lit("="), short_number(F.col("r2"))), "원")),
    }


def penalties(text: Column) -> Column:
    """struct(years, fine, fine_kind): the longest prison term, the largest fine as written, and what the first is called."""
    years = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(PRISON), F.lit(1)), lambda x: x.try_cast("int")))
    fines = F.regexp_extract_all(text, F.lit(FINE), F.lit(1))
    won = lambda a: F.regexp_extract(a, r"^(\d+)", 1).try_cast("long") * F.when(F.contains(a, F.lit("억")), 10**8).when(F.contains(a, F.lit("천만")), 10**7).when(F.contains(a, F.lit("백만")), 10**6).otherwise(1)
    largest = F.aggregate(fines, F.lit(None).cast("string"), lambda best, a: F.when(best.isNull() | (won(a) > won(best)), a).otherwise(best))
    return F.struct(years.alias("years"), largest.alias("fine"), F.nullif(F.regexp_extract(text, FINE, 2), F.lit("")).alias("fine_kind"))


def regulations(laws: DataFrame, quotas: dict[str, int] | None = None, quota: int = 10, terms: int = 12) -> dict[str, DataFrame]:
    """article_locate, definition_term, law_meta, penalty_amount, from statutes as statutes() reads them."""
    a = laws.select("name", "slug", "category", "effective_date", F.posexplode("articles").alias("pos", "a")).select("name", "slug", "category", "pos", "a.label", F.coalesce("a.title", F.lit("")).alias("title"), F.coalesce("a.text", F.lit("")).alias("body"))
    text, kind = F.substring("body", 1, 200), F.col("category")
    limit = F.lit(quota)
    for law, n in (quotas or {}).items():
        limit = F.when(F.col("name") == law, n).otherwise(limit)
    same = F.count("*").over(Window.partitionBy("slug", "title"))
    titled = a.where("length(title) >= 3").withColumn("n", same).where("n = 1").withColumn("k", F.row_number().over(Window.partitionBy("slug").orderBy("title"))).where(F.col("k") <= limit)
    found = a.where(F.contains("title", F.lit("정의"))).select("*", F.posexplode(F.arrays_zip(F.regexp_extract_all("body", F.lit(DEFINED), F.lit(1)).alias("term"), F.regexp_extract_all("body", F.lit(DEFINED), F.lit(2)).alias("said"))).alias("at", "d")).withColumns({"term": F.col("d")["term"], "said": squeezed(F.col("d")["said"])})
    level = F.length(F.regexp_replace("said", r"[^(]", "")) == F.length(F.regexp_replace("said", r"[^)]", ""))
    clear = found.where((F.length("said") >= 25) & ~F.contains("said", F.lit("다음 각")) & level & ~F.contains(F.concat("name", "label", "said"), F.col("term")))
    defined = clear.withColumn("k", F.row_number().over(Window.partitionBy("slug").orderBy("pos", "at"))).where(F.col("k") <= terms)
    facts = laws.select("name", "slug", "category", F.explode(F.array(F.struct(F.lit("시행일자").alias("what"), iso_date(F.col("effective_date")).cast("string").alias("v")), F.struct(F.lit("소관부처").alias("what"), F.col("ministry").alias("v")))).alias("x"), iso_date(F.col("effective_date")).cast("string").alias("since"))
    fined = a.where(F.contains("title", F.lit("벌칙")) | F.contains("title", F.lit("과태료"))).withColumn("pen", penalties(F.col("body")))
    cases = fined.withColumn("x", F.explode(F.filter(F.array(F.struct(F.lit("징역").alias("what"), F.col("pen.years").cast("string").alias("v")), F.struct(F.col("pen.fine_kind").alias("what"), F.col("pen.fine").alias("v"))), lambda x: x["v"].isNotNull())))
    place = F.lpad(F.col("pos").cast("string"), 6, "0")
    return {
        "article_locate": titled.select(*_row("article_locate", kind, ["slug", "title"], ["name", "title"], "span", F.col("label"), F.col("label"), text)),
        "definition_term": defined.select(*_row("definition_term", kind, ["slug", place, F.lpad(F.col("at").cast("string"), 6, "0")], ["name", "label", "said"], "span", F.col("term"), F.col("label"), text)),
        "law_meta": facts.select(*_row("law_meta", kind, ["slug", F.col("x.what")], ["name", F.col("x.what")], "span", F.col("x.v"), F.lit("기본정보"), F.concat(F.lit("시행 "), "since"))),
        "penalty_amount": cases.select(*_row("penalty_amount", kind, ["slug", place, F.col("x.what")], ["name", "label", F.col("x.what")], "span", F.col("x.v"), F.col("label"), text)),
    }


def word(rows: DataFrame, wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with question: one of its template's wordings, by a hash of its parts, filled with them."""
    chosen = F.lit(None).cast("string")
    for template, texts in (wordings or WORDINGS).items():
        one = F.element_at(F.array(*map(F.lit, texts)), variant([F.lit(template), F.array_join("parts", ":")], len(texts)) + 1)
        chosen = F.when(F.col("template") == template, one).otherwise(chosen)
    for i in range(4):
        chosen = F.replace(chosen, F.lit(f"{{{i}}}"), F.coalesce(F.get("parts", F.lit(i)), F.lit("")))
    return rows.withColumn("question", chosen)


def with_particle(noun: Column, role: str) -> Column:
    return F.concat(noun, particle(noun, role))


def take_quota(rows: DataFrame, quotas: dict[str, int], overflow: list[str], total: int) -> DataFrame:
    """rows with seq, from 1: the first rows of each template up to its quota, templates in the order of quotas; then, in
    pairs, what is left over of the overflow templates in turn, until there are `total`."""
    position = F.create_map(*[F.lit(x) for k in enumerate(quotas) for x in (k[1], k[0])])
    limit = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    spare = F.create_map(*[F.lit(x) for k in enumerate(overflow) for x in (k[1], k[0])]) if overflow else F.lit(None).cast("map<string,int>")
    n = F.row_number().over(Window.partitionBy("template").orderBy("ord"))
    r = rows.where(F.col("template").isin(*quotas)).withColumn("n", n)
    within = F.col("n") <= limit[F.col("template")]
    r = r.withColumn("part", F.when(within, F.struct(F.lit(0).alias("late"), position[F.col("template")].alias("k"))).when(spare[F.col("template")].isNotNull(), F.struct(F.lit(1).alias("late"), spare[F.col("template")].alias("k")))).where("part IS NOT NULL AND n <= 2 * " + str(max(total, 1)) + " + " + str(sum(quotas.values())))
    # what reaches this one order is bounded by the quotas and the total, whatever the input
    return r.withColumn("seq", F.row_number().over(Window.orderBy("part", "n"))).where(F.col("seq") <= total).drop("part", "n")


def stratified(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first max(1, n // number of strata) rows of each stratum."""
    strata = rows.select(by).distinct().count()
    each = max(1, n // max(1, strata))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= each).drop("_n")


def question_ids(rows: DataFrame, prefix: Column) -> DataFrame:
    return rows.withColumn("id", F.concat(prefix, F.lit("-"), F.lpad(F.col("seq").cast("string"), 4, "0")))

