"""Eligibility rules from disclosed text, judged in three values: a missing fact is neither met nor broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import least_age, least_amount, listed, short_number

#: Channels in the order in which they are listed.
CHANNELS = ["영업점", "인터넷", "스마트폰", "전화(텔레뱅킹)"]
MET, BROKEN, OPEN = "충족", "위반", "미상"
CONTRACT = "이 결론은 규칙 평가의 결과이며 답변이 뒤집을 수 없다. UNKNOWN이면 단정하지 말고 빠진 정보를 물어야 한다."


def extract(products: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """(bank, name, conditions) from products (bank, name, join_member, join_way, etc_note).

    Up to three conditions: a least age, the channels, a least amount. A condition has attr, op, number or options, and
    the field and text it comes from. Of several rows with one bank and name, the last by their fields counts.
    """
    last = products.groupBy("bank", "name").agg(F.max(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("join_member", "join_way", "etc_note")])).alias("x")).select("bank", "name", "x.*")

    def condition(attr: str, op: str, number: Column, options: Column, field: str, text: Column) -> Column:
        return F.struct(F.lit(attr).alias("attr"), F.lit(op).alias("op"), number.cast("double").alias("number"), options.cast("array<string>").alias("options"), F.lit(field).alias("field"), text.alias("text"))

    none, age, amount, ways = F.lit(None), least_age(F.col("join_member")), least_amount(F.col("etc_note")), listed(F.col("join_way"), channels)
    made = F.array(
        F.when(age.isNotNull(), condition("age", ">=", age, none, "가입대상(joinMember)", F.col("join_member"))),
        F.when(F.size(ways) > 0, condition("channel", "in", none, ways, "가입방법(joinWay)", F.col("join_way"))),
        F.when(amount.isNotNull(), condition("amount", ">=", amount, none, "기타유의사항(etcNote)", F.col("etc_note"))),
    )
    return last.select("bank", "name", F.filter(made, lambda c: c.isNotNull()).alias("conditions"))


def resolve(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, bank, product, ...) with the bank and name of its rules, null where none or several fit.

    The bank's own name counts first; else a bank whose name contains the asked one or is contained in it, if the
    product has exactly one such. The join is on the product's name.
    """
    r = rules.select(F.col("bank").alias("r_bank"), F.col("name").alias("product"))
    fits = F.contains("r_bank", F.col("bank")) | F.contains("bank", F.col("r_bank"))
    found = asked.select("id", "bank", "product").join(r, "product").where(fits).groupBy("id").agg(F.max(F.when(F.col("r_bank") == F.col("bank"), F.col("r_bank"))).alias("exact"), F.count("*").alias("n"), F.min("r_bank").alias("only"))
    return asked.join(found.select("id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("r_bank")), "id", "left")


def result(c: Column, facts: Column) -> Column:
    """true, false or null: a condition against facts (map of strings)."""
    got = facts[c["attr"]]
    return F.when(c["op"] == ">=", got.try_cast("double") >= c["number"]).when(c["op"] == "in", F.array_contains(c["options"], got))


def judge(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """A packet (id, verdict, product, conditions, missing_slots, evidence, note, contract) for each asked row
    (id, bank, product, facts map of strings, where a null value is a fact asked for and not known).

    NOT_APPLICABLE without rules; DENIED if a condition is broken; CONFIRMED if there are facts, none of a condition is
    null, and those of conditions are met, with a note of what has not been asked; else UNKNOWN with all that is missing.
    """
    found = resolve(rules, asked).join(rules.select(F.col("bank").alias("r_bank"), F.col("name").alias("product"), "conditions"), ["r_bank", "product"], "left")
    judged = found.withColumn("c", F.transform(F.coalesce("conditions", F.array().cast(rules.schema["conditions"].dataType)), lambda c: F.struct(c.alias("of"), result(c, F.col("facts")).alias("r"), F.map_contains_key("facts", c["attr"]).alias("given"))))
    open_ = F.transform(F.filter("c", lambda x: x["r"].isNull()), lambda x: x["of"]["attr"])
    waiting = F.exists("c", lambda x: x["r"].isNull() & x["given"])
    verdict = F.when(F.size("c") == 0, "NOT_APPLICABLE").when(F.exists("c", lambda x: F.coalesce(~x["r"], F.lit(False))), "DENIED").when((F.size(F.map_keys("facts")) > 0) & ~waiting, "CONFIRMED").otherwise("UNKNOWN")
    source = lambda x: F.concat(x["of"]["field"], F.lit(": "), F.substring(x["of"]["text"], 1, 120))
    locator = F.when(F.col("r_bank").isNotNull(), F.concat("r_bank", F.lit(":"), "product"))
    shown = F.transform("c", lambda x: F.struct(x["of"]["attr"].alias("attr"), x["of"]["op"].alias("op"), F.coalesce(F.array_join(x["of"]["options"], ", "), short_number(x["of"]["number"])).alias("value"), F.when(x["r"], MET).when(~x["r"], BROKEN).otherwise(OPEN).alias("result"), source(x).alias("source")))
    note = F.when(F.col("verdict") == "NOT_APPLICABLE", "적용할 규칙이 없거나 상품을 찾지 못함").when((F.col("verdict") == "CONFIRMED") & (F.size(open_) > 0), F.concat(F.lit("미확인 요건: "), F.array_join(open_, ", ")))
    out = judged.withColumn("verdict", verdict)
    return out.select("id", "verdict", locator.alias("product"), shown.alias("conditions"), F.when(F.col("verdict") == "UNKNOWN", open_).otherwise(F.array().cast("array<string>")).alias("missing_slots"), F.transform("c", lambda x: F.struct(locator.alias("source"), source(x).alias("fact"))).alias("evidence"), note.alias("note"), F.lit(CONTRACT).alias("contract"))


def top_rates(options: DataFrame) -> DataFrame:
    """(bank, name, months, rate): the best rate of each term from (bank, name, months, rate)."""
    return options.groupBy("bank", "name", "months").agg(F.max("rate").alias("rate"))


def judge_rates(rules: DataFrame, rates: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, verdict, product, rate, missing_slots) for claims (id, bank, product, months, claimed): a top rate of at least
    the claimed one. NOT_APPLICABLE: no such product; UNKNOWN: no rate for the term."""
    found = resolve(rules, asked)
    r = rates.select(F.col("bank").alias("r_bank"), F.col("name").alias("product"), "months", "rate")
    joined = found.join(r, ["r_bank", "product", "months"], "left")
    verdict = F.when(F.col("r_bank").isNull(), "NOT_APPLICABLE").when(F.col("rate").isNull(), "UNKNOWN").when(F.col("rate") >= F.col("claimed"), "CONFIRMED").otherwise("DENIED")
    return joined.select("id", verdict.alias("verdict"), F.when(F.col("r_bank").isNotNull(), F.concat("r_bank", F.lit(":"), "product")).alias("product"), "rate", F.when(verdict == "UNKNOWN", F.array(F.lit("max_rate"))).otherwise(F.array().cast("array<string>")).alias("missing_slots"))


def from_graph(triples: DataFrame, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(products, options) as extract() and top_rates() take them. names: IRIs of the predicates product_name, month,
    offered_by, bank_name, join_member, join_way, etc_note, rate_option, term_months, top_rate."""
    p = lambda key, out: triples.where(F.col("p") == names[key]).select("s", F.col("o").alias(out))
    bank = p("bank_name", "bank").withColumnRenamed("s", "b")
    offered = p("product_name", "name").join(p("offered_by", "b"), "s").join(bank, "b")
    products = offered.join(p("month", "m").select("s").distinct(), "s", "left_semi")
    for key in ("join_member", "join_way", "etc_note"):
        products = products.join(p(key, key), "s", "left")
    options = offered.join(p("rate_option", "opt"), "s").join(p("term_months", "months").withColumnRenamed("s", "opt"), "opt").join(p("top_rate", "rate").withColumnRenamed("s", "opt"), "opt")
    return products.drop("b", "s"), options.select("bank", "name", F.col("months").try_cast("int").alias("months"), F.col("rate").try_cast("decimal(38,10)").alias("rate"))



