"""Question sets made elsewhere: which of them still hold for the products that are disclosed now, and why the rest don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.etl import JOIN_DENY
from loomgraph.operators.workload import _row
from loomgraph.sources.records import display_names

#: The issuer of statutes, what begins an amendment's id, what names issuers that aren't banks, the words of a
#: question whose absence from a disclosure is what an ABSTAIN rests on, and how a question mentions its product.
LAW, AMENDMENT, OTHER_ISSUERS = "law", "amend:", ["저축은행", "보험"]
ABSENCE_TERMS = ["양도", "질권", "압류", "상속", "중도해지", "담보제공", "자동해지"]
THIS_PRODUCT, ABSTAIN = "이 상품", "ABSTAIN"
QUOTED = "'([^']+)'"
#: The group of questions on amendments, and the category that a word in one of them tells, the first that fits.
TEMPORAL_GROUP, COMMON_CATEGORY = "Q2_시간", "공통"
CATEGORY_HINTS = [
    ("퇴직연금", "퇴직연금"),
    ("퇴직급여", "퇴직연금"),
    ("여신전문", "카드"),
    ("외국환", "외환"),
    ("자본시장", "펀드"),
    ("예금자", "예금"),
    ("은행", "공통"),
    ("금융소비자", "공통"),
]
#: Why a question is left out.
NO_KEY, NO_PRODUCT, NOT_ABSENT, NO_EVIDENCE = "doc_id", "no_product", "not_absent", "no_evidence"


def _texts(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def about_banks(questions: DataFrame) -> DataFrame:
    """The questions none of whose doc_ids is of a statute, an amendment, a savings bank or an insurer; those without any
    doc_id too."""

    def other(doc: Column) -> Column:
        issuer = F.coalesce(F.get(F.split(doc, ":"), F.lit(1)), F.lit(""))
        return (issuer == LAW) | doc.startswith(AMENDMENT) | F.exists(_texts(OTHER_ISSUERS), lambda x: F.contains(issuer, x))

    ids = F.filter(F.coalesce("doc_ids", F.array().cast("array<string>")), lambda d: d.isNotNull())
    return questions.where(~F.exists(ids, other))


def disclosed(products: DataFrame) -> DataFrame:
    """(bank, code, name, full): a row for each bank and code, the last record of the last kind by name, and the texts that
    evidence is looked for in. Null fields count as empty."""
    deny = F.element_at(F.create_map(*[F.lit(x) for kv in JOIN_DENY.items() for x in kv]), F.trim(F.coalesce("join_deny", F.lit(""))))
    named = display_names(products).withColumn("deny", deny)
    full = F.array_join(F.transform(F.array("join_member", "deny", "spcl_cnd", "etc_note", "max_limit", "display_name"), lambda x: F.coalesce(x, F.lit(""))), " ")
    last = F.max_by(F.struct(F.col("display_name").alias("name"), full.alias("full")), F.struct("kind", "pos"))
    return named.groupBy(F.col("kor_co_nm").alias("bank"), F.col("fin_prdt_cd").alias("code")).agg(last.alias("x")).select("bank", "code", "x.*")


def carried_over(questions: DataFrame, products: DataFrame) -> DataFrame:
    """A row for each question: (id, group, bank, name, code, question, verdict, gold, basis, reason, detail).

    questions: (qid, group, question, doc_ids, gold_verdict, gold_basis), about banks; products as disclosures() reads them. The
    first doc_id names a product, source:bank:code:month. reason is null for those that hold: their question names the product, gold
    is its name and each quoted phrase of the basis that is disclosed still; for ABSTAIN it is empty. Left out, with what
    is at fault in detail: doc_id (the id as it is), no_product (bank and code), not_absent (an ABSTAIN whose words
    are disclosed now: those words), no_evidence (no phrase of the basis is disclosed: the phrases). A product
    with a third of all questions is one small row, so its join is left to the planner.
    """
    doc = F.get("doc_ids", F.lit(0))
    parts = F.split(F.coalesce(doc, F.lit("")), ":")
    keyed = questions.withColumns({"doc": doc, "sound": F.size(parts) == 4, "bank": F.get(parts, F.lit(1)), "code": F.get(parts, F.lit(2))})
    found = keyed.join(disclosed(products), ["bank", "code"], "left")
    asked = F.coalesce("question", F.lit(""))
    called = F.concat(F.col("bank"), F.lit(" '"), F.col("name"), F.lit("'"))
    told = F.when(F.contains(asked, F.lit(THIS_PRODUCT)), F.replace(asked, F.lit(THIS_PRODUCT), called)).otherwise(F.concat(called, F.lit(" 상품에 대해: "), asked))
    present = F.filter(_texts(ABSENCE_TERMS), lambda t: F.contains(asked, t) & F.contains(F.col("full"), t))
    phrases = F.regexp_extract_all(F.coalesce("gold_basis", F.lit("")), F.lit(QUOTED), F.lit(1))
    decisive = F.filter(phrases, lambda p: F.contains(F.col("full"), p))
    abstains = F.col("gold_verdict").eqNullSafe(ABSTAIN)
    reason = F.when(~F.col("sound"), NO_KEY).when(F.col("full").isNull(), NO_PRODUCT).when(abstains & (F.size("present") > 0), NOT_ABSENT).when(~abstains & (F.size("decisive") == 0), NO_EVIDENCE)
    fault = F.when(F.col("reason") == NO_KEY, F.array("doc")).when(F.col("reason") == NO_PRODUCT, F.array("bank", "code")).when(F.col("reason") == NOT_ABSENT, F.col("present")).when(F.col("reason") == NO_EVIDENCE, phrases)
    gold = F.when(abstains, F.array().cast("array<string>")).otherwise(F.concat(F.array("name"), F.col("decisive")))
    made = found.withColumns({"present": present, "decisive": decisive}).withColumn("reason", reason).withColumn("detail", fault)
    kept = F.col("reason").isNull()
    return made.select(
        F.col("qid").alias("id"), "group", "bank", "name", "code", F.when(kept, told).alias("question"),
        F.col("gold_verdict").alias("verdict"), F.when(kept, gold).alias("gold"), F.col("gold_basis").alias("basis"), "reason", "detail",
    )


def temporal_validity(questions: DataFrame) -> DataFrame:
    """Rows of the template temporal_validity, as other templates give them: questions on which wording of a statute was in
    force, taken over as they are. Their kind is a category told by words of the question; they are in the order of qid."""
    category = F.lit(COMMON_CATEGORY)
    for hint, name in reversed(CATEGORY_HINTS):
        category = F.when(F.contains("question", F.lit(hint)), name).otherwise(category)
    rows = questions.where(F.col("group") == TEMPORAL_GROUP)
    text = F.left(F.coalesce("gold_basis", F.lit("")), F.lit(200))
    return rows.select(*_row("temporal_validity", category, ["qid"], ["question"], "boolean", F.col("gold_verdict"), F.get("doc_ids", F.lit(0)), text))
