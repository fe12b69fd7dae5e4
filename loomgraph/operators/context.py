"""Contexts from ranked units: budgets, order, repeats, retrieval metrics, expected evidence and scores of answers.

Units are rows (qid, rank, text); all questions are worked on together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import bare, compact, last_answer, quoted

BUDGETS = (2000, 4000, 8000)


def assemble(units: DataFrame, budget: int | None = None, key: str = "qid", separator: str = "\n\n") -> DataFrame:
    """(key, context): units in rank order as long as they fit into the budget; if the first one doesn't, its beginning."""
    by_rank = Window.partitionBy(key).orderBy("rank")
    n = F.row_number().over(by_rank)
    used = F.sum(F.length("text") + F.lit(len(separator))).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) - len(separator)
    placed = units.select(key, "rank", "text", n.alias("n"), used.alias("used"))
    if budget is not None:
        placed = placed.where((F.col("used") <= budget) | (F.col("n") == 1)).withColumn("text", F.when(F.col("used") > budget, F.substring("text", 1, budget)).otherwise(F.col("text")))
    return placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), separator).alias("context"))


def _whole(units: DataFrame, key: str, budgets: tuple[int, ...], separator: str = "\n\n") -> DataFrame:
    """(key, c_inf, upto_<budget>...): the context without a budget, and how many of its characters assemble() gives within
    each: a context within a budget is the beginning of the one without."""
    by_rank = Window.partitionBy(key).orderBy("rank")
    used = F.sum(F.length("text") + F.lit(len(separator))).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) - len(separator)
    placed = units.select(key, "text", F.row_number().over(by_rank).alias("n"), used.alias("used"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), separator)
    upto = [F.coalesce(F.max(F.when(F.col("used") <= b, F.col("used"))), F.lit(b)).alias(f"upto_{b}") for b in budgets]
    return placed.groupBy(key).agg(text.alias("c_inf"), *upto)


def priority(text: Column) -> Column:
    """Facts of entities first, then uses of properties, then class trees."""
    return F.when(text.startswith("[개념]"), 2).when(text.startswith("[속성]"), 1).otherwise(0)


def engineered(units: DataFrame, key: str = "qid") -> DataFrame:
    """(key, rank, text): units compacted, by priority and rank, each text once; a headline of matches stays in front."""
    first = F.min("rank").over(Window.partitionBy(key))
    head = (F.col("rank") == first) & F.col("text").startswith("[매칭된 개념]")
    c = units.select(key, "rank", head.alias("head"), priority(F.col("text")).alias("pr"), compact(F.col("text")).alias("text")).where("head OR length(text) > 0")
    order = F.struct(~F.col("head"), "pr", "rank")
    once = c.withColumn("nth", F.row_number().over(Window.partitionBy(key, "head", "text").orderBy("pr", "rank"))).where("head OR nth = 1")
    return once.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("rank"), "text")


def retrieval_metrics(units: DataFrame, gold: DataFrame, key: str = "qid", budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(key, hit1, mrr, chars, recall_<budget>..., recall_inf) for each question of gold (key, gold array of strings).

    hit1: the first unit has all of the evidence. mrr: one over the rank at which all of it has been seen, 0 if a piece is
    listed twice (its number is compared with that of the different pieces seen). Without evidence and with units,
    hit1 and mrr are 1 and recall is 0.
    """
    numbered = units.select(key, F.row_number().over(Window.partitionBy(key).orderBy("rank")).alias("r"), "text")
    g = gold.select(key, "gold")
    wanted = g.select(key, F.explode(F.array_distinct("gold")).alias("piece"))
    seen = wanted.join(numbered, key).where(F.contains("text", F.col("piece"))).groupBy(key, "piece").agg(F.min("r").alias("at"))
    ranks = seen.groupBy(key).agg(F.max("at").alias("complete"), F.count("*").alias("found"))
    first = numbered.where("r = 1").select(key, F.col("text").alias("first"))
    out = g.join(first, key, "left").join(ranks, key, "left")
    out = out.join(_whole(units, key, budgets), key, "left")
    n = F.size("gold")
    seen_in = lambda c: F.round(F.size(F.filter("gold", lambda p: F.contains(F.coalesce(c, F.lit("")), p))) / F.greatest(n, F.lit(1)), 12)
    within = lambda b: F.substr("c_inf", F.lit(1), F.col(f"upto_{b}").cast("int"))
    hit = F.when(F.col("first").isNotNull() & F.forall("gold", lambda p: F.contains("first", p)), 1.0).otherwise(0.0)
    complete = F.when(n == 0, F.when(F.col("first").isNotNull(), 1)).when(F.col("found") == n, F.col("complete"))
    return out.select(key, hit.alias("hit1"), F.coalesce(1 / complete, F.lit(0.0)).alias("mrr"), F.coalesce(F.length("c_inf"), F.lit(0)).alias("chars"), *[seen_in(within(b)).alias(f"recall_{b}") for b in budgets], seen_in(F.col("c_inf")).alias("recall_inf"))


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over questions, 0 where there are none."""
    columns = [c for c in metrics.columns if c not in (*by, "qid")]
    return metrics.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns], F.count("*").alias("questions"))


def micro(contexts: DataFrame, gold: DataFrame, *by: str, key: str = "qid") -> DataFrame:
    """(by..., recall, perfect, questions, chars): all evidence found over all there is, questions with all of theirs."""
    joined = gold.join(contexts, key, "left").withColumn("context", F.coalesce("context", F.lit("")))
    found = F.size(F.filter("gold", lambda p: F.contains("context", p)))
    return joined.groupBy(*by).agg((F.sum(found) / F.sum(F.size("gold"))).alias("recall"), F.count_if(found == F.size("gold")).alias("perfect"), F.count("*").alias("questions"), F.avg(F.length("context")).alias("chars"))


def gold_pieces(template: Column, answer: Column, text: Column, question: Column) -> Column:
    """What a context must contain for a question of a template: an array of strings."""
    values = F.filter(F.transform(F.split(text, r";\s*"), lambda x: F.trim(F.regexp_replace(x, r"^.*=", ""))), lambda x: F.length(x) > 0)
    named = quoted(question)
    return (
        F.when(template.isin("agg_count", "enumerate_products"), F.filter(F.transform(F.split(text, r";\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 0))
        .when(template.isin("compare_two_products", "calc_interest_diff", "agg_superlative"), values)
        .when(template.isin("join_way", "age_condition", "joint_condition"), F.filter(F.transform(F.split(text, r"\s\|\s"), lambda x: F.trim(x)), lambda x: F.length(x) > 0))
        .when(template.isin("calc_interest", "calc_interest_after_tax", "rate_threshold", "base_rate_lookup", "max_rate_lookup", "loan_min_rate", "credit_avg_rate", "max_limit_lookup"), F.array(text))
        .when(template == "loan_rate_type", F.concat(F.slice(named, 1, 1), F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)))
        .otherwise(F.array(answer))
    )


def answer_score(kind: Column, answer: Column, gold: Column, tolerance: float = 1e-6) -> Column:
    """Whether an answer is right. boolean: yes or no by the last answer line, where 'no' wins wherever it is part of it;
    numeric: any number within a relative tolerance; abstain: it says that there is no such information; else the gold
    text is part of it once both are bare."""
    line = last_answer(answer)
    no = F.contains(F.upper(line), F.lit("NO")) | line.rlike("아니오|아니요")
    says = F.when(no, "NO").when(F.contains(F.upper(line), F.lit("YES")) | (line.rlike("예|네")), "YES")
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(line, r"(?<=\d),(?=\d{3})", ""), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double"))
    goal = F.regexp_replace(gold, ",", "").try_cast("double")
    near = F.exists(numbers, lambda x: F.abs(x - goal) <= F.greatest(F.abs(goal) * tolerance, F.lit(1e-12)))
    abstains = answer.rlike("(?i)정보 ?없|알 수 없|확인할 수 없|확인되지 않|판단할 수 없|공시에 ?없|not (?:available|disclosed)|unknown")
    return F.coalesce(F.when(kind == "boolean", says == gold).when(kind == "numeric", near).when(kind == "abstain", abstains).otherwise(F.contains(bare(line), bare(gold))), F.lit(False))


def choice_score(answer: Column, right: Column) -> Column:
    """Whether the first letter A to D of an answer is the right one (by number, from 0)."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(answer), r"([A-D])", 1), F.lit("")) == F.element_at(F.array(*map(F.lit, "ABCD")), right + 1), F.lit(False))


def term_cosine(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, cosine) of raw counts (key, gram, tf) on both sides."""
    a = left.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("na"))
    b = right.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("nb"))
    dot = left.select(key, "gram", F.col("tf").alias("x")).join(right.select(key, "gram", F.col("tf").alias("y")), [key, "gram"]).groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return a.join(b, key).join(dot, key, "left").select(key, (F.coalesce("dot", F.lit(0)) / (F.col("na") * F.col("nb"))).alias("cosine"))
