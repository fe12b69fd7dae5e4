"""Tool functions: each takes plain values and returns JSON text, errors included."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.kb import KnowledgeBase
from loomgraph.operators import rules


def _json(value: object) -> str:
    if isinstance(value, DataFrame):
        value = [json.loads(r) for r in value.toJSON().collect()]  # null fields are left out
    return json.dumps(value, ensure_ascii=False, default=str)


def tools(kb: KnowledgeBase, rule_names: dict[str, str] | None = None) -> dict[str, Callable[..., str]]:
    """The eight tools over one knowledge base, which is loaded once. Results are limited, so they fit into an answer."""
    book: list = []

    def rule_book() -> tuple[DataFrame, DataFrame]:
        if not book:
            book.append(tuple(x.cache() for x in kb.rule_book(rule_names or {})))
        return book[0]

    def guarded(f: Callable) -> Callable[..., str]:
        def call(*args, **kwargs) -> str:
            try:
                found = f(*args, **kwargs)
                return _json(found if found is not None else {"error": f"nothing is called {args[0] if args else ''}"})
            except Exception as e:  # a tool reports what went wrong to whoever called it
                return _json({"error": str(e)[:500]})

        return call

    def facts_of(facts: dict):
        return F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), F.lit(None if v is None else str(v)).cast("string"))]) if facts else F.expr("map_from_arrays(array(), array())").cast("map<string,string>")

    def eligibility(bank: str, product: str, facts: dict | None = None) -> dict:
        asked = kb.spark.createDataFrame([(1, bank, product)], "id int, bank string, product string").withColumn("facts", facts_of(facts or {}))
        return rules.judge(rule_book()[0], asked).first().asDict(recursive=True)

    def rate_claim(bank: str, product: str, claimed: float, months: int = 12) -> dict:
        asked = kb.spark.createDataFrame([(1, bank, product, months, str(claimed))], "id int, bank string, product string, months int, c string").withColumn("claimed", F.col("c").cast("decimal(38,10)"))
        return rules.judge_rates(*rule_book(), asked).first().asDict(recursive=True)

    made = {"search_concepts": kb.search, "concept_details": kb.concept, "class_hierarchy": kb.hierarchy, "class_instances": kb.instances, "describe_instance": kb.describe, "run_sparql": kb.sparql, "check_eligibility": eligibility, "check_rate_claim": rate_claim}
    return {name: guarded(f) for name, f in made.items()}
