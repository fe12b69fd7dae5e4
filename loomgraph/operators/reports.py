"""Results as people read them: rows as text, the worst of a table, shares by template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(*names: str) -> Column:
    """The columns of a row as 'name: value | name: value', without those that are null."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names])


def render_rows(rows: DataFrame, by: str, order: str, *names: str) -> DataFrame:
    """(by, text): the rows of each `by` as lines, in that order, ties by what the line says."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), rendered(*names).alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def worst(results: DataFrame, hits: str, total: str, key: str, n: int = 10) -> DataFrame:
    """The n rows with the least share of hits, ties by key, with their place. Rows without anything to hit come last."""
    share = F.when(F.col(total) > 0, F.col(hits) / F.col(total))
    first = results.withColumn("share", share).orderBy(F.asc_nulls_last("share"), key).limit(n)
    # n rows by now, whatever the table
    row = F.struct(F.col("share").isNull().alias("none"), "share", F.col(key).alias("k"), F.struct(*results.columns).alias("row"))
    placed = first.agg(F.array_sort(F.collect_list(row)).alias("all")).select(F.posexplode("all").alias("at", "x"))
    return placed.select((F.col("at") + 1).alias("place"), "x.share", "x.row.*")


def recall_by(results: DataFrame, by: str, systems: list[str], total: str) -> DataFrame:
    """(by, questions, a share for each system): what share of all evidence of a group's questions each system found."""
    return results.groupBy(by).agg(F.count("*").alias("questions"), *[(F.sum(s) / F.sum(total)).alias(s) for s in systems])
