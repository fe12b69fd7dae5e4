"""Nested records: product disclosures, statutes and question sets; CSV sheets as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import squeezed

#: The fields of the disclosure files, and the kinds with their order.
KINDS = ["deposit", "saving", "mortgage", "rent", "credit"]
BASE = "dcls_month fin_co_no kor_co_nm fin_prdt_cd fin_prdt_nm join_way mtrt_int spcl_cnd join_deny join_member etc_note max_limit loan_inci_expn erly_rpay_fee dly_rate loan_lmt crdt_prdt_type crdt_prdt_type_nm cb_name".split()
OPTION = "dcls_month fin_co_no fin_prdt_cd intr_rate_type intr_rate_type_nm rsrv_type rsrv_type_nm save_trm mrtg_type mrtg_type_nm rpay_type rpay_type_nm lend_rate_type lend_rate_type_nm crdt_prdt_type crdt_lend_rate_type crdt_lend_rate_type_nm".split()
RATES = "intr_rate intr_rate2 lend_rate_min lend_rate_max lend_rate_avg crdt_grad_1 crdt_grad_4 crdt_grad_5 crdt_grad_6 crdt_grad_10 crdt_grad_11 crdt_grad_12 crdt_grad_13 crdt_grad_avg".split()


def _struct(names: list[str], rates: list[str] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, T.DecimalType(20, 6)) for n in rates])


DISCLOSURE = T.StructType([T.StructField("baseList", T.ArrayType(_struct(BASE))), T.StructField("optionList", T.ArrayType(_struct(OPTION, RATES)))])
STATUTE = T.StructType([T.StructField(n, T.StringType()) for n in "name slug category law_type effective_date promulgation_date ministry mst source_url fetched_from".split()] + [T.StructField("articles", T.ArrayType(_struct(["label", "title", "text", "effective"])))])
QUESTION = T.StructType([T.StructField(n, T.StringType()) for n in "id qtype category subcategory template question answer_type answer unit".split()] + [T.StructField("evidence", _struct(["source", "locator", "text"]))])


def disclosures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """products (kind, pos, fields of a base record) and options (kind, pos, fields of an option) of <kind>.json files.

    pos is the place in its file. Rates are read as decimals, so nothing is rounded on the way. Missing files and missing
    fields give nothing and nulls.
    """
    read = spark.read.schema(DISCLOSURE).option("multiLine", True).option("prefersDecimal", True).option("pathGlobFilter", "*.json").json(folder)
    files = read.withColumn("kind", F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)\.json$", 1)).where(F.col("kind").isin(KINDS))
    take = lambda c: files.select("kind", F.posexplode(c).alias("pos", "r")).select("kind", "pos", "r.*")
    return take("baseList"), take("optionList")


def statutes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STATUTE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set, one JSON object a line."""
    return spark.read.schema(QUESTION).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """A folder of CSV files for each sheet; arrays and structs as JSON."""
    for name, df in sheets.items():
        flat = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema]
        df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def statistics_sheet(questions_: DataFrame) -> DataFrame:
    """(dimension, value, n): how many questions there are by type, category, template and kind of answer, and in all."""
    dims = ["qtype", "category", "template", "answer_type"]
    pairs = F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in dims]))
    return questions_.select(pairs.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def display_names(products: DataFrame) -> DataFrame:
    """products with display_name: the name with clean white space; credit products that share a company and name get their
    type's name behind it, or the type's name alone if that contains the name already."""
    name, kind = squeezed(F.col("fin_prdt_nm")), squeezed(F.coalesce("crdt_prdt_type_nm", F.lit("")))
    twins = F.count("*").over(Window.partitionBy("kind", "fin_co_no", name))
    needs = (F.col("kind") == "credit") & (twins > 1) & (F.length(kind) > 0) & ~F.contains(name, kind)
    return products.withColumn("display_name", F.when(needs & F.contains(kind, name), kind).when(needs, F.concat(name, F.lit("("), kind, F.lit(")"))).otherwise(name))


def flattened(article: Column, parts: tuple[str, ...] = ("항", "호", "목")) -> Column:
    """An article's text with those of its paragraphs, items and sub-items, each level's text before what lies below it.

    article: struct(text, 항: array of struct(text, 호: array of struct(text, 목: array of struct(text)))).
    """

    def level(node: Column, below: tuple[str, ...]) -> Column:
        own = F.array(node["text"])
        if not below:
            return own
        return F.concat(own, F.flatten(F.transform(F.coalesce(node[below[0]], F.array()), lambda x: level(x, below[1:]))))

    return F.array_join(F.filter(level(article, parts), lambda x: F.length(F.trim(x)) > 0), "\n")


def article_label(number: Column, branch: Column) -> Column:
    return F.concat(F.lit("제"), number, F.lit("조"), F.when(F.length(branch) > 0, F.concat(F.lit("의"), branch)).otherwise(""))


def is_deleted(text: Column) -> Column:
    """Short articles that say nothing but that they have been deleted."""
    return (F.length(F.regexp_replace(text, "<[^>]*>", "")) < 40) & F.contains(text, F.lit("삭제"))
