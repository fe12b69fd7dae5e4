"""From documents to packed sequences: language, exact copies, near copies, the mix of sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, cut
from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.llm.language_id import identify
from loomgraph.llm.mixing import mix
from loomgraph.llm.packing import pack
from loomgraph.llm.simhash import near_duplicates, reach_of, twins

#: Near copies: texts whose shingles of five words have a similarity of 0.8 or more, told from fingerprints of 128 bits.
WORDS, SIMILARITY, BITS = 5, 0.8, 128


def _alike(a: list, b: list):
    on = F.lit(True)
    for x, y in zip(a, b, strict=True):
        on = on & x.eqNullSafe(y)
    return on


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the columns of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language can be told: with letters, and not unlike all that has been learned.

    Null, empty and letterless texts go; without any labelled text all documents do. Each row is told by its own text, so
    ties and repeated rows share their fate, and very long texts are read whole. An empty table stays empty.
    """
    told = identify(docs, F.lit(True), whole=True)
    return told.where("lang_pred <> 'und' AND cosine > 0").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case), the row with the smallest doc_id stays; of rows alike in both, one.

    Null and empty texts are equal; null doc_ids come last. Texts are compared whole, however long. An empty table stays
    empty.
    """
    id_, key, own = _free(docs, "id", "sha", "own")
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(key))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    found = docs.withColumn(own, sha).join(kept, _alike([F.col("doc_id"), F.col(own)], [F.col(id_), F.col(key)]), "left_semi")
    return found.dropDuplicates(["doc_id", own]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays (null doc_ids last).

    Texts without words, null ones too, are one group. Of rows alike in doc_id and text, all stay if their text does: the
    stage before leaves one. Texts are compared whole, however long. An empty table stays empty.
    """
    id_, key = _free(docs, "id", "key")
    twin = twins(docs)
    told = near_duplicates(docs, WORDS, reach_of(SIMILARITY, BITS), BITS, SIMILARITY, twin=twin)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("twin"))
    kept = told.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.id").alias(id_), F.col("first.twin").alias(key))
    return docs.join(kept, _alike([F.col("doc_id"), twin], [F.col(id_), F.col(key)]), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the mix's slots: whole texts, and where it is taken in
    part, its first words.

    A copy stands at the slot that takes its first block, so files read in the order of their names, and their rows in
    turn, have every source's share all along. n_chars is that of the text that goes on. Documents that the mix doesn't
    take, go, as do those without words, null and empty texts among them. Rows alike in doc_id and text share what is
    taken of them. An empty table stays empty.
    """
    id_, tie, best, turn, part = _free(docs, "id", "tie", "best", "turn", "part")
    taken = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias(id_), F.col("tie").alias(tie)).agg(F.max(F.struct("taken", "size", "turns")).alias(best))
    found = docs.join(taken, _alike([F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))], [F.col(id_), F.col(tie)]))
    took, size = F.col(best)["taken"], F.col(best)["size"]
    copies = F.transform(F.col(best)["turns"], lambda slot, e: F.struct(slot.alias("slot"), F.when((e + 1) * size > took, took - e * size).alias("part")))
    made = found.withColumn(turn, F.explode(copies)).withColumn(part, F.col(turn)["part"])
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col(part).cast("int")), "")
    text = F.when(F.col(part).isNull(), F.col("text")).otherwise(first)
    made = made.withColumn("text", text)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col(part).isNull(), F.col("n_chars")).otherwise(F.length("text")))
    place = [F.col(turn)["slot"], F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))]
    return made.repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, by pack(): null and empty texts are a token, very long ones are cut, rows alike
    are packed one by one, an empty table gives an empty result."""
    return pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mixed), ("best_fit_packing", packed)]

#: Fingerprints, n-gram vectors and best-fit bins are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
