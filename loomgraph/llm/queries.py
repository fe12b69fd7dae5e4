"""The queries over whole tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.vector_sql import TOP_PRODUCTS, clusters


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int):
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.ctph import fingerprints_with_next

    return fingerprints_with_next(_documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomgraph.llm.language_id import identify

    told = identify(_documents(spark, sf_dir), _remainder(3) != 1)
    return told.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", F.col("score"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomgraph.llm.mixing import mix

    mixed = mix(_documents(spark, sf_dir)).drop("rank", "source", "tie", "turns")
    return mixed.withColumn("slot", F.coalesce("slot", F.lit(-1)).cast("long"))  # -1: not taken


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.sharding import shard

    return shard(_documents(spark, sf_dir)).drop("group_bytes")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir), keep="largest")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomgraph.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op9_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.line_dedup import LINES, WITHIN, dedup_units

    return dedup_units(_documents(spark, sf_dir), LINES, inner=WITHIN, run_words=25)


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.ppm import score

    scored = score(_documents(spark, sf_dir), _remainder(5) != 1)
    return scored.select("doc_id", (_remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op10_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.html_extract import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.alignment import align

    return align(_documents(spark, sf_dir))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomgraph.llm.topk import top_products

    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.centroids import cluster_vectors

    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piecewise_fingerprints": op1_piecewise_fingerprints,
    "op2_mix_sources": op2_mix_sources,
    "op3_language": op3_language,
    "op4_shards": op4_shards,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_components": op6_simhash_components,
    "op9_repeated_units": op9_repeated_units,
    "op7_ppm_scores": op7_ppm_scores,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op10_article_text": op10_article_text,
    "op11_token_alignment": op11_token_alignment,
    "op12_top_products": op12_top_products,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight, 3 * source_size AS lim, 3 * source_size / (1 + (rank - 1) % 3) AS ratio,
             sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
level AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, rank LIMIT 1),
goal AS (SELECT source, rank, source_size, total, least(lim::DOUBLE, coalesce((SELECT level FROM level) * weight, lim)) AS target FROM l),
placed AS (SELECT d.*, g.rank, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS words,
                  coalesce(sum(size) OVER (PARTITION BY g.rank ORDER BY key, tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
sp AS (SELECT rank, blocks, sum(blocks) OVER (ORDER BY rank)::BIGINT - blocks AS since, sum(blocks) OVER (ORDER BY rank)::BIGINT AS upto
       FROM (SELECT rank, (floor(target + 0.5)::BIGINT + 1023) // 1024 AS blocks FROM goal WHERE floor(target + 0.5) > 0)),
tot AS (SELECT coalesce(sum(blocks), 0)::BIGINT AS slots FROM sp),
pt AS (SELECT slot, (((slot % 2147483648) * 2654435769) & 4294967295)::DOUBLE / 4294967296::DOUBLE * slots::DOUBLE AS point
       FROM (SELECT slots, unnest(range(slots)) AS slot FROM tot)),
held AS (SELECT slot, rank, blocks, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS block FROM pt JOIN sp ON point >= since AND point < upto),
free AS (SELECT slot, row_number() OVER (ORDER BY slot) AS n FROM held WHERE block >= blocks),
lacking AS (SELECT rank, block, row_number() OVER (ORDER BY rank, block) AS n
            FROM (SELECT sp.rank, unnest(range(coalesce(given, 0), blocks)) AS block
                  FROM sp LEFT JOIN (SELECT rank, count(*) AS given FROM held GROUP BY rank) g ON g.rank = sp.rank)),
turns AS (SELECT rank, block, slot FROM held WHERE block < blocks UNION ALL SELECT rank, block, slot FROM lacking JOIN free USING (n)),
took AS (SELECT *, list_sum([greatest(0, least(start + e * source_size + size, words) - (start + e * source_size)) for e in [0, 1, 2]])::BIGINT AS taken FROM placed)
SELECT doc_id, size, source_size, target, taken, coalesce(slot, -1)::BIGINT AS slot, (SELECT slots FROM tot) AS slots
FROM took LEFT JOIN turns ON took.taken > 0 AND turns.rank = took.rank AND turns.block = took.start // 1024
""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
""",
    "op12_top_products": TOP_PRODUCTS,
    "op13_centroids": clusters(),
}
