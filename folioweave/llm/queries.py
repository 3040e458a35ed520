"""The p-queries of this subpackage, over whole tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import bpe, forest, mixture, neardup, reading, scanrepair, split, standins


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized_ids(table(spark, d, "legal_chunks"), table(spark, d, "split_limits"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "legal_chunks"), table(spark, d, "split_limits"))


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    chunks = standins.normalise_text(table(spark, d, "legal_chunks"), "chunk", "id", "heading")
    return chunks.unionByName(standins.normalise_text(table(spark, d, "extracted_spans"), "span", "span_id", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).where("is_case").select("src", "rec_id").distinct()


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).select("src", "rec_id", "norm_text").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.found(table(spark, d, "legal_chunks"), table(spark, d, "page_content"), table(spark, d, "extracted_spans"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.repaired(table(spark, d, "legal_chunks"), table(spark, d, "page_content"), table(spark, d, "extracted_spans"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.neighbour_pairs(table(spark, d, "legal_chunks"), "id", "embedding")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return forest.named_neighbours(table(spark, d, "legal_chunks"), "id", "embedding")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = neardup.similar_pairs(table(spark, d, "legal_chunks"), "id", "text", neardup.CHUNK_RULE)
    titles = neardup.similar_pairs(table(spark, d, "legal_documents"), "id", "title", neardup.TITLE_RULE)
    return chunks.select(F.lit("chunk").alias("src"), "id_a", "id_b").unionByName(titles.select(F.lit("document").alias("src"), "id_a", "id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    chunks = neardup.groups(table(spark, d, "legal_chunks"), "id", "text", neardup.CHUNK_RULE)
    titles = neardup.groups(table(spark, d, "legal_documents"), "id", "title", neardup.TITLE_RULE)
    return chunks.select(F.lit("chunk").alias("src"), "*").unionByName(titles.select(F.lit("document").alias("src"), "*"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(*mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples")).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    got = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples"))
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in reading.FEATURES[:7]]
    return got.groupBy("reading_level").agg(F.count("*").alias("documents"), *means)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_normalised, p3_found, p3_repaired, p4_found, p4_neighbours, p6_found, p6_groups, p7_ids, p8_mix, p8_shares, p9_found, p9_profile)
}

#: An exact join on shared runs, as an independent check of the chosen-path join; far too slow beyond small tables.
_BLANKS = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]"
_EXACT_PAIRS = rf"""
    WITH ct AS (SELECT DISTINCT id, text FROM legal_chunks WHERE id IS NOT NULL AND text IS NOT NULL),
        cw AS (SELECT id, list_filter(string_split_regex(lower(text), '{_BLANKS}+'), lambda x: x <> '') AS w FROM ct),
        cs AS (SELECT row_number() OVER () AS k, id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2])) AS s FROM cw WHERE len(w) >= 25),
        tt AS (SELECT DISTINCT id, lower(title) AS t FROM legal_documents WHERE id IS NOT NULL AND title IS NOT NULL AND NOT regexp_full_match(title, '{_BLANKS}*')),
        ts AS (SELECT row_number() OVER () AS k, id, list_distinct(list_transform(generate_series(1, length(t) - 2), lambda i: substring(t, i, 3))) AS s FROM tt WHERE length(t) >= 3),
        u AS (SELECT 'chunk' AS src, k, id, s, 0.5 AS least FROM cs UNION ALL SELECT 'document', k, id, s, 0.65 FROM ts),
        e AS (SELECT src, k, unnest(s) AS g FROM u),
        p AS (SELECT a.src, a.k AS ka, b.k AS kb, count(*) AS n FROM e a JOIN e b ON a.src = b.src AND a.g = b.g AND a.k < b.k GROUP BY ALL)
    SELECT DISTINCT p.src, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM p JOIN u x ON x.src = p.src AND x.k = p.ka JOIN u y ON y.src = p.src AND y.k = p.kb
    WHERE x.id <> y.id AND n / (len(x.s) + len(y.s) - n) >= x.least
"""

ORACLE: dict[str, str] = {
    "p6_found": _EXACT_PAIRS,
    "p1_found": """
        WITH lim AS (SELECT lower(trim(chunktype)) AS k, min(max_chars) AS m FROM split_limits GROUP BY 1)
        SELECT DISTINCT c.id AS chunk_id
        FROM legal_chunks c LEFT JOIN lim l ON lower(trim(c.chunkType)) = l.k
        WHERE c.id IS NOT NULL AND length(c.text) > coalesce(l.m, (SELECT m FROM lim WHERE k = 'generic'))
    """,
}
