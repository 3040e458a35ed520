"""Queries over structural quality and the corpus evaluation, on the trees of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, quality as ops
from ..session import cut_lineage
from .index import _CHUNKS, _NEWEST, _docs, _one
from .registry import query
from .structure import _TREE, _in, chunk_blocks, structure

_MONTHS = "|".join(["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"])
_S = "[\\s\\p{Z}]"
_BLEED = f"'(?i)diario{_S}+oficial|c[aáÁ]mara{_S}+de{_S}+(?:diputados|senadores)|gaceta{_S}+parlamentaria|secretar[iíÍ]a{_S}+de{_S}+gobernaci[oóÓ]n|^{_S}*\\d{{1,4}}{_S}*$|p[aáÁ]gina{_S}+\\d+'"
_DATED = f"'(?i)^{_S}*\\d{{1,2}}{_S}+de{_S}+(?:{_MONTHS}){_S}+de{_S}+\\d{{4}}{_S}*$|(?:DOF|diario{_S}+oficial){_S}+\\d{{1,2}}[\\s/\\-]'"
_SEQ = f"""{_TREE},
    arts AS (SELECT doc_id, ord, article_ref, try_cast(nullif(regexp_extract(replace(replace(article_ref, '-', ''), ' ', ''), '^(\\d+)([A-Za-z]*)$', 1), '') AS INT) AS base FROM tree WHERE node_type = 'article' AND article_ref IS NOT NULL),
    gaps AS (SELECT doc_id, base - lag(base) OVER (PARTITION BY doc_id ORDER BY ord) AS gap FROM arts WHERE base IS NOT NULL),
    s AS (SELECT doc_id, count(*) AS bases, count(*) FILTER (gap < 0) AS down, greatest(coalesce(max(gap), 0), 0) AS gap FROM gaps GROUP BY 1),
    u AS (SELECT doc_id, count(*) AS refs, count(*) - count(DISTINCT article_ref) AS dups FROM arts GROUP BY 1),
    seq AS (SELECT doc_id, refs, CASE WHEN few THEN 0 ELSE round(down / (bases - 1), 4) END AS disorder_ratio, CAST(CASE WHEN few THEN 0 ELSE gap END AS INT) AS max_gap, CASE WHEN few THEN 0 ELSE round(dups / refs, 4) END AS duplicate_ratio
        FROM (SELECT *, refs < 2 OR coalesce(bases, 0) < 2 AS few FROM u LEFT JOIN s USING (doc_id)))"""
_CHECKS = f"""{_SEQ},
    f AS (SELECT *, coalesce(heading, '') AS h, node_type IN {_in(structure.NAVIGABLE)} AS nav FROM tree),
    c AS (SELECT doc_id, count(*) AS nodes, count(*) FILTER (nav AND regexp_matches(concat_ws(' ', h, nullif(text, '')), '(?i)\\[?/?TABLE(?:_\\d+)?\\]?')) AS tokens, count(*) FILTER (nav AND regexp_matches(h, {_BLEED})) AS bleed,
        count(*) FILTER (nav AND regexp_matches(h, {_DATED})) AS dates, count(*) FILTER (node_type = 'table' AND page_number IS NULL) AS orphans, count(*) FILTER (node_type = 'table') AS tables,
        count(*) FILTER (node_type = 'paragraph' AND parent_ord = 0) AS loose, count(*) FILTER (node_type = 'article') AS articles, count(*) FILTER (node_type = 'article' AND article_ref IS NOT NULL) AS referred,
        count(*) FILTER (nav) AS entries, count(DISTINCT CASE WHEN nav THEN node_type || '|' || h || '|' || coalesce(CAST(page_number AS VARCHAR), '') END) AS entry_kinds, count(DISTINCT CASE WHEN nav THEN node_id END) AS ids FROM f GROUP BY 1),
    m AS (SELECT c.*, coalesce(disorder_ratio, 0) AS dis, coalesce(max_gap, 0) AS gap, coalesce(duplicate_ratio, 0) AS dr, loose / nodes AS deg, greatest(entries - entry_kinds, entries - ids) AS duplicates,
        CASE WHEN entries > 0 THEN greatest(entries - entry_kinds, entries - ids) / entries ELSE 0 END AS dup, CASE WHEN articles > 0 THEN referred / articles ELSE 1 END AS cov, CASE WHEN tables > 0 THEN orphans / tables ELSE 0 END AS orp FROM c LEFT JOIN seq USING (doc_id))"""
_SCORED = f"""{_CHECKS},
    scores AS (SELECT doc_id, nodes, round(
        0.20::DOUBLE * CASE WHEN tokens = 0 THEN 1 ELSE greatest(0, 1 - tokens * 0.8::DOUBLE) END + 0.15::DOUBLE * CASE WHEN dis < 0.3 AND gap <= 50 AND dr < 0.4 THEN 1 ELSE greatest(0, 1 - least(1.0::DOUBLE, dis * 1.5::DOUBLE + dr * 0.8::DOUBLE + least(1.0::DOUBLE, greatest(0, gap - 50) / 50) * 0.5::DOUBLE)) END
        + 0.20::DOUBLE * CASE WHEN bleed = 0 THEN 1 ELSE greatest(0, 1 - bleed * 0.4::DOUBLE) END + 0.05::DOUBLE * CASE WHEN dates = 0 THEN 1 ELSE greatest(0, 1 - dates * 0.15::DOUBLE) END
        + 0.05::DOUBLE * CASE WHEN orphans = 0 THEN 1 ELSE greatest(0, 1 - orp) END + 0.10::DOUBLE * CASE WHEN deg < 0.3 THEN 1 ELSE greatest(0, 1 - round(deg, 4) * 2) END
        + 0.10::DOUBLE * CASE WHEN dup < 0.15 THEN 1 ELSE greatest(0, 1 - round(dup, 4) * 2.5::DOUBLE) END + 0.15::DOUBLE * CASE WHEN cov >= 0.5 OR articles <= 2 THEN 1 ELSE round(cov, 4) END, 4) AS score,
        concat_ws(',', CASE WHEN tokens > 0 THEN 'has_visible_table_tokens' END, CASE WHEN NOT (dis < 0.3 AND gap <= 50 AND dr < 0.4) THEN 'article_sequence_health' END, CASE WHEN bleed > 0 THEN 'header_footer_bleed' END,
            CASE WHEN dates > 0 THEN 'date_heading_false_positive_count' END, CASE WHEN orphans > 0 THEN 'orphan_tables_count' END, CASE WHEN deg >= 0.3 THEN 'unknown_block_ratio' END, CASE WHEN dup >= 0.15 THEN 'toc_duplicate_ratio' END,
            CASE WHEN NOT (cov >= 0.5 OR articles <= 2) THEN 'article_ref_coverage' END) AS reasons FROM m),
    graded AS (SELECT doc_id, nodes, score, CASE WHEN score >= 0.85 THEN 'low' WHEN score >= 0.7 THEN 'medium' ELSE 'high' END AS severity, score >= 0.7 AS passed, reasons FROM scores)"""
_RECORDS = f"""{_SCORED}, {_NEWEST}, recs AS (SELECT docs.id AS documentId, CASE WHEN doc_id IS NULL THEN 'failed' ELSE 'ok' END AS status, coalesce(score, 0) AS score, coalesce(severity, 'high') AS severity, coalesce(reasons, '') AS reasons FROM docs LEFT JOIN graded ON doc_id = docs.id)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the chunk table with a flag for table marks, so that texts don't move with it."""
    rows = chunk_blocks(spark, d, "marked")
    rows = rows.withColumn("text", F.when(F.col("marked") | F.col("head").rlike(ops.TABLE_TOKEN), "[TABLE_1]"))
    tree = structure.nodes(rows).withColumn("tokens", F.col("text").isNotNull())
    return cut_lineage(tree.drop("text", "ancestors"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return ops.scored(_nodes(spark, d))


def _records(spark: SparkSession, d: str, tree: DataFrame | None = None) -> DataFrame:
    """Every document with its score; documents without chunks count as failed."""
    scores = ops.scored(_nodes(spark, d) if tree is None else tree)
    got = _docs(spark, d).select(F.col("id").alias("documentId")).join(scores.withColumnRenamed("doc_id", "documentId"), "documentId", "left")
    status = F.when(F.col("nodes").isNull(), "failed").otherwise("ok")
    return got.select("documentId", status.alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("severity", F.lit("high")).alias("severity"), F.coalesce("reasons", F.lit("")).alias("reasons"))


@query(f"WITH {_SEQ} SELECT * FROM seq")
def article_sequence_health(spark: SparkSession, d: str) -> DataFrame:
    return ops.article_sequence(_nodes(spark, d))


@query(f"WITH {_CHECKS} SELECT doc_id, nodes, tokens, bleed, dates, orphans, tables, 0 AS unknown, loose, articles, referred, entries, duplicates AS toc_duplicates FROM m")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    got = ops.verdicts(ops.checks(_nodes(spark, d)))
    return got.select("doc_id", "nodes", "tokens", "bleed", "dates", "orphans", "tables", "unknown", "loose", "articles", "referred", "entries", "toc_duplicates")


@query(f"WITH {_SCORED} SELECT * FROM graded")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"WITH {_SCORED} SELECT doc_id, score, score >= 0.85 AS gate, CASE WHEN score >= 0.85 THEN 'quality_sufficient' ELSE 'quality_insufficient' END AS gate_reason FROM graded")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return ops.gated(_scores(spark, d)).select("doc_id", "score", "gate", "gate_reason")


@query(f"""WITH {_RECORDS} SELECT count(*) AS documents, count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status = 'failed') AS failed, round(coalesce(avg(score) FILTER (status = 'ok'), 0), 4) AS avg_score,
    round(coalesce(median(score) FILTER (status = 'ok'), 0), 4) AS median_score, min(score) FILTER (status = 'ok') AS min_score, max(score) FILTER (status = 'ok') AS max_score,
    {", ".join(f"count(*) FILTER (status = 'ok' AND severity = '{s}') AS {s}_documents" for s in ("low", "medium", "high"))} FROM recs""")
def corpus_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ops.corpus_metrics(_records(spark, d))


@query(f"""WITH {_SCORED}, b AS (SELECT unnest(['0.0-0.5', '0.5-0.7', '0.7-0.85', '0.85-1.0']) AS bucket)
    SELECT bucket, count(score) AS documents FROM b LEFT JOIN graded ON bucket = CASE WHEN score < 0.5 THEN '0.0-0.5' WHEN score < 0.7 THEN '0.5-0.7' WHEN score < 0.85 THEN '0.7-0.85' ELSE '0.85-1.0' END GROUP BY 1""")
def score_buckets(spark: SparkSession, d: str) -> DataFrame:
    return ops.score_buckets(_scores(spark, d))


@query(f"""WITH {_SCORED}, r AS (SELECT reason, count(*) AS documents FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM graded WHERE reasons <> '') GROUP BY 1)
    SELECT reason, documents, CAST(row_number() OVER (ORDER BY documents DESC, list_position({list(ops.WEIGHTS)}, reason)) AS INT) AS place FROM r""")
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return ops.failure_reasons(_scores(spark, d))


@query(f"WITH {_RECORDS} SELECT documentId, score, status FROM recs WHERE status <> 'ok' OR score < 0.85 OR severity = 'high' ORDER BY score, documentId LIMIT 10")
def worst_documents(spark: SparkSession, d: str) -> DataFrame:
    return ops.problematic(_records(spark, d)).select("documentId", "score", "status").orderBy("score", "documentId").limit(10)


@query(f"""
    WITH {_CHUNKS}, k AS (SELECT *, coalesce(chunkType, '') AS kind, regexp_replace(coalesce(heading, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS h, chunkNo % 2 AS p FROM chunks WHERE chunkNo IS NOT NULL),
    m AS (SELECT documentId, p, count(*) AS n, count(*) FILTER (kind IN ('article', 'transitorio', 'transitory')) AS a, count(*) FILTER (kind IN ('article', 'transitorio', 'transitory') AND trim(coalesce(articleRef, '')) <> '') AS r,
        count(*) FILTER (h <> '' AND NOT regexp_matches(h, '(?i)\\[?/?TABLE(?:_\\d+)?\\]?') AND length(h) <= 300) AS g, count(*) FILTER (kind = 'table') AS t, bool_or(regexp_matches(concat_ws(' ', coalesce(heading, ''), coalesce(text, '')), '(?i)\\[?/?TABLE(?:_\\d+)?\\]?')) AS tok FROM k GROUP BY 1, 2),
    j AS (SELECT coalesce(l.documentId, r.documentId) AS documentId, coalesce(l.n, 0) AS left_chunks, round(CASE WHEN l.a > 0 THEN l.r / l.a ELSE 1 END, 4) AS left_coverage, coalesce(r.n, 0) AS right_chunks, round(CASE WHEN r.a > 0 THEN r.r / r.a ELSE 1 END, 4) AS right_coverage,
        coalesce(l.t, 0) AS left_tables, coalesce(r.t, 0) AS right_tables, coalesce(l.tok, false) AS left_tokens, coalesce(r.tok, false) AS right_tokens, round(coalesce(r.g / r.n, 1) - coalesce(l.g / l.n, 1), 4) AS heading_quality_delta
        FROM (SELECT * FROM m WHERE p = 0) l FULL OUTER JOIN (SELECT * FROM m WHERE p = 1) r ON l.documentId = r.documentId)
    SELECT *, coalesce(nullif(concat_ws('; ', CASE WHEN right_chunks <> left_chunks THEN 'chunk_count_delta=' || format('{{:+d}}', right_chunks - left_chunks) END, CASE WHEN heading_quality_delta <> 0 THEN 'heading_quality_delta=' || format('{{:+.4f}}', heading_quality_delta) END,
        CASE WHEN left_tokens AND NOT right_tokens THEN 'v2_removed_table_tokens' END, CASE WHEN NOT left_tokens AND right_tokens THEN 'v2_introduced_table_tokens' END, CASE WHEN right_tables <> left_tables THEN 'table_count_delta=' || format('{{:+d}}', right_tables - left_tables) END), ''), 'no_significant_differences') AS summary FROM j
""")
def variant_compare(spark: SparkSession, d: str) -> DataFrame:
    """The comparison of two pipeline versions, here of the even and the odd chunks of each document."""
    c = cut_lineage(_one(spark, d, "text").where("chunkNo IS NOT NULL"))
    got = ops.compared(c.where("chunkNo % 2 = 0"), c.where("chunkNo % 2 = 1"))
    return got.drop("left_notes", "right_notes", "left_types", "right_types")


_FLAGS = {"has_visible_table_tokens": "has_visible_table_tokens", "has_header_footer_bleed": "header_footer_bleed", "low_article_ref_coverage": "article_ref_coverage", "has_orphan_tables": "orphan_tables_count", "has_toc_duplicates": "toc_duplicate_ratio"}


@query(f"""WITH {_RECORDS}, n AS (SELECT doc_id, count(*) FILTER (node_type = 'article') AS article_count, count(*) FILTER (node_type = 'table') AS table_count, count(*) AS chunk_count FROM tree GROUP BY 1)
    SELECT documentId, blobPath, r.score AS quality_score, r.severity AS quality_severity, coalesce(chunk_count, 0) AS chunk_count, coalesce(article_count, 0) AS article_count, coalesce(table_count, 0) AS table_count,
        {", ".join(f"list_contains(string_split(r.reasons, ','), '{v}') AS {k}" for k, v in _FLAGS.items())}, status, string_split(r.reasons, ',')[1] AS top_reason, replace(r.reasons, ',', ';') AS all_reasons
    FROM recs r JOIN docs ON docs.id = documentId LEFT JOIN n ON n.doc_id = documentId""")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """One flat row per document, as the corpus report's CSV holds them: records joined with their quality reports and the figures of their trees."""
    tree = _nodes(spark, d)
    paths = _docs(spark, d).select(F.col("id").alias("documentId"), "blobPath")
    return index.flat_records(_records(spark, d, tree), structure.counts(tree), paths, _FLAGS)


@query(f"WITH {_RECORDS} SELECT {', '.join(f'count(*) FILTER (list_contains(string_split(reasons, chr(44)), {chr(39)}{v}{chr(39)})) AS {k}' for k, v in _FLAGS.items())} FROM recs")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    has = lambda v: F.array_contains(F.split("reasons", ","), v)
    return _records(spark, d).agg(*[F.count_if(has(v)).alias(k) for k, v in _FLAGS.items()])
