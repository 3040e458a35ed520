"""Queries over documents, chunks, runs, events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal
from ..operators import index as ops
from ..operators import vectors
from ..tables import norm_key, table
from .registry import query

_NEWEST = """docs AS (SELECT DISTINCT ON (id) * FROM legal_documents WHERE id IS NOT NULL ORDER BY id, updatedAt DESC NULLS LAST, metadata DESC NULLS LAST)"""
_CHUNKS = """chunks AS (SELECT DISTINCT ON (id) *, lower(trim(coalesce(chunkType, 'generic'), ' ')) AS type FROM legal_chunks WHERE id IS NOT NULL AND documentId IS NOT NULL
    ORDER BY id, documentId DESC, chunkNo DESC NULLS LAST, chunkType DESC NULLS LAST, articleRef DESC NULLS LAST, heading DESC NULLS LAST, startPage DESC NULLS LAST, endPage DESC NULLS LAST, md5(text) DESC NULLS LAST)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "updatedAt", "metadata", "title", "docType", "lawName", "blobPath", "contentHash", "publishDate", "jurisdiction"]
    return ops.newest(table(spark, d, "legal_documents").select(*cols), "id", ["updatedAt", "metadata"])


@query(f"WITH {_NEWEST} SELECT id, updatedAt, title, blobPath FROM docs")
def newest_documents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", "updatedAt", "title", "blobPath")


@query(f"""
    WITH {_NEWEST}, t AS (SELECT id, lower(coalesce(title, '')) AS l FROM docs)
    SELECT id, CASE WHEN contains(l, 'reglamento') THEN 'reglamento' WHEN contains(l, 'código') OR contains(l, 'codigo') THEN 'codigo' WHEN contains(l, 'presupuesto') THEN 'presupuesto'
        WHEN contains(l, 'decreto') THEN 'decreto' WHEN contains(l, 'acuerdo') THEN 'acuerdo' WHEN contains(l, 'norma') OR contains(l, 'nom-') THEN 'norma' WHEN contains(l, 'ley') THEN 'ley' ELSE 'otro' END AS doc_type FROM t
""")
def inferred_doc_types(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", legal.doc_type(F.col("title")).alias("doc_type"))


@query(f"""WITH {_NEWEST} SELECT id, substring(trim(regexp_replace(trim(title), '\\s*\\([^)]*\\)\\s*$', '')), 1, 255) AS law_name FROM docs""")
def law_names(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", legal.law_name(F.col("title")).alias("law_name"))


@query(f"WITH {_NEWEST} SELECT id FROM docs WHERE id IN (SELECT documentId FROM legal_chunks)")
def docs_with_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "legal_chunks").select(F.col("documentId").alias("id"))
    return _docs(spark, d).join(c, "id", "left_semi").select("id")


@query(f"WITH {_NEWEST} SELECT id FROM docs WHERE id NOT IN (SELECT documentId FROM legal_chunks WHERE documentId IS NOT NULL AND lower(trim(chunkType)) = 'table')")
def docs_without_tables(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "legal_chunks").where(norm_key(F.col("chunkType")) == "table").select(F.col("documentId").alias("id"))
    return _docs(spark, d).join(c, "id", "left_anti").select("id")


@query(f"""WITH {_NEWEST} SELECT id, updatedAt FROM docs WHERE (metadata IS NULL OR NOT contains(metadata, '"toc"') OR regexp_matches(metadata, '"toc"\\s*:\\s*(null|\\[\\s*\\])')) AND id IN (SELECT documentId FROM legal_chunks) ORDER BY updatedAt, id LIMIT 20""")
def missing_toc_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "legal_chunks").select(F.col("documentId").alias("id"))
    empty = F.col("metadata").rlike(r'"toc"\s*:\s*(null|\[\s*\])')
    missing = F.col("metadata").isNull() | ~F.col("metadata").contains('"toc"') | empty
    return _docs(spark, d).where(missing).join(c, "id", "left_semi").select("id", "updatedAt").orderBy("updatedAt", "id").limit(20)


@query("SELECT contentHash, count(*) AS deliveries, count(DISTINCT id) AS documents FROM legal_documents WHERE contentHash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    """Contents delivered more than once."""
    rows = table(spark, d, "legal_documents").where("contentHash IS NOT NULL").groupBy("contentHash")
    return rows.agg(F.count("*").alias("deliveries"), F.count_distinct("id").alias("documents")).where("deliveries > 1")


@query(f"""
    WITH {_NEWEST}, old AS (SELECT blobPath, max(title) AS title, max(lawName) AS lawName FROM docs WHERE publishDate < DATE '2015-01-01' GROUP BY 1),
    new AS (SELECT blobPath, max(upper(title)) AS title FROM docs WHERE publishDate >= DATE '2010-01-01' GROUP BY 1)
    SELECT coalesce(o.blobPath, n.blobPath) AS blobPath, substring(coalesce(n.title, o.title), 1, 500) AS title, substring(o.lawName, 1, 255) AS lawName FROM old o FULL OUTER JOIN new n ON o.blobPath = n.blobPath
""")
def document_upsert_view(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    old = docs.where("publishDate < DATE '2015-01-01'").groupBy("blobPath").agg(F.max("title").alias("title"), F.max("lawName").alias("lawName"))
    new = docs.where("publishDate >= DATE '2010-01-01'").groupBy("blobPath").agg(F.max(F.upper("title")).alias("title"))
    return ops.upsert_documents(old, new)


@query(f"""
    WITH {_CHUNKS} SELECT id, documentId, chunkNo, type AS chunkType, substring(articleRef, 1, 100) AS articleRef, substring(heading, 1, 500) AS heading,
        CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INT) AS tokenCount
    FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g')) AS t FROM chunks)
""")
def chunk_upsert_view(spark: SparkSession, d: str) -> DataFrame:
    return ops.chunk_rows(_one(spark, d, "text")).drop("tsv")


@query(f"""WITH {_CHUNKS}, w AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(translate(lower(coalesce(text, '')), 'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({", ".join(f"'{x}'" for x in legal.STOP_WORDS)})))) AS t FROM chunks)
    SELECT id, array_to_string(t, ' ') AS tokens FROM w""")
def chunk_search_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ops.chunk_rows(_one(spark, d, "text")).select("id", F.array_join("tsv", " ").alias("tokens"))


def _one(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return ops.distinct_chunks(table(spark, d, "legal_chunks"), *extra)


@query(f"WITH {_CHUNKS} SELECT type, count(*) AS chunks FROM chunks GROUP BY 1")
def chunk_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d).groupBy(norm_key(F.coalesce("chunkType", F.lit("generic"))).alias("type")).agg(F.count("*").alias("chunks"))


@query(f"""
    WITH {_CHUNKS} SELECT documentId, count(*) AS chunks, count(*) FILTER (type = 'article') AS articles, count(*) FILTER (type = 'fraction') AS fractions, count(*) FILTER (type = 'transitorio') AS transitory,
        count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type IN ('book', 'title', 'chapter', 'section')) AS containers, bool_or(type = 'transitorio') AS has_transitory,
        coalesce(max(endPage), 0) AS pages FROM chunks GROUP BY 1
""")
def structure_summary(spark: SparkSession, d: str) -> DataFrame:
    t = norm_key(F.coalesce("chunkType", F.lit("generic")))
    count = lambda *names: F.count_if(t.isin(*names))
    return _one(spark, d).groupBy("documentId").agg(
        F.count("*").alias("chunks"), count("article").alias("articles"), count("fraction").alias("fractions"), count("transitorio").alias("transitory"), count("table").alias("tables"),
        count("book", "title", "chapter", "section").alias("containers"), F.bool_or(t == "transitorio").alias("has_transitory"), F.coalesce(F.max("endPage"), F.lit(0)).alias("pages"),
    )


@query(f"""
    WITH {_CHUNKS} SELECT DISTINCT articleRef, CASE
        WHEN regexp_matches(r, '(?i)^(\\d+)[º°o]?\\.?\\s*Bis$') THEN regexp_extract(r, '^(\\d+)', 1) || ' Bis'
        WHEN regexp_matches(r, '(?i)^(\\d+)[º°o]?\\.?\\s*-\\s*([A-Za-z])') THEN regexp_extract(r, '(?i)^(\\d+)[º°o]?\\.?\\s*-\\s*([A-Za-z])', 1) || '-' || regexp_extract(r, '(?i)^(\\d+)[º°o]?\\.?\\s*-\\s*([A-Za-z])', 2)
        WHEN regexp_matches(r, '\\d+(-\\s*[A-Za-z0-9]+)+$') THEN r ELSE trim(regexp_replace(r, '(?i)^(\\d+)[º°o]\\s*$', '\\1')) END AS number
    FROM (SELECT articleRef, trim(regexp_replace(trim(articleRef), '(?i)^art([íiÍ]culo|\\.)\\s*', '')) AS r FROM chunks WHERE articleRef IS NOT NULL)
""")
def article_numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = legal.strip(F.regexp_replace(legal.strip(F.col("articleRef")), r"(?iU)^art([íi]culo|\.)\s*", ""))
    return _one(spark, d).where("articleRef IS NOT NULL").select("articleRef", legal.article_number(raw).alias("number")).distinct()


_RUNS = """runs AS (SELECT DISTINCT ON (id) * FROM index_runs WHERE id IS NOT NULL ORDER BY id, startedAt DESC NULLS LAST, endedAt DESC NULLS LAST, status DESC NULLS LAST)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return ops.newest(table(spark, d, "index_runs"), "id", ["startedAt", "endedAt", "status"])


@query(f"WITH {_RUNS} SELECT id, startedAt FROM runs WHERE lower(trim(status)) = 'processing' AND startedAt < (SELECT max(startedAt) FROM index_runs) - INTERVAL 1 HOUR")
def stuck_runs(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "index_runs").agg(F.max("startedAt")).first()[0]
    return ops.stuck_runs(_runs(spark, d), F.lit(newest)).select("id", "startedAt")


@query(f"""WITH {_RUNS} SELECT lower(trim(status)) AS status, count(*) AS runs, CAST(coalesce(sum(docsIndexed), 0) AS BIGINT) AS docs, CAST(coalesce(sum(chunksTotal), 0) AS BIGINT) AS chunks,
    count(*) FILTER (endedAt IS NULL) AS open_runs FROM runs GROUP BY 1""")
def run_status_summary(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy(norm_key(F.col("status")).alias("status")).agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("docsIndexed"), F.lit(0)).alias("docs"), F.coalesce(F.sum("chunksTotal"), F.lit(0)).alias("chunks"), F.count_if(F.col("endedAt").isNull()).alias("open_runs")
    )


@query(f"""WITH {_RUNS} SELECT strftime(startedAt, '%Y-%m-%d') AS day, count(*) AS runs, round(coalesce(median(epoch(endedAt) - epoch(startedAt)), 0), 3) AS median_seconds FROM runs WHERE startedAt IS NOT NULL GROUP BY 1""")
def run_durations(spark: SparkSession, d: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return _runs(spark, d).where("startedAt IS NOT NULL").groupBy(F.date_format("startedAt", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("runs"), F.round(F.coalesce(F.median(micros("endedAt") - micros("startedAt")), F.lit(0.0)), 3).alias("median_seconds")
    )


@query("""
    WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64),
    p AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(q.v, e.v), 6) AS similarity FROM e JOIN e q ON q.id % 100 = 0 AND e.id <> q.id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM p)
    SELECT * FROM r WHERE rank <= 3
""")
def embedding_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), 3)


@query(f"""WITH {_NEWEST}, w AS (SELECT id, coalesce(title, '') AS t, list_filter(string_split(trim(regexp_replace(coalesce(title, ''), '[\\s\\p{{Z}}]+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '^\\p{{L}}') AND lower(x) NOT IN ({", ".join(f"'{x}'" for x in legal.ACRONYM_STOPS)})) AS words FROM docs)
    SELECT id, CASE WHEN len(words) < 2 THEN regexp_replace(substring(t, 1, 50), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') ELSE array_to_string(list_transform(words, lambda x: upper(x[1])), '') END AS acronym FROM w""")
def law_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", legal.law_acronym(F.col("title")).alias("acronym"))
