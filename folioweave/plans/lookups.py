"""Queries that find documents and chunks, replace them, and read names, dates and signs out of short texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal
from ..operators import index, metadata
from ..sources import readers
from ..tables import norm_key, table
from .index import _CHUNKS, _NEWEST, _docs, _one
from .registry import query
from .services import _squeeze, _trim, _values

_MONTHS = "|".join(legal.MONTHS)
_MONTH_NO = " ".join(f"WHEN '{m}' THEN '{i:02}'" for i, m in enumerate(legal.MONTHS, 1))


@query(f"WITH {_CHUNKS} SELECT id, documentId, chunkNo FROM chunks WHERE documentId = (SELECT documentId FROM chunks GROUP BY 1 ORDER BY count(*) DESC, documentId LIMIT 1)")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of one document, the largest, in order."""
    rows = _one(spark, d).select("id", "documentId", "chunkNo")
    largest = rows.groupBy("documentId").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "documentId").limit(1)
    return rows.join(largest, "documentId", "left_semi").select("id", "documentId", "chunkNo").orderBy("chunkNo")


@query(f"WITH {_NEWEST} SELECT id, blobPath, title FROM docs WHERE id IN (SELECT min(id) FROM docs UNION ALL SELECT max(id) FROM docs)")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Path and title of documents by id; the ids are pushed to the scan."""
    ids = table(spark, d, "legal_documents").agg(F.min("id"), F.max("id")).first()
    return _docs(spark, d).where(F.col("id").isin(*ids)).select("id", "blobPath", "title")


@query(f"WITH {_NEWEST} SELECT id, contentHash FROM docs WHERE contentHash IN (SELECT max(contentHash) FROM docs)")
def documents_by_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.join(docs.agg(F.max("contentHash").alias("contentHash")), "contentHash", "left_semi").select("id", "contentHash")


@query(f"WITH {_NEWEST} SELECT id, blobPath FROM docs WHERE starts_with(blobPath, (SELECT regexp_extract(min(blobPath), '^([^/]*/)', 1) FROM docs)) ORDER BY updatedAt DESC")
def discovered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents below the first folder, the newest first."""
    docs = _docs(spark, d)
    first = docs.agg(F.min("blobPath")).first()[0] or ""
    return readers.matching(docs, prefix=first.split("/", 1)[0] + "/").select("id", "blobPath")


@query(f"""WITH {_CHUNKS}, fresh AS (SELECT id, documentId FROM chunks WHERE type = 'table') SELECT id, documentId, false AS fresh FROM chunks WHERE documentId NOT IN (SELECT documentId FROM fresh) UNION ALL SELECT id, documentId, true FROM fresh""")
def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after the documents with tables are delivered anew with their tables alone."""
    rows = _one(spark, d).select("id", "documentId", "chunkType")
    fresh = rows.where(norm_key(F.col("chunkType")) == "table").select("id", "documentId", F.lit(True).alias("fresh"))
    return index.replace_chunks(rows.select("id", "documentId", F.lit(False).alias("fresh")), fresh)


_PATCHES = [("p1", '{"a":1,"b":"x"}', '{"b":"y","c":[1,2]}', '{"a":1,"b":"y","c":[1,2]}'), ("p2", "no json", '{"a":true}', '{"a":true}'), ("p3", None, None, "{}"), ("p4", '{"z":null}', "[1]", '{"z":null}')]


@query(f"SELECT id, merged FROM (VALUES {_values([(r[0], r[3]) for r in _PATCHES])}) v(id, merged)")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Top-level merge of metadata, on planted rows."""
    rows = spark.createDataFrame([r[:3] for r in _PATCHES], "id string, stored string, patch string")
    return rows.select("id", index.merged_json(F.col("stored"), F.col("patch")).alias("merged"))


@query(f"WITH {_NEWEST} SELECT id, regexp_extract(blobPath, '([^/]+?)(?:\\.[^./]*)?$', 1) AS stem, sha256(coalesce(title, '')) AS hash FROM docs WHERE blobPath IS NOT NULL")
def blob_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that paths give, and content hashes."""
    rows = _docs(spark, d).where("blobPath IS NOT NULL").select("id", F.col("blobPath").alias("path"), F.coalesce("title", F.lit("")).cast("binary").alias("content"))
    return readers.with_identity(rows).select("id", F.col("title").alias("stem"), F.col("content_hash").alias("hash"))


_DATES = [("d1", "publicada el 1 de abril de 2013 en la sede"), ("d2", "el 31 de febrero de 2020"), ("d3", "15 DE MARZO DE 2024"), ("d4", "Ciudad de México, 9 de mayo de 1899"), ("d5", None), ("d6", "Toluca, 3 de enero de 2001")]


@query(f"""WITH {_CHUNKS}, u AS (SELECT id, heading AS t FROM chunks UNION ALL SELECT * FROM (VALUES {_values(_DATES)}) v(id, t)), x AS (SELECT id, t, regexp_extract(t, '(?i)(\\d{{1,2}})\\s+de\\s+({_MONTHS})\\s+de\\s+(\\d{{4}})', 1) AS dd,
        lower(regexp_extract(t, '(?i)(\\d{{1,2}})\\s+de\\s+({_MONTHS})\\s+de\\s+(\\d{{4}})', 2)) AS mm, regexp_extract(t, '(?i)(\\d{{1,2}})\\s+de\\s+({_MONTHS})\\s+de\\s+(\\d{{4}})', 3) AS yy FROM u),
    y AS (SELECT id, t, try_strptime(yy || '-' || (CASE mm {_MONTH_NO} END) || '-' || lpad(dd, 2, '0'), '%Y-%m-%d')::DATE AS day FROM x)
    SELECT id, CASE WHEN year(day) BETWEEN 1900 AND 2100 THEN day::VARCHAR END AS day, coalesce(regexp_matches(t, '(?i)^\\s*\\d{{1,2}}\\s+DE\\s+(?:{_MONTHS})\\s+DE\\s+\\d{{4}}\\s*$') OR regexp_matches(t, '(?i)^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\\s+de\\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)?,?\\s+\\d{{1,2}}\\s+de\\s+(?:{_MONTHS})') AND length(t) < 120
        OR regexp_matches(t, '(?i)\\bDOF\\s+\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}\\b') AND length(t) < 100, false) AS is_date_heading FROM y WHERE day IS NOT NULL OR id LIKE 'd_'""")
def heading_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in headings, and headings that are dates, beside planted ones."""
    rows = _one(spark, d).select("id", F.col("heading").alias("t")).unionByName(spark.createDataFrame(_DATES, "id string, t string"))
    rows = rows.select("id", legal.spanish_date(F.col("t")).alias("day"), F.coalesce(legal.date_heading(F.col("t")), F.lit(False)).alias("is_date_heading"))
    pattern = F.col("id").rlike("^d.$")
    return rows.where(F.col("day").isNotNull() | pattern).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {_NEWEST}, t AS (SELECT id, {_trim("coalesce(title, '')")} AS t FROM docs), u AS (SELECT id, t, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')), 1) AS ratio FROM (SELECT id, t FROM t UNION ALL SELECT id || ':upper', upper(t) FROM t))
    SELECT id, length(t) BETWEEN 5 AND 300 AND ratio >= 0.6 AND regexp_matches(t, '(?i)(?:^|[^\\wáéíóúñÁÉÍÓÚÑ])(?:ley|decreto|reglamento|c[óÓ]digo|estatuto|acuerdo|norma|constituci[óÓ]n|presupuesto|lineamientos?)(?:[^\\wáéíóúñÁÉÍÓÚÑ]|$)') AS is_title FROM u""")
def document_title_signs(spark: SparkSession, d: str) -> DataFrame:
    """Whether titles, as they stand and in capitals, have the form of a document's title block."""
    t = _docs(spark, d).select("id", legal.strip(F.coalesce("title", F.lit(""))).alias("t"))
    both = t.unionByName(t.select(F.concat("id", F.lit(":upper")).alias("id"), F.upper("t").alias("t")))
    return both.select("id", legal.document_title(F.col("t")).alias("is_title"))


_RUBRICS = [("r1", "Al margen.\nDECRETO por el que se reforma\n la Ley. Otra cosa."), ("r2", "Sin rubro"), ("r3", "decreto por el que  se expide el Código; y más." + " x" * 10)]


@query(f"""WITH {_CHUNKS}, u AS (SELECT id, text FROM chunks UNION ALL SELECT * FROM (VALUES {_values(_RUBRICS)}) v(id, text)), r AS (SELECT id, regexp_extract(coalesce(text, ''), '(?is)decreto\\s+por\\s+el\\s+que\\s+.*?\\.', 0) AS g FROM u) SELECT id, substring({_squeeze('g')}, 1, 500) AS rubric FROM r WHERE g <> ''""")
def decree_rubrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "text").select("id", "text").unionByName(spark.createDataFrame(_RUBRICS, "id string, text string"))
    return rows.select("id", metadata.decree_rubric(F.col("text")).alias("rubric")).where("rubric IS NOT NULL")


@query(f"""WITH {_NEWEST}, t AS (SELECT id, coalesce(title, '') AS t FROM docs), h AS (SELECT id, t, substring(t, 1, 30) AS head, regexp_extract(substring(t, 1, 30), '(?s)^(.*\\S)\\s+\\S*$', 1) AS whole FROM t)
    SELECT id, CASE WHEN length(t) <= 30 THEN t ELSE CASE WHEN whole <> '' THEN whole ELSE head END || '…' END AS short FROM h""")
def short_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of at most 30 characters, cut at a blank."""
    return _docs(spark, d).select("id", metadata.cut_at_word(F.coalesce("title", F.lit("")), 30).alias("short"))


@query(f"""WITH {_CHUNKS}, l AS (SELECT id, {_trim("split_part(coalesce(text, ''), chr(10), 1)")} AS l FROM chunks)
    SELECT id, regexp_matches(l, '(?i)^\\s*art[iíÍ]culo\\s+\\d+[\\s\\wáéíóúñ]*[.\\-–—]') AND NOT regexp_matches(l, '(?i)(?:conforme|conform[ea]|seg[úÚ]n|previsto|dispuesto|establecid[oa]|se[ñÑ]alad[oa]|referid[oa]|contenid[oa]|indicad[oa]|mencionad[oa]|de\\s+(?:acuerdo|conformidad)|en\\s+(?:t[eéÉ]rminos|los\\s+t[eéÉ]rminos)|(?:el|del|al|los|las|un)\\s+)\\s*(?:art[iíÍ]culo|art\\.)\\s+\\d+') AS article,
        regexp_matches(l, '^\\s*[IVXLCDM]+\\s*[.\\-–—]') AS fraction, regexp_matches(l, '^\\s*[a-z]\\)\\s') AS inciso FROM l""")
def first_line_signs(spark: SparkSession, d: str) -> DataFrame:
    """What the first line of each chunk opens: an article (and no mere reference to one), a fraction or an item."""
    line = legal.strip(F.split(F.coalesce("text", F.lit("")), "\n").getItem(0))
    return _one(spark, d, "text").select("id", legal.opens_article(line).alias("article"), line.rlike(legal.OPENS_FRACTION).alias("fraction"), line.rlike(legal.OPENS_ITEM).alias("inciso"))
