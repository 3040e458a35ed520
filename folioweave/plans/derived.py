"""Queries over tables, legends, headings, the tree of blocks, events and run rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..operators import tables as table_ops
from ..operators import toc
from ..streaming import indexing
from ..tables import norm_key, table
from .index import _CHUNKS, _NEWEST, _RUNS, _docs, _one, _runs
from .registry import query


@query(f"""
    WITH {_CHUNKS}, t AS (SELECT id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(x, '^\\s*\\|[\\s|:\\-]+\\|\\s*$')) AS lines FROM chunks WHERE contains(text, '|')),
    r AS (SELECT id, list_transform(lines, lambda x: list_transform(string_split(regexp_replace(trim(x), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(c))) AS rows FROM t WHERE len(lines) > 0)
    SELECT id, CAST(len(rows) AS INT) AS row_count, CAST(list_max(list_transform(rows, lambda x: len(x))) AS INT) AS columns,
        CAST(len(list_filter(flatten(rows), lambda c: c <> '')) AS INT) AS cells, CAST(len(list_filter(flatten(rows), lambda c: c <> '' AND regexp_matches(c, '\\d'))) AS INT) AS numeric_cells FROM r
""")
def table_figures(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "text").where(F.col("text").contains("|")).select("id", table_ops.from_markdown(F.col("text")).alias("rows")).where(F.size("rows") > 0)
    f = rows.withColumn("f", table_ops.figures(F.col("rows")))
    numeric = F.size(F.filter(table_ops.cells(F.col("rows")), lambda x: x.rlike(r"\d")))
    return f.select("id", F.col("f.rows").alias("row_count"), F.col("f.columns").alias("columns"), F.col("f.cells").alias("cells"), numeric.alias("numeric_cells"))


@query("""
    WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type <> 'error'), x AS (SELECT user_id, ts, value FROM events WHERE event_type = 'error')
    SELECT e.event_id, e.user_id, (SELECT max(x.value) FROM x WHERE x.user_id = e.user_id AND x.ts = (SELECT max(y.ts) FROM x y WHERE y.user_id = e.user_id AND y.ts <= e.ts)) AS last_error FROM e
""")
def event_asof_error(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = e.where("event_type = 'error'").groupBy("user_id", "at").agg(F.max("value").alias("last_error"))
    rest = e.where("event_type <> 'error'").select("event_id", "user_id", "at")
    return toc.sections_asof(rest, errors, ["user_id"], "at", "at", ["last_error"]).select("event_id", "user_id", "last_error")


@query("""
    SELECT user_id, count(*) AS events, round(coalesce(max(gap), 0), 3) AS longest_gap FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY 1
""")
def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = e.groupBy("user_id", "at").agg(F.count("*").alias("n"))  # events of one moment have no gap between them
    # the last moment before, carried over stretches of a day, so that a busy user is spread over tasks
    rows = ordered.last_known(rows.withColumn("seen", F.col("at")), ["user_id"], "at", {"before": "seen"}, include_self=False, block=86_400_000_000)
    gap = (F.col("at") - F.col("before")) / 1e6
    return rows.groupBy("user_id").agg(F.sum("n").alias("events"), F.round(F.coalesce(F.max(gap), F.lit(0.0)), 3).alias("longest_gap"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90")
def json_props_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 90")


@query(f"""WITH {_RUNS} SELECT strftime(time_bucket(INTERVAL 1 HOUR, startedAt), '%Y-%m-%d %H:%M') AS start, lower(trim(status)) AS status, count(*) AS runs FROM runs WHERE startedAt IS NOT NULL GROUP BY 1, 2""")
def run_rates(spark: SparkSession, d: str) -> DataFrame:
    return indexing.run_rates(_runs(spark, d).where("startedAt IS NOT NULL")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query(f"""
    WITH {_CHUNKS}, t AS (SELECT documentId, chunkNo, id, type, articleRef FROM chunks WHERE chunkNo IS NOT NULL)
    SELECT id, last_ref FROM (SELECT id, type, last_value(CASE WHEN type IN ('article', 'transitorio') THEN articleRef END IGNORE NULLS) OVER (PARTITION BY documentId ORDER BY chunkNo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ref FROM t)
    WHERE type = 'table'
""")
def table_last_article(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d).where("chunkNo IS NOT NULL").withColumn("type", norm_key(F.coalesce("chunkType", F.lit("generic"))))
    rows = rows.select("id", "documentId", "chunkNo", "type", F.when(F.col("type").isin("article", "transitorio"), F.col("articleRef")).alias("ref"))
    return ordered.last_known(rows, ["documentId"], "chunkNo", {"last_ref": "ref"}, include_self=False).where("type = 'table'").select("id", "last_ref")


@query(f"""
    WITH {_CHUNKS} SELECT id, CAST(sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY documentId ORDER BY chunkNo ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tables_so_far FROM chunks WHERE chunkNo IS NOT NULL
""")
def running_table_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d).where("chunkNo IS NOT NULL").select("id", "documentId", "chunkNo", F.when(norm_key(F.coalesce("chunkType", F.lit("generic"))) == "table", 1).otherwise(0).alias("is_table"))
    return ordered.running_sum(rows, ["documentId"], "chunkNo", "is_table", "tables_so_far").select("id", "tables_so_far")


@query(f"""WITH {_NEWEST} SELECT lower(trim(coalesce(jurisdiction, 'unknown'))) AS jurisdiction, lower(trim(coalesce(docType, 'unknown'))) AS doc_type, count(*) AS documents, min(publishDate)::VARCHAR AS first_published, max(publishDate)::VARCHAR AS last_published FROM docs GROUP BY 1, 2""")
def documents_by_kind(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: norm_key(F.coalesce(c, F.lit("unknown")))
    return _docs(spark, d).groupBy(key("jurisdiction").alias("jurisdiction"), key("docType").alias("doc_type")).agg(
        F.count("*").alias("documents"), F.min("publishDate").cast("string").alias("first_published"), F.max("publishDate").cast("string").alias("last_published")
    )


@query(f"""WITH {_CHUNKS}, p AS (SELECT documentId, startPage, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks WHERE startPage IS NOT NULL GROUP BY 1, 2)
    SELECT documentId, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chunks, round(avg(n), 4) AS chunks_per_page, CAST(max(chars) AS BIGINT) AS longest_page FROM p GROUP BY 1""")
def two_level_page_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = _one(spark, d, "text").where("startPage IS NOT NULL").groupBy("documentId", "startPage").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return p.groupBy("documentId").agg(F.count("*").alias("pages"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 4).alias("chunks_per_page"), F.max("chars").alias("longest_page"))


@query(f"""WITH {_NEWEST} SELECT id, blobPath, 'by_path' AS input FROM docs WHERE blobPath IS NOT NULL UNION ALL SELECT id, blobPath, 'by_id' AS input FROM docs""")
def input_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Every document named by its path and by its id, one list behind the other."""
    from ..sources import readers

    docs = _docs(spark, d).select("id", "blobPath")
    return readers.descriptors([docs.where("blobPath IS NOT NULL").withColumn("input", F.lit("by_path")), docs.withColumn("input", F.lit("by_id"))])
