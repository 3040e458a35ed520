"""Queries over the outlines nested in legal_documents.metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..tables import table
from .registry import query


def _nodes_of(value: str) -> str:
    """SQL for the objects of a JSON value: one, those of a list, or those of a JSON text in a string."""
    some = lambda v: f"CASE json_type({v}) WHEN 'OBJECT' THEN [{v}] WHEN 'ARRAY' THEN list_filter(CAST({v} AS JSON[]), lambda x: json_type(x) = 'OBJECT') ELSE [] END"
    text = f"json_extract_string({value}, '$')"
    return f"CASE WHEN json_type({value}) = 'VARCHAR' THEN CASE WHEN json_valid({text}) THEN {some(f'CAST({text} AS JSON)')} ELSE [] END ELSE {some(value)} END"


_FOUND = f"""WITH RECURSIVE docs AS (SELECT DISTINCT ON (id) id, metadata FROM legal_documents WHERE id IS NOT NULL ORDER BY id, updatedAt DESC NULLS LAST, metadata DESC NULLS LAST),
    valid AS (SELECT id, CAST(metadata AS JSON) AS j FROM docs WHERE json_valid(metadata)),
    opened AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$')) THEN CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM valid),
    walk AS (SELECT id, 0 AS depth, [0] AS path, j FROM opened WHERE json_type(j) IN ('OBJECT', 'ARRAY')
        UNION ALL SELECT id, depth + 1, list_append(path, k), v FROM (SELECT id, depth, path, unnest(generate_series(1, len(vs))) AS k, unnest(vs) AS v FROM (SELECT id, depth, path,
            CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE list_transform(list_filter(json_keys(j), lambda k: k <> 'toc'), lambda k: json_extract(j, '$."' || k || '"')) END AS vs FROM walk)) WHERE json_type(v) IN ('OBJECT', 'ARRAY')),
    holders AS (SELECT id, depth, path, {_nodes_of('t')} AS roots FROM (SELECT id, depth, path, json_extract(j, '$.toc') AS t FROM walk WHERE json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'toc'))),
    outlines AS (SELECT DISTINCT ON (id) id, roots FROM holders WHERE len(roots) > 0 ORDER BY id, depth, path),
    nodes AS (SELECT id, [k] AS path, n FROM (SELECT id, unnest(generate_series(1, len(roots))) AS k, unnest(roots) AS n FROM outlines)
        UNION ALL SELECT id, list_append(path, k), c FROM (SELECT id, path, unnest(generate_series(1, len(cs))) AS k, unnest(cs) AS c FROM (SELECT id, path, {_nodes_of("json_extract(n, '$.children')")} AS cs FROM nodes))),
    numbered AS (SELECT id, path, n, row_number() OVER (PARTITION BY id ORDER BY path) AS ord FROM nodes)"""


@query(f"{_FOUND} SELECT a.id AS document_id, CAST(a.ord AS INT) AS node_ord, CAST(coalesce(b.ord, 0) AS INT) AS parent_ord FROM numbered a LEFT JOIN numbered b ON b.id = a.id AND b.path = a.path[:-2]")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.outline_occurrences(table(spark, d, "legal_documents")).select("document_id", "node_ord", "parent_ord")


@query(f"{_FOUND} SELECT id AS document_id, CAST(ord AS INT) AS node_ord, CAST(path[-1] AS INT) AS sibling_no, CAST(len(path) AS INT) AS depth, json_extract_string(n, '$.title') AS title FROM numbered WHERE coalesce(json_type(json_extract(n, '$.title')), 'VARCHAR') IN ('VARCHAR', 'NULL')")
def p5_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each outline node whose title is a text or missing among its siblings, and its depth."""
    occ = nested.outline_occurrences(table(spark, d, "legal_documents")).where("title_is_text")
    return occ.select("document_id", "node_ord", "sibling_no", "depth", "title")


@query()
def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    occ = nested.outline_occurrences(table(spark, d, "legal_documents"))
    return occ.select("document_id", "node_ord", "parent_ord", "sibling_no", "depth", F.hex("obj_hash").alias("obj_hash"), "node_id", "title", "level")


@query()
def p5_targets(spark: SparkSession, d: str) -> DataFrame:
    occ = nested.outline_occurrences(table(spark, d, "legal_documents"))
    return occ.where("target_hash IS NOT NULL").select("document_id", "node_ord", F.hex("target_hash").alias("target_hash"), "target_page", "target_offset")


@query()
def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    got = nested.outline_objects(nested.outline_occurrences(table(spark, d, "legal_documents")))
    return got.withColumns({c: F.hex(c) for c in ("obj_hash", "target_hash")})


@query()
def p5_bridge(spark: SparkSession, d: str) -> DataFrame:
    got = nested.outline_bridge(nested.outline_occurrences(table(spark, d, "legal_documents")))
    return got.withColumns({c: F.hex(c) for c in ("parent_hash", "child_hash")})


@query()
def p5_target_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct target once, keyed as in p5_objects."""
    got = nested.outline_targets(nested.outline_occurrences(table(spark, d, "legal_documents")))
    return got.withColumn("target_hash", F.hex("target_hash"))


@query()
def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """The metadata besides the outline: every value with its parent."""
    return nested.field_occurrences(table(spark, d, "legal_documents")).drop("child_hashes").withColumn("value_hash", F.hex("value_hash"))


@query()
def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """The metadata besides the outline: every distinct value once."""
    return nested.field_values(nested.field_occurrences(table(spark, d, "legal_documents"))).withColumn("value_hash", F.hex("value_hash"))
