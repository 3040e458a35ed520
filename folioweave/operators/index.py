"""The searchable index: newest documents, upserts, chunk rows, run log.

Keys delivered several times count once by their newest row.  Plain parquet has no MERGE, so an upsert is a full outer join
that gives the whole new table, to be written beside the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import legal
from ..session import cut_lineage


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the greatest by the order columns, nulls least, ties by the other columns. Aggregates before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order and not df.schema[c].dataType.typeName() == "map"]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]]).select(*[c for c in df.columns if c == key or c in order or c in rest])


def distinct_chunks(chunks: DataFrame, *extra: str) -> DataFrame:
    """One row per chunk id, of several deliveries the greatest by document, number, type, reference, heading, pages and the text's hash.

    Only these narrow columns and the extra ones move; ask for the text only where it is needed.
    """
    cols = ["documentId", "chunkNo", "chunkType", "articleRef", "heading", "startPage", "endPage"]
    packed = F.struct(*cols, F.md5("text").alias("_md5"), *extra)
    return chunks.where("id IS NOT NULL AND documentId IS NOT NULL").groupBy("id").agg(F.max(packed).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in (*cols, *extra)])


#: What a new document gets where nothing is given, and lengths of columns.
DEFAULTS = {"jurisdiction": "MX-FEDERAL", "sourceType": "official_gazette"}
CUT = {"title": 500, "lawName": 255, "heading": 500, "articleRef": 100}


#: Fixed value: else the parser gives up a text that holds a string of more than 20 million characters.
LONG = {"maxStringLen": "2147483647"}


def json_map(c):
    """The top-level fields of a JSON object as variants, so that numbers stay numbers; what is no object has none. Strings may be of any length. Values nested too deep for a variant are kept as texts."""
    typed = F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    long = F.transform(F.array(F.from_json(c, "map<string,variant>", LONG)), lambda m: F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k, m[k]))))[0]
    plain = F.from_json(c, "map<string,string>", LONG).cast("map<string,variant>")
    return F.when(F.json_object_keys(c).isNotNull(), F.coalesce(typed, long, plain)).otherwise(F.create_map().cast("map<string,variant>"))


def merged_json(stored, patch):
    """The top-level keys of two JSON objects, those of the patch over those stored; what is no object counts as empty."""
    a, b = json_map(stored), json_map(patch)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def upsert_documents(stored: DataFrame, incoming: DataFrame, key: str = "blobPath") -> DataFrame:
    """The stored table after the incoming rows are merged by key: incoming values win where given, metadata are merged by top-level keys, new rows get defaults; titles and law names are cut."""
    cols = [c for c in stored.columns if c != key]
    new = incoming.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in incoming.columns if c in cols])
    got = stored.join(new, stored[key] == new["_key"], "full_outer")
    value = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if f"_n_{c}" in new.columns else F.col(c) for c in cols}
    if "_n_metadata" in new.columns:
        both = F.col("_key").isNotNull() & F.col(key).isNotNull()
        value["metadata"] = F.when(both, merged_json(F.col("metadata"), F.col("_n_metadata"))).otherwise(value["metadata"])
    for c, default in DEFAULTS.items():
        if c in value:
            value[c] = F.when(F.col(key).isNull(), F.coalesce(value[c], F.lit(default))).otherwise(value[c])
    for c in ("title", "lawName"):
        if c in value:
            value[c] = F.substring(value[c], 1, CUT[c])
    return got.select(F.coalesce(key, "_key").alias(key), *[v.alias(c) for c, v in value.items()])


def replace_chunks(stored: DataFrame, incoming: DataFrame, document: str = "documentId") -> DataFrame:
    """Stored chunks without those of the documents delivered anew, and the new ones."""
    return stored.join(incoming.select(document).distinct(), document, "left_anti").unionByName(incoming)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows as they are written: cut headings and references, word counts, search tokens."""
    return chunks.select(
        "id", "documentId", "chunkNo", F.lower(F.trim(F.coalesce("chunkType", F.lit("generic")))).alias("chunkType"),
        F.substring("articleRef", 1, 100).alias("articleRef"), F.substring("heading", 1, 500).alias("heading"),
        legal.word_count(F.col("text")).alias("tokenCount"), legal.search_tokens(F.col("text")).alias("tsv"),
    )


def stuck_runs(runs: DataFrame, now, hours: int = 1) -> DataFrame:
    """Runs still processing after the given hours."""
    return runs.where((F.lower(F.trim("status")) == "processing") & (F.col("startedAt") < now - F.expr(f"INTERVAL {hours} HOURS")))


def merge_metadata(stored, patch):
    """Top-level keys of the patch over those of the stored map."""
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)


def manifest(strategy, content_hash, canonical):
    """strategy-hash12-sha16 of the canonical outline text."""
    return manifest_of(strategy, content_hash, F.sha2(canonical, 256))


def manifest_of(strategy, content_hash, sha):
    """The same of the text's SHA-256."""
    return F.concat_ws("-", strategy, F.substring(content_hash, 1, 12), F.substring(sha, 1, 16))


def with_outline(docs: DataFrame, tree: DataFrame, native: DataFrame | None = None, strategy: str = "chunk_based_v1") -> DataFrame:
    """documentId and metadata with outlineStrategy, outlineManifest, toc, sections, outlineStats, nativeToc figures and a null outlineError over what it held.

    docs: documentId, metadata (JSON text), contentHash. Outlines are written flat, each node with its parent's id. Metadata that is no JSON object is replaced.
    Stored values that are replaced, which may be most of the text, are left out before anything is joined or written.
    """
    from . import toc

    names = ["outlineError", "outlineManifest", "outlineStats", "outlineStrategy", "sections", "toc"] + ["nativeToc"] * (native is not None)
    kept = cut_lineage(docs.select("documentId", "contentHash", F.map_filter(json_map(F.col("metadata")), lambda k, v: ~k.isin(names)).alias("_kept")))
    node = F.struct("position", F.col("node_id").alias("id"), F.col("parent_id").alias("parent"), "title", "level", "page")
    nodes = tree.groupBy("documentId").agg(F.array_sort(F.collect_list(node)).alias("toc"))
    shas = toc.canonical(tree).select("documentId", F.sha2("outline", 256).alias("_sha"))
    got = kept.join(shas.join(nodes, "documentId").join(toc.stats(tree), "documentId"), "documentId", "left")
    if native is not None:
        got = got.join(cut_lineage(toc.native_stats(native)), "documentId", "left")
    # fields by name, as variants have them
    node = lambda x: F.struct(x["id"].alias("id"), x["level"].alias("level"), x["parent"].alias("parent"), F.struct(x["page"].alias("page")).alias("target"), x["title"].alias("title"))
    section = lambda x: F.struct(x["id"].alias("id"), x["page"].alias("pageEnd"), x["page"].alias("pageStart"), x["title"].alias("title"))
    toc_rows = F.coalesce("toc", F.expr("CAST(array() AS array<struct<position:bigint,id:string,parent:string,title:string,level:int,page:int>>)"))
    patch = {
        "outlineManifest": manifest_of(F.lit(strategy), F.coalesce("contentHash", F.lit("")), F.coalesce("_sha", F.sha2(F.lit(""), 256))),
        "outlineStats": F.struct(F.from_json(F.coalesce("by_level", F.lit("{}")), "map<string,bigint>").alias("byLevel"), F.coalesce("max_depth", F.lit(0)).alias("maxDepth"), F.coalesce("total", F.lit(0)).alias("totalNodes")),
        "outlineStrategy": F.lit(strategy),
        "sections": F.transform(toc_rows, section),
        "toc": F.transform(toc_rows, node),
    }
    if native is not None:
        patch = {"nativeToc": F.struct(F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("transitory_sections", F.lit(0)).alias("transitorioSections"))} | patch
    part = lambda keep: F.map_filter("_kept", lambda k, v: keep(k))
    stored = F.map_concat(part(lambda k: k < "outlineError"), json_map(F.lit('{"outlineError":null}')), part(lambda k: k > "outlineError"))
    got = got.select("documentId", F.to_json(stored).alias("_stored"), F.to_json(F.struct(*[v.alias(k) for k, v in patch.items()])).alias("_patch"))
    return got.select("documentId", F.expr("concat(left(_stored, length(_stored) - 1), ',', substring(_patch, 2))").alias("metadata"))


def flat_records(records: DataFrame, counts: DataFrame, paths: DataFrame, flags: dict[str, str]) -> DataFrame:
    """A report row for each evaluated document: records and tree figures joined by document, a flag for each failing check named, the first reason and all of them."""
    types = [c for c in counts.columns if c not in ("doc_id", "has_transitories", "has_annexes", "toc_entries", "sections")]
    n = counts.select(F.col("doc_id").alias("documentId"), F.col("article").alias("article_count"), F.col("table").alias("table_count"), sum((F.col(f"`{t}`") for t in types), F.lit(0)).alias("chunk_count"))
    got = records.join(paths, "documentId").join(n, "documentId", "left").fillna(0, ["article_count", "table_count", "chunk_count"])
    reasons = F.split("reasons", ",")
    return got.select(
        "documentId", "blobPath", F.col("score").alias("quality_score"), F.col("severity").alias("quality_severity"), "chunk_count", "article_count", "table_count", *[F.array_contains(reasons, v).alias(k) for k, v in flags.items()],
        "status", reasons[0].alias("top_reason"), F.replace("reasons", F.lit(","), F.lit(";")).alias("all_reasons"),
    )


def legacy_chunks(projected: DataFrame) -> DataFrame:
    """Chunks of a tree (doc_id, ord, chunk_type, heading, text, article_ref, page_start, page_end) as the older chunk rows: numbered in order, tables counted through the document, missing headings empty, missing pages 1."""
    from . import ordered

    table = F.when(F.col("chunk_type") == "table", 1).otherwise(0)
    rows = ordered.carried(projected.withColumns({"_one": F.lit(1), "_table": table}), ["doc_id"], "ord", {}, {"chunk_no": "_one", "_tables": "_table"})
    start = F.coalesce("page_start", F.lit(1))
    return rows.select(
        "doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"), "article_ref", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("text", F.lit("")).alias("text"),
        start.alias("start_page"), F.coalesce("page_end", start).alias("end_page"), (F.col("_table") == 1).alias("has_table"), F.when(F.col("_table") == 1, F.col("_tables").cast("int")).alias("table_index"),
    )


def in_page_order(text_chunks: DataFrame, table_chunks: DataFrame, document: str = "documentId", page: str = "startPage", number: str = "chunkNo") -> DataFrame:
    """Text and table chunks as one list, numbered anew by page; on a page the texts come first, each kind in its own order."""
    from pyspark.sql import Window

    both = text_chunks.withColumn("is_table", F.lit(False)).unionByName(table_chunks.withColumn("is_table", F.lit(True)), allowMissingColumns=True)
    inside = Window.partitionBy(document, page).orderBy("is_table", number, "id")
    per = both.groupBy(document, page).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(document).orderBy(page)) - F.col("_n")
    starts = per.select(F.col(document).alias("_d"), F.col(page).alias("_p"), before.alias("_before"))
    rows = both.withColumn("_i", F.row_number().over(inside)).join(starts, F.col(document).eqNullSafe(F.col("_d")) & F.col(page).eqNullSafe(F.col("_p")))
    return rows.withColumn("place", (F.col("_i") + F.col("_before")).cast("int")).drop("_i", "_before", "_d", "_p")


def with_embeddings(chunks: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their vectors; a document whose numbers of chunks and vectors differ is an error, not a silent loss."""
    a = chunks.groupBy(keys[0]).agg(F.count("*").alias("chunks"))
    b = embeddings.groupBy(keys[0]).agg(F.count("*").alias("vectors"))
    wrong = a.join(b, keys[0], "full_outer").where("NOT (chunks <=> vectors)").limit(1).collect()
    if wrong:
        raise ValueError(f"{keys[0]} {wrong[0][0]}: {wrong[0]['chunks'] or 0} chunks, {wrong[0]['vectors'] or 0} vectors")
    return chunks.join(embeddings, keys)


def valid_requests(requests: DataFrame, ids: list[str], texts: list[str]) -> DataFrame:
    """Adds error: the first field that is no UUID or is blank; null where the request is valid."""
    uuid = r"(?i)^(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
    bad = [F.when(~F.coalesce(F.col(c).rlike(uuid), F.lit(False)), F.lit(f"{c} is no UUID")) for c in ids]
    bad += [F.when(legal.strip(F.coalesce(c, F.lit(""))) == "", F.lit(f"{c} is empty")) for c in texts]
    return requests.withColumn("error", F.coalesce(*bad))


def failed_stage(error):
    """The stage in which a run failed, by the kind of its error."""
    return F.when(error.startswith("PDFExtractionError"), "pdf_extraction").when(error.startswith("EmbeddingError"), "embeddings").when(error.isNotNull(), "unknown")
