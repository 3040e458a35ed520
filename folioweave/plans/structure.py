"""Queries over the tree of blocks: of the chunk table's rows as labelled blocks, and of layout blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, structure
from ..operators.index import distinct_chunks
from ..operators.quality import TABLE_TOKEN
from ..session import cut_lineage
from ..tables import norm_key, table
from .index import _CHUNKS
from .registry import query

_LABEL = {"book": "book_heading", "title": "title_heading", "chapter": "chapter_heading", "section": "section_heading", "annex": "annex_heading", "article": "article_heading",
          "fraction": "fraction", "inciso": "inciso", "table": "table", "boxed_note": "editorial_note"}
_WAS = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _in(labels: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


_MARKS = ", ".join(
    f"max(CASE WHEN label IN {_in(o)} THEN ord END) OVER w AS o_{v}, " + (f"max(CASE WHEN label IN {_in(c)} THEN ord END) OVER w" if c else "NULL") + f" AS c_{v}" for v, (o, c) in structure.LEVELS.items()
)
_OPEN = ", ".join(f"CASE WHEN o_{v} > coalesce(c_{v}, -1) THEN o_{v} END AS {v}" for v in structure.LEVELS)
_BLOCKS = f"""{_CHUNKS}, blocks AS (SELECT documentId AS doc_id, chunkNo AS ord, id, startPage AS page_number, text,
        trim(CASE WHEN type = 'transitorio' THEN regexp_replace(coalesce(articleRef, heading, ''), '(?i)^art[íiÍ]culo\\s+(.*?)(\\s+transitorio)?$', '\\1.') ELSE coalesce(articleRef, heading, '') END) AS head,
        CASE {" ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in _LABEL.items())} WHEN type = 'transitorio' THEN CASE WHEN trim(coalesce(articleRef, '')) = '' THEN 'transitory_heading' ELSE 'transitory_item' END ELSE 'article_body' END AS label
    FROM chunks WHERE chunkNo IS NOT NULL)"""
_TREE = f"""{_BLOCKS},
    marks AS (SELECT *, {_MARKS}, max(CASE WHEN label = 'annex_heading' THEN ord END) OVER w AS o_annex FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord {_WAS})),
    cur AS (SELECT *, CASE WHEN cut THEN NULL ELSE chapter END AS chapter_, CASE WHEN cut THEN NULL ELSE title END AS title_, CASE WHEN cut THEN NULL ELSE book END AS book_ FROM (SELECT *, coalesce(section = o_annex, false) AS cut FROM (SELECT *, {_OPEN} FROM marks))),
    paths AS (SELECT *, list_filter(CASE WHEN label IN ('book_heading', 'transitory_heading', 'annex_heading') THEN [] WHEN label = 'title_heading' THEN [book] WHEN label = 'chapter_heading' THEN [title, book] WHEN label = 'section_heading' THEN [chapter, title, book]
        WHEN label = 'article_heading' THEN [section, chapter_, title_, book_] WHEN label = 'transitory_item' THEN [container] WHEN label = 'inciso' THEN [fraction, article, section, chapter_, title_, book_]
        WHEN label = 'fraction' THEN [article, section, chapter_, title_, book_] WHEN label = 'editorial_note' AND item IS NULL THEN [article, section, chapter_, title_, book_]
        WHEN item IS NOT NULL OR container IS NOT NULL THEN [item, container] ELSE [article, section, chapter_, title_, book_] END, lambda x: x IS NOT NULL) AS ancestors FROM cur),
    refs AS (SELECT *, coalesce(ancestors[1], 0) AS parent_ord,
        CASE {" ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in structure.NODE.items())} ELSE 'paragraph' END AS node_type,
        nullif(CASE WHEN label = 'article_heading' THEN regexp_extract(head, '(?i)art[iíÍ]culo[\\s\\p{{Z}}]+(\\d+[\\wáéíóúñÁÉÍÓÚÑ]*)', 1)
            WHEN label = 'transitory_item' THEN lower(regexp_extract(head, '(?i)^\\s*(d[eéÉ]cimo\\s*(?:primer|segund|tercer|cuart|quint|sext|s[eéÉ]ptim|octav|noven)o?|primero|segundo|tercero|cuarto|quinto|sexto|s[eéÉ]ptimo|octavo|noveno|d[eéÉ]cimo|und[eéÉ]cimo|duod[eéÉ]cimo|vig[eéÉ]simo|trig[eéÉ]simo|cuadrag[eéÉ]simo|quincuag[eéÉ]simo)\\s*[.\\-–—]', 1)) END, '') AS article_ref,
        CASE WHEN label IN ('book_heading', 'title_heading', 'chapter_heading', 'section_heading', 'annex_heading') THEN nullif(lower(regexp_extract(head, '(?i)(?:libro|t[iíÍ]tulo|cap[iíÍ]tulo|secci[oóÓ]n|anexo)[\\s\\p{{Z}}]+([IVXLCDM\\d]+)', 1)), '') END AS heading_number FROM paths),
    ids AS (SELECT *, coalesce(heading_number, lower(article_ref)) AS number, CASE WHEN label = 'annex_heading' THEN 'annex' WHEN label = 'transitory_item' AND article_ref IS NULL THEN 'transitory-item' ELSE node_type END AS prefix FROM refs),
    tree AS (SELECT doc_id, ord, parent_ord, ancestors, prefix || '-' || coalesce(number, CAST(sum(CASE WHEN number IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, prefix ORDER BY ord) AS VARCHAR)) AS node_id, node_type, label,
        CASE WHEN node_type IN {_in(structure.NAVIGABLE)} THEN head END AS heading, text, article_ref, page_number, label = 'annex_heading' AS is_annex FROM ids),
    spread AS (SELECT doc_id, unnest(list_prepend(ord, ancestors)) AS ord, page_number FROM tree),
    pages AS (SELECT doc_id, ord, min(page_number) AS page_start, max(page_number) AS page_end FROM spread GROUP BY 1, 2)"""


def with_marks(chunks: DataFrame) -> DataFrame:
    """Adds marked: whether the text holds a table mark, told before anything moves."""
    return chunks.withColumn("marked", F.coalesce(F.col("text"), F.lit("")).rlike(TABLE_TOKEN))


def chunk_blocks(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """The chunk table's rows as labelled blocks in the order of their numbers; extra columns (text) move only where they are asked for."""
    rows = distinct_chunks(with_marks(table(spark, d, "legal_chunks")), *extra).where("chunkNo IS NOT NULL")
    kind = norm_key(F.coalesce("chunkType", F.lit("generic")))
    label = F.when(kind == "transitorio", F.when(F.trim(F.coalesce("articleRef", F.lit(""))) == "", "transitory_heading").otherwise("transitory_item"))
    for k, v in _LABEL.items():
        label = label.when(kind == k, v)
    head = F.coalesce("articleRef", "heading", F.lit(""))
    head = F.when(kind == "transitorio", F.regexp_replace(head, r"(?iU)^art[íi]culo\s+(.*?)(\s+transitorio)?$", "$1.")).otherwise(head)
    return rows.select(F.col("documentId").alias("doc_id"), F.col("chunkNo").alias("ord"), "id", F.col("startPage").alias("page_number"), *extra, head.alias("head"), label.otherwise("article_body").alias("label"))


def chunk_tree(spark: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    rows = chunk_blocks(spark, d, "text") if with_text else chunk_blocks(spark, d).withColumn("text", F.lit(None).cast("string"))
    return cut_lineage(structure.nodes(rows))


def layout_tree(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(structure.nodes(layout.classified(table(spark, d, "extracted_spans"))))


@query(f"WITH {_TREE} SELECT doc_id, ord, parent_ord, node_id, node_type, heading, article_ref, page_number, is_annex FROM tree")
def structure_nodes(spark: SparkSession, d: str) -> DataFrame:
    return chunk_tree(spark, d).drop("ancestors", "label", "text")


@query(f"WITH {_TREE} SELECT doc_id, ord, page_start, page_end FROM pages")
def structure_pages(spark: SparkSession, d: str) -> DataFrame:
    return structure.page_ranges(chunk_tree(spark, d))


@query(f"WITH {_TREE} SELECT doc_id, ord, node_id, node_type, heading, page_start FROM tree JOIN pages USING (doc_id, ord) WHERE node_type IN {_in(structure.NAVIGABLE)}")
def structure_contents(spark: SparkSession, d: str) -> DataFrame:
    return structure.contents(chunk_tree(spark, d))


@query(f"""WITH {_TREE}, kids AS (SELECT doc_id, parent_ord AS ord, count(*) AS child_count, count(*) FILTER (node_type = 'article') AS article_count FROM tree GROUP BY 1, 2)
    SELECT doc_id, ord, node_id, node_type, heading, coalesce(child_count, 0) AS child_count, coalesce(article_count, 0) AS article_count, page_start, page_end FROM tree JOIN pages USING (doc_id, ord) LEFT JOIN kids USING (doc_id, ord)
    WHERE node_type IN {_in(structure.CONTAINERS)}""")
def structure_sections(spark: SparkSession, d: str) -> DataFrame:
    return structure.sections(chunk_tree(spark, d))


_TYPES = [*dict.fromkeys(structure.NODE.values()), "paragraph"]


@query(f"""WITH {_TREE} SELECT doc_id, {", ".join(f'count(*) FILTER (node_type = {chr(39)}{t}{chr(39)}) AS "{t}"' for t in _TYPES)}, bool_or(label IN ('transitory_heading', 'transitory_item')) AS has_transitories, bool_or(is_annex) AS has_annexes, count(*) FILTER (node_type IN {_in(structure.NAVIGABLE)}) AS toc_entries, count(*) FILTER (node_type IN {_in(structure.CONTAINERS)}) AS sections FROM tree GROUP BY 1""")
def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    return structure.counts(chunk_tree(spark, d))


_PROJECT = f"""{_TREE},
    fam AS (SELECT t.*, trim(coalesce(t.text, ''), chr(10) || chr(13) || chr(9) || ' ') AS own, u.node_type AS p, u.article_ref AS up_ref, g.node_type AS gp, g.article_ref AS top_ref,
        EXISTS (SELECT 1 FROM tree i WHERE i.label = 'transitory_item' AND i.doc_id = t.doc_id AND i.parent_ord = t.parent_ord) AS up_holds,
        EXISTS (SELECT 1 FROM tree i WHERE i.label = 'transitory_item' AND i.doc_id = t.doc_id AND i.parent_ord = t.ord) AS holds,
        EXISTS (SELECT 1 FROM tree i WHERE i.is_annex AND i.doc_id = t.doc_id AND list_contains(t.ancestors, i.ord)) AS under_annex
        FROM tree t LEFT JOIN tree u ON u.doc_id = t.doc_id AND u.ord = t.parent_ord LEFT JOIN tree g ON g.doc_id = t.doc_id AND g.ord = u.parent_ord),
    folded AS (SELECT *, CASE WHEN node_type = 'paragraph' AND p = 'fraction' AND gp = 'article' THEN 0 WHEN node_type = 'paragraph' AND (p = 'article' OR p = 'transitory' AND NOT up_holds) THEN 1
        WHEN node_type = 'inciso' AND p = 'article' THEN 2 WHEN node_type = 'inciso' AND p = 'fraction' AND gp = 'article' THEN 0 END AS part FROM fam
        WHERE NOT coalesce(p = 'fraction' AND coalesce(gp, '') <> 'article' AND node_type NOT IN ('table', 'note'), false)),
    kinds AS (SELECT *, CASE WHEN part IS NOT NULL THEN parent_ord ELSE ord END AS owner, CASE WHEN part IS NOT NULL THEN NULL WHEN node_type IN ('article', 'fraction', 'inciso', 'table') THEN node_type WHEN node_type = 'note' THEN 'boxed_note'
        WHEN node_type = 'transitory' AND NOT holds THEN 'transitory' WHEN node_type = 'section' AND is_annex THEN 'annex' WHEN node_type = 'paragraph' AND p = 'transitory' THEN 'transitory' WHEN node_type = 'paragraph' AND under_annex THEN 'annex'
        WHEN node_type = 'paragraph' THEN 'paragraph' END AS kind,
        CASE WHEN node_type IN ('article', 'transitory') THEN article_ref WHEN node_type IN ('fraction', 'table', 'note') AND p = 'article' THEN up_ref WHEN node_type IN ('table', 'note') AND p = 'fraction' THEN top_ref END AS ref FROM folded),
    made AS (SELECT doc_id, owner AS ord, max(kind) AS chunk_type, coalesce(string_agg(CASE WHEN own <> '' THEN own END, chr(10) ORDER BY coalesce(part, -1), ord), '') AS text, max(CASE WHEN ord = owner THEN ref END) AS article_ref,
        max(CASE WHEN ord = owner THEN heading END) AS heading, max(CASE WHEN ord = owner THEN node_id END) AS node_id, count(*) AS sources FROM kinds GROUP BY 1, 2)"""


@query(f"""WITH {_PROJECT} SELECT doc_id, ord, node_id, chunk_type, heading, md5(text) AS text_md5, article_ref, page_start, page_end, sources FROM made JOIN pages USING (doc_id, ord)
    WHERE chunk_type IS NOT NULL AND (text <> '' OR chunk_type IN ('table', 'boxed_note'))""")
def projected_chunks(spark: SparkSession, d: str) -> DataFrame:
    got = structure.projected(chunk_tree(spark, d, with_text=True))
    return got.select("doc_id", "ord", "node_id", "chunk_type", "heading", F.md5("text").alias("text_md5"), "article_ref", "page_start", "page_end", F.size("source_ords").cast("bigint").alias("sources"))


@query(f"""WITH {_TREE}, up AS (SELECT t.doc_id, t.ord, t.parent_ord, unnest(CASE WHEN len(t.ancestors) = 0 THEN [NULL] ELSE t.ancestors END) AS a, t.node_id, t.node_type FROM tree t)
    SELECT u.doc_id, u.ord, coalesce(max(CASE WHEN u.a = u.parent_ord THEN x.node_id END), 'doc') AS parent_node_id, {", ".join(f"arg_max(CASE WHEN x.node_type = '{t}' THEN x.heading END, CASE WHEN x.node_type = '{t}' THEN u.a END) AS {t}_heading" for t in structure.CONTAINERS)},
        max(CASE WHEN x.node_type = 'transitory' THEN 'true' END) AS is_transitory FROM up u LEFT JOIN tree x ON x.doc_id = u.doc_id AND x.ord = u.a GROUP BY 1, 2""")
def chunk_contexts(spark: SparkSession, d: str) -> DataFrame:
    got = structure.contexts(chunk_tree(spark, d))
    field = lambda n: F.get_json_object("context", f"$.{n}").alias(n)
    return got.select("doc_id", "ord", field("parent_node_id"), *[field(f"{t}_heading") for t in structure.CONTAINERS], field("is_transitory"))


@query()
def layout_structure(spark: SparkSession, d: str) -> DataFrame:
    return layout_tree(spark, d).drop("ancestors")


@query()
def layout_chunks(spark: SparkSession, d: str) -> DataFrame:
    return structure.projected(layout_tree(spark, d))


@query()
def layout_scores(spark: SparkSession, d: str) -> DataFrame:
    """From spans to scores: blocks, labels, tree and quality of every document with a layout."""
    from ..operators import quality

    return quality.scored(layout_tree(spark, d))
