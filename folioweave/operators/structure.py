"""The legal hierarchy of labelled blocks as an adjacency list, its figures and its projection to chunks.

Blocks come in an order; every block that enters the tree gets the number of its parent.  Instead of a cursor that
walks through a document, the last block that opened each level is carried forward (in blocks of the ordinal, so a document of
any size is spread over tasks); a level is open where it was opened behind everything that closes it.

Titles close chapters, sections, articles and fractions, and so on down the levels; a TRANSITORIOS heading and its items
close articles and fractions only, and stay open, also behind later articles, until an annex; an annex is a section at the root.
Headers, footers and index blocks don't enter the tree, and a document title gives the root its heading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from . import ordered

#: Labels that stay outside, types of nodes, and the types that make the table of contents.
EXCLUDED = ["page_header", "page_footer", "index_block"]
NODE = {"book_heading": "book", "title_heading": "title", "chapter_heading": "chapter", "section_heading": "section", "annex_heading": "section", "transitory_heading": "transitory", "article_heading": "article",
        "transitory_item": "transitory", "fraction": "fraction", "inciso": "inciso", "table": "table", "editorial_note": "note"}
NAVIGABLE = ["book", "title", "chapter", "section", "article", "transitory"]
CONTAINERS = ["book", "title", "chapter", "section"]
#: What opens each level, and what closes it (besides opening it anew).
_CUT = ["transitory_heading", "transitory_item", "annex_heading"]
LEVELS = {
    "book": (["book_heading"], []),
    "title": (["title_heading"], ["book_heading"]),
    "chapter": (["chapter_heading"], ["book_heading", "title_heading"]),
    "section": (["section_heading", "annex_heading"], ["book_heading", "title_heading", "chapter_heading"]),
    "article": (["article_heading"], ["book_heading", "title_heading", "chapter_heading", "section_heading", *_CUT]),
    "fraction": (["fraction"], ["book_heading", "title_heading", "chapter_heading", "section_heading", "article_heading", *_CUT]),
    "container": (["transitory_heading"], ["annex_heading"]),
    "item": (["transitory_item"], ["transitory_heading", "annex_heading"]),
}
_UNDER = ["section", "chapter", "title", "book"]
#: References in headings.
ARTICLE_REF = r"(?iU)Art[ií]culo\s+(\d+[\w]*)"
ITEM_REF = (
    r"(?iU)^\s*(D[eé]cimo\s*(?:primer|segund|tercer|cuart|quint|sext|s[eé]ptim|octav|noven)o?|Primero|Segundo|Tercero|Cuarto|Quinto|Sexto|S[eé]ptimo|"
    r"Octavo|Noveno|D[eé]cimo|Und[eé]cimo|Duod[eé]cimo|Vig[eé]simo|Trig[eé]simo|Cuadrag[eé]simo|Quincuag[eé]simo)\s*[.\-–—]"
)
HEADING_NUMBER = r"(?iU)(?:Libro|T[ií]tulo|Cap[ií]tulo|Secci[oó]n|Anexo)\s+([IVXLCDM\d]+)"


def numbered(labelled: DataFrame, within: list[str]) -> DataFrame:
    """Adds ord, the place in the document: by page, then by the given columns. Numbered within pages, then by the pages' counts."""
    inside = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy(*within))
    counts = labelled.groupBy("doc_id", "page_number").agg(F.count("*").alias("_n"))
    starts = counts.select("doc_id", "page_number", (F.sum("_n").over(Window.partitionBy("doc_id").orderBy("page_number")) - F.col("_n")).alias("_s"))
    return labelled.withColumn("_i", inside).join(starts, ["doc_id", "page_number"]).withColumn("ord", (F.col("_i") + F.col("_s")).cast("int")).drop("_i", "_s")


def excluded(blocks: DataFrame) -> DataFrame:
    """The blocks that stay outside the tree, with the beginning of their text."""
    return blocks.where(F.col("label").isin(EXCLUDED)).select("doc_id", "ord", "label", "page_number", F.substring("text", 1, 120).alias("text_preview"))


def nodes(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, parent_ord (0 for the root), ancestors, node_id, node_type, label, heading, text, article_ref, page_number, is_annex.

    Takes doc_id, ord, label, text and page_number, and optionally head, the text in which headings and references are read (else text).
    """
    rows = blocks.where(~F.col("label").isin([*EXCLUDED, "document_title"]) & F.col("label").isNotNull())
    head = legal.strip(F.coalesce(F.col("head") if "head" in blocks.columns else F.col("text"), F.lit("")))
    kind = F.lit("paragraph")
    for name, n in NODE.items():
        kind = F.when(F.col("label") == name, n).otherwise(kind)
    ref = F.when(F.col("label") == "article_heading", F.regexp_extract(head, ARTICLE_REF, 1)).when(F.col("label") == "transitory_item", F.lower(F.regexp_extract(head, ITEM_REF, 1)))
    rows = rows.withColumns({"node_type": kind, "article_ref": F.nullif(ref, F.lit("")), "_head": head})
    marks = {}
    for level, (opens, closes) in LEVELS.items():
        marks[f"_o_{level}"] = F.when(F.col("label").isin(opens), F.col("ord"))
        marks[f"_c_{level}"] = F.when(F.col("label").isin(closes), F.col("ord")) if closes else F.lit(None).cast("int")
    marks["_annex"] = F.when(F.col("label").isin("annex_heading", "section_heading"), F.col("label") == "annex_heading")
    rows = rows.withColumns(marks)
    prefix = F.when(F.col("label") == "annex_heading", "annex").otherwise(F.col("node_type"))
    number = F.when(F.col("label").isin("book_heading", "title_heading", "chapter_heading", "section_heading", "annex_heading"), F.nullif(F.lower(F.regexp_extract("_head", HEADING_NUMBER, 1)), F.lit("")))
    number = F.coalesce(number, F.lower("article_ref"))
    rows = rows.withColumns({"_prefix": F.when((F.col("label") == "transitory_item") & number.isNull(), "transitory-item").otherwise(prefix), "_number": number})
    names = ["book", "title", "chapter", "section", "annex", "article", "paragraph", "fraction", "inciso", "table", "note", "transitory", "transitory-item"]
    rows = rows.withColumns({f"_k_{i}": F.when((F.col("_prefix") == n) & F.col("_number").isNull(), 1).otherwise(0) for i, n in enumerate(names)})
    rows = ordered.carried(rows, ["doc_id"], "ord", {f"_last{m}": m for m in marks}, {f"_n_{i}": f"_k_{i}" for i in range(len(names))}, include_self=False)
    at = {v: F.when(F.col(f"_last_o_{v}") > F.coalesce(f"_last_c_{v}", F.lit(-1)), F.col(f"_last_o_{v}")) for v in LEVELS}
    # one array of all that is open; a label names the places of its ancestors in it, the nearest first. Under an annex nothing above it is an ancestor
    cut = at["section"].isNotNull() & F.coalesce(F.col("_last_annex"), F.lit(False))
    rows = rows.withColumns({"_open": F.array(*at.values()).cast("array<int>"), "_cut": cut})
    place = {v: i + 1 for i, v in enumerate(LEVELS)}
    spots = lambda *names: F.array(*[F.lit(place[n]) for n in names]).cast("array<int>")
    below = lambda *names: F.when(F.col("_cut"), spots(*names, "section")).otherwise(spots(*names, *_UNDER))
    transitory = F.element_at("_open", place["item"]).isNotNull() | F.element_at("_open", place["container"]).isNotNull()
    label = F.col("label")
    wanted = (
        F.when(label.isin("book_heading", "transitory_heading", "annex_heading"), F.array().cast("array<int>"))
        .when(label == "title_heading", spots("book"))
        .when(label == "chapter_heading", spots("title", "book"))
        .when(label == "section_heading", spots("chapter", "title", "book"))
        .when(label == "article_heading", below())
        .when(label == "transitory_item", spots("container"))
        .when(label == "inciso", below("fraction", "article"))
        .when(label.isin("fraction", "annex_body"), below("article"))
        .when((label == "editorial_note") & F.element_at("_open", place["item"]).isNull(), below("article"))
        .when(transitory, spots("item", "container"))
        .otherwise(below("article"))
    )
    rows = rows.withColumn("_wanted", wanted)
    rows = rows.withColumn("ancestors", F.filter(F.transform("_wanted", lambda i: F.element_at("_open", i)), lambda x: x.isNotNull()))
    rows = rows.withColumn("parent_ord", F.coalesce(F.try_element_at("ancestors", F.lit(1)), F.lit(0)))
    count = F.lit(None).cast("bigint")
    for i, n in enumerate(names):
        count = F.when(F.col("_prefix") == n, F.col(f"_n_{i}")).otherwise(count)
    node_id = F.concat_ws("-", "_prefix", F.coalesce(F.col("_number"), count.cast("string")))
    heading = F.when(F.col("node_type").isin(NAVIGABLE), F.col("_head"))
    return rows.select(
        "doc_id", "ord", "parent_ord", "ancestors", node_id.alias("node_id"), "node_type", "label", heading.alias("heading"), "text", "article_ref", "page_number", label.isin("annex_heading", "annex_body").alias("is_annex")
    )


def page_ranges(tree: DataFrame) -> DataFrame:
    """doc_id, ord, page_start, page_end: each node's pages and those of all below it. Narrow rows to every ancestor, added up before the shuffle."""
    below = tree.select("doc_id", F.explode(F.concat(F.array("ord"), "ancestors")).alias("ord"), "page_number")
    return below.groupBy("doc_id", "ord").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))


def contents(tree: DataFrame) -> DataFrame:
    """The navigable nodes in order: the table of contents."""
    got = tree.where(F.col("node_type").isin(NAVIGABLE)).select("doc_id", "ord", "node_id", "node_type", "heading")
    return got.join(page_ranges(tree).select("doc_id", "ord", "page_start"), ["doc_id", "ord"])


def sections(tree: DataFrame) -> DataFrame:
    """Books, titles, chapters and sections with their pages, articles and children."""
    per = tree.groupBy("doc_id", F.col("parent_ord").alias("ord")).agg(F.count("*").alias("child_count"), F.count_if(F.col("node_type") == "article").alias("article_count"))
    got = tree.where(F.col("node_type").isin(CONTAINERS)).select("doc_id", "ord", "node_id", "node_type", "heading").join(per, ["doc_id", "ord"], "left").join(page_ranges(tree), ["doc_id", "ord"])
    return got.fillna(0, ["child_count", "article_count"])


def counts(tree: DataFrame) -> DataFrame:
    """Per document: nodes of each type, whether there are transitory articles and annexes, entries of the contents and sections."""
    types = [*dict.fromkeys(NODE.values()), "paragraph"]
    return tree.groupBy("doc_id").agg(
        *[F.count_if(F.col("node_type") == t).alias(t) for t in types], F.bool_or(F.col("label").isin("transitory_heading", "transitory_item")).alias("has_transitories"), F.bool_or("is_annex").alias("has_annexes"),
        F.count_if(F.col("node_type").isin(NAVIGABLE)).alias("toc_entries"), F.count_if(F.col("node_type").isin(CONTAINERS)).alias("sections"),
    )


def titles(blocks: DataFrame) -> DataFrame:
    """doc_id, root_heading (the first document title) and document_title (the last one)."""
    t = blocks.where("label = 'document_title'")
    return t.groupBy("doc_id").agg(legal.strip(F.min_by("text", "ord")).alias("root_heading"), legal.strip(F.max_by("text", "ord")).alias("document_title"))


def projected(tree: DataFrame) -> DataFrame:
    """Chunks of the tree, one for each owner of text.

    An article takes its own text, its paragraphs and the items directly under it, in this order; a fraction of an article takes
    its items and paragraphs; a transitory item its paragraphs. A transitory heading that has items gives no chunk itself, and its
    loose paragraphs one each. Tables and notes stand alone, also without text. Of sections only annexes have a chunk.
    """
    own = tree.withColumn("_t", legal.strip(F.coalesce("text", F.lit(""))))
    up = tree.select("doc_id", F.col("ord").alias("parent_ord"), F.col("node_type").alias("up_type"), F.try_element_at(F.col("ancestors"), F.lit(1)).alias("up_parent"), F.col("article_ref").alias("up_ref"))
    items = tree.where("label = 'transitory_item'").groupBy("doc_id", F.col("parent_ord").alias("_of")).agg(F.lit(True).alias("up_holds"))
    holds = tree.where("label = 'transitory_item'").select("doc_id", F.col("parent_ord").alias("ord")).distinct().withColumn("holds", F.lit(True))
    kinds = tree.select("doc_id", F.col("ord").alias("up_parent"), F.col("node_type").alias("top_type"), F.col("article_ref").alias("top_ref"))
    rows = own.join(up, ["doc_id", "parent_ord"], "left").join(kinds, ["doc_id", "up_parent"], "left").join(items.withColumnRenamed("_of", "parent_ord"), ["doc_id", "parent_ord"], "left").join(holds, ["doc_id", "ord"], "left")
    annex = tree.where("label = 'annex_heading'").select("doc_id", F.col("ord").alias("annex_ord"))
    under = tree.select("doc_id", "ord", F.explode("ancestors").alias("annex_ord")).join(annex, ["doc_id", "annex_ord"]).select("doc_id", "ord").distinct().withColumn("under_annex", F.lit(True))
    rows = rows.join(under, ["doc_id", "ord"], "left")
    t, p = F.col("node_type"), F.col("up_type")
    holder = F.coalesce("up_holds", F.lit(False))
    in_fraction = (p == "fraction") & (F.col("top_type") == "article")
    folded = (
        F.when((t == "paragraph") & ((p == "article") | in_fraction | (p == "transitory") & ~holder), F.when(p == "fraction", 0).otherwise(1))
        .when((t == "inciso") & (p == "article"), 2)
        .when((t == "inciso") & in_fraction, 0)
    )
    lost = (p == "fraction") & ~F.coalesce(F.col("top_type") == "article", F.lit(False)) & ~t.isin("table", "note")
    kind = (
        F.when(t.isin("article", "fraction", "inciso"), t)
        .when(t == "table", "table")
        .when(t == "note", "boxed_note")
        .when((t == "transitory") & ~F.coalesce("holds", F.lit(False)), "transitory")
        .when((t == "section") & F.col("is_annex"), "annex")
        .when((t == "paragraph") & (p == "transitory"), "transitory")
        .when((t == "paragraph") & F.coalesce("under_annex", F.lit(False)), "annex")
        .when(t == "paragraph", "paragraph")
    )
    rows = rows.where(~F.coalesce(lost, F.lit(False))).withColumns({"part": F.coalesce(folded, F.lit(-1)), "owner": F.when(folded.isNotNull(), F.col("parent_ord")).otherwise(F.col("ord")), "_kind": F.when(folded.isNull(), kind)})
    ref = F.when(t.isin("article", "transitory"), F.col("article_ref")).when(t.isin("fraction", "table", "note") & (p == "article"), F.col("up_ref")).when(t.isin("table", "note") & (p == "fraction"), F.col("top_ref"))
    parts = rows.withColumn("_ref", ref).groupBy("doc_id", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("part", "ord", "_t")), lambda x: x["_t"] != "")), lambda x: x["_t"]), "\n").alias("text"),
        F.array_sort(F.collect_list("ord")).alias("source_ords"), F.max("_kind").alias("chunk_type"), F.max(F.when(F.col("ord") == F.col("owner"), F.col("_ref"))).alias("article_ref"),
        F.max(F.when(F.col("ord") == F.col("owner"), F.col("heading"))).alias("heading"), F.max(F.when(F.col("ord") == F.col("owner"), F.col("node_id"))).alias("node_id"),
    )
    parts = parts.where(F.col("chunk_type").isNotNull() & ((F.col("text") != "") | F.col("chunk_type").isin("table", "boxed_note"))).withColumnRenamed("owner", "ord")
    return parts.join(page_ranges(tree), ["doc_id", "ord"]).select("doc_id", "ord", "node_id", "chunk_type", "heading", "text", "article_ref", "page_start", "page_end", "source_ords")


def contexts(tree: DataFrame) -> DataFrame:
    """doc_id, ord, context: what is known from above a node, as JSON without the fields that are missing."""
    up = tree.select("doc_id", F.col("ord").alias("_a"), F.col("node_type").alias("up_type"), F.col("heading").alias("up_heading"), F.col("node_id").alias("up_id"), F.col("is_annex").alias("up_annex"))
    rows = tree.select("doc_id", "ord", "node_id", "node_type", "parent_ord", F.explode_outer("ancestors").alias("_a")).join(up, ["doc_id", "_a"], "left")
    headings = {f"{t}_heading": F.max_by("up_heading", F.when(F.col("up_type") == t, F.col("_a"))) for t in CONTAINERS}
    got = rows.groupBy("doc_id", "ord").agg(
        F.max("node_id").alias("node_id"), F.max("node_type").alias("node_type"), F.coalesce(F.max(F.when(F.col("_a") == F.col("parent_ord"), F.col("up_id"))), F.lit("doc")).alias("parent_node_id"),
        *[h.alias(n) for n, h in headings.items()],
        F.max(F.when(F.col("up_type") == "transitory", True)).alias("is_transitory"), F.max(F.when(F.col("up_annex"), True)).alias("is_annex"),
    )
    return got.select("doc_id", "ord", F.to_json(F.struct("node_id", "node_type", "parent_node_id", *headings, "is_transitory", "is_annex")).alias("context"))
