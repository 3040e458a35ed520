"""Lines of pages: explosion, repetition, legal types and segments.

All windows run within a page or within light per-page summaries, so a document of any size is spread
over many tasks.  Null texts have no lines; a blank text has no segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal

PAGE = ["doc_id", "page_number"]
#: Line ends of all kinds.
NEWLINE = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085  ]"


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row per page; of several deliveries the greatest text."""
    return pages.where("doc_id IS NOT NULL AND page_number IS NOT NULL").groupBy(*PAGE).agg(F.max("text").alias("text"))


def explode_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no (from 1), line. One trailing empty line is dropped."""
    parts = F.split(F.regexp_replace("text", f"(?:{NEWLINE})\\z", ""), NEWLINE)
    return pages.where("text IS NOT NULL AND text <> ''").select(*PAGE, F.posexplode(parts).alias("pos", "line")).select(*PAGE, (F.col("pos") + 1).alias("line_no"), "line")


def split_fused(lines: DataFrame) -> DataFrame:
    """Lines in which a reform note or a TRANSITORIOS heading runs into an article become two; line_no is numbered anew within the page."""
    t = legal.strip(F.col("line"))
    note = (F.length(t) >= 30) & t.rlike(r"(?iU)(?:reformad[oa]|adicionad[oa]|derogad[oa]|Reforma)\s*.*DOF")
    at = F.regexp_extract(t, r"(?iU)^(.{21,}?)\s+(Art[íi]culo\s+\d.*)$", 1)
    rest = F.regexp_extract(t, r"(?iU)^(.{21,}?)\s+(Art[íi]culo\s+\d.*)$", 2)
    head = F.regexp_extract(t, r"(?iU)^((?:ART[ÍI]CULOS?\s+)?TRANSITORIOS?)\s+(Art[íi]culo\s+.*)$", 1)
    tail = F.regexp_extract(t, r"(?iU)^((?:ART[ÍI]CULOS?\s+)?TRANSITORIOS?)\s+(Art[íi]culo\s+.*)$", 2)
    parts = F.when(note & (rest != ""), F.array(at, rest)).when(tail != "", F.array(head, tail)).otherwise(F.array("line"))
    out = lines.select(*PAGE, "line_no", F.posexplode(parts).alias("part", "line"))
    return out.withColumn("line_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no", "part"))).drop("part")


def repeated_signatures(lines: DataFrame) -> DataFrame:
    """doc_id, signature, pages: lines whose signature stands on at least max(2, ceil(0.4 pages)) pages of a document."""
    sig = lines.withColumn("signature", legal.signature(F.col("line"))).where("signature <> ''")
    per = sig.select("doc_id", "signature", "page_number").distinct().groupBy("doc_id", "signature").agg(F.count("*").alias("pages"))
    total = lines.select(*PAGE).distinct().groupBy("doc_id").agg(F.count("*").alias("total"))
    return per.join(total, "doc_id").where((F.col("total") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("total") * 0.4)))).select("doc_id", "signature", "pages")


def repeated_headers(lines: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, key, lines: header candidates that stand at least so often in a document, reform legends left out."""
    rows = lines.where(legal.header_candidate(F.col("line")) & ~F.col("line").rlike(legal.REFORM_LEGEND)).select("doc_id", legal.squeeze(F.col("line")).alias("key")).where("key <> ''")
    return rows.groupBy("doc_id", "key").agg(F.count("*").alias("lines")).where(F.col("lines") >= least)


def keep_first_headers(lines: DataFrame) -> DataFrame:
    """Lines without page numbers and without header candidates seen before in the document; reform legends stay."""
    kept = lines.where(~legal.always_removed(F.col("line")))
    keyed = kept.withColumn("key", F.when(legal.header_candidate(F.col("line")) & ~F.col("line").rlike(legal.REFORM_LEGEND), legal.squeeze(F.col("line"))))
    first = keyed.where("key IS NOT NULL").groupBy("doc_id", "key").agg(F.min(F.struct("page_number", "line_no")).alias("first"))
    joined = keyed.join(first, ["doc_id", "key"], "left")
    return joined.where(F.col("key").isNull() | (F.struct("page_number", "line_no") == F.col("first"))).select(*PAGE, "line_no", "line")


def typed_lines(lines: DataFrame) -> DataFrame:
    """Each line with its legal type and reference, seen with the line before (over the page's edge the last line with text) and after."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    rows = lines.withColumn("t", legal.strip(F.col("line")))
    # one row per page: its last line with text, carried to the next page
    last = rows.groupBy(*PAGE).agg(F.max_by("t", F.when(F.col("t") != "", F.col("line_no"))).alias("edge"))
    over = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    edges = last.select(*PAGE, F.last("edge", ignorenulls=True).over(over).alias("edge"))
    got = rows.join(edges, PAGE)
    before = F.when(F.row_number().over(w) == 1, F.coalesce("edge", F.lit(""))).otherwise(F.lag("t").over(w))
    got = got.withColumn("before", before).withColumn("after", F.coalesce(F.lead("t").over(w), F.lit("")))
    kind = legal.line_type(F.col("t"), F.col("before"), F.col("after"))
    return got.withColumn("kind", kind).select(*PAGE, "line_no", "line", F.col("kind.type").alias("type"), F.col("kind.ref").alias("ref"))


def with_transitory_state(typed: DataFrame) -> DataFrame:
    """Adds inside: whether the line stands within transitory articles. Headers and ordinals switch it on, larger units off."""
    text = legal.strip(F.col("line"))
    header = (F.col("type") == "transitorio") & text.rlike(legal.TRANSITORY_HEADER)
    event = F.when(F.col("type") == "transitorio", 1).when(F.col("type").isin("book", "title", "chapter", "section"), 0)
    rows = typed.withColumn("header", header).withColumn("event", event)
    within = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*PAGE).agg(F.max_by("event", F.when(F.col("event").isNotNull(), F.col("line_no"))).alias("end"))
    over = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*PAGE, F.last("end", ignorenulls=True).over(over).alias("carry"))
    got = rows.withColumn("here", F.last("event", ignorenulls=True).over(within)).join(carry, PAGE)
    return got.withColumn("inside", F.coalesce("here", "carry", F.lit(0)) == 1).drop("here", "carry", "event")


def segments(typed: DataFrame) -> DataFrame:
    """doc_id, page_number, seg_no, type, ref, text: consecutive lines under one structural line."""
    rows = with_transitory_state(typed)
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    begins = (F.col("type") != "generic") | F.lag("header", 1, False).over(w)
    rows = rows.withColumn("begins", F.when(begins | (F.row_number().over(w) == 1), 1).otherwise(0))
    rows = rows.withColumn("seg", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordinal = F.initcap(F.lower(F.regexp_extract(legal.strip(F.col("line")), legal.TRANSITORY_ORDINAL, 1)))
    ref = (
        F.when(F.col("header"), F.lit(None).cast("string"))
        .when(F.col("type") == "transitorio", F.concat(F.lit("Artículo "), ordinal, F.lit(" Transitorio")))
        .when((F.col("type") == "article") & F.col("inside") & F.col("ref").isNotNull(), F.concat("ref", F.lit(" Transitorio")))
        .otherwise(F.col("ref"))
    )
    rows = rows.withColumn("ref", ref)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    got = rows.groupBy(*PAGE, "seg").agg(F.min_by("type", "line_no").alias("type"), F.min_by("ref", "line_no").alias("ref"), legal.strip(body).alias("text"))
    return got.where("text <> ''").withColumn("seg_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("seg"))).drop("seg")
