"""Filters and shapes over the rows a PDF extractor yields: spans, candidate tables, drawings, bookmarks.

The extractor itself is pluggable (sources/readers.py); whatever library it uses, it gives these rows, and everything
after it is relational.  Null boxes are dropped; rows of pages without drawings or tables simply have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal
from . import layout, tables

#: Bits of a span's flags, least sizes of frames, and the gap at which boxes become one.
ITALIC, BOLD = 2, 16
FRAME, RECT = (50.0, 20.0), (100.0, 30.0)
MERGE_GAP = 5.0
BOX = ["x0", "y0", "x1", "y1"]


def quad(c: Column) -> dict[str, Column]:
    """x0, y0, x1, y1 of an array of numbers; null where it is null or has fewer than four."""
    return {n: F.when(F.size(c) >= 4, F.get(c, i).cast("double")) for i, n in enumerate(BOX)}


def styled(spans: DataFrame) -> DataFrame:
    """Adds is_bold and is_italic from a span's flags."""
    flags = F.coalesce(F.col("flags").cast("int"), F.lit(0))
    return spans.withColumns({"is_bold": flags.bitwiseAND(F.lit(BOLD)) > 0, "is_italic": flags.bitwiseAND(F.lit(ITALIC)) > 0})


def candidate_tables(found: DataFrame) -> DataFrame:
    """Adds row_count and col_count (of the longest row) to candidate tables with their rows of cells."""
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    longest = F.coalesce(F.array_max(F.transform(rows, lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))
    return found.withColumns({"row_count": F.size(rows), "col_count": F.greatest(longest, F.lit(0))})


def visual_frames(drawings: DataFrame) -> DataFrame:
    """Drawings large enough to frame something: 50 by 20 points."""
    return drawings.where((F.col("x1") - F.col("x0") >= FRAME[0]) & (F.col("y1") - F.col("y0") >= FRAME[1]))


def visual_rects(drawings: DataFrame, relaxed: bool = False) -> DataFrame:
    """Drawn rectangles of 100 by 30 points that may hold a boxed note: with a rectangle or four lines among their items, and a stroke colour unless relaxed."""
    large = (F.col("x1") - F.col("x0") >= RECT[0]) & (F.col("y1") - F.col("y0") >= RECT[1])
    shape = F.array_contains("items", "re") | (F.size(F.filter("items", lambda i: i == "l")) >= 4)
    return drawings.where(large & F.coalesce(shape, F.lit(False)) & (F.lit(True) if relaxed else F.col("color").isNotNull()))


def bookmarks(native: DataFrame, legacy: bool = False) -> DataFrame:
    """Native outline entries in one form: trimmed titles, level 1 and page 1 where missing. legacy: pages counted from 0 by the older reader, so one is added."""
    page = F.col("page") + 1 if legacy else F.greatest(F.coalesce("page", F.lit(1)), F.lit(1))
    return native.withColumns({"level": F.coalesce("level", F.lit(1)), "title": legal.strip(F.coalesce("title", F.lit(""))), "page": page})


def _merge_boxes(page):
    """Boxes of a page that touch, or nearly, become one, until none do."""
    import pandas as pd

    doc, number = page["doc_id"].iloc[0], page["page_number"].iloc[0]
    todo = [tuple(r) for r in page[BOX].itertuples(index=False)]
    done: list[tuple] = []
    while todo:
        box = todo.pop()
        near = [o for o in done if box[0] - MERGE_GAP <= o[2] and o[0] - MERGE_GAP <= box[2] and box[1] - MERGE_GAP <= o[3] and o[1] - MERGE_GAP <= box[3]]
        if near:  # the grown box may reach others that were apart before
            done = [o for o in done if o not in near]
            todo.append((min(box[0], *(o[0] for o in near)), min(box[1], *(o[1] for o in near)), max(box[2], *(o[2] for o in near)), max(box[3], *(o[3] for o in near))))
        else:
            done.append(box)
    return pd.DataFrame([(doc, number, *b) for b in sorted(done)], columns=["doc_id", "page_number", *BOX])


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """The closure of boxes that lie within MERGE_GAP of each other, page by page."""
    kind = f"doc_id {boxes.schema['doc_id'].dataType.simpleString()}, page_number int, x0 double, y0 double, x1 double, y1 double"
    rows = boxes.select("doc_id", F.col("page_number").cast("int").alias("page_number"), *[F.col(c).cast("double").alias(c) for c in BOX])
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in BOX)).groupBy("doc_id", "page_number").applyInPandas(_merge_boxes, kind)


def exclude_boxes(table_boxes: DataFrame, rects: DataFrame) -> DataFrame:
    """Boxes whose text the page text leaves out: the tables, and the drawn rectangles that overlap one by 30 % either way, merged."""
    near = layout.touching(rects, table_boxes)
    keep = ["doc_id", "page_number", *BOX]
    # pages without drawn rectangles keep their tables as they are
    drawn = rects.select("doc_id", "page_number").distinct()
    alone = table_boxes.select(*keep).join(drawn, ["doc_id", "page_number"], "left_anti")
    both = table_boxes.select(*keep).join(drawn, ["doc_id", "page_number"], "left_semi").unionByName(near.select(*keep))
    return alone.unionByName(merged_boxes(both))


def routed_tables(found: DataFrame, rects: DataFrame, relaxed: bool = False, offset: int = 0, provider=None) -> DataFrame:
    """The tables a page keeps: header rows merged, prose dropped, numbered through the document, and told apart from boxed notes.

    Takes doc_id, page_number, table_no, rows and the box. A table inside a drawn rectangle with at most two columns is put to the arbiter (see
    providers.routed_verdict); what it calls an editorial note is a boxed note.
    """
    from ..functions import providers
    from . import ordered

    rows = found.withColumn("rows", tables.merged_header(F.col("rows"))).withColumn("figures", tables.figures(F.col("rows")))
    r, f = F.col("rows"), F.col("figures")
    rows = rows.where(~tables.prose_like(r, f, relaxed) & F.col("x0").isNotNull())
    rows = layout.inside_frames(rows, rects)
    text = F.array_join(tables.cells(r), " ")
    note = tables.boxed_note(r, f)
    asked = ~note & F.col("inside") & (f["columns"] <= 2)
    rows = rows.withColumns({"_note": note, "arbiter": F.when(asked, providers.routed_verdict(text, F.lit(True), f["columns"], f["filled_rows"], F.lit(True), provider))})
    rows = rows.withColumn("is_boxed_note", F.col("_note") | F.coalesce(F.col("arbiter.kind") == "editorial_note", F.lit(False))).drop("_note")
    rows = rows.withColumns({"_one": F.lit(1), "_at": F.col("page_number") * 1000 + F.col("table_no")})
    rows = ordered.running_sum(rows, ["doc_id"], "_at", "_one", "table_index").withColumn("table_index", F.col("table_index") + offset)
    return rows.withColumn("markdown", tables.to_markdown(F.col("rows"), F.col("table_index"))).drop("_one", "_at", "inside", "figures")


def diagnostics(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per page: blocks, those that exclude boxes cover, those kept, and the boxes."""
    kept = layout.uncovered(blocks, boxes).groupBy("doc_id", "page_number").agg(F.count("*").alias("kept"))
    per = blocks.groupBy("doc_id", "page_number").agg(F.count("*").alias("blocks")).join(kept, ["doc_id", "page_number"], "left")
    per = per.join(boxes.groupBy("doc_id", "page_number").agg(F.count("*").alias("boxes")), ["doc_id", "page_number"], "left").fillna(0, ["kept", "boxes"])
    return per.select("doc_id", "page_number", "blocks", (F.col("blocks") - F.col("kept")).alias("excluded"), "kept", "boxes")
