"""Layout blocks from text spans: reading order, zones, repeated heads and feet, labels, boxes.

Null positions give null zones and labels by text alone; a span delivered twice counts once.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from ..session import cut_lineage

BLOCK = ["doc_id", "page_number", "block_no"]
PAGE_HEIGHT = 842.0


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One row per span_id: the least row of several deliveries."""
    cols = ["doc_id", "page_number", "block_no", "line_no", "span_no", "text", "font_size", "font_name", "is_bold", "is_italic", "bbox"]
    return spans.where("span_id IS NOT NULL").groupBy("span_id").agg(F.min(F.struct(*cols)).alias("s")).select("span_id", "s.*")


def blocks(spans: DataFrame) -> DataFrame:
    """Blocks of a page: the text of their spans in order of line and span, joined without a separator, and their box.

    Blank spans are dropped, and blocks without text with them; three line feeds and more in a text become two.
    """
    rows = distinct_spans(spans).where(F.col("text").isNotNull() & (legal.strip(F.col("text")) != "") & F.col("block_no").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "span_no", "span_id", "text"))), lambda x: x["text"]), "")
    box = {k: f(F.col(f"bbox.{k}")).alias(k) for k, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))}
    got = rows.groupBy(*BLOCK).agg(text.alias("text"), F.count("*").alias("spans"), *box.values())
    return got.withColumn("text", F.regexp_replace(legal.strip(F.col("text")), r"\n{3,}", "\n\n"))


def reading_order(found: DataFrame) -> DataFrame:
    """Adds reading_order from 0: by bands of 5 points from the top, then from the left, then by number."""
    w = Window.partitionBy("doc_id", "page_number").orderBy(F.floor(F.col("y0") / 5) * 5, "x0", "block_no")
    return found.withColumn("reading_order", F.row_number().over(w) - 1)


def dominant_font(spans: DataFrame) -> DataFrame:
    """The most frequent font size of a block; of equally frequent ones the one that comes first."""
    rows = distinct_spans(spans).where("font_size IS NOT NULL AND block_no IS NOT NULL")
    per = rows.groupBy(*BLOCK, "font_size").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "span_no")).alias("at"))
    order = Window.partitionBy(*BLOCK).orderBy(F.desc("n"), "at")
    return per.withColumn("r", F.row_number().over(order)).where("r = 1").select(*BLOCK, "font_size")


def zoned(found: DataFrame) -> DataFrame:
    """Adds top and bottom: whether the block stands in the page's upper or lower tenth. The height is the column page_height, where there is one, else that of an A4 page."""
    height = F.coalesce("page_height", F.lit(PAGE_HEIGHT)) if "page_height" in found.columns else F.lit(PAGE_HEIGHT)
    return found.withColumns({"top": F.col("y0") < height * 0.1, "bottom": F.col("y1") > height * 0.9})


def repeated_zones(found: DataFrame) -> DataFrame:
    """doc_id, zone, signature, pages of signatures repeated in a zone on max(2, ceil(0.4 pages)) pages."""
    z = zoned(found).withColumn("signature", legal.signature(F.col("text"))).where("signature <> ''")
    both = z.select("doc_id", "page_number", "signature", F.explode(F.array(F.when(F.col("top"), "top"), F.when(F.col("bottom"), "bottom"))).alias("zone")).where("zone IS NOT NULL")
    per = both.distinct().groupBy("doc_id", "zone", "signature").agg(F.count("*").alias("pages"))
    total = found.select("doc_id", "page_number").distinct().groupBy("doc_id").agg(F.count("*").alias("total"))
    return per.join(total, "doc_id").where((F.col("total") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("total") * 0.4)))).drop("total")


def kinds(found: DataFrame) -> DataFrame:
    """Adds kind: header or footer where the block's signature is repeated in its zone, else text."""
    z = zoned(found).withColumn("signature", legal.signature(F.col("text")))
    rep = repeated_zones(found)
    top = rep.where("zone = 'top'").select("doc_id", "signature", F.lit(True).alias("rt"))
    bottom = rep.where("zone = 'bottom'").select("doc_id", "signature", F.lit(True).alias("rb"))
    got = z.join(top, ["doc_id", "signature"], "left").join(bottom, ["doc_id", "signature"], "left")
    kind = F.when(F.col("top") & F.col("rt"), "header").when(F.col("bottom") & F.col("rb"), "footer").otherwise("text")
    return got.withColumn("kind", kind).drop("signature", "top", "bottom", "rt", "rb")


def labelled(found: DataFrame) -> DataFrame:
    """Blocks with kind (header, footer or text) and the label of the ordered rules."""
    got = found if "kind" in found.columns else kinds(found)
    label = legal.block_label(F.col("text"), F.col("kind"), F.lit("text"), index_zone(F.col("text")), F.lit(False))
    return got.withColumn("l", label).select(*[c for c in got.columns if c not in ("l", "label", "confidence", "reason")], "l.label", "l.confidence", "l.reason")


def classified(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """From spans to labelled blocks in the order of the document: blocks, reading order, heads and feet, merged paragraphs, labels. tables: boxes of candidate tables, which part paragraphs."""
    from . import structure

    found = cut_lineage(kinds(cut_lineage(reading_order(blocks(spans)))))  # both are read several times
    return structure.numbered(cut_lineage(labelled(merged(found, font_sizes(spans), tables))), ["reading_order", "block_no"])


def with_neighbours(rows: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Adds context_before and context_after: the texts of the blocks around each block of a document in its order, as a model is asked with."""
    inside = Window.partitionBy("doc_id", "page_number").orderBy("ord")
    # the last and first blocks of a page are told to its neighbours, so that a window never spans a document
    ends = rows.groupBy("doc_id", "page_number").agg(
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_all")
    ).select("doc_id", "page_number", F.slice("_all", -F.least(F.size("_all"), F.lit(before)), before).alias("_tail"), F.slice("_all", 1, after).alias("_head"))
    over = Window.partitionBy("doc_id").orderBy("page_number")
    near = ends.select(
        "doc_id", "page_number",
        F.flatten(F.collect_list("_tail").over(over.rowsBetween(-before, -1))).alias("_before"), F.flatten(F.collect_list("_head").over(over.rowsBetween(1, after))).alias("_after"),
    )
    mine_before, mine_after = F.collect_list(F.struct("ord", "text")).over(inside.rowsBetween(-before, -1)), F.collect_list(F.struct("ord", "text")).over(inside.rowsBetween(1, after))
    got = rows.withColumns({"_mb": mine_before, "_ma": mine_after}).join(near, ["doc_id", "page_number"], "left")
    texts = lambda c: F.transform(c, lambda x: x["text"])
    b, a = F.concat("_before", "_mb"), F.concat("_ma", "_after")
    return got.withColumns({"context_before": texts(F.slice(b, F.greatest(F.size(b) - before + 1, F.lit(1)), before)), "context_after": texts(F.slice(a, 1, after))}).drop("_mb", "_ma", "_before", "_after")


def index_zone(text):
    """Whether a text reads like an index: keywords, their density and short lines."""
    hits = F.regexp_count(text, F.lit(r"(?iU)\b(art[ií]culo|cap[ií]tulo|secci[oó]n|t[ií]tulo|transitorio|libro|anexo)\b"))
    lines = F.filter(F.split(text, "\n"), lambda x: legal.strip(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(legal.strip(x)) < 80))
    return (hits >= 2) & (hits / F.greatest(F.length(text), F.lit(1)) >= 0.02) & (short >= 0.6 * F.size(lines))


def uncovered(found: DataFrame, boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks of which no exclude box on their page covers the share or more (spatial anti join on the page)."""
    b = boxes.select(F.col("doc_id").alias("bd"), F.col("page_number").alias("bp"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    over = legal.overlap_share({c: found[c] for c in ("x0", "y0", "x1", "y1")}, {c: b[f"b{c}"] for c in ("x0", "y0", "x1", "y1")})
    return found.join(b, (found["doc_id"] == b["bd"]) & (found["page_number"] == b["bp"]) & (over >= share), "left_anti")


def touching(found: DataFrame, boxes: DataFrame, share: float = 0.3) -> DataFrame:
    """Blocks that overlap a box of their page by the share of either (spatial semi join)."""
    b = boxes.select(F.col("doc_id").alias("bd"), F.col("page_number").alias("bp"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    mine, other = {c: found[c] for c in ("x0", "y0", "x1", "y1")}, {c: b[f"b{c}"] for c in ("x0", "y0", "x1", "y1")}
    near = (legal.overlap_share(mine, other) >= share) | (legal.overlap_share(other, mine) >= share)
    return found.join(b, (found["doc_id"] == b["bd"]) & (found["page_number"] == b["bp"]) & near, "left_semi")


def inside_frames(tables: DataFrame, frames: DataFrame, share: float = 0.3) -> DataFrame:
    """Adds inside: whether any frame of the page covers the share of the table (spatial exists)."""
    f = frames.select(F.col("doc_id").alias("bd"), F.col("page_number").alias("bp"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    over = legal.overlap_share({c: tables[c] for c in ("x0", "y0", "x1", "y1")}, {c: f[f"b{c}"] for c in ("x0", "y0", "x1", "y1")})
    on = (tables["doc_id"] == f["bd"]) & (tables["page_number"] == f["bp"]) & (over >= share)
    return tables.join(f, on, "left_semi").withColumn("inside", F.lit(True)).unionByName(tables.join(f, on, "left_anti").withColumn("inside", F.lit(False)))


def parted(ordered_blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks between which and the next one in reading order a table of the page stands (interval join on the page)."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("reading_order", "block_no")
    gaps = ordered_blocks.select("doc_id", "page_number", "block_no", F.col("y1").alias("gap_top"), F.lead("y0").over(w).alias("gap_bottom"), F.lead("block_no").over(w).alias("next_no")).where("gap_bottom IS NOT NULL")
    t = tables.select("doc_id", "page_number", F.col("y0").alias("t0"), F.col("y1").alias("t1"))
    hit = gaps.join(t, (gaps["doc_id"] == t["doc_id"]) & (gaps["page_number"] == t["page_number"]) & (F.col("t0") < F.col("gap_bottom")) & (F.col("t1") > F.col("gap_top")), "left_semi")
    return hit.select("doc_id", "page_number", "block_no", "next_no")


def font_sizes(spans: DataFrame) -> DataFrame:
    """The font sizes of each block's spans in order."""
    rows = distinct_spans(spans).where("font_size IS NOT NULL AND block_no IS NOT NULL").where(legal.strip(F.coalesce("text", F.lit(""))) != "")
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "span_no", "span_id", "font_size"))), lambda x: x["font_size"])
    return rows.groupBy(*BLOCK).agg(sizes.alias("sizes"))


#: What begins a new unit of the law, and signs that begin a continuation.
_UNIT = re.compile(
    r"\s*(art[ií]culo\s+\d|cap[ií]tulo\s+[IVXLCDM\d]|secci[oó]n\s+[IVXLCDM\d]|t[ií]tulo\s+[IVXLCDM\d]|libro\s+[IVXLCDM\d]|transitorio"
    r"|primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo|disposicion|anexo\s)",
    re.I,
)
_GOES_ON = "\"'«“‘([—–-"
GAP, GAP_LEAST, SIZE_OFF = 18.0, -2.0, 1.5
_MERGED = "doc_id string, page_number int, block_no int, reading_order int, kind string, text string, x0 double, y0 double, x1 double, y1 double, blocks bigint, source_blocks array<int>"


def _joins(text: str, tail: str) -> bool:
    """Whether a text goes on with the sentence of the tail before it."""
    begin = text.lstrip()
    if not begin or not tail.rstrip() or _UNIT.match(begin):
        return False
    return begin[0] in _GOES_ON or begin[0].islower() or begin[0].isdigit() or tail.rstrip()[-1] not in ".!?"


def _merge_page(page):
    """One page's blocks in reading order: a block joins the paragraph before it, seen with all that was merged into it."""
    out: list[dict] = []
    fonts: list[Counter] = []
    for r in page.sort_values(["reading_order", "block_no"], kind="stable").to_dict("records"):
        sizes = Counter(r["sizes"].tolist() if r["sizes"] is not None else [])
        if out and not r["parted"]:
            last, size = out[-1], fonts[-1]
            gap = r["y0"] - last["y1"]
            alike = not size or not sizes or abs(size.most_common(1)[0][0] - sizes.most_common(1)[0][0]) <= SIZE_OFF
            plain = r["kind"] == last["kind"] == "text" and not r["zone"] and not last["zone"]
            if plain and GAP_LEAST <= gap <= GAP and alike and _joins(r["text"], last["text"]):
                last["text"] = re.sub(r"\n{3,}", "\n\n", last["text"].rstrip() + " " + r["text"].lstrip())
                last.update(x0=min(last["x0"], r["x0"]), y0=min(last["y0"], r["y0"]), x1=max(last["x1"], r["x1"]), y1=max(last["y1"], r["y1"]), blocks=last["blocks"] + 1)
                last["source_blocks"].append(r["block_no"])
                size.update(sizes)
                continue
        out.append({**r, "blocks": 1, "source_blocks": [r["block_no"]]})
        fonts.append(sizes)
    import pandas as pd

    return pd.DataFrame(out, columns=[c.split()[0] for c in _MERGED.split(", ")])


def merged(found: DataFrame, fonts: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Paragraphs of blocks with reading_order and kind: what goes on from the block above is joined by a space, with the union of boxes.

    Blocks join at a gap of -2 to 18 points, with dominant font sizes within 1.5, where the lower one begins no unit of the law and continues the
    text, both are plain text outside an index, and no table stands between them. The fold sees the paragraph as merged so far; it runs within a page.
    """
    rows = found.join(fonts, BLOCK, "left")
    split = F.lit(False)
    if tables is not None:
        hit = parted(found, tables).select("doc_id", "page_number", F.col("next_no").alias("block_no"), F.lit(True).alias("_hit"))
        rows, split = rows.join(hit.distinct(), BLOCK, "left"), F.coalesce("_hit", F.lit(False))
    rows = rows.select(*BLOCK, "reading_order", "kind", "text", "x0", "y0", "x1", "y1", "sizes", index_zone(F.col("text")).alias("zone"), split.alias("parted"))
    return rows.groupBy("doc_id", "page_number").applyInPandas(_merge_page, _MERGED)
