"""Queries over extracted_spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as ops
from ..tables import table
from .registry import query

_SPANS = """
    spans AS (SELECT DISTINCT ON (span_id) * FROM extracted_spans WHERE span_id IS NOT NULL ORDER BY span_id, doc_id, page_number, block_no, line_no, span_no, text),
    good AS (SELECT * FROM spans WHERE text IS NOT NULL AND regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> '' AND block_no IS NOT NULL),
    blocks AS (SELECT doc_id, page_number, block_no, regexp_replace(string_agg(text, '' ORDER BY line_no NULLS FIRST, span_no NULLS FIRST, span_id), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS text, count(*) AS spans,
        min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1 FROM good GROUP BY ALL)
"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return ops.blocks(table(spark, d, "extracted_spans"))


@query(f"WITH {_SPANS} SELECT * FROM blocks")
def layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d)


@query(f"""
    WITH {_SPANS} SELECT doc_id, page_number, block_no,
        CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY floor(y0 / 5) * 5 NULLS FIRST, x0 NULLS FIRST, block_no) - 1 AS INT) AS reading_order FROM blocks
""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return ops.reading_order(_blocks(spark, d)).select("doc_id", "page_number", "block_no", "reading_order")


@query(f"""
    WITH {_SPANS}, per AS (SELECT doc_id, page_number, block_no, font_size, count(*) AS n, min(coalesce(line_no, -1) * 100000 + coalesce(span_no, -1)) AS pos FROM spans
        WHERE font_size IS NOT NULL AND block_no IS NOT NULL GROUP BY ALL)
    SELECT doc_id, page_number, block_no, font_size FROM per QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, block_no ORDER BY n DESC, pos) = 1
""")
def dominant_font(spark: SparkSession, d: str) -> DataFrame:
    return ops.dominant_font(table(spark, d, "extracted_spans"))


@query(f"WITH {_SPANS} SELECT doc_id, page_number, block_no, y0 < 84.2 AS top, y1 > 757.8 AS bottom FROM blocks")
def page_zones(spark: SparkSession, d: str) -> DataFrame:
    return ops.zoned(_blocks(spark, d)).select("doc_id", "page_number", "block_no", "top", "bottom")


_MONTHS = "|".join(["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"])
_SIGNED = f"""{_SPANS}, sig AS (SELECT *, upper(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\b\\d{{1,2}}\\s*(?:de\\s+)?(?:{_MONTHS})(?:\\s*(?:de|del)\\s*\\d{{2,4}})?\\b', '<<date>>', 'g'),
        '\\b(?:folio|n[uú]m(?:ero)?|no\\.)?\\s*\\d+\\b', '<<num>>', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))) AS signature FROM blocks),
    zones AS (SELECT DISTINCT doc_id, page_number, signature, zone FROM (SELECT *, unnest([CASE WHEN y0 < 84.2 THEN 'top' END, CASE WHEN y1 > 757.8 THEN 'bottom' END]) AS zone FROM sig) WHERE zone IS NOT NULL AND signature <> ''),
    tot AS (SELECT doc_id, count(DISTINCT page_number) AS total FROM blocks GROUP BY 1),
    rep AS (SELECT doc_id, zone, signature, count(*) AS pages FROM zones JOIN tot USING (doc_id) GROUP BY 1, 2, 3, total HAVING total >= 2 AND count(*) >= greatest(2, ceil(total * 0.4)))"""


@query(f"WITH {_SIGNED} SELECT doc_id, zone, signature, pages FROM rep")
def repeated_zone_signatures(spark: SparkSession, d: str) -> DataFrame:
    return ops.repeated_zones(_blocks(spark, d))


@query(f"""WITH {_SIGNED} SELECT doc_id, page_number, block_no, CASE WHEN y0 < 84.2 AND EXISTS (SELECT 1 FROM rep r WHERE r.doc_id = s.doc_id AND r.signature = s.signature AND zone = 'top') THEN 'header'
    WHEN y1 > 757.8 AND EXISTS (SELECT 1 FROM rep r WHERE r.doc_id = s.doc_id AND r.signature = s.signature AND zone = 'bottom') THEN 'footer' ELSE 'text' END AS kind FROM sig s""")
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ops.kinds(_blocks(spark, d)).select("doc_id", "page_number", "block_no", "kind")


_ORDINAL = "(?:primero|segundo|tercero|cuarto|quinto|sexto|s[eéÉ]ptimo|octavo|noveno|d[eéÉ]cimo|und[eéÉ]cimo|duod[eéÉ]cimo|d[eéÉ]cimo\\s*(?:primer|segund|tercer|cuart|quint|sext|s[eéÉ]ptim|octav|noven)o?|vig[eéÉ]simo|trig[eéÉ]simo|cuadrag[eéÉ]simo|quincuag[eéÉ]simo)"
_INLINE = "(?:conforme|conform[ea]|seg[úÚ]n|previsto|dispuesto|establecid[oa]|se[ñÑ]alad[oa]|referid[oa]|contenid[oa]|indicad[oa]|mencionad[oa]|de\\s+(?:acuerdo|conformidad)|en\\s+(?:t[eéÉ]rminos|los\\s+t[eéÉ]rminos)|(?:el|del|al|los|las|un)\\s+)\\s*(?:art[iíÍ]culo|art\\.)\\s+\\d+"
_KINDS = f"""{_SIGNED}, kinds AS (SELECT doc_id, page_number, block_no, text AS t, CASE WHEN y0 < 84.2 AND EXISTS (SELECT 1 FROM rep r WHERE r.doc_id = s.doc_id AND r.signature = s.signature AND zone = 'top') THEN 'header'
    WHEN y1 > 757.8 AND EXISTS (SELECT 1 FROM rep r WHERE r.doc_id = s.doc_id AND r.signature = s.signature AND zone = 'bottom') THEN 'footer' ELSE 'text' END AS kind,
    len(regexp_extract_all(text, '(?i)\\b(?:art[iíÍ]culo|cap[iíÍ]tulo|secci[oóÓ]n|t[iíÍ]tulo|transitorio|libro|anexo)\\b')) AS hits, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 1) AS capitals FROM sig s),
    signs AS (SELECT *, regexp_matches(t, '(?i)^\\s*\\d{{1,2}}\\s+DE\\s+(?:{_MONTHS})\\s+DE\\s+\\d{{4}}\\s*$') OR regexp_matches(t, '(?i)^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\\s+de\\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)?,?\\s+\\d{{1,2}}\\s+de\\s+(?:{_MONTHS})') AND length(t) < 120 OR regexp_matches(t, '(?i)\\bDOF\\s+\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}\\b') AND length(t) < 100 AS dated FROM kinds)"""


@query(f"""WITH {_KINDS} SELECT doc_id, page_number, block_no, kind, CASE WHEN kind = 'header' THEN 'page_header' WHEN kind = 'footer' THEN 'page_footer'
    WHEN regexp_matches(t, '(?i)(?:aclaraci[oóÓ]n|fe\\s+de\\s+erratas|N\\.\\s*de\\s+E\\.|nota\\s+(?:del\\s+editor|aclaratoria|editorial)|art[íiÍ]culo\\s+(?:reformad[oa]|adicionad[oa]|derogad[oa])\\b|correcci[oóÓ]n|aviso)') THEN 'editorial_note'
    WHEN hits >= 2 AND hits / greatest(length(t), 1) >= 0.02 AND length(t) < 80 THEN 'index_block' WHEN regexp_matches(t, '(?i)^\\s*transitorios?\\s*$') THEN 'transitory_heading' WHEN regexp_matches(t, '(?i)^\\s*{_ORDINAL}\\s*[.\\-–—]') THEN 'transitory_item'
    WHEN dated THEN 'article_body' WHEN length(t) BETWEEN 5 AND 300 AND capitals >= 0.6 AND regexp_matches(t, '(?i)(?:^|[^\\wáéíóúñÁÉÍÓÚÑ])(?:ley|decreto|reglamento|c[óÓ]digo|estatuto|acuerdo|norma|constituci[óÓ]n|presupuesto|lineamientos?)(?:[^\\wáéíóúñÁÉÍÓÚÑ]|$)') THEN 'document_title'
    WHEN regexp_matches(t, '(?i)^\\s*art[iíÍ]culo\\s+\\d+[\\s\\wáéíóúñ]*[.\\-–—]') AND NOT regexp_matches(t, '(?i){_INLINE}') THEN 'article_heading'
    WHEN regexp_matches(t, '(?i)^\\s*libro\\s+[IVXLCDM\\d]+') THEN 'book_heading' WHEN regexp_matches(t, '(?i)^\\s*t[iíÍ]tulo\\s+[IVXLCDM\\d]+') THEN 'title_heading' WHEN regexp_matches(t, '(?i)^\\s*cap[iíÍ]tulo\\s+[IVXLCDM\\d]+') THEN 'chapter_heading'
    WHEN regexp_matches(t, '(?i)^\\s*secci[oóÓ]n\\s+[IVXLCDM\\d]+') THEN 'section_heading' WHEN regexp_matches(t, '(?i)^\\s*anexo\\s+[IVXLCDM\\d]+') THEN 'annex_heading' WHEN regexp_matches(t, '^\\s*[IVXLCDM]+\\s*[.\\-–—]') THEN 'fraction' WHEN regexp_matches(t, '^\\s*[a-z]\\)\\s') THEN 'inciso'
    WHEN length(t) > 30 THEN 'article_body' ELSE 'unknown' END AS label FROM signs""")
def block_labels(spark: SparkSession, d: str) -> DataFrame:
    return ops.labelled(_blocks(spark, d)).select("doc_id", "page_number", "block_no", "kind", "label")


def _bold(spark: SparkSession, d: str) -> DataFrame:
    spans = ops.distinct_spans(table(spark, d, "extracted_spans"))
    return spans.where("is_bold").select("doc_id", "page_number", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


_COVER = "greatest(0.0, least(b.x1, o.x1) - greatest(b.x0, o.x0)) * greatest(0.0, least(b.y1, o.y1) - greatest(b.y0, o.y0))"


@query(f"""
    WITH {_SPANS}, bold AS (SELECT doc_id, page_number, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM spans WHERE is_bold)
    SELECT doc_id, page_number, block_no FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM bold o WHERE o.doc_id = b.doc_id AND o.page_number = b.page_number
        AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {_COVER} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.5)
""")
def bbox_overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    return ops.uncovered(_blocks(spark, d), _bold(spark, d)).select("doc_id", "page_number", "block_no")


@query(f"""
    WITH {_SPANS}, bold AS (SELECT doc_id, page_number, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM spans WHERE is_bold)
    SELECT doc_id, page_number, block_no FROM blocks b WHERE EXISTS (SELECT 1 FROM bold o WHERE o.doc_id = b.doc_id AND o.page_number = b.page_number AND (
        ((b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {_COVER} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.3) OR ((o.x1 - o.x0) * (o.y1 - o.y0) > 0 AND {_COVER} / ((o.x1 - o.x0) * (o.y1 - o.y0)) >= 0.3)))
""")
def bbox_overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    return ops.touching(_blocks(spark, d), _bold(spark, d)).select("doc_id", "page_number", "block_no")


@query()
def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "extracted_spans")
    return ops.merged(ops.kinds(ops.reading_order(ops.blocks(spans))), ops.font_sizes(spans)).drop("source_blocks")


@query(f"""
    WITH {_SPANS}, bold AS (SELECT doc_id, page_number, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM spans WHERE is_bold)
    SELECT doc_id, page_number, block_no, EXISTS (SELECT 1 FROM bold o WHERE o.doc_id = b.doc_id AND o.page_number = b.page_number
        AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {_COVER} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.3) AS inside FROM blocks b
""")
def blocks_in_frames(spark: SparkSession, d: str) -> DataFrame:
    return ops.inside_frames(_blocks(spark, d), _bold(spark, d)).select("doc_id", "page_number", "block_no", "inside")


@query(f"""
    WITH {_SPANS}, o AS (SELECT doc_id, page_number, block_no, y1 AS gap_top, lead(y0) OVER w AS gap_bottom, lead(block_no) OVER w AS next_no FROM blocks
        WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY floor(y0 / 5) * 5 NULLS FIRST, x0 NULLS FIRST, block_no)),
    bold AS (SELECT doc_id, page_number, bbox.y0 AS y0, bbox.y1 AS y1 FROM spans WHERE is_bold)
    SELECT doc_id, page_number, block_no, next_no FROM o WHERE gap_bottom IS NOT NULL AND EXISTS (SELECT 1 FROM bold t WHERE t.doc_id = o.doc_id AND t.page_number = o.page_number AND t.y0 < o.gap_bottom AND t.y1 > o.gap_top)
""")
def blocks_parted_by_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring blocks with a box between them; bold spans stand for the boxes."""
    return ops.parted(ops.reading_order(_blocks(spark, d)), _bold(spark, d))


@query(f"""
    WITH {_SPANS}, bold AS (SELECT doc_id, page_number, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM spans WHERE is_bold),
    cut AS (SELECT doc_id, page_number, block_no, EXISTS (SELECT 1 FROM bold o WHERE o.doc_id = b.doc_id AND o.page_number = b.page_number AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {_COVER} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.5) AS gone FROM blocks b),
    t AS (SELECT doc_id, page_number, count(*) AS boxes FROM bold GROUP BY 1, 2)
    SELECT doc_id, page_number, count(*) AS blocks, count(*) FILTER (gone) AS excluded, count(*) FILTER (NOT gone) AS kept, coalesce(max(boxes), 0) AS boxes FROM cut LEFT JOIN t USING (doc_id, page_number) GROUP BY 1, 2
""")
def page_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import extraction

    return extraction.diagnostics(_blocks(spark, d), _bold(spark, d))


@query(f"""
    WITH {_SPANS}, pg AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_number) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_no) AS n FROM blocks WHERE doc_id IS NOT NULL AND page_number IS NOT NULL)
    SELECT doc_id, CAST(n AS INT) AS ord, coalesce(md5(string_agg(text, chr(10) ORDER BY o)), md5('')) AS around FROM (
        SELECT a.doc_id, a.n, b.text, b.n AS o FROM pg a LEFT JOIN pg b ON a.doc_id = b.doc_id AND b.n <> a.n AND b.n BETWEEN a.n - 2 AND a.n + 2) GROUP BY 1, 2
""")
def block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The two blocks before and after each block, as a model would be asked with."""
    from ..operators import structure

    rows = structure.numbered(_blocks(spark, d).where("doc_id IS NOT NULL AND page_number IS NOT NULL"), ["block_no"])
    got = ops.with_neighbours(rows)
    return got.select("doc_id", "ord", F.md5(F.array_join(F.concat("context_before", "context_after"), "\n")).alias("around"))
