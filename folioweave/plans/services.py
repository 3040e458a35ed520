"""Queries over legends, prompts and answers of models, heading refinement, adapters and the run log.

Where the tables hold no case at all, a few planted rows stand beside the whole table, the same in both languages.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal, models, providers
from ..operators import extraction, headings, index, layout, metadata, structure
from ..operators import tables as table_ops
from ..streaming import indexing
from ..tables import norm_key, table
from .index import _CHUNKS, _NEWEST, _RUNS, _docs, _one, _runs
from .layout import _COVER, _SPANS, _blocks, _bold
from .lines import _LINES, _lines
from .registry import query
from .structure import _PROJECT, chunk_tree

_W = "[\\s\\p{Z}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _squeeze(c: str) -> str:
    return _trim(f"regexp_replace(coalesce({c}, ''), '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g')")


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_LEGENDS = [
    ("planted-1", 1, "Nueva Ley publicada en el Diario Oficial de la Federación el 1 de abril de 2013\nTEXTO VIGENTE\nÚltimas reformas publicadas DOF 12-11-2020"),
    ("planted-1", 2, "Última reforma publicada DOF 01-04-2024\nTEXTO VIGENTE"),
    ("planted-2", 1, "Cantidades actualizadas por resolución fiscal DOF 27-12-2023\nÚltima reforma DOF 31-02-2020"),
    ("planted-2", 9, "Última reforma publicada DOF 05-05-2021"),
]
_MONTH_NO = " ".join(f"WHEN '{m}' THEN '{i:02}'" for i, m in enumerate(legal.MONTHS, 1))


@query(f"""
    WITH p AS (SELECT doc_id, page_number, max(text) AS text FROM (SELECT doc_id, page_number, text FROM page_content UNION ALL SELECT * FROM (VALUES {_values(_LEGENDS)}) v(doc_id, page_number, text)) WHERE doc_id IS NOT NULL AND page_number BETWEEN 1 AND 8 GROUP BY 1, 2),
    h AS (SELECT doc_id, substring(string_agg(coalesce(text, ''), chr(10) ORDER BY page_number), 1, 8000) AS t FROM p GROUP BY 1),
    l AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS n, {_trim("unnest(a)")} AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM h)),
    k AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)(?:[úÚ]ltima|ultima)s?{_W}+reformas?{_W}+(?:publicadas?{_W}+)?dof{_W}+(\\d{{2}})-(\\d{{2}})-(\\d{{4}})') THEN 'ultima' WHEN regexp_matches(line, '(?i)nueva{_W}+ley{_W}+publicada{_W}+en{_W}+el{_W}+diario{_W}+oficial') THEN 'nueva'
        WHEN regexp_matches(line, '(?i)\\btexto{_W}+vigente\\b') THEN 'vigente' WHEN regexp_matches(line, '(?i)cantidades{_W}+actualizadas{_W}+por{_W}+[^.]*dof{_W}+\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN 'cantidades' END AS kind FROM l WHERE length(line) >= 10),
    d AS (SELECT *, CASE WHEN kind IN ('ultima', 'cantidades') THEN try_strptime(regexp_extract(line, '(\\d{{2}}-\\d{{2}}-\\d{{4}})', 1), '%d-%m-%Y')::DATE
        WHEN kind = 'nueva' THEN try_strptime(regexp_extract(line, '(\\d{{4}})', 1) || '-' || (CASE lower(regexp_extract(line, '(?i)\\d{{1,2}} de ([a-z]+) de', 1)) {_MONTH_NO} END) || '-' || lpad(regexp_extract(line, '(\\d{{1,2}}) de ', 1), 2, '0'), '%Y-%m-%d')::DATE END AS day FROM k WHERE kind IS NOT NULL)
    SELECT doc_id, max(CASE WHEN kind = 'nueva' AND f = 1 THEN day END)::VARCHAR AS publication_date, max(CASE WHEN kind = 'ultima' AND f = 1 THEN day END)::VARCHAR AS last_reform_date, CAST(count(DISTINCT kind) AS INT) AS kinds
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC) AS f FROM d WHERE kind = 'vigente' OR day IS NOT NULL) GROUP BY 1
""")
def legal_legends(spark: SparkSession, d: str) -> DataFrame:
    """Legends in the first 8000 characters of the first eight pages of each document."""
    planted = spark.createDataFrame(_LEGENDS, "doc_id string, page_number int, text string")
    pages = table(spark, d, "page_content").select("doc_id", "page_number", "text").unionByName(planted)
    got = metadata.legal_legend(metadata.first_pages(pages), "doc_id", "text")
    return got.select("doc_id", F.col("publication_date").cast("string").alias("publication_date"), F.col("last_reform_date").cast("string").alias("last_reform_date"), "kinds")


_SUSPECTS = [("planted-1", "considera que la autoridad"), ("planted-2", "casos, se estará a lo dispuesto"), ("planted-3", "De esta Ley y su reglamento"), ("planted-4", "Disposiciones generales")]
_VERBS = "considera|consider[óÓ]|consideran|deber[áÁ]n?|podr[áÁ]n?|tendr[áÁ]n?|habr[áÁ]n?|resultan?|establecen?|determinan?|disponen?|autorizan?|ordenan?|precisan?|se[ñÑ]alan?|definen?|otorgan?|fundamento"
_SUSPICIOUS = f"regexp_matches(h, '(?i)^(?:{_VERBS}){_W}+') OR regexp_matches(h, '(?i)^casos,{_W}*se{_W}|^(?:de esta ley|de la presente ley|de este c[oóÓ]digo)(?:[^\\wáéíóúüñÁÉÍÓÚÜÑ]|$)')"


@query(f"WITH {_CHUNKS}, u AS (SELECT id, {_trim('coalesce(heading, chr(32))')} AS h FROM (SELECT id, heading FROM chunks UNION ALL SELECT * FROM (VALUES {_values(_SUSPECTS)}) v(id, heading))) SELECT id FROM u WHERE {_SUSPICIOUS}")
def suspicious_headings(spark: SparkSession, d: str) -> DataFrame:
    planted = spark.createDataFrame(_SUSPECTS, "id string, heading string")
    return _one(spark, d).select("id", "heading").unionByName(planted).where(metadata.suspicious_heading(F.col("heading"))).select("id")


def _by_length(prompts: list[str]) -> list[str]:
    """A stand-in for a model: a heading of more than 30 characters is running text."""
    return [json.dumps({"isSectionTitle": len(p.split('heading: "', 1)[1].split('"\n', 1)[0]) <= 30}) for p in prompts]


def _judged(spark: SparkSession, d: str) -> DataFrame:
    titles = _docs(spark, d).select(F.col("id").alias("documentId"), "title")
    rows = _one(spark, d, "text").withColumn("chunkType", norm_key(F.coalesce("chunkType", F.lit("generic")))).join(titles, "documentId", "left")
    return headings.judged(rows.withColumn("head", F.lit("")), _by_length, refine_all=True)


_JUDGED = f"""{_CHUNKS}, {_NEWEST}, g AS (SELECT c.id, c.documentId, c.heading, d.title, {_trim("coalesce(c.heading, '')")} AS h, c.type, {_trim("coalesce(c.articleRef, '')")} AS ref FROM chunks c LEFT JOIN docs d ON d.id = c.documentId),
    j AS (SELECT *, CASE WHEN type <> 'generic' THEN 'not_generic' WHEN ref <> '' THEN 'has_article_ref' WHEN h = '' THEN 'empty_heading' WHEN length(substring({_squeeze('heading')}, 1, 400)) <= 30 THEN 'section_title' ELSE 'body' END AS outcome FROM g),
    jn AS (SELECT *, CASE WHEN outcome = 'body' THEN nullif(substring({_trim("regexp_replace(" + _trim("coalesce(title, '')") + ", '" + _W + "*\\([^)]*\\)" + _W + "*$', '')")}, 1, 255), '') END AS law FROM j)"""


@query(f"""WITH {_JUDGED} SELECT documentId, count(*) FILTER (outcome IN ('section_title', 'body')) AS evaluated, count(*) FILTER (outcome = 'body' AND law IS NOT NULL AND law <> h) AS changed_to_law, count(*) FILTER (outcome = 'section_title') AS verdict_section_title,
    count(*) FILTER (outcome = 'body') AS verdict_body, count(*) FILTER (outcome = 'not_generic') AS skipped_not_generic, count(*) FILTER (outcome = 'has_article_ref') AS skipped_has_article_ref, count(*) FILTER (outcome = 'empty_heading') AS skipped_empty_heading FROM jn GROUP BY 1""")
def heading_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d)
    law = F.nullif(legal.law_name(F.col("title")), F.lit(""))
    got = headings.counters(rows, ["documentId"]).drop("changed", "model_invocations", "verdict_none", "skipped_not_suspicious")
    to_law = rows.where((F.col("outcome") == "body") & law.isNotNull() & (F.col("new_heading") == law)).groupBy("documentId").agg(F.count("*").alias("changed_to_law"))
    return got.join(to_law, "documentId", "left").fillna(0, ["changed_to_law"])


@query(f"WITH {_JUDGED} SELECT id, law AS new_heading FROM jn WHERE outcome = 'body' AND law IS NOT NULL AND law <> h")
def refined_headings(spark: SparkSession, d: str) -> DataFrame:
    """New headings by the law's name for generic chunks whose heading the stand-in model calls running text."""
    rows = _judged(spark, d)
    return rows.where("new_heading IS NOT NULL").where(F.nullif(legal.law_name(F.col("title")), F.lit("")).isNotNull()).select("id", "new_heading")


@query(f"WITH {_JUDGED} SELECT documentId, count(*) AS chunks, count(DISTINCT CASE WHEN outcome = 'body' AND law IS NOT NULL AND law <> h THEN law ELSE heading END) AS headings FROM jn WHERE NOT (outcome = 'body' AND law IS NULL) GROUP BY 1")
def headings_after_refinement(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table with refined headings put in its place (the backfill's update)."""
    rows = _judged(spark, d)
    rows = rows.where(~((F.col("outcome") == "body") & F.nullif(legal.law_name(F.col("title")), F.lit("")).isNull()))
    chunks = rows.select("id", "documentId", "heading")
    return headings.applied(chunks, rows).groupBy("documentId").agg(F.count("*").alias("chunks"), F.count_distinct("heading").alias("headings"))


@query(f"""WITH {_CHUNKS}, {_NEWEST}, h AS (SELECT documentId, chunkNo, {_squeeze('heading')} AS h FROM chunks WHERE chunkNo <= 40), f AS (SELECT * FROM h WHERE h <> '' QUALIFY row_number() OVER (PARTITION BY documentId, lower(h) ORDER BY chunkNo) = 1),
    a AS (SELECT documentId, string_agg(h, ' | ' ORDER BY chunkNo) AS text FROM f GROUP BY 1) SELECT id, 'Titulo: ' || {_squeeze('title')} || chr(10) || 'Encabezados: ' || coalesce(text, 'Sin encabezados disponibles') AS prompt FROM docs LEFT JOIN a ON documentId = id""")
def doc_type_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked about each document: its title and the headings among its first 40 chunks."""
    rows = _one(spark, d).where(F.col("chunkNo") <= models.MOST_HEADINGS).groupBy("documentId")
    per = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunkNo", F.coalesce("heading", F.lit("")).alias("h")))), lambda x: x["h"]).alias("headings"))
    got = _docs(spark, d).select("id", "title").join(per.withColumnRenamed("documentId", "id"), "id", "left")
    return got.select("id", models.doc_type_prompt(F.col("title"), F.coalesce("headings", F.array().cast("array<string>"))).alias("prompt"))


@query(f"""WITH {_SPANS} SELECT doc_id, page_number, block_no, md5('bloque: "' || substring({_squeeze('text')}, 1, 400) || '"' || chr(10) || 'kind: text' || chr(10) || CASE WHEN y0 < 100 THEN 'zona: top' || chr(10) WHEN y1 > 750 THEN 'zona: bottom' || chr(10) ELSE 'zona: middle' || chr(10) END
    || 'possible_index_zone: false' || chr(10) || 'source: pymupdf_text' || chr(10) || 'merged: false') AS prompt_md5 FROM blocks""")
def block_prompts(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    prompt = models.block_prompt(F.col("text"), F.lit("text"), F.col("y0"), F.col("y1"), F.lit(False), F.lit("pymupdf_text"), F.lit(False), none, none)
    return _blocks(spark, d).select("doc_id", "page_number", "block_no", F.md5(prompt).alias("prompt_md5"))


_ANSWERS = [
    (1, 'Claro: {"label": "article_heading", "confidence": 0.9, "reason": "abre"} fin', "article_heading", None, None, None, None),
    (2, '{"label": "nada", "confidence": 0.9}', None, None, None, None, None),
    (3, '{"kind": "Editorial_Note", "confidence": "ALTA", "reasonCode": "fe"}', None, "editorial_note", None, None, None),
    (4, '{"kind": "structural", "confidence": "mucha"}', None, None, None, None, None),
    (5, '{"isStructural": false, "confidence": "media"}', None, None, "false", None, None),
    (6, '{"isStructural": "false", "confidence": "media"}', None, None, None, None, None),
    (7, '{"docType": "Codigo", "confidence": "baja"}', None, None, None, "codigo", None),
    (8, '{"isSectionTitle": true}', None, None, None, None, "true"),
    (9, "no sé {", None, None, None, None, None),
    (10, None, None, None, None, None, None),
]


@query(f"SELECT * FROM (VALUES {_values([(r[0], *r[2:]) for r in _ANSWERS])}) v(i, label, kind, structural, doc_type, section_title)")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Which answers of models hold, on planted answers."""
    rows, a = spark.createDataFrame([r[:2] for r in _ANSWERS], "i int, answer string"), F.col("answer")
    return rows.select(
        "i", models.block_answer(a, providers.LABELS)["label"].alias("label"), models.arbiter_answer(a)["kind"].alias("kind"), models.heading_answer(a)["structural"].cast("string").alias("structural"),
        models.doc_type_answer(a, providers.DOC_TYPES)["doc_type"].alias("doc_type"), models.section_title_answer(a).cast("string").alias("section_title"),
    )


_FIRST = "'(?i)(?:aclaraci[oóÓ]n|nota\\s*de\\s+erratas|fe\\s+de\\s+erratas|N\\.\\s*de\\s+E\\.|nota\\s+del\\s+editor|nota\\s*:\\s|art[íiÍ]culo\\s+(?:reformad[oa]|adicionad[oa]|derogad[oa])|nota\\s+aclaratoria|correcci[oóÓ]n|aviso|nota\\s+editorial)'"
_ROUTED = f"""{_SPANS}, bold AS (SELECT doc_id, page_number, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM spans WHERE is_bold),
    b AS (SELECT *, EXISTS (SELECT 1 FROM bold o WHERE o.doc_id = b.doc_id AND o.page_number = b.page_number AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {_COVER} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.3) AS inside,
        len(list_filter(string_split({_squeeze('text')}, ' '), lambda x: x <> '')) AS words, greatest(len(regexp_extract_all(text, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}')), len(regexp_extract_all(text, '(?i)(?:DOF|diario\\s+oficial|publicad[ao]|vigente|vigor)\\s'))) AS dates FROM blocks b),
    r AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, {_FIRST}) THEN 'deterministic_editorial' WHEN regexp_matches(text, '(?i)^(?:art[íiÍ]culo\\s+\\d|cap[íiÍ]tulo\\s+[IVX\\d]|t[íiÍ]tulo\\s+[IVX\\d]|secci[oóÓ]n\\s+[IVX\\d]|libro\\s+[IVX\\d]|regla\\s+\\d|transitorios?)(?:[^\\wáéíóúüñÁÉÍÓÚÜÑ]|$)') THEN 'deterministic_structural'
        WHEN inside AND (dates >= 2 OR words >= 15) THEN 'deterministic_editorial' WHEN inside AND words >= 10 THEN 'llm_fallback' WHEN words >= 20 THEN 'llm_fallback' ELSE 'deterministic_structural' END AS decision FROM b)"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.inside_frames(_blocks(spark, d), _bold(spark, d))
    verdict = providers.routed_verdict(F.col("text"), F.col("inside"), F.lit(1), F.size(F.split("text", "\n")))
    return rows.withColumn("v", verdict).select("doc_id", "page_number", "block_no", "v.kind", "v.decision")


@query(f"WITH {_ROUTED} SELECT doc_id, page_number, block_no, CASE WHEN decision = 'deterministic_editorial' THEN 'editorial_note' ELSE 'structural' END AS kind, decision FROM r")
def boxed_note_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as candidates for boxed notes, bold spans standing for the frames; without a model ambiguous ones stay structural."""
    return _routed(spark, d)


@query(f"WITH {_ROUTED} SELECT doc_id, count(*) AS total_blocks, {', '.join(f'count(*) FILTER (decision = {chr(39)}{x}{chr(39)}) AS {x}' for x in providers.DECISIONS)} FROM r GROUP BY 1")
def arbiter_summary(spark: SparkSession, d: str) -> DataFrame:
    return providers.arbiter_summary(_routed(spark, d), ["doc_id"])


@query(f"""WITH {_PROJECT}, k AS (SELECT * FROM made JOIN pages USING (doc_id, ord) WHERE chunk_type IS NOT NULL AND (text <> '' OR chunk_type IN ('table', 'boxed_note')))
    SELECT doc_id, CAST(row_number() OVER w AS INT) AS chunk_no, chunk_type, article_ref, coalesce(heading, '') AS heading, md5(text) AS text_md5, coalesce(page_start, 1) AS start_page, coalesce(page_end, page_start, 1) AS end_page, chunk_type = 'table' AS has_table,
        CASE WHEN chunk_type = 'table' THEN CAST(sum(CASE WHEN chunk_type = 'table' THEN 1 ELSE 0 END) OVER w AS INT) END AS table_index FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)""")
def legacy_chunks(spark: SparkSession, d: str) -> DataFrame:
    got = index.legacy_chunks(structure.projected(chunk_tree(spark, d, with_text=True)))
    return got.withColumn("text_md5", F.md5("text")).drop("text")


@query(f"WITH {_CHUNKS} SELECT id, documentId, CAST(row_number() OVER (PARTITION BY documentId ORDER BY startPage NULLS FIRST, type = 'table', chunkNo NULLS FIRST, id) AS INT) AS place FROM chunks")
def chunks_in_page_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d).select("id", "documentId", "chunkNo", "startPage", norm_key(F.coalesce("chunkType", F.lit("generic"))).alias("type"))
    return index.in_page_order(rows.where("type <> 'table'"), rows.where("type = 'table'")).select("id", "documentId", "place")


_REQUESTS = [("550e8400-e29b-41d4-a716-446655440000", "fiscal/ley.pdf"), ("550e8400", "x.pdf"), ("550e8400-e29b-41d4-a716-446655440001", "  "), (None, "x")]


@query(f"""WITH {_NEWEST}, u AS (SELECT id, title FROM docs UNION ALL SELECT * FROM (VALUES {_values(_REQUESTS)}) v(id, title))
    SELECT id, title, CASE WHEN NOT coalesce(regexp_matches(id, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$'), false) THEN 'id is no UUID' WHEN {_trim("coalesce(title, '')")} = '' THEN 'title is empty' END AS error FROM u""")
def request_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("id", "title").unionByName(spark.createDataFrame(_REQUESTS, "id string, title string"))
    return index.valid_requests(rows, ["id"], ["title"])


@query(f"WITH {_RUNS} SELECT CASE WHEN starts_with(error, 'PDFExtractionError') THEN 'pdf_extraction' WHEN starts_with(error, 'EmbeddingError') THEN 'embeddings' ELSE 'unknown' END AS stage, count(*) AS runs FROM runs WHERE error IS NOT NULL GROUP BY 1")
def failed_stages(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("error IS NOT NULL").groupBy(index.failed_stage(F.col("error")).alias("stage")).agg(F.count("*").alias("runs"))


@query(f"""WITH {_RUNS} SELECT id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN TIMESTAMP '2030-01-01 00:00:00' ELSE endedAt END AS endedAt, docsIndexed, CASE WHEN hit THEN 'timeout' ELSE error END AS error
    FROM (SELECT *, coalesce(lower(trim(status)) = 'processing', false) AS hit FROM runs)""")
def updated_runs(spark: SparkSession, d: str) -> DataFrame:
    """The run log after all open runs are failed: given fields win, and every change ends the run."""
    runs = _runs(spark, d).select("id", "status", "endedAt", "docsIndexed", "error")
    changes = runs.where(F.lower(F.trim("status")) == "processing").select("id", F.lit("failed").alias("status"), F.lit("timeout").alias("error"))
    return indexing.updated_runs(runs, changes, F.expr("TIMESTAMP_NTZ '2030-01-01 00:00:00'"))


@query(f"""WITH {_SPANS}, d AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM blocks) SELECT doc_id, page_number, block_no, w >= 50 AND h >= 20 AS frame, w >= 100 AND h >= 30 AND block_no % 2 = 0 AND spans >= 4 AS rect, w >= 100 AND h >= 30 AND spans >= 4 AS relaxed_rect FROM d""")
def drawn_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames and rectangles among drawings; the boxes of blocks stand for the drawings, even ones stroked, with a line for each span."""
    drawings = _blocks(spark, d).select("doc_id", "page_number", "block_no", *extraction.BOX, F.when(F.col("block_no") % 2 == 0, "black").alias("color"), F.array_repeat(F.lit("l"), F.col("spans").cast("int")).alias("items"))
    keys = ["doc_id", "page_number", "block_no"]
    mark = lambda df, name: df.select(*keys, F.lit(True).alias(name))
    got = drawings.select(*keys)
    for name, df in (("frame", extraction.visual_frames(drawings)), ("rect", extraction.visual_rects(drawings)), ("relaxed_rect", extraction.visual_rects(drawings, relaxed=True))):
        got = got.join(mark(df, name), keys, "left")
    return got.fillna(False, ["frame", "rect", "relaxed_rect"])


@query(f"WITH {_SPANS} SELECT span_id, coalesce(is_bold, false) AS is_bold, coalesce(is_italic, false) AS is_italic FROM spans")
def span_styles(spark: SparkSession, d: str) -> DataFrame:
    """Styles read back from the flags a PDF library would give."""
    spans = layout.distinct_spans(table(spark, d, "extracted_spans"))
    bit = lambda c, n: F.when(F.col(c), n).otherwise(0)
    return extraction.styled(spans.select("span_id", (bit("is_bold", 16) + bit("is_italic", 2) + 4).alias("flags"))).select("span_id", "is_bold", "is_italic")


_GRID = f"""{_CHUNKS}, t AS (SELECT id, documentId, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(x, '^\\s*\\|[\\s|:\\-]+\\|\\s*$')) AS lines FROM chunks WHERE contains(text, '|')),
    g AS (SELECT id, documentId, list_transform(lines, lambda x: list_transform(string_split(regexp_replace(trim(x), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(c))) AS rows FROM t)"""


@query(f"WITH {_GRID} SELECT id, CAST(len(rows) AS INT) AS row_count, CAST(coalesce(list_max(list_transform(rows, lambda x: len(x))), 0) AS INT) AS col_count FROM g")
def candidate_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "text").where(F.col("text").contains("|")).select("id", table_ops.from_markdown(F.col("text")).alias("rows"))
    return extraction.candidate_tables(rows).select("id", "row_count", "col_count")


@query(f"""WITH {_GRID}, c AS (SELECT id, rows, len(rows) AS n, len(list_filter(rows, lambda r: len(list_filter(r, lambda c: c <> '')) > 0)) AS filled, coalesce(list_max(list_transform(rows, lambda x: len(x))), 0) AS cols, list_filter(flatten(rows), lambda c: c <> '') AS cells FROM g),
    f AS (SELECT *, CASE WHEN len(cells) > 0 THEN len(list_filter(cells, lambda c: regexp_matches(c, '\\d'))) / len(cells) ELSE 0 END AS num, CASE WHEN len(cells) > 0 THEN list_sum(list_transform(cells, lambda c: length(c))) / len(cells) ELSE 0 END AS avg_len,
        lower(array_to_string(rows[1], ' ')) AS head, array_to_string(cells, ' ') AS joined FROM c),
    v AS (SELECT *, n >= 2 AND (regexp_matches(coalesce(head, ''), 'cuota|rango|superior|inferior|l[ií]mite') OR len(cells) > 0 AND num >= 0.4 AND n >= 3) AS tariff FROM f)
    SELECT id, CASE WHEN tariff THEN 'tariff' WHEN filled > 0 AND cols <= 2 AND joined <> '' AND (regexp_matches(joined, '(?i)aclaraci[oóÓ]n|nota\\s*de\\s+erratas|fe\\s+de\\s+erratas|N\\.\\s*de\\s+E\\.|nota\\s+del\\s+editor|nota\\s*:\\s|art[íiÍ]culo\\s+(?:reformad[oa]|adicionad[oa]|derogad[oa])')
        OR cols = 1 AND length(joined) > 100 AND filled <= 5 AND len(string_split({_squeeze('joined')}, ' ')) >= 10) THEN 'note'
        WHEN filled = 0 OR filled <= 2 AND cols >= 8 OR len(cells) > 0 AND (cols >= 6 AND avg_len < 15 AND num < 0.35 OR cols BETWEEN 4 AND 5 AND avg_len < 10 AND num < 0.25) THEN 'prose' ELSE 'table' END AS verdict FROM v""")
def table_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _one(spark, d, "text").where(F.col("text").contains("|")).select("id", table_ops.from_markdown(F.col("text")).alias("rows"))
    return table_ops.judged(rows).select("id", "verdict")


@query()
def merged_page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of bold spans and of blocks that overlap them, merged page by page."""
    return extraction.exclude_boxes(_bold(spark, d), _blocks(spark, d).select("doc_id", "page_number", *extraction.BOX))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, page_number, regexp_replace(trim(line), '{_W}+', ' ', 'g') AS key, line FROM lines), c AS (SELECT doc_id, key, count(*) AS lines FROM k WHERE length(key) <= 250 AND key <> '' AND (regexp_matches(trim(line), '^[A-ZÁÉÍÓÚÑ\\d\\s(),.\\-]{{8,250}}$')
    OR regexp_matches(key, '(?i)c[áÁ]mara de diputados|secretar[íÍ]a general|secretar[íÍ]a de servicios parlamentarios|[úÚ]ltima reforma dof \\d{{2}}-\\d{{2}}-\\d{{4}}') OR regexp_matches(key, '^\\d+ de \\d+$') OR regexp_matches(key, '(?i)^p[áÁ]gina \\d+')) GROUP BY 1, 2) SELECT * FROM c WHERE lines >= 3""")
def repeated_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header candidates that stand in a document at least three times."""
    from ..operators import lines as line_ops

    return line_ops.repeated_headers(_lines(spark, d), 3)


_CUT_120 = "CASE WHEN length({0}) <= 120 THEN {0} ELSE CASE WHEN regexp_extract(substring({0}, 1, 120), '(?s)^(.*\\S)\\s+\\S*$', 1) <> '' THEN regexp_extract(substring({0}, 1, 120), '(?s)^(.*\\S)\\s+\\S*$', 1) ELSE substring({0}, 1, 120) END || '…' END"


@query(f"""WITH {_CHUNKS}, {_NEWEST}, g AS (SELECT c.id, coalesce(c.text, '') AS text, d.title, {_trim("regexp_replace(" + _trim("coalesce(d.title, '')") + ", '" + _W + "*\\([^)]*\\)" + _W + "*$', '')")} AS law,
        contains(lower(coalesce(d.title, '')), 'decreto') AND NOT regexp_matches(lower(coalesce(d.title, '')), 'reglamento|código|codigo|presupuesto') AS decree FROM chunks c LEFT JOIN docs d ON d.id = c.documentId WHERE c.type = 'generic'),
    l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '' AND NOT (decree AND regexp_matches(x, '(?i)^\\(?\\s*edici[oóÓ]n\\s+vespertina\\s*\\)?\\s*$|^diario\\s+oficial\\b|^poder\\s+ejecutivo\\s*$'))) AS lines FROM g),
    f AS (SELECT *, list_filter(lines, lambda x: NOT regexp_matches(x, '(?i)^(?:{_VERBS}){_W}+'))[1] AS first, nullif(substring(law, 1, 255), '') AS name, regexp_extract(text, '(?is)decreto\\s+por\\s+el\\s+que\\s+.*?\\.', 0) AS rubric FROM l)
    SELECT id, coalesce(CASE WHEN decree AND rubric <> '' THEN substring({_squeeze('rubric')}, 1, 500) END, CASE WHEN decree AND length(first) >= 120 THEN coalesce(name, {_CUT_120.format('first')}) END, first, name, {_CUT_120.format('lines[1]')}, '') AS heading FROM f""")
def generic_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of generic chunks from their text and their document's title."""
    chunks = _one(spark, d, "text").where(norm_key(F.coalesce("chunkType", F.lit("generic"))) == "generic").select("id", "documentId", "text")
    titles = _docs(spark, d).select(F.col("id").alias("documentId"), "title")
    return chunks.join(titles, "documentId", "left").select("id", metadata.generic_heading(F.col("text"), F.col("title")).alias("heading"))
