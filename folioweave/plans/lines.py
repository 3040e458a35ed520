"""Queries over the lines of page_content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import legal
from ..operators import chunks as chunk_ops
from ..operators import lines as ops
from ..operators import normaliser
from ..tables import table
from .registry import query

_LINES = r"""
    pages AS (SELECT doc_id, page_number, max(text) AS text FROM page_content WHERE doc_id IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2),
    arrs AS (SELECT doc_id, page_number, string_split_regex(regexp_replace(text, '(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])\z', ''),
        '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a FROM pages WHERE text IS NOT NULL AND text <> ''),
    lines AS (SELECT doc_id, page_number, CAST(unnest(generate_series(1, len(a))) AS INT) AS line_no, unnest(a) AS line FROM arrs)
"""
_MONTHS = "|".join(legal.MONTHS)
_SIGNATURE = rf"""upper(trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '\b\d{{1,2}}\s*(?:de\s+)?(?:{_MONTHS})(?:\s*(?:de|del)\s*\d{{2,4}})?\b', '<<date>>', 'g'),
    '\b(?:folio|n[uú]m(?:ero)?|no\.)?\s*\d+\b', '<<num>>', 'g'), '\s+', ' ', 'g')))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return ops.explode_lines(ops.distinct_pages(table(spark, d, "page_content")))


@query(f"WITH {_LINES} SELECT * FROM lines")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


@query(f"""
    WITH {_LINES}, sig AS (SELECT doc_id, page_number, {_SIGNATURE} AS signature FROM lines),
    per AS (SELECT doc_id, signature, count(DISTINCT page_number) AS pages FROM sig WHERE signature <> '' GROUP BY 1, 2),
    tot AS (SELECT doc_id, count(DISTINCT page_number) AS total FROM lines GROUP BY 1)
    SELECT doc_id, signature, pages FROM per JOIN tot USING (doc_id) WHERE total >= 2 AND pages >= greatest(2, ceil(total * 0.4))
""")
def repeated_line_signatures(spark: SparkSession, d: str) -> DataFrame:
    return ops.repeated_signatures(_lines(spark, d))


@query(rf"""
    WITH {_LINES}, kept AS (SELECT *, trim(line) AS t FROM lines WHERE NOT regexp_matches(trim(line), '^\d+\s+de\s+\d+$') AND NOT regexp_matches(trim(line), '(?i)^p[áÁ]gina\s+\d+')),
    keyed AS (SELECT *, CASE WHEN length(t) <= 250 AND regexp_matches(t, '^[A-ZÁÉÍÓÚÑ\d\s(),.\-]{{8,250}}$|(?i)c[áÁ]mara de diputados|secretar[íÍ]a general|secretar[íÍ]a de servicios parlamentarios|[úÚ]ltima reforma dof \d{{2}}-\d{{2}}-\d{{4}}')
        AND NOT regexp_matches(line, '(?i)art[íiÍ]culo\s+(reformad[oa]|adicionad[oa]|derogad[oa])\s*\.?\s*DOF') THEN trim(regexp_replace(line, '\s+', ' ', 'g')) END AS key FROM kept)
    SELECT doc_id, page_number, line_no, line FROM keyed
    QUALIFY key IS NULL OR row_number() OVER (PARTITION BY doc_id, key ORDER BY page_number, line_no) = 1
""")
def header_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return ops.keep_first_headers(_lines(spark, d))


@query(rf"""
    WITH {_LINES}, pair AS (SELECT doc_id, page_number, line_no, trim(lag(line) OVER w) AS p, trim(line) AS n FROM lines WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no))
    SELECT doc_id, page_number, line_no, CASE WHEN coalesce(length(p), 0) = 0 OR length(n) = 0 THEN 0 ELSE
        CASE WHEN NOT regexp_matches(p, '[.?!;:]$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(p, '[,("'']$') THEN 1 ELSE 0 END
        + CASE WHEN regexp_matches(n, '^[a-záéíóúñü0-9]') THEN 1 ELSE 0 END + CASE WHEN length(n) > 20 THEN 1 ELSE 0 END
        - CASE WHEN regexp_matches(n, '^[^a-záéíóúñü]*$') AND regexp_matches(n, '[A-Z]') AND length(n) < 60 THEN 2 ELSE 0 END
        - CASE WHEN length(n) < 10 AND NOT regexp_matches(n, '[.,;:?!-]') THEN 2 ELSE 0 END
        - CASE WHEN regexp_matches(p, '[)\]]$') THEN 1 ELSE 0 END END AS score
    FROM pair
""")
def line_merge_score(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    return _lines(spark, d).select("doc_id", "page_number", "line_no", legal.merge_score(F.lag("line").over(w), F.col("line")).alias("score"))


@query(rf"""
    WITH {_LINES}, ruled AS (SELECT CASE
        WHEN regexp_matches(t, '(?i)^art[íiÍ]culo\s+(\d+[º°o]?(?:\.\s*Bis)?(?:\s*-\s*[A-Za-z0-9]+)*(?:[^\wáéíóúñ]|$)|(?:{legal.ORDINALS})(?:[^\wáéíóúñ]|$))') THEN 'articulo'
        WHEN regexp_matches(t, '(?i)^Art\.\s*\d+') THEN 'articulo_abbrev'
        WHEN regexp_matches(t, '(?i)^(cap[íÍ]tulo|t[íÍ]tulo|secci[óÓ]n)([^\wáéíóúñ]|$)') THEN 'titulo_capitulo_seccion'
        WHEN regexp_matches(t, '(?i)^(I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)\.\s*') THEN 'romanos'
        WHEN regexp_matches(t, '(?i)^[a-z]\)\s*(?:\.-|\.)?\s*') THEN 'inciso'
        WHEN regexp_matches(t, '^\d+\.\s+') THEN 'lista_numerica'
        WHEN regexp_matches(t, '(?i)^(fracci[óÓ]n|inciso)\s+') THEN 'fraccion_inciso'
        WHEN regexp_matches(t, '^\$\s*[\d,]+\.?\d*\s+.*\$\s*[\d,]+') OR regexp_matches(t, '^\d[\d,]*\.?\d*\s+[\d,]+\.?\d*\s+[\d,]+\.?\d*\s+[\d.]+') OR regexp_matches(t, '(?i)^\d[\d,]*\.?\d*\s+En adelante\s+[\d,]+\.?\d*\s+[\d.]+') THEN 'tabla_fila'
        WHEN regexp_matches(t, '(?i)(?:Reforma|derog[oóÓ]|adicion[oóÓ]|reformad[oa])\s+.*DOF|\d{{4}}\)\s+Reforma\s+DOF') THEN 'reform_note'
        WHEN regexp_matches(t, '(?i)^(?:ART[ÍIí]CULOS?\s+TRANSITORIOS?|TRANSITORIOS?|Transitorio)\s*$') THEN 'transitorios'
        WHEN regexp_matches(t, '(?i)^(PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[ÉÉé]PTIMO|OCTAVO|NOVENO|D[Éé]CIMO)\s*[\.\-]+') THEN 'transitorio_ordinal' END AS rule
        FROM (SELECT trim(line) AS t FROM lines))
    SELECT rule, count(*) AS lines FROM ruled WHERE rule IS NOT NULL GROUP BY 1
""")
def preserved_breaks(spark: SparkSession, d: str) -> DataFrame:
    got = _lines(spark, d).select(legal.preservation_rule(F.col("line")).alias("rule"))
    return got.where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("lines"))


@query(rf"WITH {_LINES} SELECT doc_id, page_number, line_no, line FROM lines WHERE regexp_matches(trim(line), '^\d+\s+de\s+\d+$') OR regexp_matches(trim(line), '(?i)^p[áÁ]gina\s+\d+')")
def removed_page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(legal.always_removed(F.col("line")))


_B = r"[\s\p{Z}\x{85}\x1c-\x1f]"
_END = r"(?:[^\wáéíóúüñÁÉÍÓÚÜÑ]|$)"


def _clean(c: str) -> str:
    return rf"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"


_BODY_START = (
    r"'(?i)^(?:con el |con la |con el factor |de este |de la presente |de la |de los |de las |de la ley |se considera|se se[ñÑ]alan|se refiere|partir del |partir de la |partir de los |partir de |del cap[íÍi]tulo |"
    r"del t[íÍi]tulo |del c[oóÓ]digo |primera del |segunda del |tercera del |cuarta del |quinta del |sexta del |s[eéÉ]ptima del |octava del |novena del |d[eéÉ]cima del |que incluye |incluye los art[íÍi]culos |"
    r", del |, de la |, de los |, de las |del T[íÍi]tulo |de esta Ley[,.]?\s*|de la presente Ley[,.]?\s*|de este C[oóÓ]digo[,.]?\s*|del\s)'"
)
_BODY_END = (
    r"'(?i)(?:denominaci[óÓ]n del|se[ñÑ]alad[oa]s? en el|referid[oa] en el|mencionad[oa] en el|indicad[oa] en el|establecid[oa] en el|previst[oa] en el|del cap[íÍi]tulo|del t[íÍi]tulo|del art[íÍi]culo|del libro|"
    r"de la secci[óÓo]n|permisibles\s+se[ñÑ]alad[oa]|establecidos|previstos|mencionados|referidos)'"
)
_NOTE = r"(?:reforma|derog[oóÓ]|adicion[oóÓ]|reformad[oa])\s+.*DOF"
_ORD = legal.ORDINALS.replace("[eé]", "[eéÉ]").replace("[uú]", "[uúÚ]")


def _unless_body(word: str, number: str) -> str:
    """SQL for a title or chapter that is no running text: its number holds, and nothing around it says otherwise."""
    head = rf"'(?i)^{word}{_B}+{number}'"
    rest = _clean(rf"regexp_replace(t, '(?i)^{word}{_B}+(?:[IVX]+|\d+[º°o]?)[.\s\p{{Z}}º°o\-]*', '')")
    return rf"""regexp_matches(t, {head}) AND NOT (regexp_matches({rest}, {_BODY_START}) OR regexp_matches(b, {_BODY_END}) OR regexp_matches(b, '(?i)(?:^|\W)(?:del|en el|de la|de los|de las|en la)\s*$')
        OR regexp_matches(b, '(?i)^(?:permisibles|establecidos|previstos|mencionados|referidos)\s*$') AND {rest} <> '' AND regexp_matches({rest}, '(?i)se[ñÑ]alad[oa] en el')
        OR {rest} = '' AND a <> '' AND (regexp_matches(a, {_BODY_START}) OR regexp_matches(a, '(?i)^del\s|^de esta Ley|^de la presente Ley')))"""


_NUM = rf"(?:[IVX]+{_END}|\d+[º°o]?)"
_ART_NUM = rf"\d+[º°o]?(?:\.\s*Bis)?(?:\s*-\s*[A-Za-z0-9]+)+|\d+[º°o]?(?:\.[\s\-]*[A-Za-z](?:[.\s]|$))|\d+[º°o]?(?:\.\s*Bis)?|(?:{_ORD})|[IVXLCDM]+{_END}"
_TYPED = rf"""{_LINES},
    ls AS (SELECT doc_id, page_number, line_no, line, {_clean('line')} AS s FROM lines),
    sp AS (SELECT doc_id, page_number, line_no, CASE WHEN length(s) >= 30 AND regexp_matches(s, '(?i)(?:reformad[oa]|adicionad[oa]|derogad[oa]|Reforma)\s*.*DOF') AND regexp_matches(s, '(?i)^.{{21,}}?{_B}+art[íÍi]culo{_B}+\d') THEN [regexp_extract(s, '(?i)^(.{{21,}}?){_B}+(art[íÍi]culo{_B}+\d.*)$', 1), regexp_extract(s, '(?i)^(.{{21,}}?){_B}+(art[íÍi]culo{_B}+\d.*)$', 2)]
        WHEN regexp_matches(s, '(?i)^(?:(?:art[íÍi]culos?{_B}+)?transitorios?){_B}+art[íÍi]culo{_B}') THEN [regexp_extract(s, '(?i)^((?:art[íÍi]culos?{_B}+)?transitorios?){_B}+(art[íÍi]culo{_B}+.*)$', 1), regexp_extract(s, '(?i)^((?:art[íÍi]culos?{_B}+)?transitorios?){_B}+(art[íÍi]culo{_B}+.*)$', 2)] ELSE [line] END AS parts FROM ls),
    sl AS (SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no, k) AS INT) AS line_no, line FROM (SELECT doc_id, page_number, line_no, unnest(generate_series(1, len(parts))) AS k, unnest(parts) AS line FROM sp)),
    ct AS (SELECT *, {_clean('line')} AS t FROM sl),
    ed AS (SELECT doc_id, page_number, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM (SELECT doc_id, page_number, arg_max(t, line_no) FILTER (t <> '') AS e FROM ct GROUP BY 1, 2)),
    nb AS (SELECT ct.*, coalesce(CASE WHEN row_number() OVER w = 1 THEN edge ELSE lag(t) OVER w END, '') AS b, coalesce(lead(t) OVER w, '') AS a FROM ct JOIN ed USING (doc_id, page_number) WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
    nr AS (SELECT *, {_clean(f"regexp_extract(t, '(?i)^art[íÍi]culo{_B}+({_ART_NUM})', 1)")} AS raw, {_clean(f"regexp_replace(t, '(?i)^art[íÍi]culo{_B}+(?:{_ART_NUM})[.{chr(92)}s{chr(92)}p{{Z}}º°o]*', '')")} AS tail FROM nb),
    ty AS (SELECT *, CASE WHEN length(t) < 5 THEN 'generic'
        WHEN regexp_matches(t, '(?i)^(?:art[íÍi]culo|p[áÁa]rrafo|fracc[ióÓo]+n|secci[óÓo]n|cap[íÍi]tulo|t[íÍi]tulo)\s+(?:reformad[oa]|adicionad[oa]|derogad[oa])\s*\.?\s*DOF|^Reforma\s+DOF|^(?:aclaraci[oóÓ]n|nota\s*de\s+erratas|fe\s+de\s+erratas|N\.\s*de\s+E\.|nota\s+del\s+editor|nota\s*:\s)') OR regexp_matches(t, '^\d+\s+de\s+\d+$') THEN 'generic'
        WHEN regexp_matches(t, '^[Ll]ibro{_B}+{_NUM}') THEN CASE WHEN regexp_matches(string_split_regex({_clean(f"regexp_replace(t, '^[Ll]ibro{_B}+(?:[IVX]+|{chr(92)}d+[º°o]?)[.{chr(92)}s{chr(92)}p{{Z}}º°o{chr(92)}-]*', '')")}, '{_B}+')[1], '(?i)^[IVX\d]+[º°o]?$') THEN 'book' ELSE 'generic' END
        WHEN {_unless_body('(?:t[íÍi]tulo|tema)', _NUM)} THEN 'title' WHEN {_unless_body('cap[íÍi]tulo', _NUM)} THEN 'chapter' WHEN regexp_matches(t, '(?i)^(?:t[íÍi]tulo|tema|cap[íÍi]tulo){_B}') THEN 'generic'
        WHEN regexp_matches(t, '(?i)^secci[óÓo]n{_B}+(?:[IVX]+{_END}|\d+(?:\.\d+)+)') THEN 'section' WHEN regexp_matches(t, '(?i)^anexo{_B}+(?:{_NUM}|[A-Z])') THEN 'annex'
        WHEN raw <> '' THEN CASE WHEN regexp_matches(raw, '(?i)^[uúÚ]nico$') OR starts_with(t, 'artículo') AND NOT (regexp_matches(b, '[.;:]$') OR b = '') AND NOT (regexp_matches(b, '(?i){_NOTE}') OR regexp_matches(b, '\d{{2}}-\d{{2}}-\d{{4}}\s*$'))
            OR tail <> '' AND (regexp_matches(tail, '(?i)^de (?:esta|la presente)\s+ley|^del presente|^de este (?:c[óÓ]digo|ordenamiento|cuerpo)') OR regexp_matches(tail, '(?i)^transitori[oa]\s+(?:del|de la|de los|de las)\s')) THEN 'generic' ELSE 'article' END
        WHEN regexp_matches(t, '^[Rr]egla{_B}+\d+(?:\.\d+)+') THEN 'rule' WHEN regexp_matches(t, '^[Nn]umeral{_B}+\d+') THEN 'numeral' WHEN regexp_matches(t, '^[IVXivx]+[.\-]+') THEN 'fraction' WHEN regexp_matches(t, '^[a-zA-Z]\){_B}') THEN 'inciso'
        WHEN regexp_matches(t, '(?i)^(?:art[íÍi]culos?\s+transitorios?|transitorios?)\s*$') THEN 'transitorio'
        WHEN regexp_matches(t, '^(?:PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|SÉPTIMO|OCTAVO|NOVENO|DÉCIMO|Primero|Segundo|Tercero|Cuarto|Quinto|Sexto|Séptimo|Octavo|Noveno|Décimo)[.\-]+') THEN CASE WHEN b <> '' AND NOT regexp_matches(b, '[.:;]\s*$') THEN 'generic' ELSE 'transitorio' END
        WHEN regexp_matches(t, '^\[TABLE_\d+\]') THEN 'table'
        WHEN regexp_matches(t, '(?i)^\d+[º°o]?(?:\.-\s*|\.\s+)[A-Za-z]') AND regexp_matches(b, '(?i)^art[íÍi]culo\s*$') THEN 'article'
        WHEN regexp_matches(t, '(?i)^\d+[º°o]?(?:\.-\s*|\.\s*)') AND length(b) >= 10 AND regexp_matches(b, '(?i){_NOTE}|\d{{4}}\)\s+Reforma\s+DOF|\d{{2}}-\d{{2}}-\d{{4}}\s*:?\s*(?:Derog[óÓ]|Adicion[óÓ]|Reform[óÓ])') THEN 'article' ELSE 'generic' END AS type FROM nr),
    num AS (SELECT *, CASE WHEN type = 'article' AND raw <> '' THEN raw WHEN type = 'article' THEN regexp_extract(t, '^(\d+[º°o]?)', 1) END AS n0 FROM ty),
    typed AS (SELECT doc_id, page_number, line_no, line, t, type, CASE WHEN n0 IS NULL THEN NULL ELSE (CASE WHEN raw <> '' THEN 'Artículo ' ELSE 'Art. ' END) || (CASE WHEN regexp_matches(n0, '(?i)^(\d+)[º°o]?\.?\s*Bis$') THEN regexp_extract(n0, '^(\d+)', 1) || ' Bis'
        WHEN regexp_matches(n0, '(?i)^(\d+)[º°o]?\.?\s*-\s*([A-Za-z])') THEN regexp_extract(n0, '(?i)^(\d+)[º°o]?\.?\s*-\s*([A-Za-z])', 1) || '-' || regexp_extract(n0, '(?i)^(\d+)[º°o]?\.?\s*-\s*([A-Za-z])', 2)
        WHEN regexp_matches(n0, '\d+(-\s*[A-Za-z0-9]+)+$') THEN n0 ELSE trim(regexp_replace(n0, '(?i)^(\d+)[º°o]\s*$', '\1')) END) || (CASE WHEN raw <> '' THEN '' ELSE '.' END) END AS ref FROM num)"""
_SEGMENTS = rf"""{_TYPED},
    st AS (SELECT *, type = 'transitorio' AND regexp_matches(t, '(?i)^(?:art[íÍi]culos?\s+transitorios?|transitorios?)\s*$') AS header, CASE WHEN type = 'transitorio' THEN 1 WHEN type IN ('book', 'title', 'chapter', 'section') THEN 0 END AS ev FROM typed),
    s1 AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside, CASE WHEN row_number() OVER w = 1 OR type <> 'generic' OR coalesce(lag(header) OVER w, false) THEN 1 ELSE 0 END AS begins FROM st WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
    s2 AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS seg, CASE WHEN header THEN NULL WHEN type = 'transitorio' THEN 'Artículo ' || upper(left(regexp_extract(t, '^([A-ZÉa-zé]+)', 1), 1)) || lower(substring(regexp_extract(t, '^([A-ZÉa-zé]+)', 1), 2)) || ' Transitorio' WHEN type = 'article' AND inside THEN ref || ' Transitorio' ELSE ref END AS seg_ref FROM s1),
    s3 AS (SELECT doc_id, page_number, seg, arg_min(type, line_no) AS type, max(CASE WHEN begins = 1 THEN seg_ref END) AS ref, {_clean("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM s2 GROUP BY 1, 2, 3)"""


@query(rf"WITH {_TYPED} SELECT doc_id, page_number, line_no, type, ref FROM typed")
def legal_line_types(spark: SparkSession, d: str) -> DataFrame:
    return ops.typed_lines(ops.split_fused(_lines(spark, d))).select("doc_id", "page_number", "line_no", "type", "ref")


@query(rf"WITH {_SEGMENTS} SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY seg) AS INT) AS seg_no, type, ref, md5(text) AS text_md5 FROM s3 WHERE text <> ''")
def segment_islands(spark: SparkSession, d: str) -> DataFrame:
    got = ops.segments(ops.typed_lines(ops.split_fused(_lines(spark, d))))
    return got.select("doc_id", "page_number", "seg_no", "type", "ref", F.md5("text").alias("text_md5"))


@query()
def bounded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_ops.bounded_chunks(ops.segments(ops.typed_lines(ops.split_fused(_lines(spark, d)))))


@query(rf"""
    WITH {_LINES} SELECT doc_id, max(CASE WHEN regexp_matches(line, '(?i)[úÚ]ltima reforma DOF \d{{2}}-\d{{2}}-\d{{4}}') THEN try_strptime(regexp_extract(line, '(\d{{2}}-\d{{2}}-\d{{4}})', 1), '%d-%m-%Y')::DATE END)::VARCHAR AS last_reform,
        count(DISTINCT page_number) AS pages, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines GROUP BY 1
""")
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.try_to_timestamp(F.regexp_extract("line", r"(\d{2}-\d{2}-\d{4})", 1), F.lit("dd-MM-yyyy")).cast("date")
    seen = F.when(F.col("line").rlike(r"(?iU)última reforma DOF \d{2}-\d{2}-\d{4}"), stamp)
    return _lines(spark, d).groupBy("doc_id").agg(F.max(seen).cast("string").alias("last_reform"), F.count_distinct("page_number").alias("pages"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query()
def normalised_pages(spark: SparkSession, d: str) -> DataFrame:
    return normaliser.normalised_pages(table(spark, d, "page_content"))


@query()
def normalisation_audit(spark: SparkSession, d: str) -> DataFrame:
    return normaliser.audit_totals(normaliser.normalised_pages(table(spark, d, "page_content")))


@query(rf"""
    WITH {_LINES}, t AS (SELECT doc_id, page_number, line_no, trim(line) AS t FROM lines)
    SELECT doc_id, page_number, line_no, regexp_matches(t, '(?i)^(?:(?:considerando|expidiendo|exhortando|decreto\s+por\s+el\s+que|t[ÍíI]tulo|cap[ÍíI]tulo|secci[ÓóO]n|transitorios?|[Úú]nico|visto|puntos?\s+de\s+acuerdo|c[Áá]mara\s+de\s+diputados)(?:[^\wáéíóúüñÁÉÍÓÚÜÑ]|$)|al\s+margen(?:[^\wáéíóúüñÁÉÍÓÚÜÑ]|$))') AS own_row,
        regexp_matches(t, '(?i)(?:art[íÍ]|durant)$|,\s*(?:se|le|les|nos|me|te|lo|los|las)$| [a-záéíóúñÁÉÍÓÚÑ]$') AS cut_at_end,
        regexp_matches(t, '(?i)^(?:culos|on|e)(?:[^\wáéíóúüñÁÉÍÓÚÜÑ]|$)') OR regexp_matches(t, '^[a-záéíóúñü]') AND regexp_matches(t, '(?i)^(?:considera|consider[óÓ]|consideran|deber[áÁ]n?|podr[áÁ]n?|tendr[áÁ]n?|habr[áÁ]n?|resultan?|establecen?|determinan?|disponen?|autorizan?|ordenan?|precisan?|se[ñÑ]alan?|definen?|otorgan?|fundamento)\s+') AS cut_at_start FROM t
""")
def line_break_signs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("line")
    return _lines(spark, d).select("doc_id", "page_number", "line_no", legal.own_row(c).alias("own_row"), legal.cut_at_end(c).alias("cut_at_end"), legal.cut_at_start(c).alias("cut_at_start"))


@query(r"""WITH p AS (SELECT doc_id, page_number, max(text) AS text FROM page_content WHERE doc_id IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2)
    SELECT doc_id, page_number, md5(regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g')) AS text_md5 FROM p""")
def squeezed_page_texts(spark: SparkSession, d: str) -> DataFrame:
    return ops.distinct_pages(table(spark, d, "page_content")).select("doc_id", "page_number", F.md5(legal.squeezed_breaks(F.col("text"))).alias("text_md5"))
