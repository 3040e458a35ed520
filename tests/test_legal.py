import pytest
from pyspark.sql import functions as F

from folioweave.functions import legal
from folioweave.operators import chunks, lines, normaliser, ordered, quality, toc


def column(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_article_numbers(spark):
    assert column(spark, legal.article_number, ["5o", "1º", "14-A", "9o.-A", "3 Bis", "194-N-1", "Vigésimo", None]) == ["5", "1", "14-A", "9-A", "3 Bis", "194-N", "Vigésimo", ""]


def test_dates_titles_and_types(spark):
    assert [str(x) for x in column(spark, legal.spanish_date, ["el 1 de abril de 2024", "31 de febrero de 2024", None, "sin"])] == ["2024-04-01", "None", "None", "None"]
    assert [str(x) for x in column(spark, legal.iso_date, ["2024-03-15T10:00", "2024-02-30", None])] == ["2024-03-15", "None", "None"]
    assert column(spark, legal.law_name, ["Ley del ISR (reformada en 2024)", "A" * 300, None]) == ["Ley del ISR", "A" * 255, None]
    assert column(spark, legal.law_acronym, ["Ley Federal del Impuesto sobre Automóviles Nuevos", "Código", "de la", None]) == ["LIAN", "Código", "de la", ""]
    assert column(spark, legal.doc_type, ["REGLAMENTO de la Ley", "Código", "NOM-001", None, "x"]) == ["reglamento", "codigo", "norma", "otro", "otro"]


@pytest.mark.parametrize(
    "before,line,after,want",
    [
        ("", "Artículo 5o.- Texto", "", ("article", "Artículo 5")),
        ("", "artículo 5 de esta Ley", "", ("generic", None)),
        ("", "Título II Disposiciones", "", ("title", None)),
        ("", "TÍTULO SEGUNDO", "", ("generic", None)),
        ("", "Capítulo III", "del presente", ("generic", None)),
        ("señalado en el", "Capítulo III", "", ("generic", None)),
        ("", "Capítulo III", "Artículo 5", ("chapter", None)),
        ("", "Sección IV Nombre", "", ("section", None)),
        ("", "Sección 1.2 Nombre", "", ("section", None)),
        ("", "Libro I", "", ("generic", None)),
        ("", "II. Presentar", "", ("fraction", None)),
        ("", "a) Los datos", "", ("inciso", None)),
        ("", "TRANSITORIOS", "", ("transitorio", None)),
        ("Fin.", "PRIMERO.- El presente", "", ("transitorio", None)),
        ("sigue", "PRIMERO.- El presente", "", ("generic", None)),
        ("Artículo", "5o.- Tratándose de", "", ("article", "Art. 5.")),
        ("", "Artículo reformado DOF 01-01-2020", "", ("generic", None)),
        ("", "12 de 180", "", ("generic", None)),
        ("", "abc", "", ("generic", None)),
        ("", "[TABLE_1]", "", ("table", None)),
        ("", "Anexo 3", "", ("annex", None)),
        ("", "Regla 2.1.3 Texto", "", ("rule", None)),
    ],
)
def test_line_types(spark, before, line, after, want):
    df = spark.createDataFrame([(before, line, after)], "b string, l string, a string")
    r = df.select(legal.line_type(F.col("l"), F.col("b"), F.col("a")).alias("k")).first()[0]
    assert (r["type"], r["ref"]) == want


def test_block_labels(spark):
    rows = ["LEY GENERAL DE AGUAS", "TRANSITORIOS", "Primero.- Entra", "Artículo 3.- Texto", "conforme al artículo 3.", "15 DE MARZO DE 2024", "II. Algo", "a) algo", "x", None, "Capítulo II", "texto largo que no tiene forma alguna de encabezado"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    null = F.lit(None).cast("string")
    got = [r[0] for r in df.orderBy("i").select(legal.block_label(F.col("t"), null, null, F.lit(False), F.lit(False))["label"]).collect()]
    assert got == ["document_title", "transitory_heading", "transitory_item", "article_heading", "unknown", "article_body", "fraction", "inciso", "unknown", "unknown", "chapter_heading", "article_body"]


def pages(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc_id string, page_number int, text string")


def test_transitory_state_is_carried_over_pages(spark):
    p = pages(spark, "Capítulo I\nArtículo 1.- Uno.\nTRANSITORIOS", "Artículo 2.- Dos.\nmás", "Capítulo III\nArtículo 51.- Cinco.")
    got = {(r.page_number, r.ref) for r in lines.segments(lines.typed_lines(lines.explode_lines(p))).collect() if r.ref}
    assert got == {(1, "Artículo 1"), (2, "Artículo 2 Transitorio"), (3, "Artículo 51")}


def test_lines_of_all_ends(spark):
    got = [r.line for r in lines.explode_lines(pages(spark, "a\r\nb\rc d\n\ne\n", None, "")).orderBy("line_no").collect()]
    assert got == ["a", "b", "c", "d", "", "e"]
    assert lines.explode_lines(pages(spark, "x").limit(0)).count() == 0


def test_headers_once(spark):
    p = pages(spark, "LEY DE AGUAS NACIONALES\nuno\n1 de 3", "LEY DE AGUAS NACIONALES\ndos\nArtículo reformado DOF 01-01-2020", "tres\nArtículo reformado DOF 01-01-2020")
    got = [r.line for r in lines.keep_first_headers(lines.explode_lines(p)).orderBy("page_number", "line_no").collect()]
    assert got == ["LEY DE AGUAS NACIONALES", "uno", "dos", "Artículo reformado DOF 01-01-2020", "tres", "Artículo reformado DOF 01-01-2020"]


def test_fused_lines(spark):
    p = pages(spark, "TRANSITORIOS Artículo 1.- Entra en vigor\nFracción reformada DOF 01-02-2020 Artículo 7.- Sigue el texto")
    got = [r.line for r in lines.split_fused(lines.explode_lines(p)).orderBy("line_no").collect()]
    assert got == ["TRANSITORIOS", "Artículo 1.- Entra en vigor", "Fracción reformada DOF 01-02-2020", "Artículo 7.- Sigue el texto"]


def test_split_by_size():
    for text in ("palabra " * 500, "X" * 3000, "uno dos.\n\n" * 300, ""):
        parts = chunks.split_by_size(text, 500)
        assert all(0 < len(p) <= 500 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())


def test_bounded_chunks_follow_articles(spark):
    p = pages(spark, "Preámbulo\nArtículo 1.- Uno\nsigue\nArtículo 2.- Dos", "más de dos\nTRANSITORIOS\nPrimero.- Entra.")
    got = [(r.chunk_no, r.article_ref, r.start_page, r.end_page) for r in chunks.bounded_chunks(lines.segments(lines.typed_lines(lines.explode_lines(p)))).orderBy("chunk_no").collect()]
    assert got == [(1, None, 1, 1), (2, "Artículo 1", 1, 1), (3, "Artículo 2", 1, 2), (4, "Transitorios", 2, 2)]


def test_ordered_blocks_match_windows(spark):
    rows = [("k", i, i if i % 7 == 0 else None, 1) for i in range(100)] + [("m", 5, None, 2)]
    df = spark.createDataFrame(rows, "k string, o int, v int, n int")
    got = {(r.k, r.o): (r.last, r.before) for r in ordered.last_known(ordered.last_known(df, ["k"], "o", {"last": "v"}, block=9), ["k"], "o", {"before": "v"}, False, block=9).collect()}
    for i in range(100):
        assert got["k", i] == (i // 7 * 7, None if i == 0 else (i - 1) // 7 * 7)
    assert got["m", 5] == (None, None)
    sums = {(r.k, r.o): r.s for r in ordered.running_sum(df, ["k"], "o", "n", "s", block=9).collect()}
    assert sums["k", 50] == 51 and sums["m", 5] == 2


CHUNK = "id string, documentId string, chunkNo int, chunkType string, articleRef string, heading string, text string, startPage int, endPage int"


def chunk_rows(spark, rows):
    return spark.createDataFrame([(f"{i}", "d", i, t, ref, head, "texto", 1, 1) for i, (t, ref, head) in enumerate(rows)], CHUNK)


TREE = "doc_id string, ord int, parent_ord int, node_id string, node_type string, heading string, text string, article_ref string, page_number int"


def articles(spark, refs, heading="Artículo"):
    return spark.createDataFrame([("d", i, 0, f"article-{r}", "article", f"{heading} {r}", None, r, 1) for i, r in enumerate(refs, 1)], TREE)


def test_sequence_health(spark):
    bad = quality.article_sequence(articles(spark, ["62", "47", "59", "63"])).first()
    assert bad.disorder_ratio == 0.3333 and not quality.verdicts(quality.checks(articles(spark, ["62", "47", "59", "63"]))).first()["pass_article_sequence_health"]
    good = quality.verdicts(quality.checks(articles(spark, ["14", "14-A", "14Bis", "15"]))).first()
    assert (good.disorder_ratio, good.max_gap, good.duplicate_ratio) == (0, 1, 0) and good["pass_article_sequence_health"]
    assert quality.article_sequence(articles(spark, ["1", "x"]).limit(0)).count() == 0
    few = quality.article_sequence(articles(spark, ["primero", "segundo", "9"])).first()
    assert (few.refs, few.disorder_ratio, few.max_gap) == (3, 0, 0)
    parts = column(spark, lambda c: F.struct(*quality.sequence_parts(c)), ["14", "14A", "14-A", "14 Bis", "primero", None])
    assert [tuple(p) for p in parts] == [(14, None), (14, "a"), (14, "a"), (14, "bis"), (None, None), (None, None)]


def test_scores(spark):
    clean = quality.scored(articles(spark, ["1", "2", "3"])).first()
    assert clean.score == 1.0 and clean.severity == "low" and clean.reasons == ""
    rows = [("d", 1, 0, "article-1", "article", "[TABLE_1]", None, None, 1), ("d", 2, 0, "article-2", "article", "Página 3", None, None, 1), ("d", 3, 0, "article-3", "article", "15 de marzo de 2024", None, None, 1), ("d", 4, 0, "table-1", "table", None, None, None, None),
            ("d", 5, 0, "p", "paragraph", None, "suelto", None, 1), ("d", 6, 0, "q", "paragraph", None, "suelto", None, 1), ("d", 7, 0, "r", "odd", None, None, None, 1), ("d", 8, 0, "article-3", "article", "15 de marzo de 2024", "establecer", None, 1)]
    got = quality.verdicts(quality.checks(spark.createDataFrame(rows, TREE))).first()
    assert (got.tokens, got.bleed, got.dates, got.orphans, got.unknown, got.loose, got.toc_duplicates, got.coverage) == (2, 1, 2, 1, 1, 2, 1, 0.0) and list(got.date_examples) == ["15 de marzo de 2024"]
    dirty = quality.scored(spark.createDataFrame(rows, TREE)).first()
    assert dirty.severity == "high" and dirty.reasons.split(",") == [k for k in quality.WEIGHTS if k != "article_sequence_health"]
    assert [(r.gate, r.gate_reason) for r in quality.gated(quality.scored(articles(spark, ["1", "2"]))).collect()] == [(True, "quality_sufficient")]
    assert quality.gated(quality.scored(spark.createDataFrame(rows, TREE)), production=False, allow_below=True).first().gate_reason == "low_quality_allowed_non_prod"


def test_page_fold():
    fold = lambda t: normaliser.fold(normaliser.prepared(t))
    text, audit = fold("La obliga-\nción es clara.")
    assert text == "La obligación es clara." and audit["hyphen_joins"] == 1
    assert fold("fin del párrafo anterior.\nArtículo 5. Este artículo")[0].split("\n")[1].startswith("Artículo 5")
    assert fold("texto.\na) primer inciso\nb) segundo inciso")[0] == "texto.\na) primer inciso\nb) segundo inciso"
    assert fold("Artículo 194-\nN-1 dice")[0] == "Artículo 194-N-1 dice" and normaliser.prepared("Artículo 14-\nA.") == ["Artículo 14-A."]
    assert fold("la autoridad que conoce del asunto, se\n\nconsidera competente para ello")[0] == "la autoridad que conoce del asunto, se considera competente para ello"
    assert fold("esta línea no termina en punto\ny la siguiente es larga")[1]["merges_applied"] == 1
    assert fold("uno\nCONSIDERANDO\ndos")[0] == "uno\nCONSIDERANDO\ndos" and fold("") == fold(None) and fold("")[0] == ""


def test_normalised_pages(spark):
    pages = [("d", 1, "CÁMARA DE DIPUTADOS\nContenido útil.\n23 de 180\nMás contenido."), ("d", 2, "CÁMARA DE DIPUTADOS\nOtra página."), ("d", 2, "CÁMARA DE DIPUTADOS\nOtra página."), ("d", 3, None), ("d", 4, "CÁMARA DE DIPUTADOS"), (None, 1, "x")]
    got = {r.page_number: r for r in normaliser.normalised_pages(spark.createDataFrame(pages, "doc_id string, page_number int, text string")).collect()}
    assert got[1].text == "CÁMARA DE DIPUTADOS\nContenido útil.\nMás contenido." and got[1].headers_removed == 1
    assert (got[2].text, got[2].headers_removed, got[3].text, got[4].text, got[4].headers_removed) == ("Otra página.", 1, "", "", 1)
    total = normaliser.audit_totals(normaliser.normalised_pages(spark.createDataFrame(pages, "doc_id string, page_number int, text string"))).first()
    assert (total.pages, total.headers_removed) == (4, 3)


def test_toc_levels(spark):
    rows = [("title", None, "Título I"), ("article", "Artículo 1", "Artículo 1"), ("transitorio", None, "TRANSITORIOS"), ("article", "Artículo 1", "Artículo 1"), ("boxed_note", None, "x"), ("article", "Artículo 1", "otra vez")]
    got = [(r.title, r.level, r.parent_no) for r in toc.with_parents(toc.outline_rows(chunk_rows(spark, rows))).orderBy("chunkNo").collect()]
    assert got == [("Título I", 2, None), ("Artículo 1", 5, 0), ("Transitorios", 4, 0), ("Artículo 1", 5, 2)]


def test_buckets_are_filled(spark):
    df = spark.createDataFrame([(s,) for s in (0.3, 0.6, 0.75, 0.9, 0.95)], "score double")
    assert sorted(tuple(r) for r in quality.score_buckets(df).collect()) == [("0.0-0.5", 1), ("0.5-0.7", 1), ("0.7-0.85", 1), ("0.85-1.0", 2)]


def test_cuts_of_long_texts():
    assert chunks.split_by_size("a" * 10, 20) == ["a" * 10] and chunks.split_by_size("  ", 20) == []
    assert chunks.split_by_size("uno dos.\n\ntres cuatro", 15, 2) == ["uno dos.", "tres cuatro"]
    assert chunks.split_by_size("corto. Luego sigue otra frase que es larga", 30, 2) == ["corto. Luego sigue otra frase", "que es larga"]
    assert chunks.split_by_size("una frase larga. Otra frase más", 25, 2) == ["una frase larga.", "Otra frase más"]
    assert chunks.split_by_size("aaaaaaaaaaaaaaaa bbb se ccccccc", 24, 2) == ["aaaaaaaaaaaaaaaa", "bbb se ccccccc"]
    assert chunks.split_by_size("x" * 50, 20, 2) == ["x" * 20, "x" * 20, "x" * 10] and len(chunks.split_by_size("x" * 50, 20)) == 1


def test_stretches_tables_and_preambles(spark):
    rows = [
        (1, 1, "generic", None, "Preámbulo de la ley"), (1, 2, "article", "Artículo 1", "Artículo 1.- Uno"), (1, 3, "generic", None, "sigue"), (2, 1, "article", "Artículo 1", "Artículo 1 otra vez"), (2, 2, "article", "Artículo 2", "Artículo 2.- Dos"),
        (3, 1, "generic", None, "tras la tabla"), (3, 2, "transitorio", None, "TRANSITORIOS"), (3, 3, "generic", None, "preámbulo transitorio " * 3), (3, 4, "transitorio", "Artículo Primero Transitorio", "Primero.- x"), (3, 5, "generic", None, "y más"),
    ]
    segments = spark.createDataFrame([("d", *r) for r in rows] + [("e", 1, 1, "generic", None, "solo")], "doc_id string, page_number int, seg_no int, type string, ref string, text string")
    tables = spark.createDataFrame([("d", 2, 1, "| t |", False), ("d", 2, 2, "| u |", True)], "doc_id string, page_number int, table_index int, markdown string, is_boxed_note boolean")
    titles = spark.createDataFrame([("d", "Ley de Aguas", "")], "doc_id string, title string, head string")
    got = [tuple(r) for r in chunks.bounded_chunks(segments, 60, tables, titles).where("doc_id = 'd'").orderBy("chunk_no").select("chunk_no", "chunk_type", "article_ref", "start_page", "end_page", "text", "table_index", "heading").collect()]
    assert got == [
        (1, "generic", None, 1, 1, "Preámbulo de la ley", None, "Preámbulo de la ley"), (2, "article", "Artículo 1", 1, 2, "Artículo 1.- Uno\nsigue\nArtículo 1 otra vez", None, "Artículo 1"), (3, "article", "Artículo 2", 2, 2, "Artículo 2.- Dos", None, "Artículo 2"),
        (4, "table", "Artículo 2", 2, 2, "| t |", 1, "Artículo 2"), (5, "boxed_note", "Artículo 2", 2, 2, "| u |", 2, "Artículo 2"), (6, "generic", None, 3, 3, "tras la tabla", None, "tras la tabla"),
        (7, "transitorio", None, 3, 3, "TRANSITORIOS", None, "TRANSITORIOS"), (8, "generic", "Transitorios", 3, 3, "preámbulo transitorio preámbulo transitorio preámbulo\ntransitorio", None, "Transitorios"),
        (9, "transitorio", "Artículo Primero Transitorio", 3, 3, "Primero.- x\ny más", None, "Artículo Primero Transitorio"),
    ]
    assert chunks.bounded_chunks(segments.limit(0), 60, tables.limit(0)).count() == 0
    hit = {(r.chunk_no, r.text) for r in chunks.bounded_chunks(segments, 60).where("doc_id = 'd'").collect()}
    assert len(hit) == 6 == max(n for n, _ in hit) and (3, "Artículo 2.- Dos\ntras la tabla") in hit
