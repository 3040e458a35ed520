import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioweave.functions import providers
from folioweave.session import cut_lineage
from folioweave.operators import index, layout, metadata, structure, tables, vectors
from folioweave.sources import readers, sinks
from folioweave.streaming import indexing


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def arr(rows):
    return F.from_json(F.lit(json.dumps(rows)), "array<array<string>>")


def test_table_verdicts(spark):
    numeric, words = [[str(i) for i in range(10)]] * 2, [["de", "la", "ley", "que", "el", "no"]] * 4
    cases = [
        (numeric, "prose"), (words, "prose"), ([["Límite inferior", "Cuota"], ["1", "2"]], "tariff"), ([["Nota: véase el decreto"]], "note"),
        ([["Nombre", "Dato largo"], ["Ana María", "otro"]], "table"), ([], "prose"), ([["", ""]], "prose"),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)] + [(99, None)], "i int, rows array<array<string>>")
    got = {r.i: r.verdict for r in tables.judged(df).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases] and got[99] == "prose"
    assert {r.verdict for r in tables.judged(df.where("i = 0"), relax=True).collect()} == {"table"}


def test_markdown_round_trip(spark):
    rows = [["A", ""], ["x|y", "2"], ["z"]]
    text = one(spark, tables.to_markdown(arr(rows), F.lit(3)))
    assert text == "[TABLE_3]\n| A | Col 2 |\n|---|---|\n| x\\|y | 2 |\n| z |  |\n[TABLE_3]"
    assert one(spark, tables.from_markdown(F.lit("a\n| K | V |\n|---|---|\n| 1 | 2 |\n"))) == [["K", "V"], ["1", "2"]]
    assert one(spark, tables.merged_header(arr([["A", "B"], ["x", "y"], ["1", "2"], ["p", "q"]]))) == [["A x", "B y"], ["1", "2"], ["p", "q"]]
    assert one(spark, tables.to_markdown(arr([]), F.lit(1))) is None


def test_legend(spark):
    text = "TEXTO VIGENTE de la ley\nÚltima reforma DOF 15-03-2024\nNueva Ley publicada en el Diario Oficial de la Federación el 1 de abril de 2020\nÚltima reforma DOF 31-02-2024\n"
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "nada aquí que ver")], "doc string, body string")
    got = metadata.legal_legend(df, "doc", "body").collect()
    assert [(r.doc, str(r.publication_date), str(r.last_reform_date)) for r in got] == [("a", "2020-04-01", "2024-03-15")]
    assert got[0].legend.startswith("TEXTO VIGENTE de la ley Última reforma DOF 15-03-2024 Nueva Ley")


def test_headings(spark):
    rows = [
        ("considera adecuado lo anterior\nTítulo propio", "Ley X", "Título propio"),
        ("DIARIO OFICIAL\nDECRETO por el que se reforma la ley. Sigue.", "Decreto Y", "DECRETO por el que se reforma la ley."),
        ("", "Ley Z (2020)", "Ley Z"), (None, None, ""), ("podrá hacerlo", None, "podrá hacerlo"),
    ]
    df = spark.createDataFrame(rows, "t string, title string, want string")
    for r in df.select("want", metadata.generic_heading(F.col("t"), F.col("title")).alias("got")).collect():
        assert r.got == r.want


SPAN = "span_id bigint, doc_id string, page_number int, block_no int, line_no int, span_no int, text string, font_size double, font_name string, is_bold boolean, is_italic boolean, bbox struct<x0: double, y0: double, x1: double, y1: double>"


def spans(spark, *rows):
    """(page, block, text, y0)."""
    return spark.createDataFrame([(i, "d", p, b, 0, 0, t, 10.0, None, False, False, (72.0, y, 500.0, y + 14)) for i, (p, b, t, y) in enumerate(rows)], SPAN)


def test_repeated_heads_and_tree(spark):
    s = spans(
        spark, (1, 0, "GACETA 1", 20.0), (2, 0, "GACETA 2", 20.0), (3, 0, "GACETA 3", 20.0), (1, 1, "Título I", 100.0), (1, 2, "Capítulo I", 120.0), (1, 3, "Artículo 1.- Texto", 140.0),
        (1, 4, "cuerpo del artículo que sigue con más texto", 160.0), (2, 1, "I. Una fracción", 100.0), (2, 2, "a) Un inciso", 120.0), (3, 1, "Título II", 100.0), (3, 2, "Artículo 2.- Otro", 120.0), (3, 3, " ", 140.0),
    )
    labelled = cut_lineage(layout.labelled(layout.blocks(s.unionAll(s))))
    assert labelled.where("label = 'page_header'").count() == 3
    rows = structure.numbered(labelled, ["block_no"])
    tree = cut_lineage(structure.nodes(rows))
    got = [(r.ord, r.parent_ord, r.node_type, r.article_ref, r.node_id) for r in tree.orderBy("ord").collect()]
    assert got == [
        (2, 0, "title", None, "title-i"), (3, 2, "chapter", None, "chapter-i"), (4, 3, "article", "1", "article-1"), (5, 4, "paragraph", None, "paragraph-1"), (7, 4, "fraction", None, "fraction-1"),
        (8, 7, "inciso", None, "inciso-1"), (10, 0, "title", None, "title-ii"), (11, 10, "article", "2", "article-2"),
    ]
    chunks = {r.ord: r for r in structure.projected(tree).collect()}
    assert set(chunks) == {4, 7, 11} and chunks[4].text.endswith("más texto") and list(chunks[7].source_ords) == [7, 8] and chunks[7].article_ref == "1" and (chunks[4].page_start, chunks[4].page_end) == (1, 2)
    assert {r.ord: (r.child_count, r.article_count, r.page_start, r.page_end) for r in structure.sections(tree).collect()} == {2: (1, 0, 1, 2), 3: (1, 1, 1, 2), 10: (1, 1, 3, 3)}
    assert [r.text_preview for r in structure.excluded(rows).orderBy("ord").collect()] == ["GACETA 1", "GACETA 2", "GACETA 3"]
    assert structure.nodes(rows.limit(0)).count() == 0


def tree_of(spark, labels):
    rows = [("d", i, label, text, i) for i, (label, text) in enumerate(labels, 1)]
    return cut_lineage(structure.nodes(spark.createDataFrame(rows, "doc_id string, ord int, label string, text string, page_number int")))


def test_transitory_articles_stay_open_until_an_annex(spark):
    tree = tree_of(spark, [
        ("document_title", "LEY"), ("article_body", "preámbulo"), ("book_heading", "Libro I"), ("article_heading", "Artículo 1.- Uno"), ("table", ""), ("transitory_heading", "TRANSITORIOS"), ("article_body", "suelto"),
        ("transitory_item", "Primero.- Entra"), ("article_body", "más"), ("article_heading", "Artículo 2.- Dos"), ("article_body", "tras el dos"), ("annex_heading", "Anexo 1"), ("article_body", "del anexo"), ("article_heading", "Artículo 3.- Tres"),
        ("unknown", "fin"), ("fraction", "I. a"), ("inciso", "a) b"), ("editorial_note", "Nota"), ("page_footer", "9"),
    ])
    assert [(r.ord, r.parent_ord) for r in tree.orderBy("ord").collect()] == [(2, 0), (3, 0), (4, 3), (5, 4), (6, 0), (7, 6), (8, 6), (9, 8), (10, 3), (11, 8), (12, 0), (13, 12), (14, 12), (15, 14), (16, 14), (17, 16), (18, 14)]
    got = {r.ord: (r.chunk_type, r.text, r.article_ref) for r in structure.projected(tree).collect()}
    assert got == {
        2: ("paragraph", "preámbulo", None), 4: ("article", "Artículo 1.- Uno", "1"), 5: ("table", "", "1"), 7: ("transitory", "suelto", None), 8: ("transitory", "Primero.- Entra\nmás\ntras el dos", "primero"),
        10: ("article", "Artículo 2.- Dos", "2"), 12: ("annex", "Anexo 1", None), 13: ("annex", "del anexo", None), 14: ("article", "Artículo 3.- Tres\nfin", "3"), 16: ("fraction", "I. a\na) b", "3"), 18: ("boxed_note", "Nota", "3"),
    }
    assert {r.ord: r.parent_ord for r in tree_of(spark, [("fraction", "I. a"), ("inciso", "a) b")]).collect()} == {1: 0, 2: 1}
    blocks = spark.createDataFrame([("d", 1, "document_title", " LEY ", 1), ("d", 5, "document_title", "LEY B", 1), ("d", 2, "article_body", "x", 1)], "doc_id string, ord int, label string, text string, page_number int")
    assert tuple(structure.titles(blocks).first()) == ("d", "LEY", "LEY B")
    context = {r.ord: r.context for r in structure.contexts(tree).collect()}
    assert context[9] == '{"node_id":"paragraph-3","node_type":"paragraph","parent_node_id":"transitory-primero","is_transitory":true}' and '"book_heading":"Libro I"' in context[4]


def test_paragraphs_merge(spark):
    s = spans(spark, (1, 0, "La primera parte de una frase", 100.0), (1, 1, "que sigue aquí.", 118.0), (1, 2, "Otra frase nueva.", 136.0), (1, 3, "Artículo 2.- Texto", 152.0))
    rows = layout.merged(layout.kinds(layout.reading_order(layout.blocks(s))), layout.font_sizes(s))
    got = [r.text for r in rows.orderBy("reading_order").collect()]
    assert got == ["La primera parte de una frase que sigue aquí.", "Otra frase nueva.", "Artículo 2.- Texto"]


def test_boxes(spark):
    b = layout.blocks(spans(spark, (1, 0, "dentro", 100.0), (1, 1, "fuera", 300.0)))
    boxes = spark.createDataFrame([("d", 1, 0.0, 90.0, 600.0, 130.0)], "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layout.uncovered(b, boxes).collect()] == ["fuera"] and [r.text for r in layout.touching(b, boxes).collect()] == ["dentro"]


def test_providers_fall_back(spark):
    df = spark.createDataFrame([("Ley de x", 1), (None, 2)], "title string, i int")
    answer = lambda p: [r[0] for r in df.orderBy("i").select(providers.doc_type(F.col("title"), p)).collect()]
    assert answer(None) == ["ley", "otro"]
    assert answer(lambda v: ["estatuto"] * len(v)) == ["estatuto", "otro"] and answer(lambda v: ["nonsense"] * len(v)) == ["ley", "otro"]
    calls = []

    def broken(values):
        calls.append(1)
        raise RuntimeError("down")

    assert providers.asked(["a"], broken, tries=3, wait=0) == [None] and len(calls) == 3
    blocks = spark.createDataFrame([("x", "unknown", 0.6), ("y", "article_heading", 0.95)], "text string, label string, confidence double")
    assert [r.label for r in providers.refined_labels(blocks, lambda v: ['{"label": "annex_body", "confidence": 0.9}'] * len(v)).orderBy("text").collect()] == ["annex_body", "article_heading"]
    got = providers.embedded(df, "i", "title", lambda v: [[float(len(t))] for t in v]).orderBy("i").collect()
    assert [r.embedding for r in got] == [[8.0], [1.0]]
    verdict = lambda t, box: one(spark, providers.boxed_verdict(F.lit(t), F.lit(box), F.lit(1), F.lit(1)))
    assert [verdict("", True), verdict("Artículo 3", True), verdict("Fe de erratas", False), verdict("palabra " * 30, False), verdict("corto", False)] == ["editorial_note", "structural", "editorial_note", "ambiguous", "structural"]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "b").mkdir(parents=True)
    (tmp_path / "in" / "uno.txt").write_text("p1\fp2")
    (tmp_path / "in" / "b" / "dos.txt").write_bytes(b"\xff\xfe")
    files = readers.with_identity(readers.binary_files(spark, str(tmp_path / "in"), "*.txt"))
    assert sorted(r.title for r in files.collect()) == ["dos", "uno"]
    rows = readers.extract_pages(files).collect()
    assert sorted((r.page_number, r.text) for r in rows if r.error is None) == [(1, "p1"), (2, "p2")] and sum(r.error is not None for r in rows) == 1
    report = spark.createDataFrame([(1, "a|b", ["x"]), (2, None, [])], "i int, t string, l array<string>")
    sinks.write_csv(report, str(tmp_path / "csv"))
    sinks.write_json(report, str(tmp_path / "json"))
    sinks.write_markdown(report.select("i", "t"), str(tmp_path / "md"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.json(str(tmp_path / "json")).count() == 2
    assert "| 1 | a\\|b |" in {r.value for r in spark.read.text(str(tmp_path / "md")).collect()}


def test_upsert_and_replace(spark, tmp_path):
    old = spark.createDataFrame([("p1", "T1", "L1"), ("p2", "T2", "L2")], "blobPath string, title string, lawName string")
    new = spark.createDataFrame([("p2", "N" * 600), ("p3", "T3")], "blobPath string, title string")
    got = {r.blobPath: (r.title, r.lawName) for r in index.upsert_documents(old, new).collect()}
    assert got == {"p1": ("T1", "L1"), "p2": ("N" * 500, "L2"), "p3": ("T3", None)}
    chunks = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "documentId string, chunkNo int")
    out = str(tmp_path / "chunks")
    sinks.write_chunks(chunks, out, buckets=2)
    merged = index.replace_chunks(chunks, spark.createDataFrame([("d1", 9)], "documentId string, chunkNo int"))
    sinks.write_chunks(merged, out, buckets=2)
    assert sorted((r.documentId, r.chunkNo) for r in spark.read.parquet(out).collect()) == [("d1", 9), ("d2", 1)]
    m = one(spark, index.merge_metadata(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert m == {"a": 1, "b": 3}


def test_stream_is_idempotent(spark, tmp_path):
    src, out, log, state = (str(tmp_path / x) for x in ("src", "out", "log", "state"))
    pages = spark.createDataFrame([("d1", 1, "Artículo 1.- Uno largo para contar\nArtículo 2.- Dos largo para contar"), ("d2", 1, "Título I\ntexto")], indexing.PAGES)
    pages.where("doc_id = 'd1'").write.mode("append").parquet(src)
    indexing.start(spark, src, out, log, state).awaitTermination()
    pages.where("doc_id = 'd2'").write.mode("append").parquet(src)
    indexing.start(spark, src, out, log, state).awaitTermination()
    stored = spark.read.parquet(out)
    assert {(r.doc_id, r.article_ref) for r in indexing.current_chunks(stored).collect()} == {("d1", "Artículo 1"), ("d1", "Artículo 2"), ("d2", None)}
    before = stored.count()
    indexing.index_batch(out, log)(pages.where("doc_id = 'd2'"), 1)
    assert spark.read.parquet(out).count() == before
    assert {r.status for r in indexing.run_states(spark.read.parquet(log)).collect()} == {"completed"}
    now = datetime(2024, 1, 1, 12)
    runs = spark.createDataFrame([("a", now - timedelta(hours=2), None, "processing", None, None), ("b", now - timedelta(minutes=5), None, "processing", None, None)], indexing.RUN)
    assert [(r.id, r.status) for r in indexing.swept(runs, now).collect()] == [("a", "failed")]


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    import numpy as np

    x = np.random.default_rng(0).standard_normal((40, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 4), (92, [1.0])], "id bigint, v array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in vectors.top_k(df, "id", "v", df.where("id % 8 = 0"), 2, width=4).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 40, 8):
        s = u @ u[q]
        s[q] = -2
        assert [got[q, 1], got[q, 2]] == np.argsort(-s)[:2].tolist()
    assert vectors.top_k(df, "id", "v", df.limit(0), 2, width=4).count() == 0
