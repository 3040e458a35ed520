import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioweave.functions import models, providers
from folioweave.operators import extraction, headings, index, layout, toc
from folioweave.session import cut_lineage
from folioweave.sources import readers, sinks
from folioweave.streaming import indexing

BOX = "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double"


def test_native_outline_corrects_transitory_sections(spark):
    rows = [("d", 1, "Título I", 2, 1, False), ("d", 2, "Artículo 1", 5, 2, False), ("d", 3, "Transitorios", 4, 5, True), ("d", 4, "Primero", 5, 5, False), ("d", 5, "Transitorios", 4, 9, True), ("d", 6, "Segundo", 5, 12, False), ("d", 7, "Tercero", 5, 3, False)]
    rows += [("e", 1, "Transitorios", 4, 1, True), ("e", 2, "Uno", 5, 1, False), ("e", 3, "Transitorios", 4, 2, True)]
    outline = spark.createDataFrame(rows, "documentId string, chunkNo int, title string, level int, page int, container boolean")
    entry = "documentId string, entry_no int, level int, title string, page int"
    one = spark.createDataFrame([("d", 1, 1, "LEY", 1), ("d", 2, 1, "transitorios_de_la_ley", 8), ("d", 3, 1, "x", 9), ("e", 1, 1, "transitorios", 1)], entry)
    got = {r.node_id: (r.parent_id, r.title, r.page) for r in toc.hybrid(outline, one).where("documentId = 'd'").collect()}
    assert got == {"chunk-1": (None, "Título I", 1), "chunk-2": ("chunk-1", "Artículo 1", 2), "chunk-3": (None, "Transitorios", 8), "chunk-4": ("chunk-3", "Primero", 5), "chunk-6": ("chunk-3", "Segundo", 12), "chunk-7": ("chunk-3", "Tercero", 3)}
    assert toc.hybrid(outline, one).where("documentId = 'e'").count() == 3  # one native entry is no usable outline
    more = spark.createDataFrame([("e", 1, 1, "TRANSITORIOS_A", 2), ("e", 2, 1, "a", 1), ("e", 3, 1, "b", 2)], entry)
    assert {r.node_id: r.parent_id for r in toc.hybrid(outline, more).where("documentId = 'e'").collect()} == {"chunk-1": None, "chunk-2": "chunk-1"}
    two = spark.createDataFrame([("d", 1, 1, "Transitorios A", 4), ("d", 2, 1, "Transitorios B", 10), ("d", 3, 1, "x", 9)], entry)
    three = outline.unionByName(spark.createDataFrame([("d", 8, "Transitorios", 4, 13, True)], outline.schema))
    got = {r.node_id: (r.parent_id, r.title) for r in toc.hybrid(three, two).where("documentId = 'd'").collect()}
    assert got["chunk-4"] == ("chunk-3", "Primero") and got["chunk-6"] == ("chunk-5", "Segundo") and got["chunk-7"] == ("chunk-3", "Tercero") and got["chunk-5"] == (None, "Transitorios B") and "chunk-8" not in got
    assert toc.hybrid(outline, one.limit(0)).count() == len(rows)
    tree = cut_lineage(toc.nodes(toc.with_parents(outline)))
    assert {(r.documentId, r.total, r.max_depth) for r in toc.stats(tree).collect()} == {("d", 7, 3), ("e", 3, 2)}
    assert [r.id for r in toc.sections(tree).where("documentId = 'e'").orderBy("section_no").collect()] == ["chunk-1", "chunk-2", "chunk-3"]


def test_model_rescues_doubtful_headings(spark):
    rows = [("d", 1, "title", None, "Título II de la Ley que rige", 1), ("d", 2, "chapter", None, "Capítulo I", 1), ("d", 3, "article", None, "con el artículo", 1)]
    df = spark.createDataFrame(rows, "documentId string, chunkNo int, chunkType string, articleRef string, heading string, startPage int")
    say = lambda sure: lambda v: [f'{{"isStructural": true, "confidence": "{sure}"}}'] * len(v)
    titles = lambda p: sorted(r.chunkNo for r in toc.outline_rows(df, p).collect())
    assert titles(None) == [2] and titles(say("alta")) == [1, 2] and titles(say("baja")) == [2]


def test_outline_in_metadata(spark):
    tree = cut_lineage(toc.nodes(toc.with_parents(spark.createDataFrame([("d", 1, "Título I", 2, 1, False)], "documentId string, chunkNo int, title string, level int, page int, container boolean"))))
    docs = spark.createDataFrame([("d", '{"toc":[1],"kept":{"a":1},"outlineError":"x"}', "abc"), ("e", "no", None)], "documentId string, metadata string, contentHash string")
    got = {r.documentId: r.metadata for r in index.with_outline(docs, tree).collect()}
    assert '"kept":{"a":1}' in got["d"] and '"toc":[{"id":"chunk-1","level":2,"target":{"page":1},"title":"Título I"}]' in got["d"] and '"outlineError":null' in got["d"]
    assert '"toc":[]' in got["e"] and '"totalNodes":0' in got["e"]


_LARGE = """
from pyspark.sql import SparkSession, functions as F
from folioweave.operators import index, toc
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "640m").getOrCreate()
tree = s.createDataFrame([("d0", 1, "chunk-1", None, "T", 2, 1, 1)], "documentId string, position long, node_id string, parent_id string, title string, level int, page int, depth int")
native = s.createDataFrame([("d1", 1, 1, "x", 1)], "documentId string, entry_no int, level int, title string, page int")
text = F.concat(F.lit('{"pageCount":28,"toc":"'), F.repeat(F.lit("0123456789"), 2_000_000), F.lit('"}'))
docs = s.range(0, 4, 1, 2).select(F.concat(F.lit("d"), "id").alias("documentId"), text.alias("metadata"), F.lit("abc").alias("contentHash"))
got = index.with_outline(docs, tree, native).where("metadata LIKE '{\\"outlineError\\":null,\\"pageCount\\":28,%'")
print("kept", got.count(), got.agg(F.max(F.length("metadata")) < 1000).first()[0])
"""


def test_replaced_outlines_take_no_memory(tmp_path):
    run = subprocess.run([sys.executable, "-c", _LARGE], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[1], env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 640m pyspark-shell", "TMPDIR": str(tmp_path)})
    assert "kept 4 True" in run.stdout, run.stderr[-2000:]


def test_metadata_with_long_strings_are_kept(spark):
    tree = spark.createDataFrame([("d", 1, "chunk-1", None, "T", 2, 1, 1)], "documentId string, position long, node_id string, parent_id string, title string, level int, page int, depth int")
    long = F.repeat(F.lit("0123456789"), 2_000_001)
    docs = spark.range(1).select(F.lit("d").alias("documentId"), F.concat(F.lit('{"z":28,"outline":"'), long, F.lit('","toc":"'), long, F.lit('","a":{"b":null}}')).alias("metadata"), F.lit("abc").alias("contentHash"))
    got = index.with_outline(docs, tree).select(F.length("metadata").alias("n"), F.substring("metadata", 1, 40).alias("a"), F.substring("metadata", 20_000_011, 90).alias("b")).first()
    assert got.a == '{"a":{"b":null},"outline":"0123456789012' and '","outlineError":null,"z":28,"outlineManifest":' in got.b and got.n < 20_001_000


def test_extractor_rows(spark):
    drawings = spark.createDataFrame(
        [("d", 1, 0.0, 0.0, 200.0, 40.0, "black", ["re"]), ("d", 1, 0.0, 50.0, 200.0, 90.0, None, ["l"] * 4), ("d", 1, 0.0, 0.0, 60.0, 25.0, "black", ["re"]), ("d", 1, 0.0, 0.0, 200.0, 40.0, "black", ["c"]), ("d", 1, None, 0.0, 9.0, 9.0, None, None)],
        BOX + ", color string, items array<string>",
    )
    assert extraction.visual_frames(drawings).count() == 4 and extraction.visual_rects(drawings).count() == 1 and extraction.visual_rects(drawings, relaxed=True).count() == 2
    boxes = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 30.0, 0.0, 40.0, 10.0), ("d", 1, 14.0, 0.0, 26.0, 10.0), ("d", 1, 0.0, 100.0, 5.0, 105.0), ("d", 2, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert {tuple(r)[1:] for r in extraction.merged_boxes(boxes).collect()} == {(1, 0.0, 0.0, 40.0, 10.0), (1, 0.0, 100.0, 5.0, 105.0), (2, 0.0, 0.0, 1.0, 1.0)}
    native = spark.createDataFrame([(None, " a ", None), (2, None, 0), (1, "b", 7)], "level int, title string, page int")
    assert [tuple(r) for r in extraction.bookmarks(native).collect()] == [(1, "a", 1), (2, "", 1), (1, "b", 7)] and extraction.bookmarks(native, legacy=True).collect()[2].page == 8
    q = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],), (None,)], "r array<double>").select(extraction.quad(F.col("r"))["x1"].alias("x")).collect()
    assert [r.x for r in q] == [3.0, None, None]


def test_tables_are_routed(spark):
    grid = [["Concepto", "Cuota"], ["a", "1"], ["b", "2"]]
    note = [["Nota: texto del recuadro que dice algo de interés para quien lo lee en la página"]]
    talk = [["palabra " * 25]]
    rows = [("d", 1, 1, grid, 0.0, 0.0, 9.0, 9.0), ("d", 1, 2, note, 0.0, 20.0, 9.0, 29.0), ("d", 2, 1, [["", ""]], 0.0, 0.0, 9.0, 9.0), ("d", 2, 2, talk, 0.0, 0.0, 9.0, 9.0), ("d", 2, 3, None, 0.0, 0.0, 9.0, 9.0)]
    found = spark.createDataFrame(rows, "doc_id string, page_number int, table_no int, rows array<array<string>>, x0 double, y0 double, x1 double, y1 double")
    rects = spark.createDataFrame([("d", 2, 0.0, 0.0, 10.0, 10.0)], BOX)
    got = {(r.page_number, r.table_no): (r.table_index, r.is_boxed_note) for r in extraction.routed_tables(found, rects).collect()}
    assert got == {(1, 1): (1, False), (1, 2): (2, True), (2, 2): (3, True)}
    assert extraction.candidate_tables(found).where("table_no = 1 AND page_number = 1").select("row_count", "col_count").first() == (3, 2)


def test_tables_part_paragraphs(spark):
    span = "span_id bigint, doc_id string, page_number int, block_no int, line_no int, span_no int, text string, font_size double, font_name string, is_bold boolean, is_italic boolean, bbox struct<x0: double, y0: double, x1: double, y1: double>"
    spans = spark.createDataFrame([(i, "d", 1, i, 0, 0, t, 10.0, None, False, False, (72.0, y, 500.0, y + 12)) for i, (t, y) in enumerate([("una frase que", 100.0), ("sigue aquí y", 116.0), ("acaba.", 132.0)])], span)
    table = spark.createDataFrame([("d", 1, 72.0, 129.0, 500.0, 131.0)], BOX)
    found = layout.kinds(layout.reading_order(layout.blocks(spans)))
    assert [r.text for r in layout.merged(found, layout.font_sizes(spans)).collect()] == ["una frase que sigue aquí y acaba."]
    assert [r.text for r in layout.merged(found, layout.font_sizes(spans), table).orderBy("reading_order").collect()] == ["una frase que sigue aquí y", "acaba."]
    near = {r.ord: (list(r.context_before), list(r.context_after)) for r in layout.with_neighbours(layout.classified(spans, table)).collect()}
    assert near == {1: ([], ["acaba."]), 2: (["una frase que sigue aquí y"], [])}


def test_headings_are_refined(spark):
    rows = [("a", "generic", None, "considera que", "línea\nOtra cosa", "Ley de Aguas (x)"), ("b", "generic", None, "Objeto", "t", "Ley"), ("c", "article", None, "considera x", "t", "Ley"), ("d", "generic", "Artículo 1", "considera x", "t", "Ley"), ("e", "generic", None, " ", "t", "Ley"), ("f", "generic", None, "casos, se dice", "primera\nCapítulo de prueba", None)]
    df = spark.createDataFrame([(*r, "") for r in rows], "id string, chunkType string, articleRef string, heading string, text string, title string, head string")
    body = lambda prompts: ['{"isSectionTitle": false}'] * len(prompts)
    got = {r.id: (r.outcome, r.new_heading) for r in headings.judged(df, body).collect()}
    assert got == {"a": ("body", "Ley de Aguas"), "b": ("not_suspicious", None), "c": ("not_generic", None), "d": ("has_article_ref", None), "e": ("empty_heading", None), "f": ("body", "Capítulo de prueba")}
    assert {r.outcome for r in headings.judged(df, None).where("id IN ('a', 'f')").collect()} == {"none"}
    total = headings.counters(headings.judged(df, body), []).first()
    assert (total.evaluated, total.changed, total.verdict_body, total.skipped_not_suspicious) == (2, 2, 2, 1)
    assert {r.id: r.heading for r in headings.applied(df, headings.judged(df, body)).collect()}["a"] == "Ley de Aguas"
    flags = spark.createDataFrame([(None, True), (True, False), (True, True), (False, True)], "p boolean, e boolean").select(headings.flags(F.col("p"), F.col("e")).alias("f")).collect()
    assert [tuple(r.f) for r in flags] == [(True, False), (True, True), (True, False), (False, False)]


def test_model_labels_hold_from_a_confidence_on(spark):
    blocks = spark.createDataFrame([("x", "unknown", 0.6, "r"), ("y", "article_heading", 0.95, "r")], "text string, label string, confidence double, reason string")
    sure = lambda v: ['{"label": "annex_body", "confidence": 0.9, "reason": "z"}'] * len(v)
    weak = lambda v: ['{"label": "annex_body", "confidence": 0.5}'] * len(v)
    get = lambda p: [(r.label, r.reason, r.llm_used) for r in providers.refined_labels(blocks, p).orderBy("text").collect()]
    assert get(sure) == [("annex_body", "llm:z", True), ("article_heading", "r", False)]
    assert get(weak)[0] == ("unknown", "llm_low_confidence_fallback:r", False) and get(None)[0] == ("unknown", "r", False)
    verdict = lambda p: spark.createDataFrame([("palabra " * 25,)], "t string").select(providers.routed_verdict(F.col("t"), F.lit(False), F.lit(1), F.lit(1), provider=p).alias("v")).first().v
    assert tuple(verdict(None)) == ("structural", "llm_fallback", "llm_error")
    assert tuple(verdict(lambda v: ['{"kind": "editorial_note", "confidence": "alta", "reasonCode": "fe"}'] * len(v))) == ("editorial_note", "llm_editorial", "fe")
    assert tuple(verdict(lambda v: ['{"kind": "editorial_note", "confidence": "baja"}'] * len(v)))[1] == "llm_fallback"
    waits = []

    class Slow(Exception):
        retry_after = 0.01

    def busy(values):
        waits.append(1)
        raise Slow

    assert providers.asked(["a"], busy, tries=2, wait=100) == [None] and len(waits) == 2
    assert models.MOST_HEADINGS == 40


def test_upserts_and_requests(spark):
    stored = spark.createDataFrame([("p", "t", '{"a":1,"b":2}', "MX")], "blobPath string, title string, metadata string, jurisdiction string")
    new = spark.createDataFrame([("p", "u", '{"b":3}'), ("q", "w" * 600, None)], "blobPath string, title string, metadata string")
    got = {r.blobPath: r for r in index.upsert_documents(stored, new).collect()}
    assert (got["p"].title, got["p"].metadata, got["p"].jurisdiction) == ("u", '{"a":1,"b":3}', "MX") and (len(got["q"].title), got["q"].jurisdiction) == (500, "MX-FEDERAL")
    chunks = spark.createDataFrame([("d", 1), ("d", 2)], "documentId string, chunkNo int")
    vectors = spark.createDataFrame([("d", 2, [2.0]), ("d", 1, [1.0])], "documentId string, chunkNo int, embedding array<float>")
    assert [r.embedding for r in index.with_embeddings(chunks, vectors, ["documentId", "chunkNo"]).orderBy("chunkNo").collect()] == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        index.with_embeddings(chunks, vectors.limit(1), ["documentId", "chunkNo"])
    now = datetime(2030, 1, 1)
    runs = spark.createDataFrame([("a", "processing", None, 1), ("b", "completed", datetime(2020, 1, 1), 2)], "id string, status string, endedAt timestamp, docsIndexed int")
    changed = {r.id: (r.status, r.endedAt, r.docsIndexed) for r in indexing.updated_runs(runs, spark.createDataFrame([("a", "processing", 5)], "id string, status string, docsIndexed int"), now).collect()}
    assert changed == {"a": ("processing", now, 5), "b": ("completed", datetime(2020, 1, 1), 2)}


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("b.pdf", "sub/a.pdf", "c.txt"):
        (tmp_path / "in" / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.discovered(spark, str(tmp_path / "in")).collect()] == ["b.pdf", "a.pdf"]
    with pytest.raises(FileNotFoundError):
        readers.discovered(spark, str(tmp_path / "nowhere"))
    assert readers.probe(spark)
    chunks = spark.range(50).selectExpr("CAST(id AS STRING) AS id", "CAST(id % 3 AS STRING) AS documentId", "CAST(id AS INT) AS chunkNo")
    sinks.write_chunks(chunks, str(tmp_path / "out"), buckets=4, tasks=8)
    sinks.write_chunks(chunks.where("documentId = '1'"), str(tmp_path / "out"), buckets=4, tasks=8)
    assert spark.read.parquet(str(tmp_path / "out")).where("documentId = '1'").count() == 17
    assert sinks.write_debug({"a": chunks, "b": chunks}, str(tmp_path / "dbg"), ["b"]) == ["b"] and (tmp_path / "dbg" / "b").exists() and not (tmp_path / "dbg" / "a").exists()
    sinks.write_failures(spark.createDataFrame([("f", None), ("g", "bad")], "path string, error string"), str(tmp_path / "fail"))
    assert spark.read.option("header", True).csv(str(tmp_path / "fail")).count() == 1
    sinks.write_discarded(spark.createDataFrame([("f", "prose"), ("g", "table")], "id string, verdict string"), str(tmp_path / "disc"))
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "disc")).collect()] == ["f"]
    told = []
    progress = indexing.Progress(told.append, 10)

    class Event:
        class progress:
            numInputRows = 6

    for _ in range(3):
        progress.onQueryProgress(Event)
    progress.onQueryTerminated(None)
    assert told == [12, 18]


def test_requests_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = "550e8400-e29b-41d4-a716-446655440000"
    (tmp_path / "in" / "a.json").write_text(f'{{"runId": "{one}", "categoryId": "{one}", "blobPath": "x.pdf", "documentTitle": "Ley"}}\n{{"runId": "7", "categoryId": "{one}", "blobPath": "x.pdf", "documentTitle": "Ley"}}\n')
    q = indexing.request_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.status, r.error) for r in spark.table("asked").collect()) == [("accepted", None), ("rejected", "runId is no UUID")]
