import random

from folioweave.llm import scanrepair as S

WORDS = "el la de que consejo directivo podrá autorizar recurso sanitario antes diligencia técnico administrativa técnico-administrativa humedal forestal inscripción obligación artículo hoja".split()


def reader():
    return S.Reader(WORDS, [100] * len(WORDS), heads=S.forms_of("Última actualización 01-01-2001"))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_look_up_is_complete():
    words = [w for w in WORDS if w.isalpha()] + ["responsabilidad", "ñandú", "sanitaria"]
    trie = S.Trie(words, [1] * len(words))
    rnd = random.Random(1)
    asked = ["", "xx", "artxculo", "obligcion", "artículu", "responsbilidad", "responsabilldad", "sanitari(", "ñandu", "🙂" * 9]
    for _ in range(400):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", *"aeiosrt(0ñ"])
        asked.append("".join(w))
    got = S.look_up(trie, asked, at_once=37)
    for i, w in enumerate(asked):
        most = 0 if len(w) < 4 else 1 if len(w) < S.LONG else 2
        near = {n for n, v in enumerate(trie.words) if _distance(w, v) <= most}
        have = {n: c for c, n in got.get(i, [])}
        assert near <= set(have), w
        assert all(have[n] <= S.EDITED * _distance(w, trie.words[n]) for n in near), w
    for meant, read in S.CONFUSIONS:
        for w in words:
            at = w.find(meant)
            if at >= 0 and len(w) > 5:
                bad = w[:at] + read + w[at + len(meant) :]
                assert trie.words.index(w) in {n for _, n in S.look_up(trie, [bad])[0]}, bad
    two = S.look_up(trie, ["c0nscjo"])
    assert trie.words[two[0][0][1]] == "consejo" and two[0][0][0] == 2 * S.CONFUSED
    assert S.look_up(S.Trie([], []), ["abc"]) == {} and S.look_up(trie, []) == {}


def test_misreadings_outside_the_confusions():
    pairs = [S.pair_key(*p.split()) for p in ("consejo directivo", "directivo podrá", "recurso sanitario", "sanitario antes", "la obligación", "obligación de")]
    r = S.Reader(WORDS, [100] * len(WORDS), pairs)
    text = "el consejo dixectivo podrá\nla obligacin de sani(ario\nla Obligacin de\nel xonsejo\nla técnica\nla obligacin"
    r.learn(set(text.split()))
    assert S.faults(r, text, False) == [(1, "misread"), (2, "misread")]  # a capital may be a name; without known neighbours nothing is told
    assert S.repair(r, text, False) == "el consejo directivo podrá la obligación de sanitario la Obligacin de el xonsejo la técnica la obligacin"


def test_heads_by_repetition():
    assert S.forms_of("Boletín Municipal de Avisos, Toluca    12") == S.forms_of("Bo1etín Munlcipal de Avisos, Toluca")
    assert S.forms_of("Boletín Municipal de Avisos, Toluca")[1] == S.forms_of("Boletín Municipal de Avisos, Jalapa")[1]
    assert S.forms_of("Capítulo tercero de la ley") == () and S.forms_of("que sigue la frase") == () and S.forms_of("La ley rige. El consejo") == ()
    r = S.Reader(WORDS, [100] * len(WORDS), heads=S.forms_of("Boletín Municipal de Avisos, Toluca"))
    assert r.furniture("Boletín Municipal de Avisos, Jalapa", False) and not r.furniture("Boletín Municipal de Avisos, Jalapa", True)
    assert not r.furniture("Boletín Municipal y Avisos, Jalapa", False)
    text = "Gaceta Comunal\nel consejo\npodrá\nAlgo de en medio\nautorizar\nla obligación"
    assert [(n, apart) for n, _, apart in S.head_places(text, False, True)] == [(1, True), (4, False)]
    assert [(n, apart) for n, _, apart in S.head_places(text, True, False)] == [(4, True)]


def test_lines_that_need_repair():
    r = reader()
    text = "\n".join(
        [
            "LEY DE RECURSO SANITARIO DE LOS HUMEDALES",  # 1 the title where it opens
            "el consejo podrá autori-",  # 2 broken
            "zar el recurso técnico-",  # compound
            "administrativa antes de la",
            "",
            "12 / 40",  # 6
            "diligcncia forestal que",  # 7 misread
            "9   12   7",
            "Hoja 3",  # 9
            "artículo 9.",
            "LEY DE RECURSO SANITARIO DE LOS HUMEDALES",  # 11
            "TÍTULO CUARTO DE LOS RECURSOS DEL HUMEDAL",
            "Última actualización 03-05-2016",  # 13
            "el humeda¬",  # 14
        ]
    )
    r.learn(set(text.split()))
    assert S.faults(r, text, True) == [(2, "broken"), (6, "furniture"), (7, "misread"), (9, "furniture"), (11, "furniture"), (13, "furniture"), (14, "broken")]
    assert S.faults(r, text, False)[0] == (1, "furniture")
    assert S.faults(r, "", False) == [] and S.faults(r, " \n\n", True) == []


def test_repair():
    r = reader()
    text = "El consejo directivo podrá autori-\nzar el recurso técnico-\n12 / 40\nadministrativa antes de la diligcncia.\nII. El humedal\nforestal."
    assert S.repair(r, text, False) == "El consejo directivo podrá autorizar el recurso técnico-administrativa antes de la diligencia.\nII. El humedal forestal."
    assert S.repair(r, "", False) == "" and S.repair(r, "Hoja 3", False) == ""


def test_names_and_numbers_stay():
    r = reader()
    for token in ("Topiaciape", "14-A", "9o.", "XVIII", "DC", "2010", "https://a.b/c0d", "x@y1.mx", "adnjb7kpm9bdge0p5cj193", "n.º"):
        assert not r.misread(token), token


def test_operator(spark):
    base = "el consejo directivo podrá autorizar el recurso sanitario antes de la diligencia forestal\n" * 40
    chunks = spark.createDataFrame(
        [("a", 2, base, 1), ("b", 1, "el c0nsejo directivo\npodrá auto-\nrizar", 1), ("b", 1, "el c0nsejo directivo\npodrá auto-\nrizar", 1), ("c", 2, None, 1), ("d", None, "", 1), (None, 1, "Hoja 1", 1)],
        "id string, chunkNo int, text string, src int",
    )
    pages = spark.createDataFrame([("p", 2, "Hoja 2\nel recurso"), ("p", None, "Hoja 2"), ("q", 1, None)], "doc_id string, page_number int, text string")
    place = "span_id bigint, doc_id string, page_number int, block_no int, line_no int, span_no int, text string"
    spans = spark.createDataFrame(
        [(1, "p", 1, 0, 0, 0, "Pág."), (2, "p", 1, 0, 0, 1, "7"), (3, "p", 1, 1, 0, 0, "el recur-"), (4, "p", 1, 1, 1, 0, "so"), (4, "p", 1, 1, 1, 0, "so"), (5, None, None, None, None, None, "c0nsejo"), (6, "p", 1, 1, 2, 0, None)], place
    )
    got = {tuple(r) for r in S.found(chunks, pages, spans).collect()}
    assert got == {("chunk", "b", 1), ("chunk", "b", 2), ("page", "p:2", 1), ("span", "1", 1), ("span", "2", 1), ("span", "3", 1), ("span", "5", 1)}
    fixed = {r.rec_id: r.text for r in S.repaired(chunks, pages, spans).collect()}
    assert fixed["b"] == "el consejo directivo podrá autorizar" and fixed["p:2"] == "el recurso" and fixed["d"] == ""
    assert S.found(chunks.limit(0), pages.limit(0), spans.limit(0)).count() == 0


def test_repaired_spans(spark):
    base = "el consejo directivo podrá autorizar el recurso sanitario antes de la diligencia forestal técnico-administrativa\n" * 40
    chunks = spark.createDataFrame([("a", 2, base)], "id string, chunkNo int, text string")
    pages = spark.createDataFrame([], "doc_id string, page_number int, text string")
    rows = [
        (1, "p", 2, 0, 0, 0, "Pág."), (2, "p", 2, 0, 0, 1, "7"),  # a page number in two spans
        (3, "p", 2, 1, 0, 0, "el c0nsejo"), (4, "p", 2, 1, 0, 1, "podrá auto-"),
        (5, "p", 2, 1, 1, 0, "Hoja 3"),
        (6, "p", 2, 1, 2, 0, "rizar el recurso técnico-"), (7, "p", 2, 1, 3, 0, "administrativa"), (7, "p", 2, 1, 3, 0, "administrativa"),
        (8, "p", 2, 1, 4, 0, "antes de la dili-"), (9, "p", 2, 1, 5, 0, "Consejo"),  # what follows isn't there
        (10, None, None, None, None, None, "fo-"), (11, None, None, None, None, None, "restal"), (12, "p", 2, None, None, None, "recur-"), (13, "p", 2, 1, 6, 0, None),
    ]
    spans = spark.createDataFrame(rows, "span_id bigint, doc_id string, page_number int, block_no int, line_no int, span_no int, text string")
    got = [(r.rec_id, r.text) for r in S.repaired(chunks, pages, spans).where("src = 'span'").collect()]
    assert len(got) == 12 and dict(got) == {
        "1": "", "2": "", "3": "el consejo", "4": "podrá autorizar", "5": "", "6": "el recurso técnico-administrativa", "7": "",
        "8": "antes de la dili-", "9": "Consejo", "10": "fo-", "11": "restal", "12": "recur-",
    }


def test_words_broken_between_pages(spark):
    base = "el consejo directivo podrá autorizar el recurso sanitario antes de la diligencia forestal técnico-administrativa\n" * 40
    chunks = spark.createDataFrame([("a", 2, base), ("b", 3, "podrá auto-")], "id string, chunkNo int, text string")
    texts = [
        ("p", 1, "el consejo podrá auto-\n12 / 40"), ("p", 2, "Hoja 2"),  # carried over a page without text
        ("p", 3, "Hoja 3\nrizar, el recurso técnico-"), ("p", 4, "administrativa"), ("p", 5, "antes de la dili-"), ("p", 6, "Consejo directivo"),
        ("q", 1, "la dili-"), ("q", 3, "gencia"), ("q", 4, "auto-"), ("q", 5, "ri-"), ("q", 6, "zar el recurso"),
    ]
    pages = spark.createDataFrame(texts + texts[:1], "doc_id string, page_number int, text string")
    rows, n = [], 0
    for doc, page, text in texts:
        for k, line in enumerate(text.split("\n")):
            n += 1
            rows.append((n, doc, page, 1, k, 0, line))
    lost = [(90, "r", 1, 1, 0, 0, "la dili-"), (91, "r", 1, None, None, None, "antes"), (92, "r", 2, 1, 0, 0, "gencia"), (93, "s", 1, 1, 0, 0, "la feda-"), (94, "s", 2, None, None, None, "tario"), (95, "s", 2, 1, 0, 0, "forestal")]
    spans = spark.createDataFrame(rows + lost, "span_id bigint, doc_id string, page_number int, block_no int, line_no int, span_no int, text string")
    got = {(r.src, r.rec_id): r.text for r in S.repaired(chunks, pages, spans).collect()}
    want = {
        "p:1": "el consejo podrá autorizar,", "p:2": "", "p:3": "el recurso técnico-administrativa", "p:4": "", "p:5": "antes de la dili-", "p:6": "Consejo directivo",
        "q:1": "la dili-", "q:3": "gencia", "q:4": "autori-", "q:5": "zar", "q:6": "el recurso",
    }
    assert {i: t for (s, i), t in got.items() if s == "page"} == want and got["chunk", "b"] == "podrá auto-"
    joined = {}
    for n, doc, page, *_ in rows:
        joined.setdefault(f"{doc}:{page}", []).append(got["span", str(n)])
    assert {k: " ".join(x for x in v if x) for k, v in joined.items()} == want
    assert [got["span", str(i)] for i in range(90, 96)] == ["la diligencia", "antes", "", "la feda-", "tario", "forestal"]


def test_unseen_heads_are_found_by_repetition(spark):
    body = "el consejo directivo podrá autorizar el recurso sanitario antes de la diligencia forestal"
    pages = [(f"d{d}", p, f"Boletín Municipal de Avisos, Ciudad{'abcdefgh'[d]}\n{body}\nal fin") for d in range(8) for p in (2, 3) if (d, p) != (7, 3)]
    pages += [("e", p, f"{body}\nde la\nRevista del Notariado\nx\ny\nz\nRevista de un Solo Lugar") for p in (1, 2)]
    pages += [("f", 1, f"Anales de Toga\n{body}\nla ley"), ("f", 2, f"Anales de Toga    2\n{body}\nla ley"), ("g", 2, f"Memorias de Puerto\n{body}\nla ley")]
    pages = spark.createDataFrame(pages + pages[:3], "doc_id string, page_number int, text string")
    chunks = spark.createDataFrame(
        [("a", "f", 2, f"{body} la\nAnales de Toga\nley que rige."), ("b", "z", 2, f"{body} la\nBoletín Municipal de Avisos, Otra\nley"), ("c", "z", 2, "Fin.\nMemorias de Puerto\nLey")],
        "id string, documentId string, chunkNo int, text string",
    )
    spans = spark.createDataFrame([(1, "f", 3, 0, 0, 0, "Anales de"), (2, "f", 3, 0, 0, 1, "Toga"), (3, "f", 3, 1, 1, 0, body)], "span_id bigint, doc_id string, page_number int, block_no int, line_no int, span_no int, text string")
    got = {tuple(r) for r in S.found(chunks, pages, spans).collect()}
    want = {("page", f"d{d}:{p}", 1) for d in range(8) for p in (2, 3) if (d, p) != (7, 3)}
    want |= {("page", "f:2", 1), ("span", "1", 1), ("span", "2", 1), ("chunk", "b", 2)} | {("page", f"e:{p}", 7) for p in (1, 2)}
    assert got == want | {("chunk", "a", 2)}
    fixed = {(r.src, r.rec_id): r.text for r in S.repaired(chunks, pages, spans).collect()}
    assert fixed["chunk", "a"] == f"{body} la ley que rige." and fixed["page", "f:1"].startswith("Anales") and fixed["span", "1"] == "" and "Anales" not in fixed["page", "f:2"]


def test_empty_tables_and_no_vocabulary(spark):
    chunks = spark.createDataFrame([("a", "d", 1, "ab c0d"), ("b", "d", 2, "")], "id string, documentId string, chunkNo int, text string")
    pages = spark.createDataFrame([("d", 1, "Título\nuno dos-"), ("d", 2, "tres")], "doc_id string, page_number int, text string")
    spans = spark.createDataFrame([(1, "d", 1, 0, 0, 0, "x")], "span_id bigint, doc_id string, page_number int, block_no int, line_no int, span_no int, text string")
    fixed = {(r.src, r.rec_id): r.text for r in S.repaired(chunks, pages, spans).collect()}
    assert set(fixed) == {("chunk", "a"), ("chunk", "b"), ("page", "d:1"), ("page", "d:2"), ("span", "1")} and fixed["chunk", "b"] == ""
    assert S.repaired(chunks.limit(0), pages.limit(0), spans.limit(0)).count() == 0
    assert S.found(chunks, pages.limit(0), spans.limit(0)).where("src <> 'chunk'").count() == 0
