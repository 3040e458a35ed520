import json
from datetime import datetime

from folioweave.operators import nested as N


def nodes(value):
    return [(r[0], r[1], r[6], r[7]) for r in N.flatten_document(json.dumps(value))]


def test_order_and_parents():
    toc = [{"id": "a", "children": [{"id": "b", "children": {"id": "c"}}, None, {"id": "d"}]}, {"id": "e", "children": '[{"id": "f"}]'}]
    assert [(o, p, i) for o, p, i, _ in nodes({"toc": toc})] == [(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d"), (5, 0, "e"), (6, 5, "f")]


def test_where_the_outline_stands():
    assert [x[2] for x in nodes({"x": {"y": {"toc": {"id": "q"}}}, "previousToc": [{"id": "no"}]})] == ["q"]
    assert [x[2] for x in nodes(json.dumps({"toc": [{"id": "s"}]}))] == ["s"]
    for bad in (None, "", "  ", "{", "[]", "null", '{"toc": null}', '{"toc": [1, "x", null]}', '{"toc": {"id": 1}'):
        assert N.flatten_document(bad) == []


def test_deep_nesting_is_iterative():
    depth = 30_000
    text = '{"toc": ' + '[{"title": "t", "children": ' * depth + "[]" + "}]" * depth + "}"
    rows = N.flatten_document(text)
    assert len(rows) == depth and rows[-1][1] == depth - 1


def test_iterative_parser_agrees():
    for v in ({"a": [1, -2.5, "x\\u00e9\"\n", True, None, {}, []], "b": {"c": [[]]}}, [], "s", 3, {"k": "}]"}):
        assert N._parse_iteratively(json.dumps(v)) == v
    for bad in ("", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "1 2", '{1:2}', "]", "nul"):
        try:
            N._parse_iteratively(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_equal_objects_have_one_identity():
    leaf = {"title": "Artículo 1", "level": 5, "target": {"page": 2}}
    rows = N.flatten_document(json.dumps({"toc": [{"title": "A", "children": [leaf]}, {"title": "B", "children": [dict(reversed(leaf.items()))]}]}))
    assert rows[1][4] == rows[3][4] and rows[0][4] != rows[2][4]


def test_tables(spark):
    t = datetime(2024, 1, 1)
    rows = [
        ("d", '{"toc": [{"id": "old"}]}', t, "x"),
        ("d", '{"toc": [{"id": "new", "target": {"page": 1}}, {"id": "new", "target": {"page": 1}}]}', datetime(2024, 2, 1), "x"),
        ("d", '{"toc": [{"id": "never"}]}', None, "x"),
        ("e", None, t, "x"),
        (None, '{"toc": [{"id": "z"}]}', t, "x"),
    ]
    df = spark.createDataFrame(rows, "id string, metadata string, updatedAt timestamp, obj_hash string")
    occ = N.outline_occurrences(df).cache()
    assert [(r.document_id, r.node_ord, r.node_id) for r in occ.orderBy("node_ord").collect()] == [("d", 1, "new"), ("d", 2, "new")]
    assert N.outline_objects(occ).count() == 1 and N.outline_targets(occ).count() == 1 and N.outline_bridge(occ).count() == 0
    assert N.outline_occurrences(df.limit(0)).count() == 0


def test_found_matches_recursion(spark):
    d = "/root/testdata/sf0.001"
    from folioweave.plans import load

    got = {(r.document_id, r.node_ord, r.parent_ord) for r in load()[0]["p5_found"](spark, d).collect()}
    want = set()
    newest = {}
    for r in spark.read.parquet(f"{d}/legal_documents.parquet").select("id", "updatedAt", "metadata").collect():
        if r.id not in newest or r.updatedAt > newest[r.id][0]:
            newest[r.id] = (r.updatedAt, r.metadata)

    def walk(doc, value, parent, n):
        value = json.loads(value) if isinstance(value, str) else value
        for x in [value] if isinstance(value, dict) else value or []:
            if isinstance(x, dict):
                n[0] += 1
                me = n[0]
                want.add((doc, me, parent))
                walk(doc, x.get("children"), me, n)

    def find(value):
        if isinstance(value, dict):
            if "toc" in value:
                return value["toc"]
            return next((f for v in value.values() if (f := find(v)) is not None), None)

    for doc, (_, meta) in newest.items():
        try:
            value = json.loads(meta)
            value = json.loads(value) if isinstance(value, str) else value
        except (TypeError, ValueError):
            continue
        walk(doc, find(value), 0, [0])
    assert got == want


def test_deep_values_keep_their_content():
    from folioweave.operators import nested

    value = {"b": [1, 2.5, None, True, {"ñ": "á\n", "a": []}], "a": {}, "c": [[], {"x": "\""}]}
    assert nested._write_iteratively(value) == nested._canonical(value)
    deep = lambda x: "[" * 50_000 + x + "]" * 50_000
    a, b, c = (nested.flatten_document(f'{{"toc": [{{"title": "t", "note": {deep(x)}, "target": {{"page": 1, "at": {deep(y)}}}}}]}}')[0] for x, y in (("1", "1"), ("2", "1"), ("1", "2")))
    assert a[4] != b[4] != c[4] != a[4] and a[5] == b[5] != c[5]
    assert a[12] == '{"note":' + deep("1") + "}"


def test_strings_in_strings():
    text = '{"toc": [{"id": "s"}]}'
    for _ in range(14):
        text = json.dumps(text)
    assert [r[6] for r in N.flatten_document(text)] == ["s"]


def test_targets_keep_their_fields():
    a, b = N.flatten_document('{"toc": [{"target": {"page": 1, "offset": 2, "kind": "x"}}, {"target": 7}]}')
    assert a[9:12] == ["1", "2", '{"kind":"x"}'] and b[9:12] == ["7", None, None]


def test_fields_besides_the_outline(spark):
    meta = {"a": {"toc": [{"id": 1}], "n": 2.5}, "sections": [{"t": "x", "u": None}, {"u": None, "t": "x"}, []], "toc": []}
    rows = N.flatten_fields(json.dumps(json.dumps(meta)))
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows] == [
        (1, 0, None, 1, "object", None), (2, 1, "a", 1, "object", None), (3, 2, "n", 1, "number", "2.5"), (4, 1, "sections", 2, "array", None),
        (5, 4, None, 1, "object", None), (6, 5, "t", 1, "string", "x"), (7, 5, "u", 2, "null", None), (8, 4, None, 2, "object", None),
        (9, 8, "u", 1, "null", None), (10, 8, "t", 2, "string", "x"), (11, 4, None, 3, "array", None), (12, 1, "toc", 3, "array", None),
    ]
    assert rows[4][6] == rows[7][6] != rows[10][6] == rows[11][6]
    assert N.flatten_fields(None) == N.flatten_fields("{") == N.flatten_fields("7") == []
    deep = N.flatten_fields('{"k":' + "[" * 50_000 + "]" * 50_000 + "}")
    assert len(deep) == 50_001
    df = spark.createDataFrame([("d", json.dumps(meta), 1), ("e", json.dumps(meta), 1), ("f", None, 1)], "id string, metadata string, updatedAt int")
    occ = N.field_occurrences(df)
    assert occ.count() == 24 and N.field_values(occ).where("kind = 'object'").agg({"occurrences": "sum"}).first()[0] == 8
    assert N.field_values(occ).count() == len({r[6] for r in rows})
