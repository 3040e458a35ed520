"""Flattening of nested outline JSON into linked flat tables through Merkle subtree identities.

Every outline node is canonicalised (its own scalar fields in key order, then the hashes of its
target and of its children in order) and hashed bottom-up.  Identical objects are stored once;
bridge rows (parent hash, ordinal, child hash) keep the tree of the stored objects, and occurrence
rows keep each place an object takes in a document (its number, its parent's number).

Defined results: null, blank or invalid JSON gives no rows; a JSON text inside a JSON string is
opened; a single object stands for a list of one; nulls and scalars among children are skipped;
of several rows for one id the one with the greatest updatedAt counts (null the least, ties by the
greater metadata text).  All walks are iterative, so depth is bounded by memory only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTLINE_KEY = "toc"

_ROWS = (
    "document_id string, node_ord int, parent_ord int, sibling_no int, depth int, "
    "obj_hash binary, target_hash binary, node_id string, title string, level string, "
    "target_page string, target_offset string, target_extra string, extra string, child_hashes array<binary>, title_is_text boolean"
)
_ARROW = pa.schema(
    [
        ("document_id", pa.string()),
        ("node_ord", pa.int32()),
        ("parent_ord", pa.int32()),
        ("sibling_no", pa.int32()),
        ("depth", pa.int32()),
        ("obj_hash", pa.binary()),
        ("target_hash", pa.binary()),
        ("node_id", pa.string()),
        ("title", pa.string()),
        ("level", pa.string()),
        ("target_page", pa.string()),
        ("target_offset", pa.string()),
        ("target_extra", pa.string()),
        ("extra", pa.string()),
        ("child_hashes", pa.list_(pa.binary())),
        ("title_is_text", pa.bool_()),
    ]
)

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|"((?:[^"\\\x00-\x1f]|\\.)*)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])|(true|false|null)\b)'
)


def _parse_iteratively(text: str):
    """JSON without recursion, for nesting beyond the interpreter's stack."""
    pos, stack, done, result = 0, [], False, None
    # stack entries: [container, pending key, state]; states: what may come next
    expect = "value"
    n = len(text)
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            if text[pos:].strip(" \t\n\r") or not done:
                raise ValueError("not JSON")
            return result
        if done:
            raise ValueError("not JSON")
        pos = m.end()
        punct, string, number, word = m.groups()
        value, have = None, False
        if punct:
            if punct in "{[":
                if expect not in ("value", "value_or_end"):
                    raise ValueError("not JSON")
                stack.append([{} if punct == "{" else [], None])
                expect = "key_or_end" if punct == "{" else "value_or_end"
                continue
            if punct in "}]":
                if not stack or isinstance(stack[-1][0], dict) != (punct == "}"):
                    raise ValueError("not JSON")
                if expect not in ("comma_or_end", "key_or_end" if punct == "}" else "value_or_end"):
                    raise ValueError("not JSON")
                value, have = stack.pop()[0], True
            elif punct == ",":
                if expect != "comma_or_end" or not stack:
                    raise ValueError("not JSON")
                expect = "key" if isinstance(stack[-1][0], dict) else "value"
                continue
            else:
                if expect != "colon":
                    raise ValueError("not JSON")
                expect = "value"
                continue
        elif string is not None:
            value = json.loads(f'"{string}"')
            if expect in ("key", "key_or_end"):
                stack[-1][1] = value
                expect = "colon"
                continue
        elif number is not None:
            value = json.loads(number)
        else:
            value = {"true": True, "false": False, "null": None}[word]
        if not have and expect not in ("value", "value_or_end"):
            raise ValueError("not JSON")
        if not stack:
            result, done = value, True
        else:
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            expect = "comma_or_end"
        if pos >= n and not done:
            raise ValueError("not JSON")


def parse_json(text: str | None):
    """The value, or None where the text is null, blank or not JSON."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return _parse_iteratively(text)
        except ValueError:
            return None
    except ValueError:
        return None


def _opened(value):
    """A JSON text in a string, in however many strings: each opening makes it shorter."""
    while isinstance(value, str):
        value = parse_json(value)
    return value


def _objects(value) -> list[dict]:
    """The objects of a children or toc value."""
    value = _opened(value)
    if isinstance(value, dict):
        return [value]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _locate(value) -> tuple[dict | None, list[dict]]:
    """The object that holds the outline, and the outline's nodes."""
    level = [value]
    while level:
        below = []
        for x in level:
            if isinstance(x, dict):
                if OUTLINE_KEY in x and (found := _objects(x[OUTLINE_KEY])):
                    return x, found
                below += [v for k, v in x.items() if k != OUTLINE_KEY]
            elif isinstance(x, list):
                below += x
        level = [x for x in below if isinstance(x, (dict, list))]
    return None, []


def find_outline(value) -> list[dict]:
    """The nodes under the outline key: the shallowest such key, at one depth the first written, that holds nodes."""
    return _locate(_opened(value))[1]


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return _canonical(value)


def _write_iteratively(value) -> str:
    """The text of _canonical by an explicit stack."""
    out, todo = [], [(value, False)]
    while todo:
        x, written = todo.pop()
        if written:
            out.append(x)
        elif isinstance(x, dict):
            out.append("{")
            todo.append(("}", True))
            for i, k in reversed(list(enumerate(sorted(x)))):
                todo += [(x[k], False), (("," if i else "") + json.dumps(k, ensure_ascii=False) + ":", True)]
        elif isinstance(x, list):
            out.append("[")
            todo.append(("]", True))
            for i, v in reversed(list(enumerate(x))):
                todo += [(v, False), ("," if i else "", True)]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _canonical(value) -> str:
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except RecursionError:
        return _write_iteratively(value)


def _digest(*parts: bytes) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.digest()[:16]


def flatten_document(metadata: str | None) -> list[list]:
    """Occurrence rows of one document in the order written, with Merkle hashes."""
    rows: list[list] = []  # node_ord, parent_ord, sibling_no, depth, hash, target_hash, ... child hashes
    todo = [(node, 0, i, 1) for i, node in enumerate(find_outline(parse_json(metadata)), 1)][::-1]
    while todo:
        node, parent, sibling, depth = todo.pop()
        ord_ = len(rows) + 1
        target = _opened(node.get("target")) if isinstance(node.get("target"), str) else node.get("target")
        page, offset = (target.get("page"), target.get("offset")) if isinstance(target, dict) else (target, None)
        beside = {k: v for k, v in target.items() if k not in ("page", "offset")} if isinstance(target, dict) else None
        extra = {k: v for k, v in node.items() if k not in ("id", "title", "level", "target", "children")}
        rows.append(
            [ord_, parent, sibling, depth, None, None if target is None else _digest(b"target", _canonical(target).encode("utf-8", "surrogatepass"))]
            + [_scalar(node.get(k)) for k in ("id", "title", "level")]
            + [_scalar(page), _scalar(offset), _canonical(beside) if beside else None, _canonical(extra) if extra else None, [], node.get("title") is None or isinstance(node.get("title"), str)]
        )
        todo += [(c, ord_, i, depth + 1) for i, c in reversed(list(enumerate(_objects(node.get("children")), 1)))]
    for r in reversed(rows):  # children follow their parent, so their hashes are ready first
        r[13].reverse()
        own = json.dumps([r[6], r[7], r[8], r[12]], ensure_ascii=False).encode("utf-8", "surrogatepass")
        r[4] = _digest(b"node", own, r[5] or b"", *r[13])
        if r[1]:
            rows[r[1] - 1][13].append(r[4])
    return rows


def _clean(text: str | None) -> str | None:
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in _ARROW]
        for doc, meta in zip(batch.column(0), batch.column(1)):
            doc_id = doc.as_py()
            for r in flatten_document(meta.as_py()):
                cols[0].append(doc_id)
                for c, v in zip(cols[1:], r):
                    c.append(_clean(v) if isinstance(v, str) else v)
            if len(cols[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
                cols = [[] for _ in _ARROW]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def newest_rows(documents: DataFrame, key: str = "id", order: str = "updatedAt", value: str = "metadata") -> DataFrame:
    """One row per key: the value of the row with the greatest order column. Aggregates before the shuffle."""
    return (
        documents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("document_id"))
        .agg(F.max(F.struct(F.col(order).alias("at"), F.col(value).alias("value"))).alias("m"))
        .select("document_id", F.col("m.value").alias("metadata"))
    )


def outline_occurrences(documents: DataFrame) -> DataFrame:
    """One row per outline node of each document, in the order written."""
    return newest_rows(documents).mapInArrow(_flatten_batches, _ROWS)


def outline_objects(occurrences: DataFrame) -> DataFrame:
    """Each distinct outline object once. Equal hashes have equal fields, so any row serves; first() pre-aggregates hot objects."""
    fields = ["node_id", "title", "level", "target_hash", "extra"]
    return occurrences.groupBy("obj_hash").agg(
        *[F.first(c).alias(c) for c in fields], F.count("*").alias("occurrences"), F.first(F.size("child_hashes")).alias("children")
    )


def outline_targets(occurrences: DataFrame) -> DataFrame:
    """Each distinct target once, with its fields besides page and offset."""
    return (
        occurrences.where(F.col("target_hash").isNotNull())
        .groupBy("target_hash")
        .agg(F.first("target_page").alias("page"), F.first("target_offset").alias("offset"), F.first("target_extra").alias("extra"), F.count("*").alias("occurrences"))
    )


def outline_bridge(occurrences: DataFrame) -> DataFrame:
    """Parent-child rows between stored objects; ordinal keeps the order of children."""
    return (
        occurrences.select("obj_hash", F.posexplode("child_hashes").alias("pos", "child_hash"))
        .select(F.col("obj_hash").alias("parent_hash"), (F.col("pos") + 1).alias("ordinal"), "child_hash")
        .distinct()
    )


_FIELDS = "document_id string, value_ord int, parent_ord int, key string, position int, kind string, value string, value_hash binary, child_hashes array<binary>"
_FIELDS_ARROW = pa.schema(
    [("document_id", pa.string()), ("value_ord", pa.int32()), ("parent_ord", pa.int32()), ("key", pa.string()), ("position", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("value_hash", pa.binary()), ("child_hashes", pa.list_(pa.binary()))]
)


def _kind(value) -> str:
    if value is None:
        return "null"
    return {dict: "object", list: "array", str: "string", bool: "boolean"}.get(type(value), "number")


def flatten_fields(metadata: str | None) -> list[list]:
    """Occurrence rows of all values of one document besides its outline, in the order written, with Merkle hashes.

    value_ord, parent_ord (0 for the document's value itself), key in an object, position from 1, kind, value of scalars, hash, children's hashes.
    """
    value = _opened(parse_json(metadata))
    if not isinstance(value, (dict, list)):
        return []
    holder, _ = _locate(value)
    rows: list[list] = []
    todo = [(value, 0, None, 1)]
    while todo:
        x, parent, key, position = todo.pop()
        kind = _kind(x)
        rows.append([len(rows) + 1, parent, key, position, kind, None if kind in ("null", "object", "array") else _scalar(x), None, []])
        me = len(rows)
        inner = [(k, v) for k, v in x.items() if not (x is holder and k == OUTLINE_KEY)] if kind == "object" else [(None, v) for v in x] if kind == "array" else []
        todo += [(v, me, k, i) for i, (k, v) in reversed(list(enumerate(inner, 1)))]
    for r in reversed(rows):
        parts = r[7][::-1]
        if r[4] == "object":  # the order of an object's keys is no part of its identity
            parts.sort()
        r[6] = _digest(r[4].encode(), (r[5] or "").encode("utf-8", "surrogatepass"), *(x for p in parts for x in p))
        r[7] = [h for _, h in r[7][::-1]]
        if r[1]:
            rows[r[1] - 1][7].append((("" if r[2] is None else r[2]).encode("utf-8", "surrogatepass"), r[6]))
    return rows


def _field_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in _FIELDS_ARROW]
        for doc, meta in zip(batch.column(0), batch.column(1)):
            for r in flatten_fields(meta.as_py()):
                cols[0].append(doc.as_py())
                for c, v in zip(cols[1:], r):
                    c.append(_clean(v) if isinstance(v, str) else v)
            if len(cols[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIELDS_ARROW)], schema=_FIELDS_ARROW)
                cols = [[] for _ in _FIELDS_ARROW]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIELDS_ARROW)], schema=_FIELDS_ARROW)


def field_occurrences(documents: DataFrame) -> DataFrame:
    """One row per value of each document's metadata besides its outline, linked to its parent value."""
    return newest_rows(documents).mapInArrow(_field_batches, _FIELDS)


def field_values(occurrences: DataFrame) -> DataFrame:
    """Each distinct value once: objects and arrays alike in all their content have one hash."""
    return occurrences.groupBy("value_hash").agg(
        F.first("kind").alias("kind"), F.first("value").alias("value"), F.first(F.size("child_hashes")).alias("children"), F.count("*").alias("occurrences")
    )
