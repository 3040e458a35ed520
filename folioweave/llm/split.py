"""Splitting oversized texts at natural boundaries by recursive bisection.

A text longer than its limit is cut at the strongest boundary near its midpoint; halves still
longer than limit minus overlap are cut again; then each piece but the first is given the last
overlap characters of what stands before it.  So every piece holds at most limit characters, and
the bodies without overlaps join to the text as stored.

Defined results: null ids and null texts give no piece; blank and short texts aren't cut; an overlap of half the limit or more is taken as half the limit less one;
a limit below 2 is taken as 2; without any boundary the cut falls in the middle, but never before a
combining mark.  Several limit rows for one type: the smallest limit holds.  A type that is null or
unlisted takes the generic row; without a generic row such texts are not cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Boundaries from the weakest to the strongest: blank, comma, line, clause, sentence, enumerated item, paragraph, heading.
_BOUNDARIES = [
    (1, re.compile(r"\s+")),
    (2, re.compile(r",\s+")),
    (3, re.compile(r"\n")),
    (4, re.compile(r"[;:]\s+")),
    (5, re.compile(r"[.!?…][»”\")]*\s+")),
    (6, re.compile(r"\n(?=\s*(?:[IVXLC]+|[a-zñ]|\d{1,3})[.)][-–]?\s)")),
    (7, re.compile(r"\n[^\S\n]*\n\s*")),
    (8, re.compile(r"\n(?=\s*(?:art[íi]culo|t[íi]tulo|cap[íi]tulo|secci[óo]n|libro|anexo|transitorios?|section|article|chapter)\b)", re.I)),
]


def boundary_strength(text: str) -> np.ndarray:
    """For each position the strength of a cut before the character there."""
    s = np.zeros(len(text) + 1, np.int8)
    for k, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            s[m.end()] = max(k, s[m.end()])
    return s


def cut_points(text: str, most: int) -> list[int]:
    """Ends of pieces of at most `most` characters."""
    strength = boundary_strength(text)
    ends, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            ends.append(b)
            continue
        mid, cut = (a + b) // 2, 0
        for reach in ((b - a) // 4, (b - a) // 2 - 1):
            lo, hi = max(a + 1, mid - reach), min(b - 1, mid + reach)
            if hi < lo:
                continue
            near = strength[lo : hi + 1]
            best = near.max()
            if best > 0:
                at = np.flatnonzero(near == best) + lo
                cut = int(at[np.argmin(np.abs(at - mid))])
                break
        if not cut:
            cut = mid
            while cut > a + 1 and 0x300 <= ord(text[cut]) <= 0x36F:
                cut -= 1
        todo += [(cut, b), (a, cut)]
    return ends


def split_text(text: str, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    """(piece, start in the text, overlap taken from the piece before)."""
    limit = max(2, limit)
    if len(text) <= limit:
        return [(text, 0, 0)]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    out, start = [], 0
    for end in cut_points(text, limit - overlap):
        lead = min(overlap, start)
        out.append((text[start - lead : end], start - lead, lead))
        start = end
    return out


_ARROW = pa.schema(
    [("chunk_id", pa.string()), ("chunkType", pa.string()), ("articleRef", pa.string()), ("piece_no", pa.int32()), ("pieces", pa.int32()),
     ("start_char", pa.int32()), ("overlap", pa.int32()), ("piece", pa.string())]
)
_ROWS = "chunk_id string, chunkType string, articleRef string, piece_no int, pieces int, start_char int, overlap int, piece string"


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = split_text(r["text"], r["max_chars"], r["overlap_chars"])
            rows += [(r["id"], r["chunkType"], r["articleRef"], i, len(parts), at, lead, piece) for i, (piece, at, lead) in enumerate(parts, 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Each chunk with its limit. The limits are a fixed small table: Spark broadcasts it by its own size check."""
    key = F.lower(F.trim(F.col("chunktype")))
    lim = limits.where(F.col("max_chars").isNotNull()).groupBy(key.alias("_k")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("_l"))
    generic = lim.select(F.col("_k").alias("_gk"), F.col("_l").alias("_g"))
    got = chunks.select("id", "chunkType", "articleRef", "text", F.lower(F.trim(F.col("chunkType"))).alias("_t"))
    got = got.join(lim, got["_t"] == lim["_k"], "left").join(generic, F.when(F.col("_l").isNull(), "generic") == F.col("_gk"), "left")
    got = got.withColumn("_m", F.coalesce("_l", "_g"))
    return got.select("id", "chunkType", "articleRef", "text", F.col("_m.max_chars").alias("max_chars"), F.coalesce("_m.overlap_chars", F.lit(0)).alias("overlap_chars"))


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every chunk whose text is longer than its type's limit.

    Texts within the limit never leave the JVM: the length filter runs before Python.  Only the oversized
    rows are shuffled, to count a chunk delivered twice once (its longest text, then the greatest text).
    """
    long = with_limits(chunks, limits).where(F.col("id").isNotNull() & (F.length("text") > F.col("max_chars")))
    w = Window.partitionBy("id").orderBy(F.length("text").desc(), F.col("text").desc(), F.col("chunkType").desc_nulls_last(), F.col("articleRef").desc_nulls_last())
    one = long.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.mapInArrow(_split_batches, _ROWS)


def oversized_ids(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """p1_found: ids of the chunks that the splitter cut."""
    return split_oversized(chunks, limits).where((F.col("pieces") > 1) & (F.col("piece_no") == 1)).select("chunk_id").distinct()
