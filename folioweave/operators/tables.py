"""Extracted tables as arrays of rows of cells: filters, header folding, Markdown, figures of discarded tables.

A null or empty table is prose (to be dropped), never a tariff or a note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal

#: Words by which the header of a tariff table is told.
TARIFF_WORDS = ["cuota", "rango", "superior", "inferior", "límite", "limite"]
NOTE = r"(?iU)(?:ACLARACI[OÓ]N|Nota\s*de\s+erratas|Fe\s+de\s+erratas|N\.\s*de\s+E\.|NOTA\s+DEL\s+EDITOR|Nota\s*:\s|Art[íi]culo\s+(?:reformad[oa]|adicionad[oa]|derogad[oa]))"


def from_markdown(text: Column) -> Column:
    """Rows of cells of the Markdown table lines of a text; the rule under the header is dropped."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^\s*\|[\s|:\-]+\|\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(legal.strip(x), r"^\||\|$", ""), r"\|"), legal.strip))


def cells(rows: Column) -> Column:
    """All cells with text."""
    return F.filter(F.transform(F.flatten(rows), legal.strip), lambda c: c != "")


def figures(rows: Column) -> Column:
    """struct(rows, filled_rows, columns, cells, numeric_share, mean_length)."""
    c = cells(rows)
    n = F.size(c)
    filled = F.size(F.filter(rows, lambda r: F.exists(r, lambda x: legal.strip(x) != "")))
    return F.struct(
        F.size(rows).alias("rows"), filled.alias("filled_rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("columns"), n.alias("cells"),
        F.when(n > 0, F.size(F.filter(c, lambda x: x.rlike(r"\d"))) / n).otherwise(F.lit(0.0)).alias("numeric_share"),
        F.when(n > 0, F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x)) / n).otherwise(F.lit(0.0)).alias("mean_length"),
    )


def tariff_like(rows: Column, f: Column) -> Column:
    head = F.lower(F.array_join(F.get(rows, F.lit(0)), " "))
    worded = F.lit(False)
    for w in TARIFF_WORDS:
        worded = worded | head.contains(w)
    return F.coalesce((f["rows"] >= 2) & (worded | ((f["cells"] > 0) & (f["numeric_share"] >= 0.4) & (f["rows"] >= 3))), F.lit(False))


def prose_like(rows: Column, f: Column, relax: bool = False) -> Column:
    """Grids that are prose in columns, to be dropped."""
    wide = (f["filled_rows"] <= 2) & (f["columns"] >= 8)
    if relax:
        wide = wide & ~((f["cells"] > 0) & (f["numeric_share"] >= 0.5))
    thin = (f["cells"] > 0) & (f["columns"] >= 6) & (f["mean_length"] < 15) & (f["numeric_share"] < 0.35)
    narrow = (f["cells"] > 0) & f["columns"].between(4, 5) & (f["mean_length"] < 10) & (f["numeric_share"] < 0.25)
    kept_wide = (f["filled_rows"] <= 2) & (f["columns"] >= 8) & ~wide
    drop = (f["filled_rows"] == 0) | wide | (~kept_wide & (thin | narrow))
    return F.coalesce(~tariff_like(rows, f) & drop, F.lit(True))


def boxed_note(rows: Column, f: Column) -> Column:
    """Editorial notes set in a box of one or two columns."""
    text = F.array_join(cells(rows), " ")
    plain = (f["columns"] == 1) & (F.length(text) > 100) & (f["filled_rows"] <= 5) & (legal.word_count(text) >= 10)
    return F.coalesce(~tariff_like(rows, f) & (f["filled_rows"] > 0) & (f["columns"] <= 2) & (text != "") & (text.rlike(NOTE) | plain), F.lit(False))


def merged_header(rows: Column) -> Column:
    """The rows with digit-free rows of equal width after the first folded into it."""
    start = F.struct(F.get(rows, F.lit(0)).alias("head"), F.slice(rows, 1, 0).alias("body"), F.lit(True).alias("open"))

    def step(a, r):
        fold = a["open"] & (F.size(r) == F.size(a["head"])) & ~F.exists(r, lambda c: c.rlike(r"\d"))
        head = F.when(fold, F.zip_with(a["head"], r, lambda x, y: legal.strip(F.concat_ws(" ", x, y)))).otherwise(a["head"])
        body = F.when(fold, a["body"]).otherwise(F.concat(a["body"], F.array(r)))
        return F.struct(head.alias("head"), body.alias("body"), fold.alias("open"))

    got = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)
    return F.when(F.size(rows) > 1, F.concat(F.array(got["head"]), got["body"])).otherwise(rows)


def to_markdown(rows: Column, index: Column) -> Column:
    """A Markdown table between [TABLE_n] marks; ragged rows are padded, empty heads named Col n, bars escaped."""
    width = F.array_max(F.transform(rows, F.size))
    clean = lambda c: F.regexp_replace(legal.strip(F.coalesce(c, F.lit(""))), r"\|", r"\\|")
    padded = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: clean(F.try_element_at(r, i))))
    head = F.transform(F.get(padded, F.lit(0)), lambda c, i: F.when(c == "", F.concat(F.lit("Col "), (i + 1).cast("string"))).otherwise(c))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)
    mark = F.concat(F.lit("[TABLE_"), index.cast("string"), F.lit("]"))
    return F.when(F.size(rows) > 0, F.concat(mark, F.lit("\n"), F.array_join(F.concat(F.array(line(head), rule), body), "\n"), F.lit("\n"), mark))


def judged(df: DataFrame, rows: str = "rows", relax: bool = False) -> DataFrame:
    """Adds the figures and the verdict: tariff, note, prose or table."""
    got = df.withColumn("figures", figures(F.col(rows)))
    r, f = F.col(rows), F.col("figures")
    verdict = F.when(tariff_like(r, f), "tariff").when(boxed_note(r, f), "note").when(prose_like(r, f, relax), "prose").otherwise("table")
    return got.withColumn("verdict", verdict)
