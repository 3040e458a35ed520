"""Page text from a PDF made readable: line breaks of layout joined, structural breaks kept, hyphenated words made whole.

Three stages: lines of a page in one form; repeated headers dropped across the whole document (a window over narrow keys, see
lines.keep_first_headers); then each page is folded by a table of rules, each of which may take one to three lines.  A page is the
unit of the fold, so a document of any length is spread over tasks.

Defined results: null and empty pages come out empty with an audit of zeros; equal pages delivered twice count once.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import legal
from . import lines as line_ops

PAGE = line_ops.PAGE
#: Examples kept of each page, and characters shown of each line.
EXAMPLES, SHOWN = 10, 40


def _own(pattern: str) -> re.Pattern:
    """A pattern of the JVM side for this side; letters and blanks are Unicode's on both."""
    m = re.match(r"\(\?([iU]+)\)", pattern)
    flags = m[1] if m else ""
    return re.compile(pattern[m.end() if m else 0 :].replace(r"\p{Ll}", "[^\\W\\d_A-ZÁÉÍÓÚÜÑ]"), re.I if "i" in flags else 0)


_PRESERVED = [(_own(p), name) for p, name in legal.PRESERVED]
_OWN_ROW, _BLOCK_START, _MID_WORD, _VERB = _own(legal.OWN_ROW), _own(legal.BLOCK_START), _own(legal.MID_WORD), _own(legal.VERB_START)
_CUT = [_own(p) for p in legal.CUT_AT_END]
_ALONE, _DASH, _TAIL, _LETTER = _own(legal.ARTICLE_ALONE), _own(legal.ARTICLE_DASH), _own(legal.ARTICLE_TAIL), _own(legal.LETTER_ALONE)
_HYPHEN, _WORD = re.compile(r"\s*-\s*$"), re.compile(r"[a-zA-ZáéíóúñüÁÉÍÓÚÑÜ]")


def rule_of(line: str) -> str | None:
    """The first rule that keeps the break before a line."""
    t = line.strip()
    return next((name for p, name in _PRESERVED if p.search(t)), None)


def score(before: str, after: str) -> int:
    """As legal.merge_score."""
    a, b = before.strip(), after.strip()
    if not a or not b:
        return 0
    capitals = b == b.upper() and re.search("[A-Z]", b) and len(b) < 60
    signs = [
        (2, a[-1] not in ".?!;:"), (1, a[-1] in ",(\"'"), (1, re.match(r"[a-záéíóúñü0-9]", b)), (1, len(b) > 20),
        (-2, capitals), (-2, len(b) < 10 and not re.search(r"[.,;:?!-]", b)), (-1, a[-1] in ")]"),
    ]
    return sum(points for points, sign in signs if sign)


def _stray(a: str, b: str) -> bool:
    """As legal.stray_blank."""
    a, b = a.strip(), b.strip()
    if not a or not b or not (any(p.search(a) for p in _CUT) or _MID_WORD.match(b) or _VERB.match(b)):
        return False
    return score(a, b) >= 2 and not _BLOCK_START.match(b) and rule_of(b) is None


def _glued(a: str, b: str) -> str:
    """Two lines around a stray blank; halves of a word without a space."""
    a, b = a.rstrip(), b.strip()
    halves = a[-1:].isalpha() and b[:1].islower() and (_CUT[0].search(a) or _CUT[2].search(a) or _MID_WORD.match(b))
    return a + b if halves else f"{a} {b}".strip()


def prepared(text: str | None) -> list[str]:
    """Lines without runs of blanks; the letter of an article that stands on a line of its own joins its article."""
    if not text:
        return []
    out: list[str] = []
    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = re.sub(r"\s{2,}", " ", raw).rstrip()
        last = out[-1].strip() if out else ""
        if _LETTER.match(line.strip()) and last and not getattr(out[-1], "closed", False):
            if _ALONE.search(last):
                out[-1] = _Closed(last + line.strip())
                continue
            if _DASH.search(last):
                out[-1] = _Closed(last.rstrip("-").rstrip() + "-" + line.strip())
                continue
        out.append(line)
    return out


class _Closed(str):
    """A line that has taken its letter and takes no other."""

    closed = True


@dataclass
class Fold:
    """The lines of one page on their way to text."""

    lines: list[str]
    at: int = 0
    open: str = ""
    out: list[str] = field(default_factory=list)
    merges: int = 0
    hyphens: int = 0
    kept: Counter = field(default_factory=Counter)
    examples: list[tuple[str, str, str, str]] = field(default_factory=list)

    @property
    def line(self) -> str:
        return self.lines[self.at]

    def ahead(self, n: int = 1) -> str | None:
        return self.lines[self.at + n] if self.at + n < len(self.lines) else None

    def grow(self, text: str, taken: int) -> None:
        self.open = f"{self.open} {text}" if self.open else text
        self.at += taken

    def put(self, text: str) -> None:
        """Ends the open paragraph and sets a line of its own."""
        if self.open:
            self.out.append(self.open)
        self.open = ""
        self.out.append(text)
        self.at += 1

    def show(self, after: str, action: str, rule: str) -> None:
        if len(self.examples) < EXAMPLES:
            self.examples.append((self.line[-SHOWN:], after[:SHOWN], action, rule))


def _blank(f: Fold) -> bool:
    if f.line == "":
        f.put("")
        return True
    return False


def _masthead(f: Fold) -> bool:
    if _OWN_ROW.match(f.line.strip()):
        f.put(f.line)
        return True
    return False


def _hyphen(f: Fold) -> bool:
    after = f.ahead()
    if after is None or not _HYPHEN.search(f.line) or not _WORD.match(after.strip()):
        return False
    if _TAIL.search(f.line):  # the hyphen belongs to an article's number
        f.merges += 1
        f.grow(f.line.rstrip() + after.strip(), 2)
        return True
    f.hyphens += 1
    f.show(after, "hyphen_join", "hyphen_word_split")
    f.grow(_HYPHEN.sub("", f.line) + after.strip(), 2)
    return True


def _structural(f: Fold) -> bool:
    after = f.ahead()
    rule = rule_of(after) if after else None
    if rule and after:
        f.show(after, "preserve", rule)
    rule = rule or rule_of(f.line)
    if rule:
        f.kept[rule] += 1
        f.put(f.line)
    return bool(rule)


def _over_blank(f: Fold) -> bool:
    beyond = f.ahead(2)
    if f.ahead() is None or f.ahead().strip() or not beyond or not _stray(f.line, beyond):
        return False
    f.merges += 1
    f.show(beyond, "merge", "skip_blank_merge")
    f.grow(_glued(f.line, beyond), 3)
    return True


def _before_masthead(f: Fold) -> bool:
    after = f.ahead()
    if not after or not _OWN_ROW.match(after.strip()):
        return False
    whole = f"{f.open} {f.line.strip()}".strip() if f.open else f.line
    f.open = ""
    if whole.strip():
        f.out.append(whole)
    f.at += 1
    return True


def _onward(f: Fold) -> bool:
    after = f.ahead()
    points = score(f.open or f.line, after) if after else 0
    if points < 2:
        return False
    f.merges += 1
    f.show(after, "merge", f"score={points}")
    f.grow(f"{f.line} {after.strip()}", 2)
    return True


def _backward(f: Fold) -> bool:
    if not f.open or score(f.open, f.line) < 2:
        return False
    f.merges += 1
    f.grow(f.line.strip(), 1)
    return True


def _alone(f: Fold) -> bool:
    f.put(f.line)
    return True


#: The rules in the order in which a line meets them; the last always holds.
RULES: list[Callable[[Fold], bool]] = [_blank, _masthead, _hyphen, _structural, _over_blank, _before_masthead, _onward, _backward, _alone]


def _without_stray_blanks(rows: list[str]) -> list[str]:
    out, at = [], 0
    while at < len(rows):
        window = rows[at : at + 3]
        if len(window) == 3 and not window[1].strip() and _stray(window[0], window[2]):
            out.append(_glued(window[0], window[2]))
            at += 3
        else:
            out.append(rows[at])
            at += 1
    return out


def _finished(text: str) -> str:
    tidy = lambda t: re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t)).strip()
    return tidy(re.sub(r"\s*\d+\s+de\s+\d+\s*", " ", tidy(text)))


def fold(rows: list[str], collapse: bool = True) -> tuple[str, dict]:
    """The text of a page's lines and the audit: lines, merges, hyphen joins, breaks kept by rule, examples."""
    rows = _without_stray_blanks(rows) if collapse else rows
    f = Fold(rows)
    while f.at < len(rows):
        next(rule for rule in RULES if rule(f))
    text = _finished("\n".join(f.out + ([f.open] if f.open else []))) if rows else ""
    ratio = f.merges / len(rows) if rows else 0.0
    return text, {"total_lines_raw": len(rows), "total_lines_after": len(text.split("\n")) if rows else 0, "merges_applied": f.merges, "merge_ratio": ratio, "hyphen_joins": f.hyphens, "preserved": dict(f.kept), "examples": f.examples}


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[str(x) for x in prepared(t)] for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.string()))], names=[*PAGE, "rows"])


_OUT = "text string, headers_removed int, total_lines_raw int, total_lines_after int, merges_applied int, merge_ratio double, hyphen_joins int, preserved string, examples array<string>"


def _fold_batches(collapse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.string())]
        names = [c.split()[0] for c in _OUT.split(", ")]
        for b in batches:
            made = []
            for rows, before in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                rows = rows or []
                text, audit = fold(rows, collapse)
                shown = [" | ".join((action, rule, a, z)) for a, z, action, rule in audit["examples"]]
                made.append((text, before - len(rows), *(audit[k] for k in names[2:7]), json.dumps(audit["preserved"], ensure_ascii=False, sort_keys=True), shown))
            cols = list(zip(*made)) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*PAGE, *names])

    return run


def normalised_pages(pages: DataFrame, collapse: bool = True) -> DataFrame:
    """doc_id, page_number, text and its audit. Of a header line that a document repeats only the first stays."""
    kind = f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, page_number {pages.schema['page_number'].dataType.simpleString()}"
    one = line_ops.distinct_pages(pages)
    rows = one.mapInArrow(_line_batches, f"{kind}, rows array<string>")
    before = rows.select(*PAGE, F.size("rows").alias("before"))
    flat = rows.select(*PAGE, F.posexplode("rows").alias("line_no", "line"))
    kept = line_ops.keep_first_headers(flat)
    per = kept.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("rows"))
    ready = before.join(per, PAGE, "left").select(*PAGE, "rows", "before")
    return ready.mapInArrow(_fold_batches(collapse), f"{kind}, {_OUT}")


def audit_totals(normalised: DataFrame) -> DataFrame:
    """Per document: pages, lines, merges, hyphen joins and headers removed."""
    names = ["total_lines_raw", "total_lines_after", "merges_applied", "hyphen_joins", "headers_removed"]
    return normalised.groupBy("doc_id").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in names])
