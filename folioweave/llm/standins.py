"""One consistent form for text that looks alike but is made of other characters.

Arrow text is copied to code-point arrays; a lookup table maps or drops single characters, an
expansion table with offsets writes those that stand for several, and combining marks are reordered
and composed with their bases by sorted-key lookups over the whole array.  Look-alike letters are
changed only in words that hold a Latin letter or consist of look-alikes alone, so words wholly in
another script stay, as do signs with a meaning of their own.

Defined results: null stays null (no case), empty stays empty, blanks are made ordinary spaces, runs
of blanks one space, none at the ends.  Line feeds count as blanks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I", "а": "a", "е": "e",
    "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "ү": "y", "ґ": "r",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Latin and Armenian
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g",
}
#: Hyphens that look like the ordinary one.
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]
#: Signs of these blocks have a meaning of their own: letterlike, number forms' fractions, mathematical letters.
_SIGNS = [(0x2100, 0x214F), (0x2150, 0x215F), (0x2189, 0x2189), (0x1D400, 0x1D7FF)]

KEEP, BLANK, DROP, MAP, EXPAND = 0, 1, 2, 3, 4
#: Letter kinds for the word rule.
NO_LETTER, LATIN, ALIKE, OTHER, MARK, GREEK, CYRILLIC = range(7)


@lru_cache(maxsize=1)
def tables():
    """action, value, expansion offsets, expansions and letter kind by code point; sorted composition keys and results; combining classes."""
    size = 0x110000
    action, value = np.zeros(size, np.uint8), np.arange(size, dtype=np.uint32)
    kind, ccc = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    expansions: list[int] = []
    spans: list[tuple[int, int]] = [(0, 0)]
    keys, made = [], []
    for cp in range(size):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        ccc[cp] = unicodedata.combining(ch)
        if cat[0] == "L":
            name = unicodedata.name(ch, "")
            kind[cp] = LATIN if cp < 0x250 or "LATIN" in name else GREEK if name.startswith("GREEK") else CYRILLIC if name.startswith("CYRILLIC") else OTHER
        elif cat[0] == "M":
            kind[cp] = MARK
        if cat == "Cf" and not 0x600 <= cp <= 0x605 or 0xFE00 <= cp <= 0xFE0F or cp == 0x34F or cat == "Cc" and cp not in arrays.WHITE:
            action[cp] = DROP
            continue
        form = unicodedata.decomposition(ch)
        if not form or any(a <= cp <= b for a, b in _SIGNS):
            continue
        parts = form.split()
        if parts[0][0] != "<":
            if len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                keys.append(int(parts[0], 16) << 21 | int(parts[1], 16))
                made.append(cp)
            elif unicodedata.normalize("NFC", ch) != ch:  # singletons and excluded compositions
                parts = [f"{ord(c):X}" for c in unicodedata.normalize("NFC", ch)]
            else:
                continue
            if cp in made[-1:]:
                continue
        elif parts[0] in ("<wide>", "<narrow>") or parts[0] == "<compat>" and all(c.isascii() and c.isalpha() for c in unicodedata.normalize("NFKC", ch)):
            parts = [f"{ord(c):X}" for c in unicodedata.normalize("NFKC", ch)]
        else:
            continue
        whole = [int(x, 16) for x in parts]
        if len(whole) == 1:
            action[cp], value[cp] = MAP, whole[0]
        else:
            action[cp], value[cp] = EXPAND, len(spans)
            spans.append((len(expansions), len(whole)))
            expansions += whole
        if cat[0] in "LN" and whole[0] < 0x250:
            kind[cp] = LATIN
    action[arrays.WHITE] = BLANK
    action[0x20] = KEEP
    action[HYPHENS], value[HYPHENS] = MAP, 0x2D
    alike = np.zeros(size, np.uint32)
    for a, b in LOOKALIKES.items():
        alike[ord(a)] = ord(b)
        kind[ord(a)] = ALIKE
    order = np.argsort(np.array(keys, np.int64))
    starts, counts = np.array(spans, np.int64).T
    return action, value, starts, counts, np.array(expansions, np.uint32), kind, alike, np.array(keys, np.int64)[order], np.array(made, np.uint32)[order], ccc


def _rows_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def _rebuild(keep: np.ndarray, off: np.ndarray) -> np.ndarray:
    before = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return before[off]


def _alike_places(cps: np.ndarray, off: np.ndarray, t) -> np.ndarray:
    """True where a look-alike stands for a Latin letter. Invisible characters don't part a word."""
    kind, action = t[5], t[0]
    k = kind[cps]
    found = k == ALIKE
    if not found.any():
        return found
    inword = (k != NO_LETTER) | (action[cps] == DROP)
    begins = inword.copy()
    begins[1:] &= ~inword[:-1]
    begins[off[:-1][off[:-1] < len(cps)]] = True
    word = np.cumsum(begins)
    words = int(word[-1]) + 1
    latin = np.bincount(word[k == LATIN], minlength=words) > 0
    out = np.zeros(len(cps), bool)
    greek = (cps >= 0x370) & (cps < 0x400)
    cyrillic = (cps >= 0x400) & (cps < 0x530)
    for script, mine in ((GREEK, greek), (CYRILLIC, cyrillic), (OTHER, ~greek & ~cyrillic)):
        own = np.bincount(word[k == script], minlength=words) > 0
        out |= found & mine & (latin | ~own)[word]
    return out


def _apart(cps: np.ndarray, off: np.ndarray, cc: np.ndarray, keys: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composed letters before a mark as base and mark, so that all their marks are ordered together."""
    order = np.argsort(made)
    whole, parts = made[order], keys[order]
    todo = np.zeros(len(cps), bool)
    todo[:-1] = (cc[1:] > 0) & (cc[:-1] == 0)
    while todo.any():
        at = np.flatnonzero(todo)
        slot = np.minimum(np.searchsorted(whole, cps[at]), len(whole) - 1)
        hit = whole[slot] == cps[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            break
        size = np.ones(len(cps), np.int64)
        size[at] = 2
        before = np.append(0, np.cumsum(size))
        cps, off = np.repeat(cps, size), before[off]
        cps[before[at]], cps[before[at] + 1] = parts[slot] >> 21, parts[slot] & 0x1FFFFF
        todo = np.zeros(len(cps), bool)
        todo[before[at]] = True
    return cps, off


def _compose(cps: np.ndarray, off: np.ndarray, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical order and composition of marks. Third result: rows in which a mark was composed or moved."""
    keys, made, ccc = t[7], t[8], t[9]
    changed = np.zeros(len(off) - 1, bool)
    cc = ccc[cps]
    if not cc.any():
        return cps, off, changed
    given, given_off = cps, off
    cps, off = _apart(cps, off, cc, keys, made)
    cc = ccc[cps]
    cps, row = cps.copy(), _rows_of(off)
    while True:  # marks of a higher class go behind those of a lower one
        swap = np.flatnonzero((cc[:-1] > cc[1:]) & (cc[1:] > 0) & (row[:-1] == row[1:]))
        swap = swap[np.append(True, np.diff(swap) > 1)] if len(swap) else swap
        if not len(swap):
            break
        cps[swap], cps[swap + 1] = cps[swap + 1], cps[swap].copy()
        cc[swap], cc[swap + 1] = cc[swap + 1], cc[swap].copy()
        changed[row[swap]] = True
    n = len(cps)
    starter = np.where(cc == 0, np.arange(n), -1)
    np.maximum.accumulate(starter, out=starter)
    alive, failed = np.ones(n, bool), np.zeros(n, bool)
    todo = np.flatnonzero(cc > 0)
    todo = todo[(starter[todo] >= 0)]
    todo = todo[row[starter[todo]] == row[todo]]
    prev_class = np.zeros(n, np.uint8)  # of the last kept mark behind a starter
    while len(todo):  # each round takes the first open mark of every starter
        first = np.append(True, starter[todo][1:] != starter[todo][:-1])
        at = todo[first]
        base = starter[at]
        key = cps[base].astype(np.int64) << 21 | cps[at].astype(np.int64)
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = (keys[slot] == key) & (prev_class[base] < cc[at])
        cps[base[hit]] = made[slot[hit]]
        alive[at[hit]] = False
        changed[row[at[hit]]] = True
        prev_class[base[~hit]] = cc[at[~hit]]
        todo = todo[~first]
    cps, off = cps[alive], _rebuild(alive, off)
    # a row taken apart and put together again as it was
    for i in np.flatnonzero(changed & (np.diff(off) == np.diff(given_off))):
        changed[i] = not np.array_equal(cps[off[i] : off[i + 1]], given[given_off[i] : given_off[i + 1]])
    return cps, off, changed


def normalise(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The one form of each row, and whether the row held a stand-in character."""
    t = tables()
    action, value, starts, counts, expansions, _, alike = t[:7]
    cps, off = arrays.code_points(arr)
    act = action[cps]
    case = np.zeros(len(off) - 1, bool)
    row = _rows_of(off)
    case[row[act != KEEP]] = True
    looks = _alike_places(cps, off, t)
    case[row[looks]] = True
    out = np.where(looks, alike[cps], value[cps])
    out[act == BLANK] = 0x20
    size = np.ones(len(cps), np.int64)
    size[act == DROP] = 0
    big = act == EXPAND
    if big.any():
        size[big] = counts[value[cps[big]]]
    before = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    made = np.repeat(out, size)
    if big.any():
        span = value[cps[big]].astype(np.int64)
        made[arrays.repeat_ranges(before[:-1][big], counts[span])] = expansions[arrays.repeat_ranges(starts[span], counts[span])]
    made, off, composed = _compose(made, before[off], t)
    case |= composed
    # blanks: one between words, none at the ends
    blank = made == 0x20
    keep = ~blank
    if blank.any():
        edge = np.zeros(len(made) + 1, bool)
        edge[off] = True
        first = blank.copy()
        first[1:] &= keep[:-1] | edge[1:-1]
        ends = np.zeros(len(made), bool)  # a run of blanks that touches a row's begin or end
        at = np.flatnonzero(first)
        size_of = np.diff(np.append(at, len(made)))
        nonblank_after = np.append(np.flatnonzero(keep), len(made))
        stop = nonblank_after[np.searchsorted(nonblank_after, at)]
        row_end = off[np.searchsorted(off, at, "right")]
        ends[at] = edge[at] | (stop >= row_end)
        keep |= first & ~ends
    made, off = made[keep], _rebuild(keep, off)
    text = arrays.strings(made, off)
    if arr.null_count:
        text = pa.compute.if_else(arr.is_valid(), text, pa.scalar(None, pa.large_string()))
    return text, case


def _normalise_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        for part in arrays.slices(batch, 2):
            text, case = normalise(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text.cast(pa.string()), pa.array(case)], names=["src", "rec_id", "norm_text", "is_case"])


def normalise_text(df: DataFrame, src: str, key: str, text: str) -> DataFrame:
    """src, rec_id, norm_text and is_case of each row whose key and text aren't null. A map over the scan, no shuffle.

    Pure ASCII texts without control characters can't hold a stand-in but still take part: their blanks are unified.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.lit(src).alias("src"), F.col(key).cast("string").alias("rec_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_normalise_batches, "src string, rec_id string, norm_text string, is_case boolean")
