"""Repair of text from scanned pages: broken words, misread words, running heads and page numbers.

A first pass over the whole collection counts words, pairs of neighbouring words and forms of head-like
lines; what passes a share of all is known, so that the sizes are bounded by the shares whatever the data.

Misread words: every word outside the vocabulary is looked up by intersecting a weighted Levenshtein
automaton with a trie of the vocabulary, breadth-first over many words at once.  Its edits are any
insertion, deletion or replacement (one, from LONG letters on two) and, at less cost, the confusions of
scanning (two at most); all candidates within the bound are found.  Candidates by confusions, or for
words with a sign among their letters, are taken as they are; candidates by other edits only where the
words beside them are known neighbours of the candidate, and never for words with a capital of their
own, which may be names.  Rank: cost, neighbours, standing elsewhere in the same text, frequency.

Page furniture: page numbers and lines in capitals by their shape; other running heads by repetition: a
form of line (its words with numbers as marks, also with the last word left open) that over all records
mostly stands apart, at the edges of pages or interrupting a sentence; and a line apart that several
pages or several chunks of the same document repeat.  Then lines are joined into paragraphs.

Defined results: null and blank texts have no lines to repair and come out null or empty; lines are
parted by line feeds alone and blank ones are counted; equal keys delivered twice count once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import arrays, standins

#: A word, a pair of neighbouring words and a form of running heads is known from EVIDENCE times and a share of all words, of all words, of all head-like lines on.
EVIDENCE = 3
KNOWN_SHARE, PAIR_SHARE, HEAD_SHARE = 6e-6, 2e-6, 1e-5
#: Share of its places in which a form of running heads stands apart from the text.
APART = 0.6
#: What scanning makes of letters (as meant, as read).
CONFUSIONS = [
    ("o", "0"), ("ó", "6"), ("ó", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("g", "9"), ("b", "6"), ("z", "2"), ("e", "c"), ("a", "e"),
    ("i", "l"), ("l", "i"), ("í", "i"), ("í", "¡"), ("i", "!"), ("í", "!"), ("í", "f"), ("í", "l"), ("n", "ri"), ("ri", "n"), ("m", "rn"), ("rn", "m"),
    ("d", "cl"), ("cl", "d"), ("u", "ii"), ("t", "f"), ("f", "t"), ("v", "y"), ("l", "|"), ("h", "li"), ("m", "nn"),
]
#: Confusions that also part common words of the language count only beside another sign of misreading.
_WEAK = {("í", "i"), ("l", "i"), ("í", "l"), ("f", "t"), ("rn", "m"), ("cl", "d"), ("h", "li"), ("m", "nn")}
#: Costs of a confusion, of a weak one and of any other insertion, deletion or replacement; bounds: two confusions
#: for words of up to 3 letters, else one free edit, from LONG letters on two.
CONFUSED, WEAKLY, EDITED, LONG = 10, 20, 21, 9

#: Forms of page numbers.
_NUMBER = re.compile(
    r"\s*(?:[-–—\[(|*]*\s*\d{1,5}\s*[-–—\])|*]*|(?:p\s*[áa6]\s*g\s*(?:i\s*n\s*a)?|h[o0][jl]a|f[o0]l[i1l]o|page)\s*\.?\s*(?:n[.º°o]*\s*)?\d{1,5}(?:\s*(?:de|/|of)\s*\d{1,5})?|\d{1,5}\s*(?:/|de|of)\s*\d{1,5})\s*",
    re.I,
)
_STRUCTURE = re.compile(r"(?:t[íi]tulo|cap[íi]tulo|secci[óo]n|libro|transitorios?|art[íi]culo|anexo|apartado|parte)\b", re.I)
_CAPITALS = re.compile(r"\s*(?:\d{1,5}\s{2,})?([^\d|]\S+(?:\s+\S+){3,}?)(?:\s{2,}\d{1,5})?\s*$")
_BROKEN = re.compile(r"(\w*[^\W\d_])(\s?)([-¬­‐])\s*$")
_FIRST_WORD = re.compile(r"\s*([^\W\d_]+)")
_ROMAN = re.compile(r"[IVXLCDM]+$")
_UNSURE = "\x01"
_STRIP = re.compile(r"^[^\w¡!|]+|[^\w|]+$")


class Trie:
    """The vocabulary as sorted (node, letter) keys."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words = sorted(set(words))
        count = dict(zip(words, counts))
        self.counts = np.array([count[w] for w in self.words], np.int64)
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for w in self.words for c in w}))}
        self.size = len(self.letters) + 1
        self.end = [-1]
        edges: dict[int, int] = {}
        for n, w in enumerate(self.words):
            node = 0
            for c in w:
                key = node * self.size + self.letters[c]
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(self.end)
                    self.end.append(-1)
                node = nxt
            self.end[node] = n
        self.end = np.array(self.end, np.int64)
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.first = np.searchsorted(self.keys, np.arange(len(self.end) + 1) * self.size)
        # letters at least and at most from a node to the end of a word; children have greater numbers than their parent
        self.least = np.where(self.end >= 0, 0, 1 << 30)
        self.most = np.where(self.end >= 0, 0, -1)
        for parent, child in sorted(((k // self.size, v) for k, v in edges.items()), reverse=True, key=lambda e: e[1]):
            self.least[parent] = min(self.least[parent], self.least[child] + 1)
            self.most[parent] = max(self.most[parent], self.most[child] + 1)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child under the letter, or -1."""
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node * self.size + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (letter > 0) & (node >= 0), self.to[at], -1)

    def code(self, text: str) -> list[int]:
        return [self.letters.get(c, 0) for c in text]


def bound_of(word: str) -> int:
    return WEAKLY if len(word) < 4 else EDITED if len(word) < LONG else 2 * EDITED


def look_up(trie: Trie, words: list[str], bounds: list[int] | None = None, at_once: int = 400) -> dict[int, list[tuple[int, int]]]:
    """All candidates of each word: (cost, number in the vocabulary). bounds: the greatest cost of each word, by default bound_of."""
    if not len(trie.words):
        return {}
    bounds = [bound_of(w) for w in words] if bounds is None else bounds
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    out: dict[int, list[tuple[int, int]]] = {}
    for k in range(0, len(order), at_once):
        part = order[k : k + at_once]
        got = _look_up(trie, [words[i] for i in part], np.array([bounds[i] for i in part], np.int64))
        out.update((part[i], c) for i, c in got.items())
    return out


def _look_up(trie: Trie, words: list[str], bound: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    width = max(map(len, words)) + 3
    raw = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        raw[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    top = int(raw.max()) + 1
    table = np.zeros(top, np.int64)
    for c, k in trie.letters.items():
        if ord(c) < top:
            table[ord(c)] = k
    letter = table[raw]
    rules = [(np.array(trie.code(a)), [ord(c) for c in b], WEAKLY if (a, b) in _WEAK else CONFUSED) for a, b in CONFUSIONS if all(c in trie.letters for c in a)]
    q, node, pos, cost = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    found: dict[int, dict[int, int]] = {}
    while len(q):
        done = (pos == size[q]) & (trie.end[node] >= 0)
        for i, n, c in zip(q[done].tolist(), trie.end[node[done]].tolist(), cost[done].tolist()):
            best = found.setdefault(i, {})
            best[n] = min(c, best.get(n, c))
        parts = []
        inside = pos < size[q]
        nxt = trie.step(node, letter[q, pos])
        ok = (nxt >= 0) & inside
        parts.append((q[ok], nxt[ok], pos[ok] + 1, cost[ok]))
        for meant, read, price in rules:
            at = np.flatnonzero((raw[q, pos] == read[0]) & (cost + price <= bound[q]))
            if len(read) == 2:
                at = at[raw[q[at], pos[at] + 1] == read[1]]
            if not len(at):
                continue
            there = node[at]
            for m in meant:
                there = trie.step(there, np.full(len(there), m))
            ok = there >= 0
            parts.append((q[at[ok]], there[ok], pos[at[ok]] + len(read), cost[at[ok]] + price))
        free = np.flatnonzero(cost + EDITED <= bound[q])
        if len(free):
            fan = trie.first[node[free] + 1] - trie.first[node[free]]
            who = np.repeat(free, fan)
            child = trie.to[np.repeat(trie.first[node[free]] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())]
            other = inside[who] & (child != nxt[who])
            parts.append((q[who[other]], child[other], pos[who[other]] + 1, cost[who[other]] + EDITED))
            parts.append((q[who], child, pos[who], cost[who] + EDITED))
            left = free[inside[free]]
            parts.append((q[left], node[left], pos[left] + 1, cost[left] + EDITED))
        q, node, pos, cost = (np.concatenate(x) for x in zip(*parts))
        # lengths that can't be made up, and dearer ways to the same state
        slack, rest = (bound[q] - cost) // CONFUSED, size[q] - pos
        ok = (trie.least[node] <= rest + slack) & (trie.most[node] >= rest - slack)
        q, node, pos, cost = q[ok], node[ok], pos[ok], cost[ok]
        key = (q * len(trie.end) + node) * width + pos
        by = np.lexsort((cost, key))
        one = by[np.append(True, key[by[1:]] != key[by[:-1]])] if len(by) else by
        q, node, pos, cost = q[one], node[one], pos[one], cost[one]
    return {i: sorted((c, n) for n, c in best.items()) for i, best in found.items()}


def core_of(token: str) -> str:
    """The token without marks around it."""
    return _STRIP.sub("", token)


#: Marks that no word holds between its letters unless they stand in pairs.
_MARKS = "(){}[]<>¢€$&*^~+=#%"
_INNER = re.compile(rf"[^\W\d_][{re.escape(_MARKS)}][^\W\d_]")


def _inner(word: str) -> bool:
    """One mark among letters without its counterpart."""
    return bool(_INNER.search(word)) and sum(c in _MARKS for c in word) == 1


def _odd(word: str) -> bool:
    """One or two digits or bars among letters, as no word, number or reference has them."""
    digits = sum(c.isdigit() or c in "|¡!" for c in word)
    if not digits or digits > 2 or not word.isascii() and not word.replace("|", "").replace("¡", "").replace("!", "").isalnum():
        return False
    letters = sum(c.isalpha() for c in word)
    return letters >= 3 and not re.fullmatch(r"\d+[^\W\d_]{1,2}|[^\W\d_]{1,2}\d+|[A-Z]+\d+|\d+[.-].*", word)


@lru_cache(maxsize=500_000)
def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def pair_key(a: str, b: str) -> int:
    """Signed 64-bit number of two neighbouring words."""
    k = (word_hash(a) * _FIRST + word_hash(b) * _SECOND) % (1 << 64)
    return k - (1 << 64) if k >> 63 else k


class Reader:
    """Judges words against the vocabulary; remembers tokens it has met (emptied when full).

    bad: tokens told misread by themselves (confusions of scanning, or a sign among letters), with candidates.
    doubt: tokens with candidates by other edits only; they count as misread where the neighbouring words bear a candidate out.
    """

    def __init__(self, words: list[str], counts: list[int], pairs=(), heads=()):
        self.known = set(words)
        self.heads = {w.split("-")[0] for w in words if "-" in w.strip("-")}
        self.trie = Trie([w for w in words if w.isalpha()], [c for w, c in zip(words, counts) if w.isalpha()])
        self.longest = max(map(len, self.trie.words), default=0) + 2 * EDITED // CONFUSED
        self.pairs, self.forms = set(pairs), frozenset(heads)
        self.seen: set[str] = set()
        self.bad: dict[str, list[tuple[int, int]]] = {}
        self.doubt: dict[str, list[tuple[int, int]]] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.seen) > 2_000_000:
            self.seen.clear()
            self.bad.clear()
            self.doubt.clear()
        new = tokens - self.seen
        if not new:
            return
        self.seen |= new
        asked: list[tuple[str, str, bool]] = []
        for token in new:
            word = core_of(token)
            low = word.lower()
            if len(word) < 2 or low in self.known or _ROMAN.match(word) or low.startswith("http") or "@" in low:
                continue
            if _inner(low):
                asked.append((token, low, True))
                continue
            for p in re.split(r"[-‐/.,;:()\"«»“”=]+", low):
                odd = _odd(p)
                if len(p) >= 2 and p not in self.known and (odd or not any(c.isdigit() for c in p)):
                    asked.append((token, p, odd))
        # longer words than those of the vocabulary and its edits have no candidate
        got = look_up(self.trie, [p if len(p) <= self.longest else "" for _, p, _ in asked])
        for i, (token, p, odd) in enumerate(asked):
            cands = got.get(i, [])
            sure = cands if odd else [(c, n) for c, n in cands if c <= CONFUSED and len(p) >= 3 or c <= WEAKLY and len(p) >= 6]
            if sure or odd and not _inner(p):
                self.bad[token] = sure
            elif cands and len(p) >= 5 and token[-1] not in "-¬\u00ad‐" and core_of(token).islower():
                self.doubt.setdefault(token, cands)  # names stay: only words without capitals

    def all_known(self, tokens: list[str]) -> bool:
        """No token is told misread or doubtful."""
        return self.bad.keys().isdisjoint(tokens) and self.doubt.keys().isdisjoint(tokens)

    def misread(self, token: str) -> bool:
        self.learn({token})
        return token in self.bad

    def borne_out(self, token: str, cand: int, before: str, after: str) -> tuple[int, int]:
        """How many of the known words beside the token are known as neighbours of the candidate, and how many there are."""
        word = core_of(self.replaced(token, self.trie.words[cand])).lower()
        b, a = core_of(before).lower(), core_of(after).lower()
        near = [pair_key(b, word)] if b in self.known else []
        near += [pair_key(word, a)] if a in self.known else []
        return sum(k in self.pairs for k in near), len(near)

    def doubtful(self, tokens: list[str], i: int, last: str = "", following: str = "") -> bool:
        """Whether both words beside the i-th token bear out a candidate; last and following stand around the tokens."""
        before, after = tokens[i - 1] if i else last, tokens[i + 1] if i + 1 < len(tokens) else following
        return any(self.borne_out(tokens[i], c, before, after) == (2, 2) for _, c in self.doubt[tokens[i]])

    def any_misread(self, tokens: list[str], last: str = "", following: Callable[[], str] = str) -> bool:
        """following gives the first word after the tokens; it is asked only where it counts."""
        if not self.bad.keys().isdisjoint(tokens):
            return True
        return not self.doubt.keys().isdisjoint(tokens) and any(t in self.doubt and self.doubtful(tokens, i, last, following()) for i, t in enumerate(tokens))

    def repaired(self, tokens: list[str], i: int, context: set[str]) -> str:
        """The i-th token with its best candidate in place of a misread word: the least cost, then what the neighbours bear out, then what stands elsewhere in the text, then frequency."""
        token = tokens[i]
        cands = self.bad.get(token) or (self.doubt[token] if token in self.doubt and self.doubtful(tokens, i) else None)
        if not cands:
            return token
        before, after = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""
        if token in self.doubt:
            rank = lambda c: (-self.borne_out(token, c[1], before, after)[0], c[0])
        else:
            rank = lambda c: (c[0], -self.borne_out(token, c[1], before, after)[0]) if len(cands) > 1 else ()
        best = min(cands, key=lambda c: (*rank(c), self.trie.words[c[1]] not in context, -int(self.trie.counts[c[1]])))
        return self.replaced(token, self.trie.words[best[1]])

    def replaced(self, token: str, best: str) -> str:
        word = core_of(token)
        parts = [word] if _inner(word.lower()) else re.split(r"([-‐/.,;:()\"«»“”=]+)", word)
        at = [i for i, p in enumerate(parts) if p and p.lower() not in self.known and i % 2 == 0]
        if not at:
            return token
        old = parts[at[0]]
        letters = [c for c in old if c.isalpha()]
        parts[at[0]] = best.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else best.capitalize() if old[0].isupper() else best
        return token.replace(word, "".join(parts), 1)

    def furniture(self, line: str, opens: bool) -> bool:
        """Running head, foot or page number. opens: the first line with text of page 1 or chunk 1, which is the title."""
        if shaped_as_furniture(line, opens):
            return True
        return not opens and line[-1:] not in ".;:,-" and not line[:1].islower() and not self.forms.isdisjoint(forms_of(line))


def shaped_as_furniture(line: str, opens: bool) -> bool:
    """Furniture by its shape alone: a page number, or a line in capitals that is no heading of the structure."""
    if len(line) < 60 and _NUMBER.fullmatch(line):
        return True
    if opens or len(line) < 20 or line.upper() != line or any(c.islower() for c in line):
        return False
    m = _CAPITALS.match(line)
    return bool(m) and not _STRUCTURE.match(m[1]) and "|" not in line and sum(c.isalpha() for c in line) > 0.6 * len(line)


_HEADLIKE = re.compile(r"^[ \t]*(?:\d{1,5}[ \t]+)?([^\W\d_a-zß-öø-ÿ][^\n|]{4,118}[^\n|.;:,\-¬\u00ad‐\s])[ \t]*$", re.M)
_PAGED = re.compile(r"^\s*\d{1,5}\s+|\s+\d{1,5}\s*$")


def _folds() -> tuple[dict[int, str], list[tuple[str, str]]]:
    """Letters that scanning confuses as one letter, and pairs as the single letter, so that a misread head keeps its form."""
    kin: dict[str, str] = {}

    def root(c: str) -> str:
        while kin.setdefault(c, c) != c:
            c = kin[c]
        return c

    for meant, read in CONFUSIONS:
        if len(meant) == len(read) == 1:
            kin[root(read)] = root(meant)
    table = {ord(c): root(c) for c in list(kin)}
    pairs = [(max(m, r, key=len), min(m, r, key=len)) for m, r in CONFUSIONS if len(m) != len(r)]
    return table, [(a.translate(table), b.translate(table)) for a, b in dict.fromkeys(pairs)]


_FOLD, _FOLD_PAIRS = _folds()


@lru_cache(maxsize=100_000)
def forms_of(line: str) -> tuple[str, ...]:
    """The forms by which a head-like line is counted: its words with numbers as a mark, and the same with its last word left open."""
    m = _HEADLIKE.fullmatch(line)
    if not m or not m[1][0].isupper() or ". " in m[1] or _STRUCTURE.match(m[1]) or _ITEM.match(m[1] + " "):
        return ()
    text = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", "#", _PAGED.sub("", line).lower()).translate(_FOLD)
    for a, b in _FOLD_PAIRS:
        text = text.replace(a, b)
    words = text.split()
    if len(words) < 2:
        return ()
    whole = " ".join(words)
    return (whole, " ".join(words[:-1]) + " *") if len(words) > 2 else (whole,)


def head_places(text: str, opening: bool, page: bool) -> list[tuple[int, tuple[str, ...], bool]]:
    """(line number from 1, forms, apart) of the head-like lines that have no other shape of furniture.

    Apart is a line among the first or last two of a page; in other records one that interrupts a sentence.
    """
    spots = [m for m in _HEADLIKE.finditer(text) if m[1][0].isupper()]
    if not spots:
        return []
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    rank = {i: k for k, i in enumerate(full)}
    out, at, line_no = [], 0, 0
    for m in spots:
        line_no += text.count("\n", at, m.start())
        at = m.start()
        line, k = lines[line_no], rank[line_no]
        if opening and k == 0 or shaped_as_furniture(line, False) or not (forms := forms_of(line)):
            continue
        if page:
            apart = k < 2 or k >= len(full) - 2
        else:
            near = [next((lines[j].strip() for j in js if not shaped_as_furniture(lines[j], False)), "") for js in (reversed(full[:k]), full[k + 1 :])]
            apart = near[0] != "" and near[0][-1] not in ".:;!?»”)|" and near[1][:1].islower()
        out.append((line_no + 1, forms, apart))
    return out


def break_kind(reader: Reader, line: str, following: str | None) -> str:
    """'' no break, 'compound' a compound broken at its own hyphen, 'word' a broken word."""
    m = _BROKEN.search(line)
    if not m:
        return ""
    head, known = m[1].lower(), reader.known
    n = _FIRST_WORD.match(following) if following is not None else None
    tail = n[1].lower() if n else ""
    if m[2]:  # a blank before the hyphen: only where both parts make a word
        return "word" if tail and head + tail in known else ""
    if m[3] in "¬\u00ad":
        return "word"
    if not n or n[1][0].isupper() and not m[1].isupper():  # what follows isn't there
        return "compound" if head in reader.heads else "word"
    if head + tail in known:
        return "word"
    if f"{head}-{tail}" in known or head in reader.heads and len(tail) > 3 or head in known and tail in known and min(len(head), len(tail)) > 3:
        return "compound"
    return "word"


def taken(reader: Reader, line: str, following: str, unsure: bool = False) -> str:
    """The kind of break where the first word of following belongs to the end of line, else ''. unsure: what follows may not be the next line; then only a known word is joined."""
    m, rest = _BROKEN.search(line), following.split()
    first = core_of(rest[0]) if rest else ""
    if not m or not any(c.isalpha() for c in first) or first[0].isupper() and not m[1].isupper() and f"{m[1]}-{first}".lower() not in reader.known or _ITEM.match(following):
        return ""
    if unsure and not {m[1].lower() + first.lower(), f"{m[1]}-{first}".lower()} & reader.known:
        return ""
    return break_kind(reader, line, following)


def faults(reader: Reader, text: str, first_record: bool) -> list[tuple[int, str]]:
    """(line number, kind) of the lines that need repair: number, head, broken or misread."""
    lines = text.split("\n")
    out = []
    opening, fragment, last = first_record, False, ""
    clean = reader.all_known(text.split())  # most texts hold no word to judge line by line
    for i, line in enumerate(lines):
        if not line or line.isspace():
            continue
        opens, opening = opening, False
        if reader.furniture(line, opens):
            out.append((i + 1, "furniture"))
            continue
        kind = ""
        if line[-1] in "-¬\u00ad‐ ":
            following = next((x for x in lines[i + 1 :] if x and not x.isspace() and not reader.furniture(x, False)), None)
            kind = break_kind(reader, line, following)
        if clean:
            if kind == "word":
                out.append((i + 1, "broken"))
            continue
        tokens = line.split()
        if fragment:
            tokens, last = tokens[1:], ""
        fragment = kind != ""
        if fragment:
            tokens = tokens[:-1]
        if kind == "word":
            out.append((i + 1, "broken"))
        elif reader.any_misread(tokens, last, lambda: next((x.split()[0] for x in lines[i + 1 :] if x and not x.isspace() and not reader.furniture(x, False)), "")):  # noqa: B023
            out.append((i + 1, "misread"))
        last = tokens[-1] if tokens and not fragment else ""
    return out


def edges(reader: Reader, text: str, first_record: bool, heads=()) -> tuple[str | None, str | None]:
    """The first line of a page's text without furniture, and the last one if it ends in a hyphen ('' if not); None where there is none. heads: as in repair."""
    lines = [(i, x) for i, x in enumerate(text.split("\n"), 1) if x and not x.isspace()]
    is_text = lambda k: lines[k][0] not in heads and not reader.furniture(lines[k][1], first_record and k == 0)
    first = next(filter(is_text, range(len(lines))), None)
    if first is None:
        return None, None
    last = lines[next(filter(is_text, reversed(range(len(lines)))))][1].strip()
    return lines[first][1].strip(), last if _BROKEN.search(last) else ""


def repair(reader: Reader, text: str, first_record: bool, before: str | None = None, after: str | None = None, heads=()) -> str:
    """Continuous paragraphs without page furniture, broken and misread words.

    before, after: the last line of the page before and the first of the page after. A word broken between
    pages stands whole on the page where it begins; where nothing continues a word its hyphen stays.
    heads: numbers of lines known as running heads of the document.
    """
    lines, paragraphs, current, glue = text.split("\n"), [], "", ""
    opening = first_record
    context = {core_of(t).lower() for t in text.split()}
    kept = []
    for i, line in enumerate(lines, 1):
        if line and not line.isspace():
            opens, opening = opening, False
            if i in heads or reader.furniture(line, opens):
                continue
        kept.append(line.strip())
    full = [i for i, x in enumerate(kept) if x]
    over = taken(reader, kept[full[-1]], after) if full and after else ""
    if full and before and taken(reader, before, kept[full[0]]):
        kept[full[0]] = " ".join(kept[full[0]].split()[1:])
    if over:
        kept[full[-1]] = (_BROKEN.sub(r"\1", kept[full[-1]]) if over == "word" else kept[full[-1]]) + after.split()[0]
    for i, line in enumerate(kept):
        if not line:
            if not glue and current and current[-1] in ".:;!?»”":
                paragraphs.append(current)
                current = ""
            continue
        kind = taken(reader, line, next((x for x in kept[i + 1 :] if x), "")) if line[-1] in "-¬\u00ad‐" else ""
        body = _BROKEN.sub(r"\1", line) if kind == "word" else line
        if current and not glue and _starts_paragraph(line, current):
            paragraphs.append(current)
            current = ""
        current = current + glue + body if glue else f"{current} {body}" if current and not current.endswith("\0") else current.rstrip("\0") + body
        glue = ""
        if kind:
            current, glue = current + "\0", "\0"
        current = current.replace("\0\0", "")
    if current:
        paragraphs.append(current)
    out = []
    for p in paragraphs:
        tokens = p.replace("\0", "").split()
        reader.learn(set(tokens))
        out.append(" ".join(_mended(reader, tokens, context)))
    return "\n".join(out)


def _mended(reader: Reader, tokens: list[str], context: set[str]) -> list[str]:
    return [reader.repaired(tokens, i, context) if t in reader.bad or t in reader.doubt else t for i, t in enumerate(tokens)]


_ITEM = re.compile(r"(?:[IVXLC]+\.|[a-zñ]\)|\d{1,3}[.)]|[-•|])\s")


def _starts_paragraph(line: str, before: str) -> bool:
    if _STRUCTURE.match(line) and (line.isupper() or len(line) < 60 or re.match(r"art[íi]culo\s+\S+[.-]", line, re.I)) and before[-1] in ".:;!?»”)|" or _ITEM.match(line):
        return True
    return before.isupper() != line.isupper() and len(before) < 80


@dataclass(frozen=True)
class Known:
    """What the whole collection tells: words with their counts, pairs of neighbouring words, forms of running heads."""

    words: tuple[str, ...] = ()
    counts: tuple[int, ...] = ()
    pairs: tuple[int, ...] = ()
    heads: tuple[str, ...] = ()


@lru_cache(maxsize=1)
def _reader(known: Known) -> Reader:
    return Reader(list(known.words), list(known.counts), known.pairs, known.heads)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: words (kind 0), neighbouring words (1) and forms of head-like lines (2) with their counts.

    Distinct tokens are stripped and hashed once; pairs are counted as numbers.
    """
    for batch in batches:
        for part in arrays.slices(batch, 2):
            texts = part.column(2).to_pylist()
            tokens = "\n".join(texts).lower().split()
            counted = Counter(tokens)
            words: Counter = Counter()
            index = {}
            hashes = np.zeros(len(counted), np.uint64)
            for k, (t, n) in enumerate(counted.items()):
                index[t] = k
                w = core_of(t)
                if len(w) >= 2 and not any(c.isdigit() for c in w):
                    words[w] += n
                    if "-" in w:
                        for p in w.split("-"):
                            if len(p) > 1:
                                words[p] += n
                hashes[k] = word_hash(w)
            at = hashes[np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))]
            with np.errstate(over="ignore"):
                pairs, times = np.unique(at[:-1] * np.uint64(_FIRST) + at[1:] * np.uint64(_SECOND), return_counts=True)
            forms: Counter = Counter()
            apart: Counter = Counter()
            for src, opening, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                if src != "span":
                    for _, found, alone in head_places(text, opening, src == "page"):
                        forms.update(found)
                        if alone:
                            apart.update(found)
            size = (len(words), len(pairs), len(forms))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(3, dtype=np.int32), size)),
                    pa.array([*words, *[None] * len(pairs), *forms], pa.string()),
                    pa.array(np.concatenate([np.zeros(size[0], np.int64), pairs.view(np.int64), np.zeros(size[2], np.int64)])),
                    pa.array(np.concatenate([np.fromiter(words.values(), np.int64, size[0]), times.astype(np.int64), np.fromiter(forms.values(), np.int64, size[2])])),
                    pa.array(np.concatenate([np.zeros(size[0] + size[1], np.int64), np.array([apart[f] for f in forms], np.int64)])),
                ],
                names=["kind", "word", "pair", "n", "apart"],
            )


def learnt(texts: DataFrame) -> Known:
    """What is known from src, opening and text of all records.

    Everything is known from EVIDENCE + share x total occurrences on, one rule at all sizes, so that at most
    1 / KNOWN_SHARE words, 1 / PAIR_SHARE pairs and 2 / HEAD_SHARE forms come to the driver.
    """
    rows = texts.where(F.col("text").isNotNull()).select("src", "opening", "text").mapInArrow(_count_batches, "kind int, word string, pair bigint, n bigint, apart bigint")
    counts = rows.groupBy("kind", "word", "pair").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    # what is seen too seldom only counts in the totals
    often = F.col("n") > EVIDENCE
    counts = counts.groupBy("kind", F.when(often, F.col("word")).alias("word"), F.when(often, F.col("pair")).alias("pair")).agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    counts = cut_lineage(counts)
    total = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = lambda share, kind: EVIDENCE + share * total.get(kind, 0)
    known = counts.where((F.col("kind") == 0) & F.col("word").isNotNull() & (F.col("n") > least(KNOWN_SHARE, 0))).select("word", "n").toArrow().to_pydict()
    pairs = counts.where((F.col("kind") == 1) & F.col("pair").isNotNull() & (F.col("n") > least(PAIR_SHARE, 0))).select("pair").toArrow().column(0).to_pylist()
    heads = counts.where((F.col("kind") == 2) & F.col("word").isNotNull() & (F.col("apart") > least(HEAD_SHARE, 2)) & (F.col("apart") >= APART * F.col("n"))).select("word").toArrow().column(0).to_pylist()
    order = sorted(range(len(known["word"])), key=lambda i: known["word"][i])
    return Known(tuple(known["word"][i] for i in order), tuple(known["n"][i] for i in order), tuple(sorted(pairs)), tuple(sorted(heads)))


_JUDGED = "src string, rec_id string, line_no int, doc string, unit string, form string"


def _judged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["src", "rec_id", "line_no", "doc", "unit", "form"])


def _record_heads(reader: Reader, src: str, rec: str, opening: bool, doc: str, unit: str, text: str) -> list[tuple]:
    """Lines of a record that are running heads if the document repeats them."""
    return [(src, rec, n, doc, unit, forms[0]) for n, forms, apart in head_places(text, opening, src == "page") if apart and reader.forms.isdisjoint(forms)]


def _judge_batches(known: Known, heads_only: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(known)
        for batch in batches:
            for part in arrays.slices(batch, 5):
                records_ = list(zip(*(part.column(i).to_pylist() for i in range(6))))
                rows = [h for r in records_ if r[3] is not None for h in _record_heads(reader, *r)]
                if not heads_only:
                    reader.learn(set("\n".join(r[5] for r in records_).split()))
                    rows += [(src, rec, n, None, None, None) for src, rec, opening, _, _, text in records_ for n, _ in faults(reader, text, opening)]
                if rows:
                    yield _judged(rows)

    return run


def _repair_batches(known: Known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(known)
        for batch in batches:
            for part in arrays.slices(batch, 5):
                src, rec, first, before, after, texts, heads = (part.column(i).to_pylist() for i in range(7))
                reader.learn(set("\n".join(texts).split()))
                fixed = [repair(reader, t, f, b, a, h or ()) for t, f, b, a, h in zip(texts, first, before, after, heads)]
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(rec, pa.string()), pa.array(fixed, pa.string())], names=["src", "rec_id", "text"])

    return run


def records(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """src, rec_id, opening (page 1 or chunk 1), doc, unit and text of chunks and pages."""
    doc = F.col("documentId").cast("string") if "documentId" in chunks.columns else F.lit(None).cast("string")
    a = chunks.where("id IS NOT NULL AND text IS NOT NULL").select(
        F.lit("chunk").alias("src"), F.col("id").cast("string").alias("rec_id"), F.coalesce(F.col("chunkNo") == 1, F.lit(False)).alias("opening"), doc.alias("doc"), F.col("id").cast("string").alias("unit"), "text"
    )
    page = F.col("page_number").cast("string")
    b = pages.where("doc_id IS NOT NULL AND page_number IS NOT NULL AND text IS NOT NULL").select(
        F.lit("page").alias("src"), F.concat_ws(":", F.col("doc_id").cast("string"), page).alias("rec_id"), (F.col("page_number") == 1).alias("opening"), F.col("doc_id").cast("string").alias("doc"), page.alias("unit"), "text"
    )
    return a.unionByName(b)


def _all_texts(rows: DataFrame, spans: DataFrame) -> DataFrame:
    return rows.select("src", "opening", "text").unionByName(spans.select(F.lit("span").alias("src"), F.lit(False).alias("opening"), "text"))


def repeated_heads(judged: DataFrame) -> DataFrame:
    """doc, form: head-like lines apart that stand on several pages, or in several chunks, of one document."""
    rows = judged.where("form IS NOT NULL").select("doc", "form", F.when(F.col("src") == "chunk", "chunk").otherwise("page").alias("family"), "unit").distinct()
    return rows.groupBy("doc", "form", "family").agg(F.count("*").alias("n")).where("n >= 2").select("doc", "form").distinct()


def _span_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The spans of one page after another, texts normalised; a span of no page stands alone. Spans arrive by page and in reading order."""
    held: list = []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns) if i != 6]
        texts = standins.normalise(batch.column(6))[0].to_pylist() if len(batch) else []
        for text, doc, page, block, line, no, span, *edge in zip(texts, *cols):
            if held and ((held[-1][0], held[-1][1]) != (doc, page) or doc is None or page is None):
                yield held
                held = []
            held.append((doc, page, block, line, no, text or "", span, *edge))
    if held:
        yield held


def _span_lines(rows: list[tuple]) -> list[list[tuple]]:
    """A page's lines as lists of their spans; a span without a place is a line of its own."""
    lines: list[list] = []
    for r in rows:
        if lines and r[2] is not None and r[3] is not None and lines[-1][-1][2:4] == r[2:4]:
            lines[-1].append(r)
        else:
            lines.append([r])
    return lines


def _line_text(line: list[tuple]) -> str:
    return " ".join(r[5] for r in line)


def _span_heads(reader: Reader, lines: list[list[tuple]]) -> list[tuple]:
    """Spans of a page's lines that are running heads if the document repeats them."""
    full = [line for line in lines if _line_text(line).strip()]
    out = []
    for k, line in enumerate(full):
        doc, page, text = line[0][0], line[0][1], _line_text(line)
        if doc is None or page is None or page == 1 and k == 0 or 2 <= k < len(full) - 2 or shaped_as_furniture(text, False):
            continue
        forms = forms_of(text)
        if forms and reader.forms.isdisjoint(forms):
            out += [("span", r[6], 1, doc, str(page), forms[0]) for r in line if r[5].strip()]
    return out


def _span_batches(known: Known, heads_only: bool = False):
    """Lines are put together from their spans and judged as lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(known)

        def judged(rows: list) -> list[str]:
            lines = _span_lines(rows)
            out, fragment, opening, last = [], False, rows[0][1] == 1, ""
            joined = [_line_text(line) for line in lines]
            reader.learn({t for x in joined for t in x.split()})
            for i, line in enumerate(lines):
                if not joined[i].strip():
                    continue
                opens, opening = opening, False
                if reader.furniture(joined[i], opens):
                    out += [r[6] for r in line if r[5].strip()]
                    continue
                kind = ""
                if _BROKEN.search(line[-1][5]):
                    following = next((x for x in joined[i + 1 :] if x.strip() and not reader.furniture(x, False)), None)
                    kind = break_kind(reader, joined[i], following)
                for k, r in enumerate(line):
                    tokens = r[5].split()
                    if fragment and k == 0:
                        tokens, last = tokens[1:], ""
                    if kind and k == len(line) - 1:
                        tokens = tokens[:-1]
                        if kind == "word":
                            out.append(r[6])
                            continue
                    after = lambda: next((x.split()[0] for x in (_line_text(line[k + 1 :]), *joined[i + 1 :]) if x.strip() and not reader.furniture(x, False)), "")  # noqa: B023, E731
                    if reader.any_misread(tokens, last, after):
                        out.append(r[6])
                    last = tokens[-1] if tokens else last
                fragment = kind != ""
                if fragment or line[0][2] is None:
                    last = ""
            return out

        found: list[tuple] = []
        for rows in _span_pages(batches):
            found += _span_heads(reader, _span_lines(rows))
            if not heads_only:
                found += [("span", r, 1, None, None, None) for r in judged(rows)]
            if len(found) > 20_000:
                yield _judged(found)
                found = []
        if found:
            yield _judged(found)

    return run


def _body(reader: Reader, rows: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
    """The lines of a page that are text, without blank spans, and the spans that have lost their place and are text."""
    lines, alone, opening = [], [], rows[0][1] == 1
    for line in _span_lines([r for r in rows if r[5].strip()]):
        if line[0][2] is None or line[0][3] is None:
            if not line[0][7] and not reader.furniture(line[0][5], rows[0][1] == 1):
                alone.append(line[0])
            continue
        opens, opening = opening, False
        if not line[0][7] and not reader.furniture(_line_text(line), opens):
            lines.append(line)
    return lines, alone


def span_edges(reader: Reader, rows: list[tuple]) -> tuple[str | None, str | None]:
    """As edges, of a page of spans; marked where spans of the page have lost their place."""
    lines, alone = _body(reader, rows)
    if not lines:
        return ("", "") if alone else (None, None)
    first, last = (_line_text(line) for line in (lines[0], lines[-1]))
    mark = _UNSURE if alone else ""
    return mark + first, mark + last if _BROKEN.search(lines[-1][-1][5]) else ""


def repair_spans(reader: Reader, rows: list[tuple], before: str | None = None, after: str | None = None) -> list[tuple[str, str]]:
    """(span, text) of all spans of a page: a broken word stands whole in the span where it begins, furniture is empty. before, after: as in repair, by span_edges."""
    lines, alone = _body(reader, rows)
    tokens = {r[6]: r[5].split() for line in lines for r in line} | {r[6]: r[5].split() for r in alone}
    context = {core_of(t).lower() for ts in tokens.values() for t in ts}
    joined = [_line_text(line) for line in lines]
    if lines and before and taken(reader, before.lstrip(_UNSURE), joined[0], bool(alone) or before[0] == _UNSURE):
        tokens[lines[0][0][6]].pop(0)
    for i, line in enumerate(lines):
        within = i + 1 < len(lines)
        following = joined[i + 1] if within else after or ""
        if not _BROKEN.search(line[-1][5]):
            continue
        kind = taken(reader, joined[i], following.lstrip(_UNSURE), bool(alone) or following[:1] == _UNSURE)
        if kind:
            rest = following.lstrip(_UNSURE).split()[0]
            own = " ".join(tokens[line[-1][6]])
            if within:
                tokens[lines[i + 1][0][6]].pop(0)
            tokens[line[-1][6]] = ((_BROKEN.sub(r"\1", own) if kind == "word" else own.rstrip()) + rest).split()
    reader.learn({t for ts in tokens.values() for t in ts})
    return [(r[6], " ".join(_mended(reader, tokens.get(r[6], []), context))) for r in rows]


def _span_repairs(known: Known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(known)
        out: list[tuple[str, str]] = []
        for rows in _span_pages(batches):
            out += repair_spans(reader, rows, *rows[0][8:])
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["rec_id", "text"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["rec_id", "text"])

    return run


def _span_rows(spans: DataFrame) -> DataFrame:
    place = ["doc_id", "page_number", "block_no", "line_no", "span_no"]
    return spans.where("span_id IS NOT NULL AND text IS NOT NULL").select(*place, F.col("span_id").cast("string").alias("span"), "text").dropDuplicates(["span"])


def _in_reading_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", "block_no", "line_no", "span_no", "span")


def found(chunks: DataFrame, pages: DataFrame, spans: DataFrame) -> DataFrame:
    """src, rec_id, line_no of every line that needs repair."""
    rows = records(chunks, pages)
    known = learnt(_all_texts(rows, spans))
    parts = _in_reading_order(_span_rows(spans)).mapInArrow(_span_batches(known), _JUDGED)
    judged = cut_lineage(rows.mapInArrow(_judge_batches(known), _JUDGED).unionByName(parts))
    keys = ["src", "rec_id", "line_no"]
    own = judged.where("form IS NOT NULL").join(repeated_heads(judged), ["doc", "form"]).select(*keys)
    return judged.where("form IS NULL").select(*keys).unionByName(own).distinct()


def _edge_batches(known: Known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(known)
        for batch in batches:
            got = [edges(reader, t, f, h or ()) for f, t, h in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], names=["doc_id", "page_number", "first", "last"])

    return run


def _span_edge_batches(known: Known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(known)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "page_number", "first", "last"])

        for rows in _span_pages(batches):
            out.append((*rows[0][:2], *span_edges(reader, rows)))
            if len(out) > 20_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


_EDGES = "doc_id string, page_number int, first string, last string"


def _carried(rows: DataFrame) -> DataFrame:
    """doc_id, page_number, before, after: the edge lines beside a page that ends or begins within a word. They are carried over pages without text, not over missing ones."""
    one = rows.groupBy("doc_id", "page_number").agg(F.max(F.struct("first", "last")).alias("e")).select("doc_id", "page_number", "e.*")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    one = one.withColumn("island", F.col("page_number").cast("bigint") - number)
    # both windows only look back: a frame that looks forward to the end is evaluated anew for each row
    back = Window.partitionBy("doc_id", "island").rowsBetween(Window.unboundedPreceding, -1)
    got = one.withColumn("before", F.last("last", ignorenulls=True).over(back.orderBy("page_number")))
    got = got.withColumn("after", F.last("first", ignorenulls=True).over(back.orderBy(F.desc("page_number"))))
    return got.where("before <> '' OR last <> '' AND after <> ''").select("doc_id", "page_number", "before", "after")


def repaired(chunks: DataFrame, pages: DataFrame, spans: DataFrame) -> DataFrame:
    """src, rec_id and the repaired text of chunks, pages and spans; the text of spans is repaired in its normalised form.

    Of several deliveries of a chunk or page the greatest text counts. Records are brought together by key once: deliveries,
    lines of running heads and the edges of neighbouring pages meet in the same partitions.
    """
    rows = records(chunks, pages)
    known = learnt(_all_texts(rows, spans))
    one = rows.groupBy("src", "rec_id").agg(F.max(F.struct("text", "opening", "doc", "unit")).alias("r")).select("src", "rec_id", "r.opening", "r.doc", "r.unit", "r.text")
    kept, keyless = _span_rows(spans), F.col("doc_id").isNull() | F.col("page_number").isNull()
    judged = rows.mapInArrow(_judge_batches(known, True), _JUDGED).unionByName(_in_reading_order(kept.where(~keyless)).mapInArrow(_span_batches(known, True), _JUDGED))
    judged = cut_lineage(judged)
    own = cut_lineage(judged.join(repeated_heads(judged), ["doc", "form"]).groupBy("src", "rec_id").agg(F.collect_set("line_no").alias("heads")))
    whole = one.join(own, ["src", "rec_id"], "left")
    none = F.lit(None).cast("string")
    near = _carried(whole.where("src = 'page'").select(F.col("doc").alias("doc_id"), F.col("unit").cast("int").alias("page_number"), "opening", "text", "heads").mapInArrow(_edge_batches(known), _EDGES))
    near = near.select(F.lit("page").alias("src"), F.concat_ws(":", "doc_id", F.col("page_number").cast("string")).alias("rec_id"), "before", "after")
    whole = whole.join(near, ["src", "rec_id"], "left").select("src", "rec_id", "opening", "before", "after", "text", "heads")
    whole = whole.mapInArrow(_repair_batches(known), "src string, rec_id string, text string")
    kept = kept.join(own.where("src = 'span'").select(F.col("rec_id").alias("span"), F.lit(True).alias("head")), "span", "left").select(*kept.columns, "head")
    placed = kept.where(~keyless)
    near = _carried(_in_reading_order(placed).mapInArrow(_span_edge_batches(known), _EDGES))
    placed = _in_reading_order(placed.join(near, ["doc_id", "page_number"], "left").select(*kept.columns, "before", "after"))
    parts = placed.unionByName(kept.where(keyless).withColumns({"before": none, "after": none}))
    return whole.unionByName(parts.mapInArrow(_span_repairs(known), "rec_id string, text string").select(F.lit("span").alias("src"), "rec_id", "text"))
