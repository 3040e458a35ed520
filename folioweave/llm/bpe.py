"""Byte-level BPE encoding of whole texts with the byte_bpe_50k vocabulary.

Texts are cut into words by the vocabulary's pattern (vectorised over code points), and each distinct
word is encoded once per worker.  A word's pair ranks stand in a segment tree over its byte positions
whose root is the leftmost minimum; each merge changes the leaves of the live neighbours and repairs
their paths to the root.  Many words are merged at once, one tree row each.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text.
The cache of words is a speed-up only: it is emptied when full, and no word is ever skipped.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

L, N, O, W = 1, 2, 3, 0
NONE = np.int64(1) << 40
#: Words of more code points are looked up by their text, shorter ones by a hash of it.
HASHED = 64
#: Words held by a worker.
CACHE = 400_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pattern's class of each code point."""
    out = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = L
        elif c == "N":
            out[cp] = N
    out[arrays.WHITE] = W
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Ranks of pairs and ids of bytes."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        # byte-level alphabets write printable bytes as themselves and the rest from U+0100 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.byte = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.table = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made)}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id, or NONE << 20 for pairs that don't merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at] << 20 | self.made[at], NONE << 20)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode_rows(v: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """BPE of many words at once. ids: words x width (a power of two), -1 beyond each length."""
    rows, width = ids.shape
    ids = ids.copy()
    tree = np.full((rows, 2 * width), NONE << 20, np.int64)
    tree[:, width : 2 * width - 1] = v.rank(ids[:, :-1], ids[:, 1:])
    for node in range(width - 1, 0, -1):
        tree[:, node] = _least(tree[:, 2 * node], tree[:, 2 * node + 1])
    nxt = np.tile(np.arange(1, width + 1), (rows, 1))
    prv = np.tile(np.arange(-1, width - 1), (rows, 1))
    live = np.flatnonzero((tree[:, 1] >> 20) < NONE)
    while len(live):
        best = tree[live, 1]
        node = np.ones(len(live), np.int64)
        while node[0] < width:  # down to the leftmost leaf that holds the least rank
            left = tree[live, 2 * node]
            node = 2 * node + ((left >> 20) != (best >> 20))
        at = node - width
        leaf = tree[live, node]
        ids[live, at] = leaf & 0xFFFFF
        gone = nxt[live, at]
        after = nxt[live, gone]
        ids[live, gone] = -1
        nxt[live, at] = after
        inside = after < width
        prv[live[inside], after[inside]] = at[inside]
        right = np.where(inside, ids[live, np.minimum(after, width - 1)], -1)
        _update(tree, live, gone + width, np.full(len(live), NONE << 20))
        _update(tree, live, at + width, v.rank(ids[live, at], right))
        before = prv[live, at]
        has = before >= 0
        if has.any():
            who, b = live[has], before[has]
            _update(tree, who, b + width, v.rank(ids[who, b], ids[who, at[has]]))
        live = live[(tree[live, 1] >> 20) < NONE]
    return [r[r >= 0] for r in ids]


def _least(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smaller rank; the left one when equal."""
    return np.where((left >> 20) <= (right >> 20), left, right)


def _update(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
    tree[rows, node] = value
    node = node >> 1
    while node[0] >= 1:
        tree[rows, node] = _least(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        node = node >> 1


def _encode_long(v: Vocabulary, data: bytes) -> np.ndarray:
    """The same for one long word, with plain lists."""
    n = len(data)
    width = 1 << (n - 1).bit_length() if n > 1 else 1
    ids = [int(v.byte[b]) for b in data]
    top = (int(NONE), 0)
    get = v.table.get
    tree = [top] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = get(ids[i] << 20 | ids[i + 1], top)
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a[0] <= b[0] else b
    nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]

    def put(i: int, value: tuple[int, int]) -> None:
        node = width + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a[0] <= b[0] else b
            node >>= 1

    while tree[1][0] < NONE:
        rank, node = tree[1][0], 1
        while node < width:
            node *= 2
            if tree[node][0] != rank:
                node += 1
        at = node - width
        ids[at] = tree[node][1]
        gone = nxt[at]
        ids[gone] = -1
        put(gone, top)
        after = nxt[at] = nxt[gone]
        if after < n:
            prv[after] = at
        put(at, get(ids[at] << 20 | ids[after], top) if after < n else top)
        if (before := prv[at]) >= 0:
            put(before, get(ids[before] << 20 | ids[at], top))
    return np.array([i for i in ids if i >= 0], np.int64)


def encode_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word."""
    out: list[np.ndarray | None] = [None] * len(words)
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) <= 1:
            out[i] = v.byte[np.frombuffer(w, np.uint8)]
        elif len(w) > 256:
            out[i] = _encode_long(v, w)
        else:
            groups.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
    for width, members in groups.items():
        for k in range(0, len(members), 4096):
            part = members[k : k + 4096]
            ids = np.full((len(part), width), -1, np.int64)
            lengths = np.array([len(words[i]) for i in part])
            for r, i in enumerate(part):
                ids[r, : lengths[r]] = v.byte[np.frombuffer(words[i], np.uint8)]
            for i, got in zip(part, _encode_rows(v, ids, lengths)):
                out[i] = got
    return out


def word_starts(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True where a word of the vocabulary's pattern begins."""
    n = len(cps)
    start = np.zeros(n, bool)
    if not n:
        return start
    cls = _classes()[cps]
    first = np.zeros(n + 1, bool)
    first[off] = True
    first[n] = True
    last = first[1:]  # the next position begins another row
    first = first[:-1]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, cls[:-1]
    before[first] = 255
    white = cls == W
    space = cps == 0x20
    # blanks: the first of a run, and the last one before a word
    next_word = np.zeros(n, bool)
    next_word[:-1] = ~white[1:]
    next_word &= ~last
    start |= white & ((before != W) | next_word)
    # words: a change of class; after a plain space the word has begun at it
    prev_space = np.zeros(n, bool)
    prev_space[1:] = space[:-1]
    start |= ~white & (cls != before) & ~((before == W) & prev_space)
    # contractions: an apostrophe at which a word begins takes its letters along
    for i in np.flatnonzero((cps == 0x27) & start & ~last):
        a = cps[i + 1]
        if a in (0x73, 0x74, 0x6D, 0x64):
            size = 2
        elif not last[i + 1] and (int(a), int(cps[i + 2])) in ((0x6C, 0x6C), (0x72, 0x65), (0x76, 0x65)):
            size = 3
        else:
            continue
        start[i + 1] = False
        if not last[i + size - 1] and not (white[i + size] and not start[i + size]):
            start[i + size] = True
    return start


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


@lru_cache(maxsize=1)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(count, _BASE, np.uint64), np.full(count, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _word_hashes(cps: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, from running sums over all code points."""
    up, down = _powers(1 << max(22, len(cps).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps + np.uint32(0x1F123)) * up[: len(cps)], out=sums[1:])
        return (sums[at + size] - sums[at]) * down[at]


class Encoder:
    """Encodes Arrow text; keeps the words it has met."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.index = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.long: dict[str, int] = {}

    def _add(self, words: list[str]) -> np.ndarray:
        made = encode_words(self.v, [w.encode("utf-8") for w in words])
        counts = np.array([len(m) for m in made], np.int64)
        first = len(self.flat)
        self.starts = np.append(self.starts, first + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.flat = np.append(self.flat, np.concatenate(made).astype(np.int32))
        return np.arange(len(self.counts) - len(words), len(self.counts))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the known ones, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return slot, self.hashes[slot] == h

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the row offsets into them."""
        if len(self.counts) > CACHE:
            self.clear()
        cps, off = arrays.code_points(arr)
        start = word_starts(cps, off)
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(cps)))
        word = np.empty(len(at), np.int64)
        short = size <= HASHED
        if len(at):
            h = _word_hashes(cps, at[short], size[short])
            slot, known = self._find(h)
            new = np.flatnonzero(~known)
            if len(new):
                keys, firsts = np.unique(h[new], return_index=True)
                a, s = at[short][new[firsts]], size[short][new[firsts]]
                number = self._add([cps[i : i + k].tobytes().decode("utf-32-le") for i, k in zip(a, s)])
                self.hashes = np.append(self.hashes, keys)
                self.index = np.append(self.index, number)
                order = np.argsort(self.hashes, kind="stable")
                self.hashes, self.index = self.hashes[order], self.index[order]
                slot, _ = self._find(h)
            word[short] = self.index[slot]
            far = np.flatnonzero(~short)
            if len(far):
                texts = [cps[at[i] : at[i] + size[i]].tobytes().decode("utf-32-le") for i in far]
                new_texts = [t for t in dict.fromkeys(texts) if t not in self.long]
                if new_texts:
                    self.long.update(zip(new_texts, self._add(new_texts).tolist()))
                word[far] = [self.long[t] for t in texts]
        counts = self.counts[word]
        ids = self.flat[arrays.repeat_ranges(self.starts[word], counts)] if len(word) else np.zeros(0, np.int32)
        before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return ids, before[np.searchsorted(at, off)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_batches(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in arrays.slices(batch, batch.num_columns - 1):
                ids, off = enc.encode(part.column(part.num_columns - 1))
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                names = part.schema.names[:-1]
                if counts_only:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(off))], names=[*names, "tokens"])
                else:
                    got = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([*kept, got], names=[*names, "ids"])

    return run


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids: the token ids of each row's text. No shuffle: a map over the scan."""
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(_encode_batches(path or default_vocabulary(), False), f"{key} {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The kept columns and tokens, the number of ids of each row's text."""
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, text).mapInArrow(_encode_batches(path or default_vocabulary(), True), f"{kinds}, tokens bigint")
