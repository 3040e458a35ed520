"""Reading level of each document by regularised ordinal regression, calibrated to graded texts.

Features of a text: lexical diversity (distinct words in blocks of 50), word rarity (mean surprisal
under the word counts of the whole corpus), connectives, clause depth (commas, semicolons and
subordinating words per sentence) and length (of words and sentences).  They are measured for many
texts at once, on the numbers of their words and on their code points.  A proportional-odds model with
a ridge penalty maps them to levels; the penalty is chosen by cross-validation on the graded texts.
The level given is the one whose cumulative probability passes one half.

The graded texts are a bounded set (at most MOST_GRADED rows are used); the corpus counts cover all
documents, and the words seen more often than EVIDENCE + KNOWN_SHARE of all words, at most 1 / KNOWN_SHARE,
come to the driver.

Defined results: null and blank texts get no level; a text without letters gets the level of a text
without any of the features' words; case, line ends and list marks have no influence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import arrays

MOST_GRADED = 5000
EVIDENCE, KNOWN_SHARE = 1, 2e-6
LEVELS = 5
BLOCK = 50

#: Connecting and subordinating words of Spanish and English.
CONNECTIVES = set(
    """que cuando aunque mientras siempre si porque pues salvo conforme asimismo además así como sino cuya cuyo cuyas cuyos sin embargo
    obstante empero habida cuenta arreglo supuestos salvedad perjuicio independencia inteligencia tenor efecto defecto consecuencia anterior
    menos después antes hasta donde cual cuales mediante respecto ello
    that when although while if because unless where whereas provided notwithstanding whether which whose so save having being without
    prejudice regard therefore hereby thereof understood insofar far under within""".split()
)
#: Runs of blanks that aren't one space, and of blanks and line ends that aren't one line end.
_BLANKS, _BREAKS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+"), re.compile(r" \n[ \n]*|\n[ \n]+")
_WRAPPED = re.compile(r"(?<=[^.!?…\x00\n])\n(?=[^\W\d_])")
_MARK = re.compile(r"(?<=[\x00\n])(?:(?:art[íi]culo|section|secci[óo]n)\s+\d+\s*\.?\s*[-–]?\s*|[-•*·]\s+|\d+[.)]\s+|[ivxlc]+[.)]\s+|[a-z]\)\s+)", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
FEATURES = ["diversity", "rarity", "connectives", "clauses", "sentence", "word", "longest"]


def prepared(texts: list[str]) -> str:
    """All texts as one string, each after a NUL: lower case, without list marks; lines wrapped within a sentence are joined, runs of blanks are one."""
    whole = "\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    whole = _BREAKS.sub("\n", _BLANKS.sub(" ", whole.replace("\r", "\n"))).replace("\0\n", "\0").replace("\n\0", "\0").replace("\0 ", "\0").replace(" \0", "\0")
    whole = _WRAPPED.sub(lambda m: " " if whole[m.end()].islower() else "\n", whole)
    return _MARK.sub("", whole).lower()


class _Facts(dict):
    """Numbers of tokens; a new one's word is looked at once."""

    def __init__(self, surprisal: dict[str, float], unknown: float):
        super().__init__()
        self.surprisal, self.unknown = surprisal, unknown
        self.rows: list[tuple] = []

    def __missing__(self, token: str) -> int:
        m = _WORD.search(token)
        w = m[0] if m else ""
        self[token] = n = len(self.rows)
        self.rows.append((1.0, self.surprisal.get(w, self.unknown), float(w in CONNECTIVES), len(w)) if w else (0.0, 0.0, 0.0, 0.0))
        return n


class Measure:
    """Turns texts into feature rows; remembers tokens (emptied when there are many)."""

    def __init__(self, surprisal: dict[str, float], unknown: float):
        self.surprisal, self.unknown = surprisal, unknown
        self.facts = _Facts(surprisal, unknown)

    def rows(self, texts: list[str]) -> np.ndarray:
        if len(self.facts) > 500_000:
            self.facts = _Facts(self.surprisal, self.unknown)
        low = prepared(texts)
        n = len(texts)
        tokens = low.replace("\0", " \0 ").split()[:-1]
        number = np.fromiter(map(self.facts.__getitem__, tokens), np.int64, len(tokens))
        fact = np.array(self.facts.rows).reshape(-1, 4)
        begins = number == self.facts["\0"]
        row = np.cumsum(begins)[~begins] - 1
        number = number[~begins]
        worded, rare, linked, letters = (np.bincount(row, fact[number, k], n) for k in range(4))
        words = np.maximum(worded, 1)
        size = np.bincount(row, minlength=n)
        # blocks from the start, and one at the end that makes the last words count; a shorter text is one block
        first = np.cumsum(size) - size
        whole, tail, short = size // BLOCK, np.flatnonzero((size > BLOCK) & (size % BLOCK > 0)), np.flatnonzero((size > 0) & (size < BLOCK))
        owner = np.concatenate([np.repeat(np.arange(n), whole), tail, short])
        step = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        begin = np.concatenate([np.repeat(first, whole) + BLOCK * step, first[tail] + size[tail] - BLOCK, first[short]])
        held = np.minimum(size[owner], BLOCK)
        col = np.arange(BLOCK)
        inside = col < held[:, None]
        block = np.where(inside, number[np.where(inside, begin[:, None] + col, 0)] if len(number) else -1, -1).astype(np.int32)
        block.sort(axis=1)
        distinct = (block[:, 1:] != block[:, :-1]).sum(1) + (block[:, 0] >= 0)
        diversity = np.bincount(owner, distinct / held, n) / np.maximum(np.bincount(owner, minlength=n), 1)
        cps = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        stop = np.isin(cps, [ord(c) for c in ".!?…"])
        edge = (cps == 10) | (cps == 0)
        edge[:-1] |= stop[:-1] & np.isin(cps[1:], [10, 32, 0])
        edges = np.flatnonzero(edge)
        text = np.cumsum(cps == 0) - 1
        length, owner = np.diff(edges), text[edges[:-1]]
        ok = length > 6
        length, owner = length[ok], owner[ok]
        order = np.lexsort((length, owner))
        length, owner = length[order], owner[order]
        count = np.bincount(owner, minlength=n)[:n]
        first = np.cumsum(count) - count
        ninth = np.zeros(n)
        some = count > 0
        ninth[some] = length[(first + (0.9 * (count - 1)).astype(np.int64))[some]]
        sentences = np.maximum(count, 1)
        marks = np.bincount(text[np.isin(cps, [ord(","), ord(";")])], minlength=n)[:n]
        out = np.stack([diversity, rare / words, linked / words, np.log1p((marks + linked) / sentences), np.log1p(worded / sentences), letters / words, np.log1p(ninth)], axis=1)
        out[worded == 0] = (1.0, self.unknown, 0.0, 0.0, 0.0, 0.0, 0.0)
        return out


class Ordinal:
    """Proportional odds with a ridge penalty, fitted by gradient steps with momentum."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 1200) -> Ordinal:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.std
        n, k = len(y), LEVELS - 1
        w = np.zeros(z.shape[1])
        cut = np.linspace(-1.5, 1.5, k)
        above = (y[:, None] > np.arange(1, k + 1)).astype(float)
        m1 = np.zeros(len(w) + k)
        m2 = np.zeros(len(w) + k)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-(z @ w)[:, None] + cut))
            e = (p - above) / n
            g = np.concatenate([z.T @ e.sum(1) + ridge * w / n, -e.sum(0)])
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
            w -= step[: len(w)]
            cut = np.sort(cut - step[len(w) :])
        self.w, self.cut = w, cut
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std) @ self.w

    def level(self, x: np.ndarray) -> np.ndarray:
        return 1 + (self.score(x)[:, None] > self.cut).sum(1)


def cross_validate(rows: np.ndarray, levels: np.ndarray, ridges: list[float], folds: int = 6, seed: int = 0) -> dict[float, np.ndarray]:
    """Held-out levels of the graded texts under each penalty."""
    order = np.random.default_rng(seed).permutation(len(rows))
    out = {r: np.zeros(len(rows), int) for r in ridges}
    for f in range(folds):
        test = order[f::folds]
        train = np.setdiff1d(order, test)
        for r in ridges if len(train) else []:
            out[r][test] = Ordinal().fit(rows[train], levels[train], r).level(rows[test])
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strip = ".,;:!?()[]\"'«»“”-–—¡¿…"
    for batch in batches:
        for part in arrays.slices(batch, 0):
            tokens = Counter("\n".join(part.column(0).to_pylist()).lower().split())
            words: Counter = Counter()
            for t, n in tokens.items():
                w = t.strip(strip)
                if w and not any(c.isdigit() for c in w):
                    words[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


def corpus_surprisal(documents: DataFrame, text: str = "text") -> tuple[dict[str, float], float]:
    """Surprisal (log of total over count) of the words above KNOWN_SHARE, and that of all others; counts over all documents."""
    counts = documents.where(F.col(text).isNotNull()).select(text).mapInArrow(_count_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    got = counts.where(F.col("n") > EVIDENCE + KNOWN_SHARE * total).toArrow().to_pydict()
    return {w: float(np.log(total / n)) for w, n in zip(got["word"], got["n"])}, float(np.log(1 / KNOWN_SHARE))


def fitted(samples: DataFrame, documents: DataFrame, text: str = "text") -> tuple[Ordinal, Measure]:
    graded = samples.where(F.col("text").isNotNull() & F.col("reading_level").between(1, LEVELS)).orderBy("sample_id").limit(MOST_GRADED).select("text", "reading_level").collect()
    texts, levels = [r[0] for r in graded], np.array([r[1] for r in graded], int)
    if not len(texts):
        raise ValueError("no graded texts")
    measure = Measure(*corpus_surprisal(documents, text))
    rows = measure.rows(texts)
    held = cross_validate(rows, levels, [0.3, 1.0, 3.0])
    ridge = min(held, key=lambda r: (float(np.mean(np.abs(held[r] - levels))), -r))
    return Ordinal().fit(rows, levels, ridge), Measure(measure.surprisal, measure.unknown)


def _level_batches(model: Ordinal, measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, 1):
                rows = measure.rows(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.level(rows).astype(np.int32)), pa.array(model.score(rows)), *(pa.array(c) for c in rows.T)],
                    names=["doc_id", "reading_level", "score", *FEATURES],
                )

    return run


def reading_levels(documents: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, reading_level, the model's score and the features of every document whose text isn't blank."""
    if samples.limit(1).count() == 0:
        return documents.sparkSession.createDataFrame([], f"doc_id bigint, reading_level int, score double, {', '.join(f'{c} double' for c in FEATURES)}")
    model, measure = fitted(samples, documents, text)
    rows = documents.where(F.col(text).isNotNull() & F.col(text).rlike(r"(?U)\S") & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_level_batches(model, measure), f"doc_id bigint, reading_level int, score double, {', '.join(f'{c} double' for c in FEATURES)}")
