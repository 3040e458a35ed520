"""The k most similar vectors for every vector by a hash-prefix forest.

Each tree gives a vector a long hash string: two digits (the nearest of PIVOTS[0], then of PIVOTS[1]
pivots taken from a bounded sample, numbered by repeated bisection, so that a common prefix of their bits
is a common cluster) and then hyperplane bits.  A tree is the array of all vectors sorted by that string,
cut into ranges at quantiles of the sample's strings.

Descent finds a vector's longest-prefix matches, the rows next to it.  The ascent is synchronous: all
trees go up together, from long common prefixes to short ones, to the longest prefix length at which they
have WANTED candidates between them.  That length differs from vector to vector; it is told when a vector
is planted, from its place among the sample's strings of all trees, so that no exchange between trees is
needed.  In each tree the candidates are the rows with at least that common prefix, and in any case the
NEAR next rows on each side; of longer stretches the REACH next ones on each side.  Their exact
similarities are taken and the trees' lists are merged.

Every row is indexed; only the pivots and the range bounds come from a sample of about SAMPLE rows.
The last bits of the string are bits of the row's key, so that equal vectors, however many, spread over
several ranges.  Vectors are carried as 16-bit fractions of their unit vector (error of a cosine about 1e-5).

Defined results: rows whose key is null, or whose vector has not `width` finite numbers or is all zero, take no part;
a key delivered twice counts once; of equally similar neighbours the one of smaller key hash counts.
Keys are carried as 64-bit hashes and turned back into keys at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees; candidates all trees ascend to together; rows on each side that a tree gives at least and at most; rows compared at once.
TREES, WANTED, NEAR, REACH, BLOCK = 4, 1500, 128, 768, 256
#: Rows of the sample from which a prefix length is told; deeper ones are reckoned by halving.
TOLD = 32
PIVOTS = (2048, 64)
#: Expected rows of the sample for pivots and bounds; at most twice as many are taken.
SAMPLE = 24_000
RANGE_ROWS = 16_000
DIGIT_BITS, PLANE_BITS, KEY_BITS = (11, 6), 35, 11
BITS = sum(DIGIT_BITS) + PLANE_BITS + KEY_BITS


@dataclass
class Tree:
    pivots: list[np.ndarray]
    digits: list[np.ndarray]
    planes: np.ndarray
    bounds: np.ndarray
    sample: np.ndarray

    def strings(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Hash strings as ordered 63-bit numbers."""
        out = np.zeros(len(x), np.int64)
        for p, d, bits in zip(self.pivots, self.digits, DIGIT_BITS):
            out = out << bits | d[np.argmax(x @ p.T, axis=1)]
        for b in ((x @ self.planes) > 0).T:
            out = out << 1 | b
        return out << KEY_BITS | (keys >> np.int64(20)) & np.int64((1 << KEY_BITS) - 1)


def stretch_of(strings: np.ndarray, length: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end in the sorted array `among` of the strings that share prefixes of the given lengths."""
    shift = BITS - length
    prefix = strings >> shift
    return np.searchsorted(among, prefix << shift), np.searchsorted(among, (prefix << shift) + ((np.int64(1) << shift) - 1), "right")


def prefix_lengths(forest: list[Tree], strings: list[np.ndarray], rows: int) -> np.ndarray:
    """Of each row, given by its strings in all trees: the longest common prefix at which the trees together have WANTED of all rows."""
    each = rows / max(1, len(forest[0].sample))
    need = max(WANTED / each, TOLD)
    n = len(strings[0])
    low, high, held = np.zeros(n, np.int64), np.full(n, BITS - KEY_BITS, np.int64), np.full(n, float(rows * len(forest)))
    while (low < high).any():
        mid = (low + high + 1) // 2
        count = np.zeros(n)
        for tree, s in zip(forest, strings):
            a, b = stretch_of(s, mid, tree.sample)
            count += b - a
        ok = count >= need
        held = np.where(ok & (low < high), count * each, held)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    deeper = np.floor(np.log2(np.maximum(held / WANTED, 1))).astype(np.int64) if each > WANTED / TOLD else 0
    return np.minimum(low + deeper, BITS - KEY_BITS).astype(np.int8)


def bisected(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of points by repeated halving along their widest direction."""
    place = np.empty(len(points), np.int64)
    todo = [(np.arange(len(points)), 0)]
    while todo:
        part, base = todo.pop()
        if len(part) == 1:
            place[part[0]] = base
            continue
        y = points[part] - points[part].mean(0)
        d = rng.standard_normal(y.shape[1]).astype(np.float32)
        for _ in range(3):
            d = y.T @ (y @ d)
            d /= np.linalg.norm(d) + 1e-9
        order, half = np.argsort(y @ d, kind="stable"), (len(part) + 1) // 2
        todo += [(part[order[:half]], base), (part[order[half:]], base + half)]
    return place


def grow(sample: np.ndarray, keys: np.ndarray, rows: int, trees: int = TREES) -> list[Tree]:
    """Trees from a sample of unit vectors."""
    rng = np.random.default_rng(7)
    out = []
    # trees take different rows of the sample as pivots, as far as it reaches: trees with the same pivots part the same neighbours
    order, used = rng.permutation(len(sample)), 0
    for _ in range(trees):
        planes = rng.standard_normal((sample.shape[1], PLANE_BITS)).astype(np.float32)
        pivots, digits = [], []
        for count in PIVOTS:
            p = sample[np.take(order, np.arange(used, used + min(count, len(sample))), mode="wrap")]
            used += count
            pivots.append(p)
            digits.append(bisected(p, rng))
        tree = Tree(pivots, digits, planes, np.zeros(0, np.int64), np.zeros(0, np.int64))
        ranges = max(1, min(-(-rows // RANGE_ROWS), len(sample) // 4))
        tree.sample = np.sort(tree.strings(sample, keys))
        tree.bounds = tree.sample[np.arange(1, ranges) * len(tree.sample) // ranges]
        out.append(tree)
    return out


def unit_vectors(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of the rows that take part."""
    keys = batch.column(0).to_numpy()
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat.reshape(-1, width)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return keys[ok], (x[ok] / norm[ok][:, None]).astype(np.float32)


def _binary(raw: np.ndarray, width: int) -> pa.Array:
    raw = np.ascontiguousarray(raw).view(np.uint8).reshape(-1)
    n = len(raw) // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])


def _from_binary(arr: pa.Array, kind, width: int) -> np.ndarray:
    _, off, data = arr.buffers()
    at = np.frombuffer(off, np.int32)[arr.offset]
    return np.frombuffer(data, np.uint8, count=len(arr) * width, offset=int(at)).view(kind).reshape(len(arr), -1)


def _plant_batches(trees: list[Tree], width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.cumsum([len(t.bounds) + 1 for t in trees])])
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                keys, x = unit_vectors(part, width)
                if not len(keys):
                    continue
                packed = np.rint(x * 32767).astype(np.int16)
                strings = [t.strings(x, keys) for t in trees]
                length = prefix_lengths(trees, strings, rows)
                for n, (tree, s) in enumerate(zip(trees, strings)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((first[n] + np.searchsorted(tree.bounds, s, "right")).astype(np.int32)), pa.array(s), pa.array(keys), pa.array(length), _binary(packed, 2 * width)],
                        names=["stretch", "string", "key", "length", "vector"],
                    )

    return run


def _nearest(x: np.ndarray, keys: np.ndarray, strings: np.ndarray, length: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows lo..hi the k best candidates of their stretch; missing ones have similarity -2."""
    at = np.arange(lo, hi)
    begin, end = stretch_of(strings[lo:hi], length[lo:hi], strings)
    begin = np.maximum(np.maximum(np.minimum(begin, at - NEAR), at - REACH), 0)
    end = np.minimum(np.minimum(np.maximum(end, at + NEAR + 1), at + REACH + 1), len(x))
    a, b = int(begin.min()), int(end.max())
    s = x[lo:hi] @ x[a:b].T
    col = np.arange(a, b)
    s[(col < begin[:, None]) | (col >= end[:, None])] = -2
    s[at - lo, at - a] = -2
    take = min(k, b - a)
    best = np.argpartition(s, b - a - take, axis=1)[:, b - a - take :] if b - a > take else np.tile(np.arange(b - a), (hi - lo, 1))
    return keys[a + best], np.take_along_axis(s, best, 1)


def _search_batches(width: int, k: int):
    """Rows arrive sorted by stretch and string; blocks are compared with their surroundings as they stream by."""

    def emit(x, keys, strings, length, lo, hi):
        got, sim = _nearest(x, keys, strings, length, lo, hi, k)
        if got.shape[1] < k:
            pad = k - got.shape[1]
            got = np.pad(got, ((0, 0), (0, pad)))
            sim = np.pad(sim, ((0, 0), (0, pad)), constant_values=-2)
        row = np.empty((hi - lo, 12 * k), np.uint8)
        row[:, : 8 * k] = np.ascontiguousarray(got).view(np.uint8).reshape(hi - lo, -1)
        row[:, 8 * k :] = np.ascontiguousarray(sim, np.float32).view(np.uint8).reshape(hi - lo, -1)
        return pa.RecordBatch.from_arrays([pa.array(keys[lo:hi]), _binary(row, 12 * k)], names=["key", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # stretch, vectors, keys, strings, prefix lengths; rows before `done` have been answered
        done = 0
        for batch in batches:
            if not len(batch):
                continue
            new = (batch.column(0).to_numpy(), _from_binary(batch.column(4), np.int16, 2 * width).astype(np.float32) / np.float32(32767), batch.column(2).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy().astype(np.int64))
            rows = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
            same = np.append(False, (rows[2][1:] == rows[2][:-1]) & (rows[0][1:] == rows[0][:-1]))
            if same.any():  # delivered twice: equal keys and vectors are neighbours
                done -= int(same[:done].sum())
                rows = tuple(r[~same] for r in rows)
            stretch = rows[0]
            edges = np.append(np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1])), len(stretch))
            for a, b in zip(edges[:-1], edges[1:]):
                last = b == len(stretch)
                at = max(done, a)
                part = [r[a:b] for r in rows[1:]]
                while at < b and (not last or at + BLOCK + REACH <= b):
                    end = min(at + BLOCK, b)
                    yield emit(*part, at - a, end - a)
                    at = end
                done = at
            keep = max(edges[-2], done - REACH)
            held, done = tuple(r[keep:] for r in rows), done - keep
        if held is not None:
            while done < len(held[0]):
                end = min(done + BLOCK, len(held[0]))
                yield emit(*held[1:], done, end)
                done = end

    return run


def _merge_batches(k: int):
    """The trees' lists of each key, which arrive together, become the k best neighbours."""
    schema = pa.schema([("key", pa.int64()), ("rank", pa.int32()), ("neighbour", pa.int64()), ("similarity", pa.float32())])

    def merged(keys, found):
        who = np.repeat(keys, k)
        near = np.ascontiguousarray(found[:, : 8 * k]).view(np.int64).reshape(-1)
        sim = np.ascontiguousarray(found[:, 8 * k :]).view(np.float32).reshape(-1)
        ok = (sim > -2) & (near != who)
        who, near, sim = who[ok], near[ok], sim[ok]
        order = np.lexsort((-sim, near, who))
        who, near, sim = who[order], near[order], sim[order]
        one = np.append(True, (who[1:] != who[:-1]) | (near[1:] != near[:-1])) if len(who) else np.zeros(0, bool)
        who, near, sim = who[one], near[one], sim[one]
        order = np.lexsort((near, -sim, who))
        who, near, sim = who[order], near[order], sim[order]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        ok = rank < k
        return pa.RecordBatch.from_arrays([pa.array(who[ok]), pa.array((rank[ok] + 1).astype(np.int32)), pa.array(near[ok]), pa.array(sim[ok])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            keys, found = batch.column(0).to_numpy(), _from_binary(batch.column(1), np.uint8, 12 * k)
            if held is not None:
                keys, found = np.append(held[0], keys), np.concatenate([held[1], found])
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield merged(keys[:cut], found[:cut])
            held = keys[cut:], found[cut:]
        if held is not None:
            yield merged(*held)

    return run


def _keyed(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == width))
    return rows.select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(vector).cast("array<float>").alias("vector"))


def _sample(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A bounded sample of keys and unit vectors, by the keys' hashes, and the number of rows."""
    total = rows.count()
    if not total:
        return np.zeros(0, np.int64), np.zeros((0, width), np.float32), 0
    part = F.pmod(F.xxhash64(F.col("key"), F.lit(99)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / total)))
    got = rows.where(part).limit(2 * SAMPLE).toArrow().combine_chunks()
    if not len(got):
        got = rows.limit(SAMPLE).toArrow().combine_chunks()
    parts = [unit_vectors(b, width) for b in got.to_batches()]
    keys, x = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(keys, kind="stable")
    return keys[order], x[order], total


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, width: int = 64, trees: int = TREES) -> DataFrame:
    """key (hash), rank, neighbour (hash), similarity: the k nearest of every row."""
    rows = _keyed(df, key, vector, width)
    keys, sample, total = _sample(rows, width)
    spark = df.sparkSession
    if not len(sample):
        return spark.createDataFrame([], "key bigint, rank int, neighbour bigint, similarity float")
    forest = grow(sample, keys, total, trees)
    planted = rows.mapInArrow(_plant_batches(forest, width, total), "stretch int, string bigint, key bigint, length tinyint, vector binary")
    # as many tasks as ranges, so that a task's rows don't grow with the data
    ranges = sum(len(t.bounds) + 1 for t in forest)
    sorted_ = planted.repartition(ranges, "stretch").sortWithinPartitions("stretch", "string", "key")
    found = sorted_.mapInArrow(_search_batches(width, k), "key bigint, found binary")
    together = found.repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(_merge_batches(k), "key bigint, rank int, neighbour bigint, similarity float")


def _names(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == width))
    return rows.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).cast("string").alias("name")).distinct()


def neighbour_pairs(df: DataFrame, key: str, vector: str, k: int = 5, width: int = 64) -> DataFrame:
    """id_a < id_b of which at least one is among the other's k nearest."""
    near = nearest(df, key, vector, k, width)
    pairs = near.select(F.least("key", "neighbour").alias("lo"), F.greatest("key", "neighbour").alias("hi")).distinct()
    names = _names(df, key, vector, width)
    got = pairs.join(names.select(F.col("h").alias("lo"), F.col("name").alias("x")), "lo")
    got = got.join(names.select(F.col("h").alias("hi"), F.col("name").alias("y")), "hi")
    return got.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def named_neighbours(df: DataFrame, key: str, vector: str, k: int = 5, width: int = 64) -> DataFrame:
    """id, rank, neighbour, similarity."""
    names = _names(df, key, vector, width)
    got = nearest(df, key, vector, k, width).join(names.select(F.col("h").alias("key"), F.col("name").alias("id")), "key")
    got = got.join(names.select(F.col("h").alias("neighbour"), F.col("name").alias("near")), "neighbour")
    return got.select("id", "rank", F.col("near").alias("neighbour"), "similarity")
