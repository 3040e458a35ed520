"""Near-duplicate texts by a chosen-path similarity join.

Every text is a set of runs (of words or of characters).  In each run of the join a set follows one
sampled token, the one of least hash under that run's function, into a bucket; buckets that are
too large are split again by further sampled tokens of their members, recursively; buckets that are
small enough, or would not be compared with less work after a split, are compared pair by pair on
sketches.  Two sets of similarity s meet at a sampled token with probability s and stay together in
each of a split's children with probability s, so the number of runs follows from the threshold, the
chance to be together after any number of splits, and the recall wanted.
Candidate pairs are then checked exactly on their whole texts.

Exact copies are one class before anything else: the join works on class representatives, and
copies come back through the membership table.

Hot buckets: path keys that are frequent in a bounded sample of the classes are split before the
shuffle by the same function that splits large buckets within a task.

Defined results: texts that are null or have fewer than min_words words (no run of size n for
characters) take no part; a key with several texts takes part with each; equal ids are never paired.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from . import arrays

#: Sketch positions of four bits carried along, two in a byte.
SKETCH, NIBBLES = 80, 16
WIDTH = SKETCH // 2
#: Buckets up to this size are compared pair by pair.
SMALL = 64
#: Children of a path at a split, and splits at most within a task: beyond, members are alike in nearly all tokens.
CHILDREN, DEPTH = 3, 8
#: Classes in the sample for hot paths, members from which a path counts as hot, and meetings in the sample that tell it.
SAMPLE, HOT_ROWS, HOT_SEEN = 16_384, 20_000, 12


def agreement(s: float) -> float:
    """Chance that two sets of similarity s have the same value at a sketch position."""
    return s + (1 - s) / NIBBLES


def survival(s: float) -> float:
    """Chance that two sets of similarity s that met are together in some bucket after however many splits."""
    lost, same = 0.0, agreement(s)
    for _ in range(1000):
        lost = (1 - same + same * lost) ** CHILDREN
    return 1 - lost


@dataclass(frozen=True)
class Rule:
    """What a text's set is and when two sets are alike."""

    kind: str  # "words" or "chars"
    run: int
    threshold: float
    min_words: int = 0
    recall: float = 0.999

    @property
    def runs(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold * survival(self.threshold)))

    @property
    def shared(self) -> int:
        """Sketch positions that a pair must share to be checked exactly: 2.5 deviations below the threshold's mean."""
        p = agreement(self.threshold)
        return math.floor(SKETCH * p - 2.5 * math.sqrt(SKETCH * p * (1 - p)))

    def units(self, text: str):
        low = text.lower()
        if self.kind == "chars":
            return low if low.strip() else ""
        return low.split()

    def set_of(self, text: str) -> set:
        u = self.units(text)
        if self.kind == "chars":
            return {u[i : i + self.run] for i in range(len(u) - self.run + 1)}
        return set(zip(*(u[i:] for i in range(self.run))))


CHUNK_RULE = Rule("words", 3, 0.5, min_words=25)
TITLE_RULE = Rule("chars", 3, 0.65)

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _run_hashes(texts: list, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of all texts, and row offsets. texts: joined words, or lower-case strings."""
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    with np.errstate(over="ignore"):
        if rule.kind == "chars":
            lengths = np.array([len(t) for t in texts], np.int64)
            starts = np.cumsum(lengths + 1) - lengths - 1
            units, first, count = cps.astype(np.uint64), starts, lengths
        else:
            gap = (cps == 0x20) | (cps == 0x0A)
            end = np.flatnonzero(gap)
            up = np.full(len(cps), _BASE, np.uint64)
            down = np.full(len(cps), pow(int(_BASE), -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
            sums = np.zeros(len(cps) + 1, np.uint64)
            np.cumsum((cps + np.uint32(0x1F123)) * up, out=sums[1:])
            at = np.append(0, end[:-1] + 1)
            units = _mix((sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64))
            row_end = np.flatnonzero(cps[end] == 0x0A) + 1
            count = np.diff(np.append(0, row_end))
            first = row_end - count
        runs = np.maximum(count - rule.run + 1, 0)
        off = np.append(0, np.cumsum(runs))
        pos = np.repeat(first - off[:-1], runs) + np.arange(off[-1])
        h = np.zeros(len(pos), np.uint64)
        for k in range(rule.run):
            h = h * _BASE + units[pos + k] + np.uint64(k + 1)
        return _mix(h), off


def sketches(texts: list, rule: Rule, functions: int) -> np.ndarray:
    """Least value, mixed, of each text's runs under each hash function; every text must have a run."""
    h, off = _run_hashes(texts, rule)
    half = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((functions, len(texts)), np.uint32)
    seed = np.random.default_rng(20240229)
    mult = seed.integers(1, 1 << 31, functions, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    at = off[:-1]
    x, y = np.empty_like(half), np.empty_like(half)
    with np.errstate(over="ignore"):
        for k in range(functions):
            np.multiply(half, mult[k], out=x)
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            out[k] = np.minimum.reduceat(x, at)
    return _mix(out.T.astype(np.uint64))


def pack(values: np.ndarray) -> np.ndarray:
    """Sketches of values below 16, two in a byte."""
    return np.ascontiguousarray(values[:, 0::2] | values[:, 1::2] << np.uint8(4))


def _sketch_batches(rule: Rule):
    total = rule.runs + SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, 3, 2_000_000):
                kept, texts = [], []
                for i, t in enumerate(part.column(3).to_pylist()):
                    u = rule.units(t)
                    if len(u) >= max(rule.run, rule.min_words):
                        kept.append(i)
                        texts.append(u if rule.kind == "chars" else " ".join(u))
                if not kept:
                    continue
                got = sketches(texts, rule, total)
                tokens = np.ascontiguousarray((got[:, : rule.runs] >> np.uint64(32)).astype(np.uint32))
                sketch = pack((got[:, rule.runs :] >> np.uint64(60)).astype(np.uint8))
                rest = part.select([0, 1, 2]).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, _binary(sketch, WIDTH), _binary(tokens.view(np.uint8), 4 * rule.runs)], names=["id", "t1", "t2", "sketch", "tokens"]
                )

    return run


def _binary(raw: np.ndarray, width: int) -> pa.Array:
    raw = np.ascontiguousarray(raw).reshape(-1)
    n = len(raw) // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])


def _from_binary(arr: pa.Array, kind, width: int) -> np.ndarray:
    _, off, data = arr.buffers()
    at = np.frombuffer(off, np.int32)[arr.offset]
    return np.frombuffer(data, kind, count=len(arr) * width, offset=int(at)).reshape(-1, width)


def classes(texts: DataFrame, rule: Rule) -> DataFrame:
    """One row per distinct text: its number rid, least id, deliveries n, sketch and sampled tokens; written to the shared folder."""
    rows = texts.select("id", "t1", "t2", "text").mapInArrow(_sketch_batches(rule), "id string, t1 bigint, t2 bigint, sketch binary, tokens binary")
    reps = rows.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens"))
    return cut_lineage(reps.withColumn("rid", F.monotonically_increasing_id()))


def _paths(tokens: np.ndarray) -> np.ndarray:
    """First-level paths: run number and token."""
    return tokens.astype(np.uint64) | np.arange(1, tokens.shape[1] + 1, dtype=np.uint64) << np.uint64(32)


def hot_paths(sample: pa.Table, runs: int, total: int) -> np.ndarray:
    """Paths, and paths below them, that by the sample hold HOT_ROWS of the total classes; sorted."""
    if not len(sample):
        return np.zeros(0, np.uint64)
    sample = sample.combine_chunks()
    sketch = _from_binary(sample.column("sketch").chunk(0), np.uint8, WIDTH)
    path = _paths(_from_binary(sample.column("tokens").chunk(0), np.uint32, runs)).reshape(-1)
    row = np.repeat(np.arange(len(sketch)), runs)
    hot, least = [], max(HOT_SEEN, HOT_ROWS * len(sketch) / max(1, total))
    for _ in range(DEPTH):
        keys, counts = np.unique(path, return_counts=True)
        inside = np.isin(path, keys[counts >= least])
        if not inside.any():
            break
        path, row = path[inside], row[inside]
        below = _children(path, sketch[row])
        keys, group = np.unique(path, return_inverse=True)
        work, _ = _after_split(group, below)
        gain = work < np.bincount(group).astype(float) ** 2
        hot.append(keys[gain])
        path, row = below[gain[group]].reshape(-1), np.repeat(row[gain[group]], CHILDREN)
    return np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)


def _path_batches(runs: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sketch = _from_binary(batch.column(1), np.uint8, WIDTH)
            path = _paths(_from_binary(batch.column(2), np.uint32, runs)).reshape(-1)
            row = np.repeat(np.arange(len(batch)), runs)
            done = []
            for _ in range(DEPTH):
                inside = np.isin(path, hot)
                if not inside.any():
                    break
                done.append((path[~inside], row[~inside]))
                row = row[inside]
                path = _children(path[inside], sketch[row]).reshape(-1)
                row = np.repeat(row, CHILDREN)
            path, row = (np.concatenate(x) for x in zip(*done, (path, row)))
            rest = batch.select([0, 1]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *rest.columns], names=["path", "rid", "sketch"])

    return run


def _children(path: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Child paths: the positions sampled, different ones for each child, depend on the path alone, the branch on the member's token there."""
    out = np.empty((len(path), CHILDREN), np.uint64)
    each = SKETCH // CHILDREN
    with np.errstate(over="ignore"):
        for c in range(CHILDREN):
            where = (_mix(path + np.uint64(c)) % np.uint64(each)).astype(np.int64) + c * each
            value = sketch[np.arange(len(path)), where >> 1] >> (where & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15)
            out[:, c] = _mix(path * _BASE + value.astype(np.uint64) + (where.astype(np.uint64) << np.uint64(20)))
    return out


def _after_split(group: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of rows: the sum of the squared sizes of its child buckets, and the first child that holds the whole group, or CHILDREN. below: the rows' child paths."""
    size = np.bincount(group)
    work, whole = np.zeros(len(size)), np.full(len(size), CHILDREN)
    for c in reversed(range(CHILDREN)):
        order = np.lexsort((below[:, c], group))
        g, b = group[order], below[order, c]
        first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (g[1:] != g[:-1])))
        n = np.diff(np.append(first, len(b)))
        work += np.bincount(g[first], n.astype(float) ** 2, len(size))
        full = n == size[g[first]]
        whole[g[first[full]]] = c
    return work, whole


_ONES = np.uint64(0x1111111111111111)


def _agreeing(other: np.ndarray) -> np.ndarray:
    """Positions at which sketches agree, from the exclusive or of their words: those whose four bits are equal."""
    other |= other >> np.uint64(1)
    other |= other >> np.uint64(2)
    other &= _ONES
    return SKETCH - np.bitwise_count(other).sum(0, dtype=np.int16)


def _pairs_in_groups(order: np.ndarray, group: np.ndarray, sketch: np.ndarray, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike pairs at each distance within equal group numbers; order: row numbers sorted by group.

    Large groups go first, so that at a distance only a beginning of the rows is left; sketches are compared side by side in memory.
    """
    if not len(order):
        return
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    by = np.argsort(-size, kind="stable")
    size, first = size[by], first[by]
    order = order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(order))]
    group = np.repeat(np.arange(len(size)), size)
    words = np.ascontiguousarray(sketch.view(np.uint64)[order].T)
    ends = np.cumsum(size)
    for step in range(1, int(size[0])):
        most = int(ends[np.searchsorted(-size, -step, "left") - 1])
        for lo in range(0, most - step, 1 << 15):
            hi = min(lo + (1 << 15), most - step)
            ok = _agreeing(words[:, lo:hi] ^ words[:, lo + step : hi + step]) >= shared
            at = lo + np.flatnonzero(ok)
            at = at[group[at] == group[at + step]]
            if len(at):
                yield order[at], order[at + step]


def candidate_pairs(path: np.ndarray, sketch: np.ndarray, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in a small bucket; large buckets are split again by sampled tokens."""
    rows, path = np.arange(len(path)), path.view(np.uint64)
    for depth in range(DEPTH + 1):
        if not len(rows):
            return
        order = np.argsort(path, kind="stable")
        rows, path = rows[order], path[order]
        first = np.append(True, path[1:] != path[:-1])
        group = np.cumsum(first) - 1
        size = np.bincount(group)[group]
        large = (size > SMALL) & (depth < DEPTH)
        take = (size > 1) & ~large
        yield from _pairs_in_groups(rows[take], group[take], sketch, shared)
        if not large.any():
            return
        rows, path, size = rows[large], path[large], size[large]
        group = np.cumsum(np.append(True, path[1:] != path[:-1])) - 1
        below = _children(path, sketch[rows])
        work, whole = (x[group] for x in _after_split(group, below))
        # a bucket that a child holds as a whole goes on with that child alone; one that a split doesn't ease is compared now
        same = whole < CHILDREN
        now = ~same & (work >= size.astype(float) ** 2)
        yield from _pairs_in_groups(rows[now], group[now], sketch, shared)
        split = ~same & ~now
        path = np.concatenate([below[same, whole[same]], below[split].reshape(-1)])
        rows = np.concatenate([rows[same], np.repeat(rows[split], CHILDREN)])


def _candidate_batches(shared: int):
    """Rows arrive sorted by path; whole groups are handled, the last one waits for the next batch."""
    def pairs(path, rid, sketch):
        for a, b in candidate_pairs(path, sketch, shared):
            a, b = np.minimum(rid[a], rid[b]), np.maximum(rid[a], rid[b])
            keep = a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            path = batch.column(0).to_numpy()
            waiting.append((path, batch.column(1).to_numpy(), _from_binary(batch.column(2), np.uint8, WIDTH)))
            held += len(path)
            if held < 50_000 or path[0] == path[-1]:
                continue
            path, rid, sketch = (np.concatenate(x) for x in zip(*waiting))
            cut = int(np.searchsorted(path, path[-1]))
            yield from pairs(path[:cut], rid[:cut], sketch[:cut])
            waiting, held = [(path[cut:], rid[cut:], sketch[cut:])], len(path) - cut
        if waiting:
            yield from pairs(*(np.concatenate(x) for x in zip(*waiting)))

    return run


def candidates(reps: DataFrame, rule: Rule) -> DataFrame:
    """Pairs a < b of class numbers that met in a small bucket of some run and are alike on their sketches."""
    kinds = "path bigint, rid bigint, sketch binary"
    total = reps.count()
    near = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, total))))
    hot = hot_paths(reps.where(near).select("sketch", "tokens").limit(2 * SAMPLE).toArrow(), rule.runs, total)
    paths = reps.select("rid", "sketch", "tokens").mapInArrow(_path_batches(rule.runs, hot), kinds)
    met = paths.repartition("path").sortWithinPartitions("path")
    return met.mapInArrow(_candidate_batches(rule.shared), "a bigint, b bigint").distinct()


def _verify_batches(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, a, b in zip(range(len(batch)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = rule.set_of(a), rule.set_of(b)
                common = len(x & y)
                s = common / (len(x) + len(y) - common) if x or y else 0.0
                if s >= rule.threshold:
                    out.append((k, s))
            if out:
                kept = batch.select([0, 1]).take(pa.array([k for k, _ in out]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([s for _, s in out])], names=["a", "b", "similarity"])

    return run


def similar_classes(texts: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of class numbers whose exact similarity reaches the threshold.

    The candidates' texts are fetched by the id and class of each representative: one shuffle of the text
    column serves both sides, and besides it one text of each candidate pair moves.
    """
    pairs = candidates(reps, rule)
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("rid").alias(side), F.col("rep").alias(f"r{side}"), F.col("t1").alias(f"t{side}")), side)
    source = texts.select("id", "t1", "text")
    pairs = pairs.join(source.select(F.col("id").alias("ra"), F.col("t1").alias("ta"), F.col("text").alias("x")), ["ra", "ta"])
    pairs = pairs.join(source.select(F.col("id").alias("rb"), F.col("t1").alias("tb"), F.col("text").alias("y")), ["rb", "tb"])
    return pairs.select("a", "b", "x", "y").mapInArrow(_verify_batches(rule), "a bigint, b bigint, similarity double").distinct()


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, text, and the text's class: 128 bits of it."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


#: Copies of one class that a task pairs with another copy at most.
SHARE_OF_CLASS = 1000


def _shares(n: Column) -> Column:
    """Into how many shares the n copies of a class are cut."""
    return F.ceil(n / SHARE_OF_CLASS).cast("int")


def _ids(texts: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rid, id and share of every id that takes part, and of the ids of classes with several deliveries.

    Most classes have one delivery, whose id stands with the class; only the others look their ids up.
    """
    several = reps.where("n > 1").select("rid", "t1", "t2", _shares(F.col("n")).alias("s"))
    copies = texts.select("id", "t1", "t2").join(several, ["t1", "t2"]).select("rid", "id", F.pmod(F.xxhash64("id"), F.col("s")).cast("int").alias("share")).distinct()
    return reps.where("n = 1").select("rid", F.col("rep").alias("id"), F.lit(0).alias("share")).unionByName(copies), copies


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction of edges a > b: every neighbour is tied to the least of the neighbourhood. small: only the neighbours below a vertex count; else those above it are tied."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
    return both.where("w > v").join(least, "v").select(F.col("w").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, label: the least vertex of each vertex's component.

    Large and small stars alternate until the edges stay as they are, in a number of rounds that grows with the
    logarithm of the longest path. Each round is written to the shared folder and the one before it removed.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        new = cut_lineage(_star(_star(now, False), True))
        discard(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())


def groups(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """id, group_id (the least id of its group, its own where it stands alone) and links, the number of other ids whose texts are alike: one row per id that takes part."""
    texts = _texts(df, key, text)
    reps = classes(texts, rule)
    linked = cut_lineage(similar_classes(texts, reps, rule).select("a", "b"))
    ids = _ids(texts, reps)[0].drop("share")
    size = ids.groupBy("rid").agg(F.count("*").alias("size"))
    ends = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(size.select(F.col("rid").alias("b"), "size"), "b").groupBy(F.col("a").alias("rid")).agg(F.sum("size").alias("others"))
    label = components(linked).select(F.col("v").alias("rid"), "label")
    rows = ids.join(size, "rid").join(near, "rid", "left").join(label, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    first = rows.groupBy("label").agg(F.min("id").alias("group_id"))
    got = rows.join(first, "label").select("id", "group_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return got.groupBy("id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))


def _members(rows: DataFrame, rid: str, n: str, ids: DataFrame, name: str) -> DataFrame:
    """rows with every id of the class rid of n copies as name; a class meets its rows share by share, so that a large one is spread over many tasks."""
    spread = rows.withColumn("share", F.explode(F.sequence(F.lit(0), _shares(F.col(n)) - 1)))
    return spread.join(ids.select(F.col("rid").alias(rid), "share", F.col("id").alias(name)), [rid, "share"]).drop("share")


def similar_pairs(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """id_a < id_b: every pair of ids whose texts are alike, copies included.

    The result has n (n - 1) / 2 rows for a text with n copies, as the listing of all pairs wants; groups gives one row per id instead.
    """
    texts = _texts(df, key, text)
    reps = classes(texts, rule)
    linked = similar_classes(texts, reps, rule)
    ids, copies = _ids(texts, reps)
    for side in "ab":
        linked = linked.join(reps.select(F.col("rid").alias(side), F.col("n").alias(f"n{side}")), side)
    ab = _members(_members(linked, "a", "na", ids, "x"), "b", "nb", ids, "y").select("x", "y")
    own = copies.join(reps.where("n > 1").select("rid", "n"), "rid").select("rid", "n", F.col("id").alias("x"))
    same = _members(own, "rid", "n", copies, "y").where("x < y").select("x", "y")
    both = ab.unionByName(same).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
