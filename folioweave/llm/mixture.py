"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are tokens of a public tokenizer.  The mixture is the largest in which every source that has
both documents and a target can supply its share within max_repeats (or of a given size, where capped
sources pass their blocks on to the rest).  Its blocks of equal token size are awarded one by one to the source with the
highest quotient share / (2 * blocks held + 1); the award sequence is cut into shards, so every shard has
integer quotas in proportion.  A source's documents stand in a seeded random order, repeated up to
max_repeats times; its n-th block is the n-th stretch of that stream, and a document belongs to the block
in which it begins.

Running sums over a source, however large, are taken within buckets of the seeded order and shifted by
the buckets' totals, so no task holds a whole source.

Defined results: sources are compared without case and surrounding blanks; a null source, one without
target, or one whose share is null or not positive supplies nothing; a listed source without documents
reaches share 0 and its target is spread over the others in proportion; several target rows of one
source: the greatest share with the greatest max_repeats; max_repeats null or below 1 counts as 1; null and
empty texts have no tokens and are never chosen.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import norm_key
from . import bpe

BLOCKS, SHARDS, BUCKETS, SEED = 8192, 16, 1024, 17


@dataclass
class Quota:
    source: str
    target: float
    adjusted: float
    tokens: int
    repeats: int
    blocks: int = 0


def award(shares: list[float], caps: list[int], blocks: int) -> list[int]:
    """The source of each block in order, by highest quotient; a source at its cap is passed over. Ties go to the earlier source."""
    heap = [(-s, i, 0) for i, s in enumerate(shares) if s > 0 and caps[i] > 0]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < blocks:
        _, i, held = heapq.heappop(heap)
        out.append(i)
        if held + 1 < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * held + 3), i, held + 1))
    return out


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None, blocks: int = BLOCKS) -> tuple[list[Quota], float, list[int]]:
    """Quotas, tokens of a block, and the award sequence."""
    quotas = [Quota(s, t, 0.0, sizes.get(s, 0), max(1, r or 1)) for s, t, r in sorted(targets) if t and t > 0]
    live = [q for q in quotas if q.tokens > 0]
    weight = sum(q.target for q in live)
    for q in live:
        q.adjusted = q.target / weight
    if not live:
        return quotas, 1.0, []
    total = total_tokens or min(q.tokens * q.repeats / q.adjusted for q in live)
    size = total / blocks
    caps = [int(q.tokens * q.repeats / size + 1e-9) for q in live]
    got = award([q.adjusted for q in live], caps, blocks)
    for i in got:
        live[i].blocks += 1
    index = {id(q): i for i, q in enumerate(quotas)}
    return quotas, size, [index[id(live[i])] for i in got]


def counted(documents: DataFrame, path: str | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, order and tokens of each document; written to the shared folder, as the tokenizer's work is used twice."""
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", norm_key(F.col("source")).alias("source"), F.xxhash64(F.lit(seed), "doc_id").alias("order"), "text")
    return cut_lineage(bpe.count_tokens(rows, ["doc_id", "source", "order"], path=path))


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """One row per source; the target table is small and fixed, one row per source."""
    t = targets.where(F.col("source").isNotNull()).groupBy(norm_key(F.col("source")).alias("s")).agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("r"))
    return [(r["s"], float(r["t"] or 0), r["r"]) for r in t.collect()]


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, pass, block, shard, tokens: one row for each use of a document) and the shares reached."""
    spark = documents.sparkSession
    docs = counted(documents)
    wanted = _targets(targets)
    docs = docs.where(F.col("source").isin([s for s, _, _ in wanted]) & (F.col("tokens") > 0)).withColumn("bucket", F.shiftrightunsigned("order", 54).cast("int"))
    parts = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    sizes = {r[0]: r[1] for r in parts.groupBy("source").agg(F.sum("n")).collect()}
    quotas, size, sequence = plan(sizes, wanted, total_tokens, blocks)
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = docs.withColumn("inside", inside).join(before, ["source", "bucket"]).withColumn("start", F.col("inside") + F.col("before"))
    held: dict[int, int] = {}
    rows = []
    for n, i in enumerate(sequence):
        rows.append((quotas[i].source, held.get(i, 0), n * shards // len(sequence)))
        held[i] = held.get(i, 0) + 1
    awards = spark.createDataFrame(rows, "source string, block int, shard int")
    sources = spark.createDataFrame([(q.source, q.tokens, q.repeats, q.blocks) for q in quotas], "source string, available bigint, repeats int, quota int")
    uses = placed.join(sources, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    uses = uses.withColumn("block", F.floor((F.col("start") + F.col("pass") * F.col("available")) / F.lit(size)).cast("int")).where(F.col("block") < F.col("quota"))
    mix = uses.join(awards, ["source", "block"]).select("doc_id", "source", (F.col("pass") + 1).alias("pass"), "block", "shard", "tokens")
    base = spark.createDataFrame(
        [(q.source, q.target, q.adjusted, q.tokens, q.repeats, q.blocks) for q in quotas], "source string, target_share double, adjusted_share double, available_tokens bigint, max_repeats int, quota_blocks int"
    )
    return mix, base


def shares(mix: DataFrame, base: DataFrame) -> DataFrame:
    """Target and reached share of each listed source. The mixture is reduced to a row per source before anything is joined."""
    used = mix.groupBy("source").agg(F.sum("tokens").alias("mixture_tokens"), F.count("*").alias("uses"), F.max("pass").alias("most_uses"))
    got = base.join(used, "source", "left").fillna(0, ["mixture_tokens", "uses", "most_uses"])
    whole = F.sum("mixture_tokens").over(Window.partitionBy(F.lit(1)))
    return got.withColumn("reached_share", F.when(whole > 0, F.col("mixture_tokens") / whole).otherwise(F.lit(0.0)))
