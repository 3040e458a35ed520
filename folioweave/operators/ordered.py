"""Ordered computations within a key of any size: carry-forward, running sums and numbering.

A window over a key puts the whole key in one task.  Here the key's rows are cut into blocks of the
ordinal; windows run within blocks, blocks are summarised in one row each, a light window runs over the
summaries, and a join brings the carry back.  So a document that holds a third of all rows is worked on
by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocked(df: DataFrame, ordinal: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(ordinal) / F.lit(block)))


def carried(df: DataFrame, keys: list[str], ordinal: str, last: dict[str, str], sums: dict[str, str], include_self: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds, for each name: column of last, the last non-null value at or before (before) the row, and for each of sums the sum up to and with the row.

    Rows with a null ordinal come first. One join brings the blocks' summaries back.
    """
    rows = _blocked(df, ordinal, block)
    inside = Window.partitionBy(*keys, "_block").orderBy(ordinal)
    known, summed = inside.rowsBetween(Window.unboundedPreceding, 0 if include_self else -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_in_{n}": F.last(c, ignorenulls=True).over(known) for n, c in last.items()} | {f"_in_{n}": F.sum(c).over(summed) for n, c in sums.items()})
    ends = rows.groupBy(*keys, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ordinal))).alias(f"_end_{n}") for n, c in last.items()], *[F.sum(c).alias(f"_end_{n}") for n, c in sums.items()]
    )
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), *[F.last(f"_end_{n}", ignorenulls=True).over(over).alias(f"_carry_{n}") for n in last],
        *[F.coalesce(F.sum(f"_end_{n}").over(over), F.lit(0)).alias(f"_carry_{n}") for n in sums],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block").eqNullSafe(F.col("_b"))]
    out = rows.join(carry, on, "left")
    out = out.withColumns({n: F.coalesce(f"_in_{n}", f"_carry_{n}") for n in last} | {n: F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0)) for n in sums})
    return out.drop("_block", "_b", *[f"_k_{k}" for k in keys], *[f"_{w}_{n}" for w in ("in", "carry") for n in (*last, *sums)])


def last_known(df: DataFrame, keys: list[str], ordinal: str, columns: dict[str, str], include_self: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds, for each name: source column, the last non-null source value at or before (before) the row. Rows with a null ordinal come first."""
    return carried(df, keys, ordinal, columns, {}, include_self, block)


def running_sum(df: DataFrame, keys: list[str], ordinal: str, column: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of a column up to and with the row."""
    return carried(df, keys, ordinal, {}, {name: column}, block=block)
