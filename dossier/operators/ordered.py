"""Order-dependent results computed in parallel.

A running total or an ordered fold over all rows would put every row into one task.
Here the order key (a unique, non-negative long) is cut into blocks of ``2**bits`` keys,
each block is reduced alone, and the block results are combined the same way, level by
level. No group ever holds more than ``2**bits`` rows, however the rows are distributed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K

BITS = 12


def _last_key(df: DataFrame, seq: str) -> int:
    row = df.agg(F.max(seq).alias("top")).first()
    return -1 if row is None or row["top"] is None else int(row["top"])


def running_totals(df: DataFrame, seq: str, values: list[str], keys: list[str] | None = None,
                   bits: int = BITS, top: int | None = None) -> DataFrame:
    """Add ``running_<v>`` (inclusive, by ``seq``) for each value column."""
    keys = keys or []
    top = _last_key(df, seq) if top is None else top
    block = f"{seq}_block"
    window = Window.partitionBy(*keys, block).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    blocked = df.withColumn(block, F.shiftright(F.col(seq).cast("long"), bits))
    local = blocked.select("*", *[F.sum(v).over(window).alias(f"running_{v}") for v in values])
    if top < 2**bits:
        return local.drop(block)
    totals = blocked.groupBy(*keys, block).agg(*[F.sum(v).alias(v) for v in values])
    above = running_totals(totals, block, values, keys, bits, top >> bits)
    before = above.select(
        *[F.col(k).alias(f"k_{k}") for k in keys], F.col(block).alias("b_"),
        *[(F.col(f"running_{v}") - F.col(v)).alias(f"before_{v}") for v in values],
    )
    match = F.col(block) == F.col("b_")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return local.join(before, match).select(
        *df.columns, *[(F.col(f"running_{v}") + F.col(f"before_{v}")).alias(f"running_{v}") for v in values]
    )


# -- Clamped additions ------------------------------------------------------
# x -> least(hi, greatest(lo, x + d)) composes with another such step into a third one,
# so a run of steps is one (d, lo, hi) triple and runs combine like numbers do.

def _then(a: Column, b: Column) -> Column:
    return F.struct(
        (a["d"] + b["d"]).alias("d"),
        F.least(b["hi"], F.greatest(b["lo"], a["lo"] + b["d"])).alias("lo"),
        F.least(b["hi"], F.greatest(b["lo"], a["hi"] + b["d"])).alias("hi"),
        (a["n"] + b["n"]).alias("n"),
    )


def clamp_fold(df: DataFrame, seq: str, delta: str, keys: list[str], bits: int = BITS,
               lo: float = K.WEIGHT_FLOOR, hi: float = K.WEIGHT_CEIL) -> DataFrame:
    """One row per key: the whole ordered run of clamped additions as ``d, lo, hi, n``."""
    level = df.select(
        *keys, F.col(seq).cast("long").alias("at_"),
        F.struct(
            F.col(delta).cast("double").alias("d"), F.lit(lo).cast("double").alias("lo"),
            F.lit(hi).cast("double").alias("hi"), F.lit(1).cast("long").alias("n"),
        ).alias("step_"),
    )
    top = _last_key(df, seq)
    while True:
        level = level.withColumn("block_", F.shiftright("at_", bits))
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct("at_", "step_"))), lambda x: x["step_"]
        )
        folded = F.reduce(F.slice(ordered, 2, 2**bits), ordered[0], _then)
        level = level.groupBy(*keys, "block_").agg(folded.alias("step_")).withColumnRenamed("block_", "at_")
        if top < 2**bits:
            return level.select(*keys, "step_.*")
        top >>= bits


def apply_clamp(weight: Column, d: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, weight + d))


# -- Order statistic --------------------------------------------------------

def value_at_rank(df: DataFrame, value: str, rank: Callable[[Column], Column], block: int = 1000) -> DataFrame:
    """One row: the value at 0-based ``rank(row count)`` of a sorted whole-number column.

    Values are counted first; the block of values holding the rank is found from block
    totals, and only that block is ordered, so no task sorts the rows themselves.
    """
    counts = (
        df.groupBy(F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        .withColumn("b", F.floor(F.col("v") / block))
    )
    blocks = counts.groupBy("b").agg(F.sum("c").alias("c"))
    wanted = rank(blocks.agg(F.sum("c")).scalar())
    order = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        blocks.select("b", F.sum("c").over(order).alias("upto"), "c", wanted.alias("wanted"))
        .where((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("c") <= F.col("wanted")))
        .select("b", (F.col("upto") - F.col("c")).alias("before"), "wanted")
    )
    within = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(F.broadcast(placed), "b")
        .withColumn("upto", F.col("before") + F.sum("c").over(within))
        .where(F.col("upto") > F.col("wanted"))
        .agg(F.min("v").alias(value))
    )
