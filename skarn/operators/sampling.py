"""TABLESAMPLE: every k-th row, and a fixed number of rows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a row's place within its partition in monotonically_increasing_id.
PLACE_BITS = 33


def system_sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """Every k-th row, k = round(100 / percent), from a start below k that the seed gives.

    Rows are numbered in scan order without moving them: each partition's size is
    counted (a number a partition comes to the driver), and its first number, the sum
    of those before it, goes back as a row a partition: 16 bytes for each split of the input.
    """
    if percent <= 0:
        return df.limit(0)
    step = max(1, round(100 / percent))
    if step == 1:
        return df
    start = random.Random(seed).randrange(step)
    sizes = dict(df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    firsts, total = {}, 0
    for p in range(max(sizes, default=-1) + 1):
        firsts[p] = total % step
        total += sizes.get(p, 0)
    if not firsts:
        return df
    place = F.monotonically_increasing_id()
    first = df.sparkSession.createDataFrame(sorted(firsts.items()), "_part int, _first long")
    own = df.withColumn("_place", place).withColumn("_part", F.shiftright("_place", PLACE_BITS).cast("int"))
    number = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.col("_first") - start
    return own.join(F.broadcast(first), "_part").withColumn("_number", number).where((F.col("_number") >= 0) & (F.col("_number") % step == 0)).select(*[f"`{c}`" for c in df.columns])


def fixed_sample(df: DataFrame, rows: float, seed: int | None = None) -> DataFrame:
    """``rows`` rows drawn with equal chances (all, if there are fewer)."""
    n = max(0, round(rows))
    drawn = df.withColumn("_draw", F.rand(seed) if seed is not None else F.rand())
    return drawn.orderBy("_draw").limit(n).drop("_draw")
