"""LAG and LEAD whose offset differs from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shifted(df: DataFrame, value: Column, offset: Column, partition: list[str], order: list[Column], name: str, default: Column | None = None, lead: bool = False) -> DataFrame:
    """Adds the value of the row ``offset`` places before (or after) in its partition's order.

    A null offset is 1; one below 1 is an error of the query. Rows are numbered in one
    sort and joined with themselves by partition and number; no row gathers its partition.
    """
    step = F.coalesce(offset, F.lit(1))
    step = F.when(step > 0, step).otherwise(F.raise_error(F.lit("offsets must be positive")).cast("int"))
    rn = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    left = df.withColumn("_rn", rn).withColumn("_at", F.col("_rn") + (step if lead else -step))
    right = df.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)], rn.alias("_of"), value.alias("_value"), F.lit(True).alias("_found"))
    on = F.col("_at") == F.col("_of")
    for i, c in enumerate(partition):
        on = on & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    out = F.when(F.col("_found"), F.col("_value")).otherwise(default if default is not None else F.lit(None))
    return left.join(right, on, "left").withColumn(name, out).select(*df.columns, name)
