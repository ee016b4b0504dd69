"""Recursive common tables whose steps are joined with UNION, or that have several recursive terms."""

from __future__ import annotations

import atexit
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def _delete(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as e:  # noqa: BLE001 - the gateway may be gone when the process ends
        logging.getLogger(__name__).debug("not deleted: %s (%s)", root, e)


def iterate(spark: SparkSession, seed: DataFrame, steps: list[Callable[[], DataFrame]], delta_view: str, distinct: bool, folder: str, max_rounds: int = 100_000) -> DataFrame:
    """Rows of ``seed`` and of all steps over the rows that the round before added.

    With ``distinct`` a row counts once and rounds end when none is new, so cycles
    end too. Each round's rows are a written table: lineage stays short and a lost
    executor costs no earlier round. The tables go when the process ends. More than
    ``max_rounds`` rounds are an error.
    """
    root = f"{folder.rstrip('/')}/recursion-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, root)
    schema = StructType([StructField(f.name, f.dataType) for f in seed.schema])
    k = 0

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/{k:06d}")
        return spark.read.schema(schema).parquet(f"{root}/{k:06d}")

    delta = keep(seed.distinct() if distinct else seed)
    while not delta.isEmpty():
        k += 1
        if k > max_rounds:
            raise RuntimeError(f"recursion has not ended after {max_rounds} rounds")
        delta.createOrReplaceTempView(delta_view)
        new = steps[0]()
        for s in steps[1:]:
            new = new.union(s())
        new = new.toDF(*schema.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        if distinct:
            on = [F.col(f"n.`{f.name}`").eqNullSafe(F.col(f"s.`{f.name}`")) for f in schema]
            new = new.distinct().alias("n").join(spark.read.schema(schema).parquet(f"{root}/*").alias("s"), on, "left_anti")
        delta = keep(new)
    return spark.read.schema(schema).parquet(f"{root}/*")
