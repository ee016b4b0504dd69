"""Functions that Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def register(spark: SparkSession) -> None:
    """``normalize_text(s, form)``: Unicode normal forms, in batches; everything else is SQL."""

    @pandas_udf("string")
    def normalize_text(s: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unicodedata.normalize(f, x) for x, f in zip(s, form, strict=True)])

    spark.udf.register("normalize_text", normalize_text)
