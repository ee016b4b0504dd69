"""A query of the engine with its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..api import Engine


@dataclass(frozen=True)
class Query:
    """``sql`` in the dialect, or ``build``; ``oracle`` is DuckDB's SQL, the same text if True, none if None."""

    name: str
    sql: str = ""
    oracle: str | bool | None = True
    build: Callable[[Engine], DataFrame] | None = None
    params: dict | list | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, sf_dir)
        return self.build(engine) if self.build else engine.sql(self.sql, self.params)

    @property
    def oracle_sql(self) -> str | None:
        return self.sql if self.oracle is True else self.oracle or None
