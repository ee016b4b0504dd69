"""The engine: SQL in the dialect, over the tables of a directory."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable
from functools import partial
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StructType

from .dialect import Rewriter
from .dialect.rewrite import Names
from .functions import register
from .operators.recursion import iterate
from .operators.sampling import fixed_sample, system_sample
from .session import engine_session
from .sources.catalog import DEFAULT_SCHEMA, INFORMATION_SCHEMA, Catalog


class Engine:
    """A read-only database over ``base_dir``.

    >>> Engine(spark, "/data").sql("SELECT name FROM people WHERE id = :id", {"id": 3})
    """

    def __init__(self, spark: SparkSession, base_dir: str, case_sensitive: bool = False) -> None:
        self.spark = engine_session(spark)
        self.spark.conf.set("spark.sql.caseSensitive", str(case_sensitive).lower())
        register(self.spark)
        self.catalog = Catalog(self.spark, base_dir, case_sensitive)
        self.case_sensitive = case_sensitive
        self._views: set[str] = set()
        self._named: set[str] = set()
        self._serial = 0

    @classmethod
    def from_url(cls, spark: SparkSession, url: str) -> Engine:
        """``<scheme>:<dir>[?caseSensitive=true]``, the directory optionally with ``file://``."""
        m = re.fullmatch(r"(?:[a-z]+:)*?(?P<dir>(?:\w+://)?/[^?]*)(?:\?(?P<query>.*))?", url)
        if not m:
            raise ValueError(f"not a database URL: {url}")
        options = dict(p.partition("=")[::2] for p in (m["query"] or "").split("&") if p)
        return cls(spark, m["dir"], options.get("caseSensitive", "false").lower() == "true")

    # queries

    def sql(self, text: str, params: dict[str, Any] | list[Any] | None = None) -> DataFrame:
        """The result of one statement, lazily. Parameters are ``?`` (a list) or ``:name`` (a dict)."""
        self._named = set()
        done = Rewriter(self._names(params)).rewrite(text)
        if params is not None:
            _check_parameters(params)
        args = {} if params is None else {"args": params}
        try:
            return self._unique(self.spark.sql(done.text, **args))
        except AnalysisException:
            for other in done.others():
                try:
                    return self._unique(self.spark.sql(other, **args))
                except AnalysisException:  # noqa: S112 - the first form's error is the one to show
                    continue
            raise

    def batch(self, text: str, params: Iterable[dict[str, Any] | list[Any]]) -> list[DataFrame]:
        """The same statement with each set of parameters."""
        return [self.sql(text, p) for p in params]

    def explain_rewrite(self, text: str) -> str:
        """The Spark SQL that a statement becomes."""
        return Rewriter(self._names(None)).rewrite(text).text

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        found = self.catalog.find(schema, name)
        if found is None:
            raise ValueError(f"no table {name}")
        return self.catalog.frame(found)

    def pushdown(self, text: str, params: dict[str, Any] | list[Any] | None = None) -> list[dict[str, str]]:
        """For each scan of the plan: what filters reach the files, and which columns are read."""
        plan = self.sql(text, params)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        out = []
        for part in re.split(r"\n(?=\(\d+\) )", plan):
            if re.match(r"\(\d+\) (Scan|BatchScan)", part):
                get = lambda k: (re.search(rf"^{k}: (.*)$", part, re.M) or ["", ""])[1]  # noqa: E731, B023
                out.append({"location": get("Location"), "pushed_filters": get("PushedFilters"), "partition_filters": get("PartitionFilters"), "read_schema": get("ReadSchema")})
        return out

    # metadata

    def tables(self) -> DataFrame:
        return self.catalog.tables_frame()

    def columns(self) -> DataFrame:
        return self.catalog.columns_frame()

    def schemas(self) -> DataFrame:
        rows = [(s, self.catalog.name) for s in [*self.catalog.schemas(), INFORMATION_SCHEMA]]
        return self.spark.createDataFrame(rows, "TABLE_SCHEM string, TABLE_CATALOG string")

    def functions(self) -> DataFrame:
        """Every function the engine takes: Spark's, and the dialect's own names."""
        from .dialect.calls import CALLS

        names = {f.name.lower() for f in self.spark.catalog.listFunctions()} | {c.lower() for c in CALLS} | {"json_object", "json_array", "convert", "extract", "cast"}
        return self.spark.createDataFrame([(n,) for n in sorted(names)], "FUNCTION_NAME string")

    # what the rewriter asks

    def _names(self, params: Any) -> Names:
        return Names(
            table=self._table, record_fields=self._record_fields, exact=self._exact, sample=self._sample,
            recursive=partial(self._recursive, params=params), database=self.catalog.name,
        )

    def _register(self, name: str, df: DataFrame) -> str:
        df.createOrReplaceTempView(name)
        self._views.add(name)
        return name

    def _table(self, schema: str | None, name: str) -> str | None:
        """The view of a table, registered when a statement first names it."""
        if schema and schema.upper() == INFORMATION_SCHEMA:
            frames = {"TABLES": self.catalog.tables_frame, "COLUMNS": self.catalog.columns_frame}
            if name.upper() not in frames:
                raise ValueError(f"no table {schema}.{name}")
            return self._register(f"{INFORMATION_SCHEMA}__{name.upper()}", frames[name.upper()]())
        found = self.catalog.find(schema, name)
        if found is None:
            if schema and any(s.lower() == schema.lower() for s in self.catalog.schemas()):
                raise ValueError(f"no table {schema}.{name}")
            return None
        self._named.add(found.view)
        if found.view not in self._views:
            self._register(found.view, self.catalog.frame(found))
        return found.view

    def _known_columns(self) -> Iterable[tuple[str, Any]]:
        """Columns of the tables that the statement has named so far."""
        for t in self.catalog.tables:
            if t.view in self._named:
                for f in self.catalog.frame(t).schema.fields:
                    yield f.name, f.dataType

    def _record_fields(self, column: str) -> list[str] | None:
        """Field names if the column is an array of records in a table of the statement."""
        for name, kind in self._known_columns():
            if name.lower() == column.lower() and isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
                return kind.elementType.fieldNames()
        return None

    def _exact(self, name: str) -> bool:
        """False if the catalog knows the name only in another case."""
        names = {t.name for t in self.catalog.tables} | {c for c, _ in self._known_columns()}
        return name in names or name.lower() not in {n.lower() for n in names}

    def _sample(self, view: str, method: str, value: float, seed: int | None) -> str:
        df = self.spark.table(f"`{view}`")
        self._serial += 1
        return self._register(f"sample_{self._serial}", fixed_sample(df, value, seed) if method == "ROWS" else system_sample(df, value, seed))

    def _recursive(self, name: str, columns: list[str], seed: str, rest: list[str], params: Any) -> str:
        args = {} if params is None else {"args": params}
        start = self.spark.sql(seed, **args)
        start = start.toDF(*columns) if columns else start
        folder = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
        if not folder:
            if not self.spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="skarn-")
        steps = [lambda q=q: self.spark.sql(q, **args) for q in rest[:-1]]
        out = iterate(self.spark, start, steps, name, rest[-1] == "UNION", folder)
        self.spark.catalog.dropTempView(name)
        self._serial += 1
        return self._register(f"recursive_{self._serial}", out)

    def _unique(self, df: DataFrame) -> DataFrame:
        """Columns of equal names get the name of their table before theirs, as every later step needs unique names."""
        low = [c.lower() for c in df.columns]
        if len(set(low)) == len(low):
            return df
        output = df._jdf.queryExecution().analyzed().output()
        seen: set[str] = set()
        names = []
        for i, c in enumerate(df.columns):
            if low.count(c.lower()) > 1:
                parts = output.apply(i).qualifier()
                c = f"{parts.apply(parts.size() - 1)}__{c}" if parts.size() else c
            n, k = c, 1
            while n.lower() in seen:
                k += 1
                n = f"{c}_{k}"
            seen.add(n.lower())
            names.append(n)
        return df.toDF(*names)


def _check_parameters(params: dict[str, Any] | list[Any]) -> None:
    for v in params.values() if isinstance(params, dict) else params:
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            raise ValueError("parameters must be finite numbers")
        if hasattr(v, "read"):
            raise ValueError("streams can't be parameters")


__all__ = ["DEFAULT_SCHEMA", "Engine"]
