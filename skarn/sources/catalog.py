"""A directory as a database: files in it are tables of PUBLIC, sub-directories are schemas.

Paths are listed by Hadoop's file systems, so any store that Spark reads will do.
Only footers are read until a query runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, CharType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType,
    ShortType, StringType, StructType, TimestampNTZType, TimestampType, VarcharType,
)

DEFAULT_SCHEMA = "PUBLIC"
INFORMATION_SCHEMA = "INFORMATION_SCHEMA"
#: SQL type name, numeric precision, date-time precision of each type.
TYPE_NAMES: dict[type, tuple[str, int | None, int | None]] = {
    StringType: ("VARCHAR", None, None), BooleanType: ("BOOLEAN", None, None), ByteType: ("TINYINT", 3, None), ShortType: ("SMALLINT", 5, None),
    IntegerType: ("INTEGER", 10, None), LongType: ("BIGINT", 19, None), FloatType: ("REAL", 24, None), DoubleType: ("DOUBLE", 53, None),
    DateType: ("DATE", None, 0), TimestampType: ("TIMESTAMP", None, 6), TimestampNTZType: ("TIMESTAMP", None, 6), BinaryType: ("BINARY", None, None),
    ArrayType: ("ARRAY", None, None), StructType: ("STRUCT", None, None), MapType: ("STRUCT", None, None),
}


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    path: str

    @property
    def view(self) -> str:
        """The view that stands for it: its own name in PUBLIC, else schema and name."""
        return self.name if self.schema == DEFAULT_SCHEMA else f"{self.schema}__{self.name}"


@dataclass
class Catalog:
    spark: SparkSession
    base: str
    case_sensitive: bool = False
    tables: list[Table] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tables = [Table(DEFAULT_SCHEMA, n, p) for n, p in self._parquet(self.base)]
        for name, path in self._folders(self.base):
            self.tables += [Table(name, n, p) for n, p in self._parquet(path)]
        self._frames: dict[tuple[str, str], DataFrame] = {}

    def _list(self, folder: str) -> list:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return sorted(path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path), key=lambda s: s.getPath().getName())

    def _parquet(self, folder: str) -> list[tuple[str, str]]:
        """Tables of a folder: ``x.parquet``, a file or a folder of part files; of equal names the first counts."""
        found: dict[str, tuple[str, str]] = {}
        for s in self._list(folder):
            name = s.getPath().getName()
            if name.lower().endswith(".parquet"):
                stem = name[: -len(".parquet")]
                found.setdefault(stem if self.case_sensitive else stem.lower(), (stem, s.getPath().toString()))
        return list(found.values())

    def _folders(self, folder: str) -> list[tuple[str, str]]:
        return [
            (n, s.getPath().toString()) for s in self._list(folder)
            if s.isDirectory() and not (n := s.getPath().getName()).startswith((".", "_")) and not n.lower().endswith(".parquet")
        ]

    @property
    def name(self) -> str:
        return self.base.rstrip("/").rpartition("/")[2]

    def schemas(self) -> list[str]:
        return list(dict.fromkeys([DEFAULT_SCHEMA, *(t.schema for t in self.tables)]))

    def find(self, schema: str | None, name: str) -> Table | None:
        same = (lambda a, b: a == b) if self.case_sensitive else (lambda a, b: a.lower() == b.lower())
        schema = schema or DEFAULT_SCHEMA
        for t in self.tables:
            if same(t.name, name) and (same(t.schema, schema) or schema.upper() == t.schema == DEFAULT_SCHEMA):
                return t
        return None

    def frame(self, table: Table) -> DataFrame:
        key = (table.schema, table.name)
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(table.path)
        return self._frames[key]

    # metadata

    def tables_frame(self) -> DataFrame:
        """INFORMATION_SCHEMA.TABLES."""
        rows = [(self.name, t.schema, t.name, "BASE TABLE", None) for t in self.tables]
        return self.spark.createDataFrame(rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string, REMARKS string")

    def columns_frame(self) -> DataFrame:
        """INFORMATION_SCHEMA.COLUMNS: one row a column, from the files' footers."""
        rows = []
        for t in self.tables:
            for i, f in enumerate(self.frame(t).schema.fields):
                kind, precision, scale, moment, length = describe(f.dataType)
                rows.append((self.name, t.schema, t.name, f.name, i + 1, "YES" if f.nullable else "NO", kind, length, precision, scale, moment, None, None))
        return self.spark.createDataFrame(
            rows,
            "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, IS_NULLABLE string, DATA_TYPE string, "
            "CHARACTER_MAXIMUM_LENGTH int, NUMERIC_PRECISION int, NUMERIC_SCALE int, DATETIME_PRECISION int, COLLATION_NAME string, REMARKS string",
        )


def describe(t: DataType) -> tuple[str, int | None, int | None, int | None, int | None]:
    """(SQL name, precision, scale, date-time precision, length)."""
    if isinstance(t, DecimalType):
        return "DECIMAL", t.precision, t.scale, None, None
    if isinstance(t, (CharType, VarcharType)):
        return "VARCHAR", None, None, None, t.length
    name, precision, moment = TYPE_NAMES.get(type(t), (t.simpleString().upper(), None, None))
    return name, precision, 0 if name in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT") else None, moment, None
