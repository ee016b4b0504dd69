"""An interactive session: ``python -m skarn.sources.shell [DIR]``."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..api import Engine
from ..session import local_session

HELP = """/connect DIR   open a folder of Parquet files
/close         close it
/list [SCHEMA] its tables
/describe T    a table's columns ([schema.]table)
/info          what is open
/help          this text
/exit          leave
anything else  is a statement; it may end with a semicolon"""


class Shell:
    """One line in, text out. Errors are told, never raised."""

    def __init__(self, spark: Callable[[], SparkSession], rows: int = 100) -> None:
        self.spark, self.rows = spark, rows
        self.engine: Engine | None = None
        self.done = False

    def run(self, line: str) -> str:
        line = line.strip()
        if not line:
            return ""
        try:
            if line.startswith("/"):
                name, _, rest = line[1:].partition(" ")
                command = getattr(self, f"do_{name.lower()}", None)
                return command(rest.strip()) if command else f"unknown command /{name}; /help lists them"
            return self.show(self.opened().sql(line.rstrip(";")))
        except Exception as e:  # noqa: BLE001 - a session goes on after an error
            return f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"

    def opened(self) -> Engine:
        if self.engine is None:
            raise ValueError("nothing is open; /connect DIR")
        return self.engine

    def show(self, df) -> str:  # noqa: ANN001
        rows = [df.columns, *[["NULL" if v is None else str(v) for v in r] for r in df.limit(self.rows).collect()]]
        widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
        lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
        return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])

    def do_connect(self, rest: str) -> str:
        self.engine = Engine.from_url(self.spark(), rest)
        return f"opened {self.engine.catalog.base}"

    def do_close(self, rest: str) -> str:
        self.engine = None
        return "closed"

    def do_list(self, rest: str) -> str:
        return "\n".join(f"{t.schema}.{t.name}" for t in self.opened().catalog.tables if not rest or t.schema.lower() == rest.lower())

    def do_describe(self, rest: str) -> str:
        schema, _, name = rest.rpartition(".")
        return "\n".join(f"{n} {t}" for n, t in self.opened().table(name, schema or None).dtypes)

    def do_info(self, rest: str) -> str:
        e = self.opened()
        return f"{e.catalog.base}: {len(e.catalog.tables)} tables in {len(e.catalog.schemas())} schemas"

    def do_help(self, rest: str) -> str:
        return HELP

    def do_exit(self, rest: str) -> str:
        self.done = True
        return ""


def main(args: list[str]) -> None:
    shell = Shell(local_session)
    if args:
        print(shell.run(f"/connect {args[0]}"))
    while not shell.done:
        try:
            print(shell.run(input("skarn> ")))
        except EOFError:
            break


if __name__ == "__main__":
    main(sys.argv[1:])
