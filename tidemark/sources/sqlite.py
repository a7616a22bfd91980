"""Tables of a SQLite file as a Spark data source: ``spark.read.format("sqlite_table").option("table", ...).load(path)``.

The file lies where every executor can open it. A table is read in ranges of its rowid, one a partition.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS_PER_PARTITION = 100_000
#: Affinities of declared column types, by a word that they contain; anything else is text.
KINDS = (("INT", "bigint"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))


def connection(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TableReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.names, self.kinds = path, table, schema.names, [f.dataType.simpleString() for f in schema]

    def partitions(self) -> list[Range]:
        with connection(self.path) as c:
            lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        return [Range(a, min(a + ROWS_PER_PARTITION - 1, hi)) for a in range(lo, hi + 1, ROWS_PER_PARTITION)] if lo is not None else [Range(1, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        cast = {"bigint": int, "double": float, "binary": bytes, "string": str}
        with connection(self.path) as c:
            for row in c.execute(f"SELECT {', '.join(map(quoted, self.names))} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (part.first, part.last)):
                yield tuple(None if x is None else cast[k](x) for x, k in zip(row, self.kinds))


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with connection(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda declared: next((k for word, k in KINDS if word in declared.upper()), "string")
        return ", ".join(f"`{name}` {kind(declared or '')}" for _, name, declared, *_ in columns)

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options["path"], self.options["table"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)


def attached(spark: SparkSession, path: str, table: str, fixture: list[tuple] | None = None, schema: str | None = None):
    """A table of the file at ``path``; the fixture's rows if there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fixture is not None and not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame(fixture, schema)
    register(spark)
    return spark.read.format("sqlite_table").option("table", table).load(path)
