"""SQL dumps of price histories as a data source: files pruned by name, split by bytes, rows dropped by date where they are read.

A dump is a folder of text with one INSERT statement a line, a file for each ticker and
market, named ``TICKER_MARKET.sql`` or lying below ``ticker=TICKER/market=MARKET``.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COLUMNS = "ticker string, market string, date date, open double, high double, low double, close double, volume double"
NUMBERS = ("open", "high", "low", "close", "volume")
SPLIT = 64 << 20
ROWS = 1 << 14

_NAMED = re.compile(r"(?:^|/)([^/_]+)_([^/_]+)\.sql$")
_FOLDERS = re.compile(r"(?:^|/)ticker=([^/]+)/market=([^/]+)/[^/]+$")
_LITERAL = re.compile(r"'((?:[^']|'')*)'|([^\s,()]+)")


def statement(table: str) -> re.Pattern:
    return re.compile(rf'^\s*INSERT\s+INTO\s+"?{re.escape(table)}"?[^\'()]*(?:\([^()]*\))?\s*VALUES\s*\((.*)\)\s*;?\s*$', re.IGNORECASE)


def number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:  # text where a number should be is unknown
        return None


def day(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text[:10]) if text else None
    except ValueError:
        return None


def parsed(line: str, pattern: re.Pattern) -> tuple | None:
    """(ticker, market, date, numbers...) of a statement for the table, None for any other line."""
    found = pattern.match(line)
    if not found:
        return None
    values = [m.group(1).replace("''", "'") if m.group(1) is not None else None if m.group(2).upper() == "NULL" else m.group(2) for m in _LITERAL.finditer(found.group(1))]
    if len(values) < 3 + len(NUMBERS):
        return None
    return (values[0], values[1], day(values[2]), *(number(v) for v in values[3 : 3 + len(NUMBERS)]))


@dataclass
class Part(InputPartition):
    """Bytes [start, stop) of a file: the lines that begin in them."""

    path: str
    start: int
    stop: int


class DumpReader(DataSourceReader):
    """Filters on ticker and market choose files by their names, those on the date drop rows; Spark checks all of them again."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "ohlcv_daily")
        self.split = int(options.get("splitbytes", SPLIT))
        self.wanted: dict[str, set] = {}
        self.low: dt.date | None = None  # dates from low to high, both inclusive
        self.high: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        step = dt.timedelta(days=1)
        for f in filters:
            name = f.attribute[0].lower() if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("ticker", "market") and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            elif name == "date" and isinstance(getattr(f, "value", None), dt.date):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = f.value + step if isinstance(f, GreaterThan) else f.value
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value - step if isinstance(f, LessThan) else f.value
                    self.high = high if self.high is None else min(self.high, high)
            yield f

    def takes(self, path: str) -> bool:
        """Whether a file is of the dump and may hold wanted rows."""
        found = _NAMED.search(path) or _FOLDERS.search(path)
        if not found or path.rsplit("/", 1)[-1].startswith(("_", ".")):
            return False
        return all(value in self.wanted.get(name, {value}) for name, value in zip(("ticker", "market"), found.groups(), strict=True))

    def partitions(self) -> list[Part]:
        system, base = fs.FileSystem.from_uri(self.path)
        files = system.get_file_info(fs.FileSelector(base, recursive=True))
        return [Part(f.path, at, min(at + self.split, f.size)) for f in files if f.is_file and f.size and self.takes(f.path) for at in range(0, f.size, self.split)] or [Part("", 0, 0)]

    def lines(self, part: Part) -> Iterator[str]:
        if not part.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(part.path) as file:
            at = max(part.start - 1, 0)
            file.seek(at)
            rest, skip = b"", part.start > 0  # from the byte before on: a line that begins at start is whole
            while at < part.stop:
                block = file.read(1 << 20)
                if not block:
                    break
                rest += block
                *whole, rest = rest.split(b"\n")
                for line in whole:
                    if skip:
                        skip = False
                    elif at < part.stop:
                        yield line.decode("utf-8", "ignore")
                    at += len(line) + 1
            if rest and not skip and at < part.stop:
                yield rest.decode("utf-8", "ignore")

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        pattern, rows = statement(self.table), []
        for line in self.lines(partition):
            row = parsed(line, pattern)
            if row is None or ((self.low or self.high) and (row[2] is None or (self.low and row[2] < self.low) or (self.high and row[2] > self.high))):
                continue
            rows.append(row)
            if len(rows) == ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.date32(), *[pa.float64()] * len(NUMBERS)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["ticker", "market", "date", *NUMBERS])


class DumpSource(DataSource):
    """Format ``sql_dump``; options: path, table, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "sql_dump"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DumpReader:
        return DumpReader(dict(self.options))


def read_dump(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of a dump, with filters pushed to its files."""
    spark.dataSource.register(DumpSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("sql_dump").options(**options).load(path)


def write_dump(df: DataFrame, path: str, table: str = "ohlcv_daily") -> None:
    """Rows (ticker, market, date, numbers) as INSERT statements, a folder a ticker and market."""
    from pyspark.sql import functions as F

    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    values = F.concat_ws(", ", *map(quoted, ("ticker", "market", "date")), *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in NUMBERS])
    lines = df.select("ticker", "market", F.concat(F.lit(f'INSERT INTO "{table}" VALUES ('), values, F.lit(");")).alias("value"))
    lines.repartition("ticker", "market").write.mode("overwrite").partitionBy("ticker", "market").text(path)


def history(path: str, table: str = "ohlcv_daily") -> Callable[[object], pd.DataFrame]:
    """A fetch function: the rows of one ticker in a dump; it raises for a ticker without files."""

    def fetch(name: object) -> pd.DataFrame:
        reader = DumpReader({"path": path, "table": table})
        reader.wanted = {"ticker": {str(name)}}
        parts = [p for p in reader.partitions() if p.path]
        if not parts:
            raise LookupError(f"no history of {name}")
        rows = [b for p in parts for b in reader.read(p)]
        return pa.Table.from_batches(rows, batch_of([]).schema).to_pandas().sort_values("date")

    return fetch
