"""The dump source: statements, pruned files, splits, pushed filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from panelspark.sources import dumps

LINE = """INSERT INTO "ohlcv_daily" VALUES ('{}', '{}', '{}', 1.5, 2e0, NULL, {}, 10);"""


def folder(tmp_path):
    tmp_path.mkdir(exist_ok=True)
    for ticker, market in (("A", "NYSE"), ("B", "NASDAQ"), ("C", "NYSE")):
        lines = ["-- a dump", 'INSERT INTO "news" VALUES (1);', ""]
        lines += [LINE.format(ticker, market, dt.date(2020, 1, 1) + dt.timedelta(days=i), "oops" if i == 3 else i) for i in range(40)]
        (tmp_path / f"{ticker}_{market}.sql").write_text("\n".join(lines))
    (tmp_path / "notes.txt").write_text("no dump")
    return str(tmp_path)


def test_statements():
    pattern = dumps.statement("ohlcv_daily")
    assert dumps.parsed("""insert into ohlcv_daily (a, b) values ('O''X', 'm', '2020-02-30', 1, -2.5, 1e3, x, null)""", pattern) == ("O'X", "m", None, 1.0, -2.5, 1000.0, None, None)
    assert dumps.parsed("SELECT 1", pattern) is None and dumps.parsed('INSERT INTO "ohlcv_daily" VALUES (1, 2)', pattern) is None


def test_rows_are_the_same_for_any_split(spark, tmp_path):
    path = folder(tmp_path / "d")
    whole = sorted(dumps.read_dump(spark, path).collect(), key=str)
    assert len(whole) == 120 and sum(r.close is None for r in whole) == 3 and all(r.low is None and r.high == 2.0 for r in whole)
    assert sorted(dumps.read_dump(spark, path, splitBytes="1000").collect(), key=str) == whole
    for size in (1, 7, 100):
        reader = dumps.DumpReader({"path": path, "splitbytes": str(size)})
        rows = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(rows, key=str) == sorted((tuple(r) for r in whole), key=str)


def test_files_are_pruned_and_dates_dropped_where_they_are_read(spark, tmp_path):
    path = folder(tmp_path / "d")
    reader = dumps.DumpReader({"path": path})
    assert len(reader.partitions()) == 3
    filters = [EqualTo(("market",), "NYSE"), In(("ticker",), ("A", "B")), GreaterThan(("date",), dt.date(2020, 1, 30)), LessThanOrEqual(("date",), dt.date(2020, 2, 2))]
    assert list(reader.pushFilters(filters)) == filters
    (part,) = reader.partitions()
    assert part.path.endswith("A_NYSE.sql")
    (batch,) = reader.read(part)
    assert [str(x) for x in batch.column(2).to_pylist()] == ["2020-01-31", "2020-02-01", "2020-02-02"]
    df = dumps.read_dump(spark, path).where((F.col("market") == "NYSE") & (F.col("date") > F.lit(dt.date(2020, 2, 8))))
    assert df.rdd.getNumPartitions() == 2 and df.count() == 2
    assert dumps.read_dump(spark, path).where("ticker = 'Z'").count() == 0


def test_written_dumps_come_back(spark, tmp_path):
    rows = [("it's", "M", dt.date(2020, 1, 1), 1.25, 2.0, None, 0.1, 5.0), ("b", "N", dt.date(2021, 1, 1), 1e-9, 2.0, 3.0, 4.0, 5.0)]
    path = str(tmp_path / "out")
    dumps.write_dump(spark.createDataFrame(rows, dumps.COLUMNS), path)
    assert sorted(tuple(r) for r in dumps.read_dump(spark, path).collect()) == sorted(rows)
    assert dumps.history(path)("b")["close"].tolist() == [4.0]
