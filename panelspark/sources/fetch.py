"""Histories from a caller's fetch function, a name at a time on the executors, kept as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import cached

COLUMNS = ["date", "open", "high", "low", "close", "volume"]


def fetched(names: DataFrame, key: str, fetch: Callable[[object], pd.DataFrame]) -> DataFrame:
    """(key, date, open, high, low, close, volume, error): the rows of every name, or one row with what its fetch raised.

    A name that fails is passed over, not the others.  Rows without volume go; times
    with a zone become dates.
    """
    schema = f"{key} {names.schema[key].dataType.simpleString()}, date date, open double, high double, low double, close double, volume double, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part[key]:
                try:
                    rows = fetch(name)[COLUMNS].copy()
                    rows["date"] = pd.to_datetime(rows["date"]).dt.tz_localize(None).dt.date
                    rows = rows[rows["volume"] > 0]
                    rows["error"] = None
                except Exception as e:  # noqa: BLE001 a caller's function may raise anything; it becomes the name's status
                    rows = pd.DataFrame([[None] * len(COLUMNS) + [str(e)]], columns=[*COLUMNS, "error"])
                rows.insert(0, key, name)
                yield rows

    return names.select(key).distinct().mapInPandas(run, schema)


def fetched_once(names: DataFrame, key: str, fetch: Callable[[object], pd.DataFrame], path: str, rebuild: bool = False) -> DataFrame:
    """The same from the table at ``path``, which is made if it is not there."""
    return cached(names.sparkSession, path, lambda: fetched(names, key, fetch), rebuild)


def failures(histories: DataFrame, key: str) -> DataFrame:
    """(key, error) of the names that failed."""
    return histories.where(F.col("error").isNotNull()).select(key, "error")
