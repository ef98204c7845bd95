"""Schema checks that fail before any job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
