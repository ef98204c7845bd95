"""Reports: tables as CSV and LaTeX, and provenance as JSON.  A report has a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_latex(df: DataFrame, path: str, keys: list[str], digits: dict[str, int], source: str) -> None:
    """A table in order of its keys: names, numbers with their digits, and a line that says where it comes from."""
    escaped = lambda x: F.regexp_replace(x, r"([_&%#$])", r"\\$1")
    number = lambda c, n: F.col(c).cast("string") if n == 0 else F.format_string(f"%.{n}f", F.col(c).cast("double"))
    cells = [*(escaped(F.col(k).cast("string")) for k in keys), *(number(c, n) for c, n in digits.items())]
    rows = df.select(F.lit(3).alias("k"), F.concat_ws("", *[F.col(k).cast("string") for k in keys]).alias("o"), F.concat(F.concat_ws(" & ", *[F.coalesce(c, F.lit("--")) for c in cells]), F.lit(" \\\\")).alias("value"))
    names = " & ".join(c.replace("_", "\\_") for c in [*keys, *digits])
    frame = [(0, "", f"\\begin{{tabular}}{{{'l' * len(keys)}{'r' * len(digits)}}}"), (1, "", f"{names} \\\\"), (2, "", "\\midrule"), (4, "", "\\end{tabular}"), (5, "", f"% source: {source}")]
    lines = rows.unionByName(df.sparkSession.createDataFrame(frame, "k int, o string, value string"))
    lines.coalesce(1).sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(path)


def digest(df: DataFrame) -> DataFrame:
    """One row (n, digest) of a bounded table: a digest of the digests of its rows, columns by name."""
    row = F.md5(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) for c in sorted(df.columns)]))
    return df.agg(F.count(F.lit(1)).alias("n"), F.substring(F.md5(F.array_join(F.array_sort(F.collect_list(row)), "")), 1, 12).alias("digest"))


def write_provenance(df: DataFrame, path: str, name: str, **more: str) -> None:
    """The table's digest, its columns and what the caller adds, as one line of JSON."""
    extra = [F.lit(v).alias(k) for k, v in more.items()]
    digest(df).select(F.lit(name).alias("name"), "n", "digest", F.lit(",".join(sorted(df.columns))).alias("columns"), *extra).coalesce(1).write.mode("overwrite").json(path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, n long, digest string, columns string").json(path)
