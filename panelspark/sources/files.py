"""Readers and writers of files: schemas are given, never inferred."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import require_columns

PRICES = "ticker string, date date, open double, high double, low double, close double, volume double"
NEWS = "ticker string, published_at timestamp, source string, headline string"
FACTORS = ("MKT", "SMB", "HML", "RMW", "CMA", "MOM", "STR")


def prices_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(PRICES).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return require_columns(df, "date", "close", "volume").where("volume > 0")


def news_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(NEWS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    text = F.trim(F.regexp_replace(F.regexp_replace("headline", r"<[^>]+>|https?://\S+", ""), r"\s+", " "))
    return df.withColumn("headline", text).where(F.length("headline") > 10)


def symbols(spark: SparkSession, path: str, exchange: str | None = None) -> DataFrame:
    """Pipe-separated directory without its footer row, of one exchange if named."""
    df = spark.read.option("header", True).option("sep", "|").csv(path)
    first = df.columns[0]
    df = df.where(~F.col(first).startswith("File Creation Time"))
    return (df.where(F.col("Exchange") == exchange) if exchange else df).distinct()


def factors_csv(spark: SparkSession, path: str, date_column: str = "date") -> DataFrame:
    """Known factors as fractions; refuses a file of percentages (over half of the values beyond 1)."""
    header = spark.read.option("header", True).csv(path)
    named = header.select(F.to_date(date_column).alias("date"), *[F.col(c).cast("double").alias(c.upper()) for c in header.columns if c.upper() in FACTORS])
    values = [F.abs(F.col(c)) for c in named.columns[1:]]
    if not values:
        raise ValueError("no known factor in the file")
    large, n = (sum((F.coalesce(F.sum(e), F.lit(0)) for e in es), F.lit(0)) for es in ([(v > 1).cast("int") for v in values], [v.isNotNull().cast("int") for v in values]))
    share = named.agg((large / F.nullif(n, F.lit(0))).alias("s")).first()["s"]
    if share is not None and share > 0.5:
        raise ValueError("the factors look like percentages")
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; a temporary one in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelspark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows of df as a table in a scratch folder."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the table's folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_vocabulary(df: DataFrame, path: str) -> None:
    """A vocabulary (token, n, id) as JSON, one file: its size has a bound."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, n long, id long").json(path)


def write_texts(df: DataFrame, path: str, name: str) -> None:
    """A data set of texts as Parquet below ``path``, one folder a name."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{name}")


def cached(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """Reads the table at ``path``; builds and writes it if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if rebuild or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_prices(df: DataFrame, path: str) -> None:
    df.withColumn("year", F.year("date")).repartition("ticker", "year").write.mode("overwrite").partitionBy("ticker", "year").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_sql(df: DataFrame, table: str, path: str) -> None:
    """INSERT statements as text: nulls, numbers, quoted strings and ISO times."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(name)
        plain = c.cast("string") if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal") else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        parts.append(F.coalesce(plain, F.lit("NULL")))
    df.select(F.concat(F.lit(f'INSERT INTO "{table}" VALUES ('), F.concat_ws(", ", *parts), F.lit(");")).alias("value")).write.mode("overwrite").text(path)
