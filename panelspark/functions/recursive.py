"""Recursive smoothing as a scan in blocks, without Python and without a group a series.

y = a y' + b is solved within a block of a series in closed form: with A the running
product of the a, y = A (carry + sum of b / A).  A block leaves one row, its product
and its last value from nothing; the carries into a series' blocks come from these
rows alone.  Blocks are spans of time (a year of dates, say), so a long series is as
many groups as it has spans, and are cut further where A would leave the range of
doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest -log(A) of a block's rows, and of the step over the nulls before it; doubles reach some 700 for both.
REACH = 300.0
SPAN = 4096


def span_of(df: DataFrame, order: str) -> Column:
    """The block of a row by its place in time: years, or spans of whole numbers."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(order).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(order) / SPAN).cast("long")
    return F.lit(0).cast("long")


def same(left: list[str], right: dict[str, str]) -> Column:
    """Equality of keys, nulls included; right: name in the other table by name."""
    condition = F.lit(True)
    for c in left:
        condition = condition & F.col(c).eqNullSafe(F.col(right[c]))
    return condition


def attached(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of other, a row for each value of the keys (nulls included)."""
    names = {k: f"_of{i}" for i, k in enumerate(keys)}
    renamed = other.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in other.columns if c not in keys])
    return df.join(renamed, same(keys, names)).drop(*names.values())


def smooth(df: DataFrame, columns: dict[str, tuple[str, str, float, int]], key: str = "ticker", order: str = "date", block: Column | None = None) -> DataFrame:
    """Adds columns: {out: (input, "seeded" | "unseeded", alpha, n or min_periods)}.

    seeded: the mean of the first n values after leading nulls, then y + alpha (x - y);
    null before, and from a later null on.  unseeded: from the first value on; over a
    null the older weight decays and the mean stays; null until min_periods values.
    ``block``: a row's span of time, ascending with ``order``.
    """
    sources = sorted({source for source, *_ in columns.values()})
    slow = max(-math.log(max(1 - alpha, 1e-280)) for _, _, alpha, _ in columns.values())
    limit = max(1, int(REACH / max(slow, 1e-12)))
    by = [key, "_block"]
    w = Window.partitionBy(*by).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_block", block if block is not None else span_of(df, order)).withColumn("_row", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("_sub", F.floor((F.col("_row") - 1) / limit))
    known = {s: F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")) for s in sources}
    rows = rows.withColumns({f"_n{i}": F.count(F.when(known[s], 1)).over(upto) for i, s in enumerate(sources)} | {f"_l{i}": F.max(F.when(known[s], F.col("_row"))).over(before) for i, s in enumerate(sources)})

    # rows, values, first and last value before each span
    spans = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_r"), *[f for i, s in enumerate(sources) for f in (F.count(F.when(known[s], 1)).alias(f"_c{i}"), F.min(F.when(known[s], F.col("_row"))).alias(f"_f{i}"), F.max(F.when(known[s], F.col("_row"))).alias(f"_m{i}"))])
    every = Window.partitionBy(key)
    past = every.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_r0", F.coalesce(F.sum("_r").over(past), F.lit(0)))
    for i in range(len(sources)):
        spans = spans.withColumns({f"_c{i}": F.coalesce(F.sum(f"_c{i}").over(past), F.lit(0)), f"_m{i}": F.max(F.col("_r0") + F.col(f"_m{i}")).over(past), f"_f{i}": F.min(F.col("_r0") + F.col(f"_f{i}")).over(every)})
    rows = attached(rows, spans.drop("_r"), by)

    place = F.col("_r0") + F.col("_row")
    logs, terms, shown = {}, {}, {}
    for k, (source, kind, alpha, n) in enumerate(columns.values()):
        i = sources.index(source)
        x, number = F.col(source).cast("double"), F.col(f"_c{i}") + F.col(f"_n{i}")
        decay = math.log(max(1 - alpha, 1e-280))
        if kind == "seeded":
            early = number <= n
            log_a, b = F.when(early, 0.0).otherwise(decay), F.when(early, x / n).otherwise(alpha * x)
            shown[k] = (number >= n) & (place - F.col(f"_f{i}") + 1 == number)
        else:
            gap = place - F.coalesce(F.col("_r0") + F.col(f"_l{i}"), F.col(f"_m{i}"))
            weight = F.exp(gap * decay)
            log_a = F.when(number == 1, 0.0).when(gap == 1, decay).otherwise(gap * decay - F.log(weight + alpha))
            b = F.when(number == 1, x).when(gap == 1, alpha * x).otherwise(alpha * x / (weight + alpha))
            shown[k] = number >= max(n, 1)
        logs[f"_a{k}"] = F.when(known[source], F.greatest(log_a, F.lit(-REACH))).otherwise(0.0)
        terms[f"_b{k}"] = F.when(known[source], b).otherwise(0.0)
    rows = rows.withColumns(logs | terms)
    parts = [*by, "_sub"]
    within = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = len(columns)
    rows = rows.withColumns({f"_a{k}": F.sum(f"_a{k}").over(within) for k in range(size)})
    rows = rows.withColumns({f"_b{k}": F.exp(f"_a{k}") * F.sum(F.col(f"_b{k}") * F.exp(-F.col(f"_a{k}"))).over(within) for k in range(size)})
    ends = rows.groupBy(*parts).agg(*[f for k in range(size) for f in (F.exp(F.max_by(f"_a{k}", "_row")).alias(f"_p{k}"), F.max_by(f"_b{k}", "_row").alias(f"_y{k}"))])
    block_ = F.struct("_block", "_sub", *[F.col(f"_{c}{k}") for k in range(size) for c in "py"])
    start = F.struct(F.array(*[F.lit(0.0)] * size).alias("y"), F.array().cast("array<array<double>>").alias("seen"))
    step = lambda s, b: F.struct(F.array(*[b[f"_p{k}"] * s["y"][k] + b[f"_y{k}"] for k in range(size)]).alias("y"), F.concat(s["seen"], F.array(s["y"])).alias("seen"))
    folded = ends.groupBy(key).agg(F.sort_array(F.collect_list(block_)).alias("_blocks")).withColumn("_seen", F.aggregate("_blocks", start, step, lambda s: s["seen"]))
    before_ = folded.select(key, F.explode(F.arrays_zip("_blocks", "_seen")).alias("_e")).select(key, F.col("_e._blocks._block").alias("_block"), F.col("_e._blocks._sub").alias("_sub"), F.col("_e._seen").alias("_carry"))
    rows = attached(rows, before_, parts)
    values = {out: F.when(shown[k], F.exp(f"_a{k}") * F.col("_carry")[k] + F.col(f"_b{k}")) for k, out in enumerate(columns)}
    rows = rows.withColumns(values)
    return rows.select(*df.columns, *[c for c in columns if c not in df.columns])
