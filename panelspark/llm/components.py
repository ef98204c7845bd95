"""Connected components by smallest labels, as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, written_at

ROWS_A_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node that links reach.

    Each turn takes the smallest label of all neighbours and then the label of
    that label, so the number of turns grows with the logarithm of a chain's
    length.  Labels are summed by task before they are shuffled; a node with a
    million neighbours is no task of its own.
    """
    spark = links.sparkSession
    both, links_at = written_at(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    # few links need few tasks, whatever the session's number of partitions
    tasks = max(4, both.count() // ROWS_A_TASK)
    labels, at = written_at(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root").coalesce(tasks), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        onward = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step, step_at = written_at(lower.join(onward, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")).coalesce(tasks), "labels")
        drop_folder(spark, at)
        labels, at = step.select("node", "root"), step_at
        if step.where("old <> root").limit(1).count() == 0:
            drop_folder(spark, links_at)
            return labels
