"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut, release


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``comp``, the smallest id reachable, for all ids in ``edges`` (a, b).

    Each round every id takes the smallest label around it and then that label's own label, so long chains shorten by
    powers of two; rounds are stored in the shared folder. It ends when no label changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        moved = labels.select("id", "comp").join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        roots = moved.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        new = cut(moved.join(roots, "comp").select("id", "old", F.col("root").alias("comp")))
        done = new.filter("old <> comp").isEmpty()
        release(labels)
        labels = new
        if done:
            release(both)
            return new.drop("old")
