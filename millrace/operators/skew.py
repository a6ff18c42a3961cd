"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows, so there are fewer hot keys than this.
HOT_ONE_IN = 1000


def hot_keys(df: DataFrame, key: str, one_in: int = HOT_ONE_IN) -> DataFrame:
    """The keys of ``df`` that hold more than ``1 / one_in`` of its rows: fewer than ``one_in`` rows.

    Counted with a map-side combine; the total is one count over the same input.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    return counts.where(F.col("__n") * one_in > F.lit(total)).select(key)


def left_join_by_state(big: DataFrame, state: DataFrame, key: str, one_in: int = HOT_ONE_IN) -> DataFrame:
    """``big`` left-joined with ``state`` (at most one row a key) without a hot reduce task.

    Rows of hot keys meet a broadcast of the hot keys' states, which has fewer than ``one_in`` rows whatever the
    input holds; only the other rows are shuffled by key. Null keys meet nothing, so they are not shuffled either; their
    state columns are null.
    """
    hot = F.broadcast(hot_keys(big, key, one_in))
    marked = big.join(hot.withColumn("__hot", F.lit(True)), key, "left")
    hot_side = marked.where("__hot").drop("__hot").join(F.broadcast(state.join(hot, key, "left_semi")), key, "left")
    cold_side = marked.where(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot").join(state, key, "left")
    return hot_side.unionByName(cold_side).unionByName(big.where(F.col(key).isNull()), allowMissingColumns=True)
