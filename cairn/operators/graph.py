"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.storage import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b", jumps: int = 1, rounds: int = 100) -> DataFrame:
    """node, component: each node that an edge names, and the least node reachable from it.

    In every round each node joins the least of its neighbours and itself, and whom that one joined, and
    so on for 2 ** jumps steps; nodes that joined are contracted and edges inside a contracted node go.
    The rounds are logarithmic and the edges shrink with them; a star is done in one. Nothing is
    collected but whether edges are left. Rows with a null end are ignored; loops make a node a
    component of its own.
    """
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).where("ok").select("a", "b")
    left = written(pairs.distinct())
    if left.isEmpty():
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = None
    for _ in range(rounds):
        ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")
        choice = written(left.select(ends).groupBy("e.x").agg(F.min("e.y").alias("y")).select("x", F.least("x", "y").alias("to")))
        step = choice.select("x", F.col("to").alias("root"))
        for _ in range(jumps):
            step = step.join(step.select(F.col("x").alias("root"), F.col("root").alias("next")), "root").select("x", F.col("next").alias("root"))
        step = written(step)
        if labels is None:
            fresh = written(step.select(F.col("x").alias("node"), F.col("root").alias("component")))
        else:
            fresh = written(labels.join(step.withColumnRenamed("x", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
            drop(labels)
        labels = fresh
        ra, rb = (step.select(F.col("x").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        fewer = written(left.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        for done in (left, choice, step):
            drop(done)
        left = fewer
        if left.isEmpty():
            return labels
    raise RuntimeError(f"not settled after {rounds} rounds")
