"""Connected components of an edge table by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, label): the smallest node that each node of the edge table reaches; a table in the shared folder.

    In a round every node takes the least of itself and its neighbours as its parent, then its parent's parent, and the edges are drawn
    again between parents; those inside a parent vanish. A chain halves in a round and a star is gone after two, so edges dwindle and the
    joins of all rounds together hold a small multiple of them. Parents of a round are a table in the shared folder, one row a node; at the
    end labels are looked up through them. Nulls are no nodes; self-loops and repeated edges change nothing. A hub's many edges meet
    one row for each node in a join, so the adaptive skew join may split them.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    left = written(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    alone = e.where("a = b").select(F.col("a").alias("node")).distinct()
    steps: list[DataFrame] = []
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        ends = left.select(F.col("a").alias("node"), F.col("a").alias("parent")).union(left.select(F.col("b").alias("node"), F.col("a").alias("parent")))
        least = ends.groupBy("node").agg(F.min("parent").alias("parent"))
        far = least.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        step = written(least.join(far, "parent").select("node", F.col("far").alias("parent")), "cc-parents")
        steps.append(step)
        by = lambda c: step.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_up"))  # noqa: B023, E731
        moved = left.join(by("a"), "a").join(by("b"), "b").where("a_up <> b_up")
        new = written(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "cc-edges")
        forget(left)
        left = new
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    forget(left)
    if not steps:
        return written(alone.select("node", F.col("node").alias("label")), "cc-labels")
    labels = steps[-1].select("node", F.col("parent").alias("label"))
    for step in steps[-2::-1]:
        # What this round's parents became later; a parent that no later round has is a label itself
        later = labels.select(F.col("node").alias("parent"), "label")
        labels = step.join(later, "parent", "left").select("node", F.coalesce("label", "parent").alias("label"))
    lone = alone.join(steps[0], "node", "left_anti").select("node", F.col("node").alias("label"))
    out = written(labels.union(lone), "cc-labels")
    forget(*steps)
    return out
