"""Connected components of a link table that is never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.joins import looked_up
from cadenza.llm.lineage import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), digests: component is the least node it can reach.

    In each round every node takes the least label among its own and its neighbours', then the label of that label, so the
    rounds grow with the logarithm of a chain's length. Labels are written to the shared folder after each round. Nodes of
    very many links and labels of very many nodes are looked up apart from the others. Self links and repeated links are
    allowed, null ends are left out; without links the result is empty.
    """
    links = links.filter("a is not null and b is not null")
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("label"), "n"))
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("their"), "n")
        near = looked_up(both, seen, on="b", count="n", total=total, values=["their"], spread="a")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("their").alias("their"))
        taken = labels.join(least, "node").select("node", "label", "n", F.least("label", "their").alias("new"))
        onward = taken.groupBy("new").agg(F.count("*").alias("users")).join(labels.select(F.col("node").alias("new"), F.col("label").alias("further")), "new")
        moved = looked_up(taken, onward, on="new", count="users", total=total, values=["further"], spread="node")
        to = F.least("new", "further")
        after = written(moved.select("node", to.alias("label"), "n", (to != F.col("label")).alias("changed")))
        ended = after.filter("changed").isEmpty()
        dropped(labels)
        labels = after.select("node", "label", "n")
        if ended:
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))
