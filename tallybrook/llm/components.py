"""Connected components of links between ids, by contraction, without a driver or a single task ever holding them.

Each round points every node to its least neighbour, doubles the pointers until all reach a local minimum, and replaces
the links by those between these minima, of which at most half the nodes are any. Least neighbours are aggregated on the map side; joins are plain equi-joins of written tables, which
adaptive execution splits where a node has very many links. Rounds, and doublings in a round, grow with the logarithm of the nodes of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _roots(to: DataFrame) -> DataFrame:
    """node, to: where the pointers of `to`, a written table, end."""
    while True:
        onward = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = F.coalesce(F.col("next") < F.col("to"), F.lit(False)).alias("moved")
        further = cut(to.select("node", "to").join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"), moved))
        discard(to)
        to = further
        if to.filter("moved").isEmpty():
            return to


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links (a, b). Self-links add nothing; an empty table gives an
    empty result. Tables of earlier rounds are deleted."""
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    label = None
    while label is None or not links.isEmpty():
        both = links.union(links.select("b", "a"))
        to = _roots(cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))))
        ends = cut(links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("b", "x"))
        fewer = cut(ends.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        discard(links, ends)
        links = fewer
        if label is None:
            label = to
            continue
        onward = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
        relabelled = cut(label.select("node", "to").join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        discard(label, to)
        label = relabelled
    return label.select("node", F.col("to").alias("component"))
