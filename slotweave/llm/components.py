"""Connected components of a link table, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small, stored


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): every node that has one, with the smallest node it reaches: (node, root), stored.

    Each round points every node to its smallest neighbour, follows the pointers once more, and contracts
    the links to the nodes pointed at; a component's smallest node always stays. Hubs cost no more than their
    links: minima are taken before the shuffle, and pointers are broadcast while they are few, else their joins can
    be split. Links and pointers are stored every round.
    """
    links = stored(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while roots is None or not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        up = small(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "pointers")
        up = small(up.join(up.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p")), "pointers")
        if roots is None:  # all nodes have a pointer
            roots = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = roots.join(up, roots.root == up.u, "left").select("node", F.coalesce("p", "root").alias("root"))
        low, high = (up.select(F.col("u").alias(c), F.col("p").alias(f"p_{c}")) for c in ("a", "b"))
        moved = links.join(low, "a").join(high, "b").select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b"))
        links = stored(moved.filter(F.col("a") != F.col("b")).distinct(), "links")
    return small(roots, "roots")
