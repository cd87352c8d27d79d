"""Connected components of a graph whose nodes have few links each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import lookup, staged


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b: longs); root is the least node of its component.

    Each round a node takes the least root among its own and its neighbours' roots; a root that has taken another root
    hands it to all its nodes, which halves the depth. Rounds are written to the shared folder. A node's degree bounds
    the rows of a key in the joins by link; hot roots are looked up by broadcast.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    for _ in range(most):
        offered = (both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
                   .agg(F.min("root").alias("offer")))
        met = staged(now.join(offered, "node").select("node", "root", F.least("root", "offer").alias("to")))
        changed = met.where("root <> to")
        if changed.isEmpty():
            return now
        # the least root that any node of a tree has met becomes the root of the whole tree
        trees = met.groupBy("root").agg(F.min("to").alias("to"), F.count("*").alias("members"))
        hooked = staged(lookup(met.select("node", "root"), trees, ["root"], "members", met.count(), "inner").select("node", F.col("to").alias("root")))
        # and roots that are now nodes of another tree pass its root on
        up = (hooked.groupBy("root").agg(F.count("*").alias("members"))
              .join(hooked.select(F.col("node").alias("root"), F.col("root").alias("above")), "root"))
        now = staged(lookup(hooked, up, ["root"], "members", hooked.count(), "inner").select("node", F.least("root", "above").alias("root")))
    raise RuntimeError(f"components did not settle in {most} rounds")
