"""Connected components of a table of links, by rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is linked to another; the root is the smallest node it is linked to, over any path.

    Each round gives every node the smallest root among itself and its neighbours, then follows roots of roots.
    Sums and minima are partial aggregates, so a node with very many links is spread over tasks.
    """
    links = links.filter("a <> b").select("a", "b")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hooked = stored(roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root")), "hooked")
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = stored(hooked.join(above, "root", "left").select("node", "was", F.coalesce("up", "root").alias("root")), "roots")
        roots = jumped.select("node", "root")
        if jumped.filter("root <> was").isEmpty():
            return roots
