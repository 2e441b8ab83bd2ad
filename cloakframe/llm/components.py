"""Connected components of a graph that lies in a DataFrame.

Alternating large-star and small-star rounds: each joins the edges with the
least neighbour of their nodes, so work stays linear in the edges and the
number of rounds logarithmic.  Every round is written to the shared folder;
nothing of the graph comes to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import kit


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp for every node of an edge (long ids); comp is the least id of the component.

    Self edges and null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = kit.stored(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are stored, so that the joins shuffle both sides and Spark can split the edges of a hub.
        least = kit.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kit.stored(large)
        least = kit.stored(large.groupBy("u").agg(F.min("v").alias("m")))
        down = large.join(least, "u")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = kit.stored(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
