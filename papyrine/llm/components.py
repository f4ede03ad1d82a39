"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.storage import materialize


#: A node with more neighbours than MANY is a hub.
MANY, SALTS = 1_000, 64
#: Up to this many hubs are broadcast (16 MB); there is one at most for each MANY links.
BROADCAST_HUBS = 1_000_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    sides = _both_ways(edges)
    least = sides.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"), F.count("*").alias("n"))
    # A hub's neighbours are spread over as many tasks as SALTS, each with the hub's least.
    hubs = F.when(F.col("n") > MANY, SALTS).otherwise(1)
    copies = least.select("src", "least", F.explode(F.sequence(F.lit(0), hubs - 1)).alias("salt"))
    degree = least.filter(F.col("n") > MANY).select("src", F.lit(SALTS).alias("salts"))
    up = sides.filter("dst > src").join(F.broadcast(degree) if degree.count() <= BROADCAST_HUBS else degree, "src", "left").withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int"))
    joined = up.join(copies, ["src", "salt"])
    return joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src != dst")
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    joined = down.join(least, "src")
    moved = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src != dst")
    return moved.union(least.select("src", F.col("least").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) of every node with an edge. edges: src, dst long, any direction, repeats allowed.

    Every step is a shuffle of the edges; the number of steps grows with the logarithm of a component's size.
    A node's neighbours are never gathered: hubs only meet aggregates and joins. Null ends and loops are ignored.
    """
    edges = materialize(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src != dst"), "components")
    state = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    least = edges.select("src", "dst")
    return least.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(least.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
