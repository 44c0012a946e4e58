"""Connected components of a large graph as rounds of joins and sums."""

from pyspark.sql import functions as F

from maskwright.llm.common import written


def connected_components(edges, a="a", b="b"):
    """(node, component) for every node of the edges; component is its smallest node.

    Alternating large-star and small-star rounds: every round hangs nodes on smaller
    ones, until each is linked to the least of its component alone. A node's least
    neighbour is an aggregate that is summed before the shuffle; a hub's links meet it
    in an ordinary join, whose large partitions the engine splits. Every round is
    written to the folder of `spark.checkpoint.dir`. Null ends are left out; a loop
    makes a component of one node.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    links = written(_down(pairs))
    state = _state(links)
    while state[0]:
        # large star: what lies above a node goes to the node's least neighbour
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        links = _down(large.select(F.col("w").alias("u"), F.col("m").alias("v")))
        links = written(links)
        # small star: a node and what lies below it go to the least of these
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        small = links.join(least, "u")
        links = _down(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .union(least.select("u", F.col("m").alias("v"))))
        links = written(links)
        now = _state(links)
        if now == state:
            break
        state = now
    root = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.distinct().join(root, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _down(pairs):
    """Distinct links from a larger to a smaller node."""
    return pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links):
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
