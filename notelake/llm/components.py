"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edges; a round's edges are written to
the shared folder, so lineage stays short and a lost executor costs one round at most. Of up
to ``BROADCAST_EDGES`` edges, as counted, the nodes' minima are broadcast, so that a node with
many edges is not one task's; of more never, whatever Spark takes their files for. The
number of rounds grows with the logarithm of the longest path. Nothing is collected: a
round compares two numbers, the count and a hash sum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import drop_written, written


#: Edges up to which a round broadcasts a row for each node: a few MB.
BROADCAST_EDGES = 1 << 16


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of the component.

    Loops, repeated edges and edges with a null end are ignored; an empty edge table gives
    an empty result.
    """
    e = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(e)
    while mark[0]:
        how = "broadcast" if mark[0] <= BROADCAST_EDGES else "merge"
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint(how), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least.hint(how), "u")
            .select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
            .where("a <> b")
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
        )
        following = written(small, "edges")
        last, mark = mark, _mark(following)
        drop_written(e)
        e = following
        if mark == last:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
