"""Connected components of undirected edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (columns a and b, longs): vertices have one
    root if and only if they are connected.

    Each round every vertex joins the neighbour (or itself) that comes first in a
    round-specific pseudorandom order, and edges are renamed; the expected number of
    vertices with edges falls by a constant factor a round, whatever the shape of the
    graph.  Each round is written to the shared folder.  Vertices and edges stay on
    the executors throughout.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        n = len(maps)
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        order = lambda c: F.xxhash64(F.lit(n), F.col(c))  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b"))).alias("m"))
        hop = written(first.select(F.col("a").alias("v"), F.when(F.col("m.o") < order("a"), F.col("m.b")).otherwise(F.col("a")).alias("to")))
        maps.append(hop)
        renamed = left.join(hop.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a").join(hop.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
        left = written(renamed.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct())
    if not maps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0].select("v", F.col("to").alias("root"))
    for hop in maps[1:]:
        out = out.join(hop.select(F.col("v").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return out
