"""Connected components of an edge table, by contraction in rounds; no round leaves the cluster."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b: of one type) -> (node, root): every node of an edge, with one node of its component as the root.

    In each round a node moves to the neighbour (or itself) that comes first in a random order, drawn anew by hashing
    with the round's number, so the nodes shrink by a constant factor expected, chains included. Edges are renamed,
    made distinct, and written to the shared folder. Loops, repeated and null edges count for nothing; an empty table
    gives an empty one.
    """
    edges = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    mapped, salt = None, 0
    while not edges.isEmpty():
        salt += 1
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.xxhash64(F.lit(salt), c)
        moves = (
            both.groupBy("a")
            .agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("to"))).alias("m"))
            .select(F.col("a").alias("node"), F.when(F.col("m.r") < rank(F.col("a")), F.col("m.to")).otherwise(F.col("a")).alias("root"))
        )
        moves = cut(moves)
        if mapped is None:
            mapped = moves
        else:
            later, before = moves.select(F.col("node").alias("root"), F.col("root").alias("next")), mapped
            mapped = cut(mapped.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            drop(before)
        left = moves.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = moves.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        old = edges
        edges = cut(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        drop(old, *([moves] if moves is not mapped else []))
    if mapped is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapped
