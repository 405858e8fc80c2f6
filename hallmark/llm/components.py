"""Connected components of a link table, by contraction.

In each round every node moves to the neighbour of the smallest hash among itself and
its neighbours; links then join the nodes moved to, and repeated links and loops go.
Node hashes change from round to round, so a constant share of the nodes goes in each,
whatever the shape: long chains and stars take a few rounds more, no more rows. All
tables stay in Spark; the driver only learns whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallmark.llm.tables import step


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node.

    Nodes may be longs or strings. Links with a null end and loops join nothing, though
    a loop's node is returned. No links give no rows.
    """
    rows = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    left = step(
        rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    named = None
    turn = 0
    while not left.where("a <> b").isEmpty():
        turn += 1
        moves = step(_moves(left, turn))
        named = moves if named is None else step(_follow(named, moves))
        left = step(_contracted(left, moves))
    nodes = rows.select("a").union(rows.select("b")).distinct().withColumnRenamed("a", "node")
    if named is None:
        return nodes.withColumn("component", F.col("node"))
    named = nodes.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("node").alias("component"))
    return named.join(smallest, "label").select("node", "component")


def _moves(links: DataFrame, turn: int) -> DataFrame:
    """(node, label): each node and the one it moves to."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).union(
        links.select(F.col("b"), F.col("a"))
    )
    ranked = F.struct(F.xxhash64(F.lit(turn), F.col("next")).alias("h"), F.col("next").alias("n"))
    own = F.struct(F.xxhash64(F.lit(turn), F.col("node")).alias("h"), F.col("node").alias("n"))
    return both.groupBy("node").agg(F.min(ranked).alias("best")).select(
        "node", F.least(own, "best")["n"].alias("label")
    )


def _follow(named: DataFrame, moves: DataFrame) -> DataFrame:
    later = moves.select(F.col("node").alias("label"), F.col("label").alias("later"))
    return named.join(later, "label", "left").select(
        "node", F.coalesce("later", "label").alias("label")
    )


def _contracted(links: DataFrame, moves: DataFrame) -> DataFrame:
    ends = links.where("a <> b")
    for end in ("a", "b"):
        ends = ends.join(moves.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}")), end)
    return (
        ends.where("to_a <> to_b")
        .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        .distinct()
    )
