"""Parent walks over tables by pointer doubling: a tree may be of any size and depth, and need not fit one row or task.

Each round replaces what a node points to by what that points to, so after k rounds a node points 2**k steps up or to its root.
A round is one join of narrow rows, written; the number of rounds is the logarithm of the depth. Nodes that have not come to a
root when 2**k passes the number of nodes are on a cycle or lead to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.stored import discard, store


def jumps(nodes: DataFrame, tree: str, node: str, parent: str, keep: bool = False) -> list[DataFrame]:
    """Tables (tree, node, to, steps, done) of each round; only the last is kept unless all are asked for. Nodes that are known to
    point to their root take no part in later rounds.

    A node without a parent, or with one that its tree does not have, is a root and points to itself in no steps. (tree, node)
    is one row each.
    """
    n = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"))
    there = n.select("tree", F.col("node").alias("parent"), F.lit(1).alias("_there"))
    has = F.col("_there").isNotNull()
    first = n.join(there, ["tree", "parent"], "left").select("tree", "node", F.when(has, F.col("parent")).otherwise(F.col("node")).alias("to"), has.cast("long").alias("steps"), (~has).alias("done"))
    rounds = [store(first, "jumps")]
    count, reach = rounds[0].count(), 1
    while reach < count:
        now = rounds[-1]
        up = now.select("tree", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        further = now.filter("not done").join(up, ["tree", "to"]).select("tree", "node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_steps") == 0).alias("done"))
        rounds.append(store(now.filter("done").unionByName(further), "jumps"))
        reach *= 2
        if rounds[-1].filter("not done").isEmpty():
            break
    if not keep:
        discard(*rounds[:-1])
        return rounds[-1:]
    return rounds


def roots(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, node, root, depth) of each node; both are null for nodes on a cycle and those that lead to one."""
    last = jumps(nodes, tree, node, parent)[-1]
    ends = last.filter("steps = 0").select("tree", F.col("node").alias("to"), F.lit(True).alias("_root"))
    told = last.join(ends, ["tree", "to"], "left")
    own = F.col("_root").isNotNull()
    return told.select(F.col("tree").alias(tree), F.col("node").alias(node), F.when(own, F.col("to")).alias("root"), F.when(own, F.col("steps")).alias("depth"))


def ancestors(nodes: DataFrame, starts: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, node) of the starts and all nodes above them, one row each; starts on a cycle give the whole cycle.

    What lies 2**k steps up of all that is known is added for each k from the highest: sums of powers are all distances. At a root
    a longer jump ends at the root.
    """
    tables = jumps(nodes, tree, node, parent, keep=True)
    known = starts.select(F.col(tree).alias("tree"), F.col(node).alias("node")).distinct()
    held = None
    for table in reversed(tables):
        above = table.join(known, ["tree", "node"], "left_semi").select("tree", F.col("to").alias("node"))
        known = store(known.unionByName(above).distinct(), "ancestors")
        if held is not None:
            discard(held)
        held = known
    discard(*tables)
    return known.select(F.col("tree").alias(tree), F.col("node").alias(node))
