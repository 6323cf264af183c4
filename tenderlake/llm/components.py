"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces the links of a node by links to the smallest node it knows, until every component is a star around its
smallest node; that takes about the logarithm of the longest path in rounds. Only links travel; every round is written to the shared folder, so the lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import join_split
from tenderlake.sources.tables import discard, materialize


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """One step, written, over ``total`` links (a, b) with a > b. Large: each node's larger neighbours move to its smallest one; small: so do its smaller ones and itself.

    The centre of a star holds all of a component's links: such nodes are broadcast, so their links needn't meet in one task.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = materialize(both.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n")), "least-neighbours")  # read several times
    if large:
        # A node that is the smallest of its neighbours is their target itself.
        joined = join_split(both.where("other > node"), least, "node", total).select(F.col("other").alias("a"), F.least("least", "node").alias("b"))
    else:
        joined = join_split(both, least, "node", total).where("other != least").select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    done = materialize(joined.distinct(), "links")
    discard(least)
    return done


def _state(links: DataFrame) -> tuple[int, int]:
    """How many links (a, b) there are, and how many nodes keep them from being stars around smallest nodes: those with several smaller neighbours, or with a smaller and a larger one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return tuple(nodes.agg(F.coalesce(F.sum("below"), F.lit(0)), F.count_if(F.expr("below > 1 OR below = 1 AND above = 1"))).first())


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the smallest node it is linked with) for each node of ``links`` (a, b).

    Links may repeat, point either way or lead from a node to itself; those with a null end are left out. Nodes without a link aren't listed.
    An empty table gives an empty result. Jobs run while the result is built.
    """
    now = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        total, unsettled = _state(now)
        if not unsettled:
            break
        half = _star(now, True, 2 * total)
        after = _star(half, False, half.count())
        discard(now, half)
        now = after
    else:
        raise RuntimeError(f"the components haven't settled after {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def named_components(groups: DataFrame, least: DataFrame) -> DataFrame:
    """``node`` and ``component_id`` for each node of :func:`connected_components`: the smallest of the ``least`` ids (``node, least``) of its component's nodes, null if all are."""
    known = materialize(groups.join(least, "node"), "component-nodes")
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return join_split(known, ids, "component", known.count()).select("node", "component_id")
