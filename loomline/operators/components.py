"""Connected components of a graph of links, by contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomline.operators.skew import join_key_facts
from loomline.runtime import cut

#: A node of more links is a hub, whose joins are split.
HUB = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each node that has a link, with the smallest node of its component: columns node, rep.

    A distributed union-find.  Each round every node hooks to the neighbour
    that comes first in a random order (its hash), if that comes before the
    node itself; links are then redrawn between what the nodes hooked to, and
    those within one node vanish.  At least half of the nodes of a component
    are expected to vanish in a round, so rounds grow with the logarithm of
    its size; they go on until no link remains, however many that takes.
    Mappings are kept in the shared folder, never on the driver.  Where
    a node has more than ``HUB`` links the joins go through
    ``join_key_facts``, so the hub of a star is not gathered in a task.  Links to oneself or with a null end are left out; repeated links
    change nothing.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("node"), F.col(b).alias("to"))
    edges, hooked = cut(ends.unionAll(ends.select("to", "node")).distinct()), []
    while True:
        order = lambda c: F.struct(F.xxhash64(c), F.col(c))
        hooks = edges.groupBy("node").agg(F.min(order("to")).alias("m"), F.count(F.lit(1)).alias("n"))
        hooks = cut(hooks.select("node", F.when(F.col("m") < order("node"), F.col("m.to")).otherwise(F.col("node")).alias("up"), "n"))
        most = hooks.agg(F.max("n")).first()[0]
        if most is None:
            break
        hooked.append(hooks)
        # joins are split for hubs only where there is one
        meet = join_key_facts if most > HUB else lambda rows, facts, key, _: rows.join(facts, key)
        half = meet(edges, hooks, "node", "n").select(F.col("up").alias("node"), "to")
        other = hooks.select(F.col("node").alias("to"), F.col("up").alias("far"), "n")
        edges = cut(meet(half, other, "to", "n").select("node", F.col("far").alias("to")).where("node != to").distinct())
    if not hooked:
        return edges.select("node", F.col("to").alias("rep"))
    mapping = hooked[0].select("node", F.col("up").alias("rep"))
    for hooks in hooked[1:]:
        mapping = mapping.join(hooks.select(F.col("node").alias("rep"), "up"), "rep", "left").select("node", F.coalesce("up", "rep").alias("rep"))
    mapping = cut(mapping)
    least = mapping.groupBy("rep").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    return join_key_facts(mapping, least, "rep", "n").select("node", F.col("least").alias("rep"))
