"""Connected components by joins: smallest neighbour label, then label of the label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import discard, materialise


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``links`` (src, dst); component is the smallest node reachable.

    Each round takes the smallest label among the neighbours (combined before the shuffle, so that a
    hub does not gather its neighbours) and then replaces each label by the label of the node it names.
    The state of every round is a table in the shared folder.
    """
    both = materialise(links.select("src", "dst").union(links.select("dst", "src")).distinct())
    state = materialise(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")))
    for _ in range(max_rounds):
        low = both.join(state.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("low"))
        step = state.join(low.withColumnRenamed("src", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("via"))
        # A label names a node, whose own label is at most as large; following it halves long chains.
        jump = state.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = materialise(step.join(jump, "via").select("node", F.least("via", "far").alias("component"), (F.least("via", "far") < F.col("old")).alias("moved")))
        done = not new.filter("moved").limit(1).count()
        discard(state)
        state = new.select("node", "component")
        if done:
            discard(both)
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
