"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, dropped, hot_keys, spread_join, stored


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component: the smallest node that can be reached. A stored table.

    Each round a node takes the smallest label among its neighbours and itself, the node that held its old label
    follows, and labels are replaced by their own labels (pointer jumping): the rounds grow with the logarithm of the
    longest path. Every round is written to the shared folder. The links of a hot node are dealt over several tasks,
    and labels are looked up by distinct label, not by node. An empty table of links gives an empty result.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.filter("a <> b").distinct(), "edges")
    hubs = hot_keys(edges.groupBy("b").agg(F.count("*").alias("n")), ["b"])
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        seen = spread_join(edges, theirs, ["b"], hubs, "a").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        best = stored(labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "theirs").alias("new")), "best")
        followed = best.filter("new < old").groupBy(F.col("old").alias("node")).agg(F.min("new").alias("hooked"))
        hooked = stored(best.join(followed, "node", "left").select("node", "old", F.least("new", "hooked").alias("new")), "hooked")
        # labels that have a smaller label themselves
        jumps = stored(hooked.filter("new < node").select(F.col("node").alias("new"), F.col("new").alias("next")).join(hooked.select("new").distinct(), "new", "left_semi"), "jumps")
        small = bounded(jumps)
        hot = None if small is not jumps else hot_keys(hooked.groupBy("new").agg(F.count("*").alias("n")), ["new"])
        followed_up = spread_join(hooked, small, ["new"], hot, "node", "left")
        jumped = stored(followed_up.select("node", "old", F.least("new", "next").alias("component")), "jumped")
        moved = jumped.filter("component <> old").limit(1).count()
        dropped(labels, best, hooked, jumps)
        labels = jumped.select("node", "component")
        labels._stored_at = jumped._stored_at
        if not moved:
            dropped(edges)
            return labels
