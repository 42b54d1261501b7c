"""Connected components by label propagation with pointer jumping; every round is staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdlweave.runtime import stage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) for the undirected ``links(a, b)``.

    Isolated nodes do not occur in links and so give no row; self links and repeats are harmless.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a is not null and b is not null"))
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = label.join(near, label["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("to"))
        up = label.select(F.col("node").alias("to"), F.col("component").alias("top"))
        moved = stage(hooked.join(up, "to").select("node", F.col("component").alias("was"), F.least("to", "top").alias("component")))
        label = moved.select("node", "component")
        if moved.filter("was <> component").isEmpty():
            return label
