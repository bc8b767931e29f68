"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, label)``: the smallest node reachable from each node that has a link.

    Each round every node takes the least label among its neighbours and then its label's label. Labels
    and links stay distributed; a round ends in a written table, so a lost executor repeats one round at
    most. No links give an empty table.
    """
    both = staged(links.select(F.col("a").alias("node"), F.col("b").alias("other"))
                       .union(links.select(F.col("b"), F.col("a"))).where("node <> other").distinct())
    labels = staged(both.groupBy("node").agg(F.min("other").alias("label"))
                         .select("node", F.least("node", "label").alias("label")))
    while True:
        heard = (both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("said")), "other")
                 .groupBy("node").agg(F.min("said").alias("said")))
        hooked = labels.join(heard, "node").select("node", F.col("label").alias("was"),
                                                   F.least("label", "said").alias("label"))
        hooked = staged(hooked)
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = staged(hooked.join(root, "label").select(
            "node", F.least("label", "root").alias("label"), "was"))
        labels = jumped.select("node", "label")
        if not jumped.where("label <> was").limit(1).count():
            return labels
