"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import kept


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, comp`` for all nodes of ``links`` (``a``, ``b``); ``comp`` is the smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so labels travel twice as far each time.  A node with very many neighbours is reduced
    before the shuffle.  Each round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both.filter(F.col("a") != F.col("b")), label)
    labels = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), label)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next")
        )
        hop = labels.select(F.col("node").alias("hop"), F.col("comp").alias("far"))
        step = step.join(hop, step["next"] == hop["hop"], "left").select(
            "node", "comp", F.least("next", F.coalesce("far", "next")).alias("next")
        )
        step = kept(step, label)
        moved = step.filter(F.col("next") != F.col("comp")).limit(1).count()
        labels = step.select("node", F.col("next").alias("comp"))
        if not moved:
            return labels
