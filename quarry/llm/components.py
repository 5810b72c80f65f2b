"""Connected components of a graph of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sized


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``links`` (a, b).

    Every round takes the smallest label among neighbours and then jumps to the
    label of that label, so chains halve in length; stars, which most links
    form, take two rounds. A node with very many links is a key of joins only:
    no list of neighbours is ever gathered."""
    both, _ = sized(
        links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        .distinct()
    )
    labels, _ = sized(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("comp")))
    while True:
        lower = (
            both.join(labels.withColumnRenamed("node", "src"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("comp").alias("seen"))
        )
        nearer = labels.join(lower, "node").select("node", "comp", F.least("comp", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved, _ = sized(nearer.join(jump, "next").select("node", "comp", F.least("next", "far").alias("next")))
        changed = not moved.filter(F.col("comp") != F.col("next")).isEmpty()
        labels = moved.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels
