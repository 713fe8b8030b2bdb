"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.common import materialise


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """Smallest node that each node of ``links`` (a, b: long, not null) reaches: node, component.

    Each round takes the smallest label next to a node and follows that label's own label, so long
    chains shrink by halves. Labels are written after each round.
    """
    both = materialise(
        links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), purpose + "-links"
    )
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), purpose)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        # Whoever pointed at a node that now points lower follows it.
        jump = least.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        then = materialise(
            least.join(jump, "low", "left").select(
                "node", F.least("low", F.coalesce("lower", "low")).alias("component"), F.col("component").alias("before")
            ),
            purpose,
        )
        labels = then.select("node", "component")
        if then.filter("component != before").isEmpty():
            return labels
