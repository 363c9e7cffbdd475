"""Connected components of a table of links, by labels that spread and jump; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycadence.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): component is the smallest id that can be reached.

    Every round takes the smallest label among the neighbours, then the label of that label, so a path of length n
    needs about log2 n rounds. Rounds end in a written table; the driver sees one count per round. Links with a
    NULL end or from an id to itself say nothing; repeated links count once. No links give an empty table.
    """
    links = links.where("a <> b").select("a", "b")
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near")))
        spread = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        target = labels.select(F.col("id").alias("via"), F.col("component").alias("beyond"))
        after = written(spread.join(target, spread["component"] == target["via"]).select(
            "id", F.least("component", "beyond").alias("component"), "before"), "labels")
        if after.where("component <> before").isEmpty():
            return after.select("id", "component")
        labels = after.select("id", "component")
