"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregation with map-side combining and an equi-join, whose skewed keys adaptive execution can split; no
component, and no node's list of neighbours, is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another one; component: the smallest node reachable."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = cut(edges)
    state = _state(edges)
    while True:
        # large star: a node's larger neighbours go to its smallest neighbour or itself
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(pointed.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def _state(edges: DataFrame) -> tuple:
    """Changes whenever the edges do: their number and a checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
