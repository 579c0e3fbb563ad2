"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import meet, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each vertex of a link with the smallest vertex that it reaches.

    Alternates large-star and small-star contraction until the links no longer
    change; each round is written to the shared folder, and the links of a vertex with
    many are dealt over several tasks.  Only the number of links and a sum of hashes
    reach the driver.  Rows with a null end and loops count as
    no link; repeated links count once; no links give an empty table.

    Returns ``id``, ``component``; a vertex without a link isn't listed.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    links, before = written(links, "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = meet(both, least, ["u"], "v", at_most=2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = meet(large, least, ["u"], "v", at_most=2 * state[0])
        small = near.select("u", F.col("m").alias("v")).unionByName(near.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = written(small.filter("u > v").distinct(), "small-star")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
