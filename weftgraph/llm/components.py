"""Connected components by alternating large-star and small-star steps.

Everything is a join or a partially aggregated minimum, so a vertex with very many
neighbours is never gathered; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize


def _to_minimum(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs (u, v): send every v to the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, label) for every vertex of edges (u, v): label is the component's least vertex.

    Self loops and edges with a null end are ignored; repeated edges are harmless. A
    vertex without edges to others isn't listed.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    for _ in range(rounds):
        # done when every edge leads to a root: no end is itself sent on, no vertex twice
        sent_on = e.select(F.col("u").alias("v")).join(e.select("v"), "v", "left_semi").limit(1)
        twice = e.groupBy("u").count().where("count > 1").select("u").limit(1)
        if not sent_on.unionAll(twice).take(1):
            return e.select("u", F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct())
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, keep_larger=True)
        e = materialize(_to_minimum(large, keep_larger=False), "edges")
    raise RuntimeError("components did not settle")
