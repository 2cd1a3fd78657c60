"""Bounded traversal of an edge table by level-wise joins.

A path is a row: its steps, the nodes it has seen, its cost and uncertainty. Edges are
written once as a step table (see ``sources.store``); each level is one join of it with the
frontier, which holds max_edges_visited rows at most and is therefore the broadcast side.
A level reads only the relations that are followed, is cut to what is left of the budget by a distributed top-k, and is written, so no
level is planned or run twice; an empty frontier ends the traversal. The cut is exact:
discovery order is (depth, step keys), and a row beyond it can only have descendants beyond.

Best-first search (``best_first``) pops paths in order of cost, equal costs by length, then
step keys, and its budget counts the edges that are looked at in that order. It runs in cost
layers: no step costs less than the cheapest relation that is followed, so all open paths within
that much of the cheapest one are popped together, and a running sum of their degrees says
exactly which of them the budget still expands. Several origins are searched side by side,
each with a budget of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr
from ..sources.shared import materialized
from ..sources.store import write_steps


@dataclass(frozen=True)
class Limits:
    max_depth: int = 6
    max_paths: int = 32
    max_edges_visited: int = 10_000

    def __post_init__(self):
        if min(self.max_depth, self.max_paths, self.max_edges_visited) < 1:
            raise ValueError("limits must be positive")


def both_ways(edges: DataFrame, forward: list[str], reverse: list[str]) -> DataFrame:
    """Edges as steps (from, to) in the allowed directions; edges may be a step table already."""
    steps = edges if "direction" in edges.columns else write_steps(edges)
    return steps.where((F.col("direction") == "forward") & F.col("relation").isin(forward) | (F.col("direction") == "reverse") & F.col("relation").isin(reverse))


def neighbors(edges: DataFrame, node: str, forward: list[str], reverse: list[str]) -> DataFrame:
    return both_ways(edges, forward, reverse).where(F.col("from") == node).drop("bucket").orderBy("to", "id")


def explore(edges: DataFrame, source: str, forward: list[str], reverse: list[str], limits: Limits) -> DataFrame:
    """Every generated step as a path row in discovery terms: depth, keys, ok (simple)."""
    steps = both_ways(edges, forward, reverse)
    spark = edges.sparkSession
    step_type = "array<struct<id:string,relation:string,direction:string,from:string,to:string,exactness:string,confidence:double,context:string>>"
    frontier = spark.createDataFrame([(source,)], "source string").select(
        "source", F.col("source").alias("target"), F.array("source").alias("seen"), F.expr(f"cast(array() as {step_type})").alias("steps"), F.expr("cast(array() as array<string>)").alias("keys"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("uncertainty")
    )
    levels, left = None, limits.max_edges_visited
    for depth in range(1, limits.max_depth + 1):
        step = F.struct("id", "relation", "direction", "from", "to", "exactness", "confidence", "context")
        # the frontier has max_edges_visited rows at most, so it may be broadcast
        reached = steps.join(F.broadcast(frontier), F.col("target") == F.col("from")).select(
            "source", F.col("to").alias("target"), "seen", F.array_append("steps", step).alias("steps"), F.array_append("keys", F.concat("to", F.lit("\u0001"), "id")).alias("keys"),
            (F.col("cost") + expr.step_cost(F.col("relation"), F.col("confidence"), F.col("exactness"), F.lit(float(depth)))).alias("cost"),
            (F.col("uncertainty") + expr.uncertainty(F.col("confidence"), F.col("exactness"))).alias("uncertainty"),
        )
        reached = reached.withColumn("ok", ~F.array_contains("seen", F.col("target"))).withColumn("depth", F.lit(depth))
        reached = materialized(reached.orderBy("keys").limit(left), "level")
        levels = reached if levels is None else levels.unionByName(reached)
        frontier = reached.where("ok").withColumn("seen", F.array_append("seen", F.col("target"))).drop("ok", "depth")
        left -= reached.count()
        if left <= 0 or frontier.isEmpty():
            break
    return levels.where("ok").drop("ok", "seen")


STEPS = "array<struct<id:string,relation:string,direction:string,from:string,to:string,exactness:string,confidence:double,context:string>>"
#: frontier rows that are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 50_000


def best_first(edges: DataFrame, origins: DataFrame, forward: list[str], reverse: list[str], limits: Limits = Limits(), accept: Column | None = None) -> DataFrame:
    """The paths that are popped before the budget is spent, with their place in that order.

    origins (source) are different nodes. A path that is popped is expanded unless it has
    max_depth steps: every edge of its end counts, also those that lead back; the path at
    which the count passes max_edges_visited is popped but not expanded, and nothing after
    it. An origin also ends once max_paths accepted paths are popped; accept is a condition
    on path columns. Result: path columns, depth and place (from 1 for each source).
    """
    steps = both_ways(edges, forward, reverse)
    least = min((expr.RELATION_COST.get(r, 1.0) for r in [*forward, *reverse]), default=1.0) + 0.05 - 2e-6
    accept = F.lit(True) if accept is None else accept
    start = origins.select("source").distinct().select("source", F.col("source").alias("target"), F.array("source").alias("seen"), F.expr(f"cast(array() as {STEPS})").alias("steps"), F.expr("cast(array() as array<string>)").alias("keys"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("uncertainty"), F.lit(0).alias("depth"))
    opened, popped, spent = materialized(start, "open"), None, None
    order = W.partitionBy("source").orderBy(F.round("cost", 6), "depth", "keys")
    while True:
        n = opened.count()
        if not n:
            break
        cheapest = opened.groupBy("source").agg(F.min("cost").alias("cheapest"))
        layer = opened.join(cheapest, "source").withColumn("now", F.col("cost") < F.col("cheapest") + least).drop("cheapest")
        small = (lambda df: F.broadcast(df)) if n <= BROADCAST_ROWS else (lambda df: df)
        ends = layer.where(F.col("now") & (F.col("depth") < limits.max_depth)).select(F.col("target").alias("from")).distinct()
        degree = steps.join(small(ends), "from").groupBy(F.col("from").alias("target")).agg(F.count("*").alias("degree"))
        now = layer.where("now").drop("now").join(degree, "target", "left").withColumn("looked", F.when(F.col("depth") < limits.max_depth, F.coalesce("degree", F.lit(0))).otherwise(0).cast("long")).drop("degree")
        before = F.lit(0) if spent is None else F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in spent.items() for x in kv)), F.col("source")), F.lit(0))
        now = now.withColumn("upto", before + F.sum("looked").over(order.rowsBetween(W.unboundedPreceding, 0)))
        now = materialized(now.where(F.col("upto") - F.col("looked") <= limits.max_edges_visited).withColumn("accepted", F.coalesce(accept, F.lit(False)) & (F.col("depth") > 0)), "popped")
        popped = now if popped is None else popped.unionByName(now)
        # an origin ends at its budget or its last path; there are few origins
        state = popped.groupBy("source").agg(F.max("upto").alias("upto"), F.count_if("accepted").alias("accepted")).collect()
        spent = {r["source"]: r["upto"] for r in state}
        over = [r["source"] for r in state if r["upto"] > limits.max_edges_visited or r["accepted"] >= limits.max_paths]
        going = ~F.col("source").isin(over) if over else F.lit(True)
        step = F.struct("id", "relation", "direction", "from", "to", "exactness", "confidence", "context")
        grown = steps.join(small(now.where(going & (F.col("depth") < limits.max_depth))), F.col("target") == F.col("from")).where(~F.array_contains("seen", F.col("to"))).select(
            "source", F.col("to").alias("target"), F.array_append("seen", F.col("to")).alias("seen"), F.array_append("steps", step).alias("steps"), F.array_append("keys", F.concat("to", F.lit("\u0001"), "id")).alias("keys"),
            (F.col("cost") + expr.step_cost(F.col("relation"), F.col("confidence"), F.col("exactness"), F.col("depth") + 1.0)).alias("cost"),
            (F.col("uncertainty") + expr.uncertainty(F.col("confidence"), F.col("exactness"))).alias("uncertainty"), (F.col("depth") + 1).alias("depth"),
        )
        opened = materialized(layer.where(~F.col("now") & going).drop("now").unionByName(grown), "open")
    found = popped.where("depth > 0").withColumn("place", F.row_number().over(order)) if popped is not None else start.where("depth > 0").withColumn("accepted", F.lit(True)).withColumn("place", F.lit(1))
    return found.drop("seen", "looked", "upto")


def explore_many(edges: DataFrame, origins: DataFrame, forward: list[str], reverse: list[str], limits: Limits) -> DataFrame:
    """``explore`` from several different origins (source) side by side, each with a budget of its own; simple paths with their depth."""
    steps = both_ways(edges, forward, reverse)
    frontier = materialized(origins.select("source").distinct().select("source", F.col("source").alias("target"), F.array("source").alias("seen"), F.expr(f"cast(array() as {STEPS})").alias("steps"), F.expr("cast(array() as array<string>)").alias("keys"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("uncertainty"), F.lit(0).alias("depth"), F.lit(True).alias("ok"), F.lit(0).cast("long").alias("spent")), "level")
    levels = None
    step = F.struct("id", "relation", "direction", "from", "to", "exactness", "confidence", "context")
    for depth in range(1, limits.max_depth + 1):
        n = frontier.count()
        if not n:
            break
        # a source has max_edges_visited rows of a frontier at most
        grown = steps.join(F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier, F.col("target") == F.col("from")).select(
            "source", F.col("to").alias("target"), "seen", F.array_append("steps", step).alias("steps"), F.array_append("keys", F.concat("to", F.lit("\u0001"), "id")).alias("keys"),
            (F.col("cost") + expr.step_cost(F.col("relation"), F.col("confidence"), F.col("exactness"), F.lit(float(depth)))).alias("cost"),
            (F.col("uncertainty") + expr.uncertainty(F.col("confidence"), F.col("exactness"))).alias("uncertainty"), F.lit(depth).alias("depth"), "spent",
        )
        nth = F.row_number().over(W.partitionBy("source").orderBy("keys"))
        grown = grown.withColumn("spent", F.col("spent") + nth).where(F.col("spent") <= limits.max_edges_visited).withColumn("ok", ~F.array_contains("seen", F.col("target")))
        level = materialized(grown, "level")
        levels = level if levels is None else levels.unionByName(level)
        # what a source has spent is the same on all of its rows
        spent = F.max("spent").over(W.partitionBy("source"))
        frontier = materialized(level.withColumn("spent", spent).where("ok").withColumn("seen", F.array_append("seen", F.col("target"))), "level")
    return (frontier if levels is None else levels).where("ok and depth > 0").drop("ok", "seen", "spent")


def within_reach(edges: DataFrame, origins: DataFrame, follows: list[tuple[list[str], list[str]]], depth: int) -> DataFrame:
    """The steps that searches of the origins (source) can look at, written once for all of them.

    follows has the forward and reverse relations of each search. A search of at most depth steps
    looks at the steps of nodes up to depth - 1 steps away, all of which are kept, so it finds
    the same here as in the whole table. Every level passes over the table once for all
    searches. Where they reach more than BROADCAST_ROWS nodes, the table is left whole.
    """
    kinds = {(way, r): [i for i, f in enumerate(follows) if r in f[at]] for at, way in enumerate(("forward", "reverse")) for r in {x for f in follows for x in f[at]}}
    by = F.coalesce(*(F.when((F.col("direction") == way) & (F.col("relation") == r), F.array(*map(F.lit, i))) for (way, r), i in kinds.items()))
    steps = both_ways(edges, [r for way, r in kinds if way == "forward"], [r for way, r in kinds if way == "reverse"])
    told, followed = steps.select("from", "to", "relation", "direction"), (F.col("from") == F.col("node")) & F.array_contains(by, F.col("search"))  # what is followed is asked of steps that meet
    seen = front = materialized(origins.select(F.col("source").alias("node"), F.explode(F.array(*(F.lit(i) for i in range(len(follows))))).alias("search")).distinct(), "reach")
    for _ in range(depth - 1):
        met = told.join(F.broadcast(front), followed).select(F.col("to").alias("node"), "search").distinct()
        front = materialized(met.join(F.broadcast(seen), ["node", "search"], "left_anti"), "reach")
        seen = seen.unionByName(front)
        if seen.count() > BROADCAST_ROWS:
            return edges
        if front.isEmpty():
            break
    found = steps.join(F.broadcast(seen), followed, "left_semi")
    return materialized(found.repartition(16, "from"), "near")


def presented(paths: DataFrame) -> DataFrame:
    """Flat columns of paths: ids and relations joined, cost and uncertainty rounded."""
    return paths.select(
        "source", "target", F.array_join(F.col("steps.id"), "|").alias("edge_ids"), F.array_join(F.col("steps.relation"), "->").alias("relations"),
        F.size("steps").alias("length"), F.round("cost", 6).alias("cost"), F.round("uncertainty", 6).alias("uncertainty"),
    )


def bounded_bfs(edges: DataFrame, source: str, forward: list[str], reverse: list[str], limits: Limits = Limits(), accept: Column | None = None) -> DataFrame:
    """The first max_paths accepted paths in discovery order (accepts when generated)."""
    found = explore(edges, source, forward, reverse, limits)
    if accept is not None:
        found = found.where(accept)
    return found.orderBy("depth", "keys").limit(limits.max_paths)


def k_shortest(edges: DataFrame, source: str, forward: list[str], reverse: list[str], limits: Limits = Limits(), accept: Column | None = None) -> DataFrame:
    """The first max_paths accepted paths that best-first search pops; equal costs by length, then step keys."""
    origin = edges.sparkSession.createDataFrame([(source,)], "source string")
    found = best_first(edges, origin, forward, reverse, limits, accept).where("accepted").drop("accepted", "place")
    return found.orderBy(F.round("cost", 6), "depth", "keys").limit(limits.max_paths)


def dijkstra(edges: DataFrame, source: str, target: str, forward: list[str], reverse: list[str], limits: Limits = Limits()) -> DataFrame:
    return k_shortest(edges, source, forward, reverse, limits, F.col("target") == target).limit(1)


def trace_path(edges: DataFrame, source: str, target: str, relations: list[str], limits: Limits = Limits()) -> DataFrame:
    return k_shortest(edges, source, relations, relations, limits, F.col("target") == target)


def unique_paths(paths: DataFrame) -> DataFrame:
    """One path for each list of edges, the cheapest."""
    return paths.groupBy(F.col("steps.id").alias("edge_list")).agg(F.min_by(F.struct(*paths.columns), F.struct("cost", "target")).alias("p")).select("p.*")


def path_sql(source: str, forward: list[str], reverse: list[str], limits: Limits, accept: str = "true", shortest: bool = False) -> str:
    """DuckDB CTEs that end in `paths`, by recursion; expects CTE edges."""
    return paths_sql(f"SELECT '{source}' AS source", forward, reverse, limits, accept, shortest)


def paths_sql(starts: str, forward: list[str], reverse: list[str], limits: Limits, accept: str = "true", shortest: bool = False) -> str:
    """``path_sql`` from each start (source) of a select, each with limits of its own."""
    order = "round(cost, 6), depth, keys" if shortest else "depth, keys"
    return f"""{walk_sql(starts, forward, reverse, limits, shortest)}, paths AS (SELECT * FROM visited WHERE depth > 0 AND ok AND ({accept}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY {order}) <= {limits.max_paths})"""


def walk_sql(starts: str, forward: list[str], reverse: list[str], limits: Limits, shortest: bool = False) -> str:
    """DuckDB CTEs that end in `visited`: what a breadth-first or best-first search from each start (source) visits."""
    cost = "CASE relation " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in expr.RELATION_COST.items()) + " ELSE 1.0 END"
    penalty = "CASE exactness " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in expr.EXACTNESS_PENALTY.items()) + " END"
    among = lambda names: "(" + ", ".join(f"'{n}'" for n in names or ["-"]) + ")"
    visited = f"SELECT * FROM walk WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY depth, keys) <= {limits.max_edges_visited}"
    if shortest:  # the degrees of all paths before it, in order of cost, are within the budget
        order = "PARTITION BY source ORDER BY round(cost, 6), depth, keys ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        visited = f"SELECT * FROM (SELECT walk.*, coalesce(sum(CASE WHEN depth < {limits.max_depth} THEN coalesce(d, 0) ELSE 0 END) OVER ({order}), 0) AS before FROM walk LEFT JOIN (SELECT f, count(*) AS d FROM priced GROUP BY f) g ON g.f = target WHERE ok) WHERE before <= {limits.max_edges_visited}"
    return f"""steps AS (
  SELECT *, head_id AS f, tail_id AS t FROM edges WHERE relation IN {among(forward)}
  UNION ALL SELECT *, tail_id, head_id FROM edges WHERE relation IN {among(reverse)}
), priced AS (SELECT id, relation, exactness, confidence, path, head_id, tail_id, f, t, ({cost})::DOUBLE AS rc, (least(greatest(1 - confidence, 0), 1) + {penalty})::DOUBLE AS unc FROM steps),
walk AS (
  SELECT source, source AS target, [source] AS seen, []::VARCHAR[] AS ids, []::VARCHAR[] AS rels, []::VARCHAR[] AS keys, []::VARCHAR[] AS exs, []::DOUBLE[] AS confs, []::VARCHAR[] AS tos, []::VARCHAR[] AS files, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS uncertainty, 0 AS depth, true AS ok FROM ({starts})
  UNION ALL
  SELECT source, t, list_append(seen, t), list_append(ids, id), list_append(rels, relation), list_append(keys, t || chr(1) || id), list_append(exs, exactness), list_append(confs, confidence), list_append(tos, t), list_append(files, path), cost + rc + unc + (depth + 1) * 0.05, uncertainty + unc, depth + 1, NOT list_contains(seen, t)
  FROM walk JOIN priced ON f = target WHERE ok AND depth < {limits.max_depth}
), visited AS ({visited})"""


PRESENTED_SQL = "SELECT source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, list_aggregate(rels, 'string_agg', '->') AS relations, len(ids)::INT AS length, round(cost, 6) AS cost, round(uncertainty, 6) AS uncertainty FROM paths"
