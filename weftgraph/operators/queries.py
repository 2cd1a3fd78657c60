"""Named graph queries: callers, callees, reads, writes, mutations, dataflow, auth, events,
tests, migrations, impact, derived closure, explanations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr
from ..sources.shared import materialized
from .traverse import Limits, best_first, both_ways, bounded_bfs, explore_many, k_shortest, walk_sql, within_reach, write_steps


@dataclass(frozen=True)
class PathQuery:
    """What a named query follows, which paths it accepts (Spark and SQL text), and how it ranks."""

    forward: tuple[str, ...] = ()
    reverse: tuple[str, ...] = ()
    shortest: bool = False
    must: tuple[tuple[str, ...], ...] = ()  # each group: one of these relations is on the path
    last: tuple[str, ...] = ()  # the last relation is one of these

    def accept(self) -> Column | None:
        rel = F.col("steps.relation")
        tests = [F.arrays_overlap(rel, F.array(*map(F.lit, g))) for g in self.must]
        if self.last:
            tests.append(F.get(rel, F.size(rel) - 1).isin(*self.last))
        out = None
        for t in tests:
            out = t if out is None else out & t
        return out

    def accept_sql(self) -> str:
        quoted = lambda g: "[" + ", ".join(f"'{x}'" for x in g) + "]"
        tests = [f"list_has_any(rels, {quoted(g)})" for g in self.must]
        if self.last:
            tests.append(f"list_contains({quoted(self.last)}, rels[-1])")
        return " AND ".join(tests) or "true"

    def run(self, edges: DataFrame, source: str, limits: Limits = Limits()) -> DataFrame:
        f = k_shortest if self.shortest else bounded_bfs
        return f(edges, source, list(self.forward), list(self.reverse), limits, self.accept())

    def run_many(self, edges: DataFrame, origins: DataFrame, limits: Limits = Limits()) -> DataFrame:
        """The paths of each of several origins (source), each with limits of its own."""
        if self.shortest:
            found = best_first(edges, origins, list(self.forward), list(self.reverse), limits, self.accept()).where("accepted").drop("accepted", "place")
            order = (F.round("cost", 6), "depth", "keys")
        else:
            found = explore_many(edges, origins, list(self.forward), list(self.reverse), limits)
            found = found if self.accept() is None else found.where(self.accept())
            order = ("depth", "keys")
        nth = F.row_number().over(W.partitionBy("source").orderBy(*order))
        return found.withColumn("nth", nth).where(F.col("nth") <= limits.max_paths).drop("nth")


AUTH = ("AUTHORIZES", "CHECKS_ROLE", "CHECKS_PERMISSION")
TESTS = ("TESTS", "COVERS", "ASSERTS", "MOCKS", "STUBS", "FIXTURES_FOR")
SCHEMA = ("MIGRATES", "ALTERS_COLUMN", "DEPENDS_ON_SCHEMA")
SOURCES, SINKS = ("PUBLISHES", "EMITS"), ("CONSUMES", "LISTENS_TO", "SUBSCRIBES_TO")

QUERIES = {
    "callers": PathQuery(reverse=("CALLS",)),
    "callees": PathQuery(forward=("CALLS",)),
    "reads": PathQuery(("READS",), ("READS",)),
    "writes": PathQuery(("WRITES",), ("WRITES",)),
    "mutations": PathQuery(("CALLS", "WRITES", "MUTATES"), shortest=True, last=("WRITES", "MUTATES")),
    "dataflow": PathQuery(("FLOWS_TO",), ("ASSIGNED_FROM",), shortest=True),
    "auth_paths": PathQuery(("EXPOSES", "CALLS", *AUTH), shortest=True, must=(("EXPOSES",), AUTH)),
    "tests": PathQuery(reverse=TESTS, shortest=True),
    "migrations": PathQuery(SCHEMA, (*SCHEMA, "READS_TABLE", "WRITES_TABLE"), shortest=True),
}


def relabel(edges: DataFrame, relations: dict[str, str]) -> DataFrame:
    """Edges with relations renamed (how a fixture plays another relation's part)."""
    return edges.withColumn("relation", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in relations.items() for x in kv]), F.col("relation")), F.col("relation")))


def _ranked(relations: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, relations)), F.col("relation"))


def event_flow(edges: DataFrame, source: str, limits: Limits = Limits()) -> DataFrame:
    """``event_flows`` of one publisher, cheapest first."""
    found = event_flows(edges, edges.sparkSession.createDataFrame([(source,)], "source string"), limits)
    return found.orderBy(F.round("cost", 6), "depth", "keys")


def event_flows(edges: DataFrame, origins: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Paths from publishers (source) over an event to its consumers, and on along their calls.

    Publish steps are taken by relation, then id, and each one's consumers likewise; every one
    of both counts against one budget (max_edges_visited) of the publisher. A consumer is a
    path, followed by the cheapest call paths from it (as ``k_shortest`` finds them, with the rest of the
    depth and a budget of their own) until max_paths are found. A consumer may be the source itself.
    """
    steps = both_ways(edges, list(SOURCES), list(SINKS))
    step = F.struct("id", "relation", "direction", "from", "to", "exactness", "confidence", "context")
    of = lambda *order: W.partitionBy("source").orderBy(*order)
    said = steps.where((F.col("direction") == "forward") & F.col("relation").isin(*SOURCES)).join(F.broadcast(origins.select("source").distinct()), F.col("from") == F.col("source"))
    said = said.withColumn("rank", _ranked(SOURCES)).withColumn("n", F.row_number().over(of("rank", "id"))).where(F.col("n") <= limits.max_edges_visited)
    # no publish step beyond the budget is looked at, so these are few
    out = materialized(said.select("source", "n", F.col("to").alias("event"), step.alias("first")), "publishers")
    back = steps.where((F.col("direction") == "reverse") & F.col("relation").isin(*SINKS))
    heard = back.join(F.broadcast(out.select("event").distinct()), F.col("from") == F.col("event"))
    many = heard.groupBy("event").agg(F.count("*").alias("many"))
    before = of("n").rowsBetween(W.unboundedPreceding, -1)  # over max_edges_visited rows of a publisher
    out = out.join(many, "event", "left").withColumn("many", F.coalesce("many", F.lit(0))).withColumn("at", F.coalesce(F.sum(F.col("many") + 1).over(before), F.lit(0)) + 1)
    # each consumer is a path, so the first max_paths are enough
    nth = F.row_number().over(W.partitionBy("event").orderBy(_ranked(SINKS), "id"))
    first = heard.withColumn("nth", nth).where(F.col("nth") <= limits.max_paths).select("event", "nth", F.col("to").alias("target"), step.alias("second"))
    base = out.join(first, "event").withColumn("at", F.col("at") + F.col("nth")).where(F.col("at") <= limits.max_edges_visited)
    base = base.withColumn("nth", F.row_number().over(of("at"))).where(F.col("nth") <= limits.max_paths)
    cost = lambda s, d: expr.step_cost(F.col(f"{s}.relation"), F.col(f"{s}.confidence"), F.col(f"{s}.exactness"), F.lit(float(d)))
    doubt = lambda s: expr.uncertainty(F.col(f"{s}.confidence"), F.col(f"{s}.exactness"))
    key = lambda s: F.concat(F.col(f"{s}.to"), F.lit("\u0001"), F.col(f"{s}.id"))
    base = materialized(base.select(
        "source", "target", F.array("first", "second").alias("steps"), F.array(key("first"), key("second")).alias("keys"), (cost("first", 1) + cost("second", 2)).alias("cost"), (doubt("first") + doubt("second")).alias("uncertainty"), F.lit(2).alias("depth"), "at", F.lit(0).alias("place"),
    ), "consumers")
    found = base
    if limits.max_depth > 2:
        rest = Limits(limits.max_depth - 2, limits.max_paths, limits.max_edges_visited)
        calls = best_first(edges, base.select(F.col("target").alias("source")), ["CALLS"], [], rest).where(F.col("place") <= limits.max_paths)
        calls = calls.select(F.col("source").alias("from"), *(F.col(c).alias(f"c_{c}") for c in ("target", "steps", "keys", "cost", "uncertainty", "depth", "place")))
        longer = base.join(calls, F.col("target") == F.col("from"))
        found = base.unionByName(longer.select(
            "source", F.col("c_target").alias("target"), F.concat("steps", "c_steps").alias("steps"), F.concat("keys", "c_keys").alias("keys"), (F.col("cost") + F.col("c_cost") + 0.1 * F.col("c_depth")).alias("cost"),
            (F.col("uncertainty") + F.col("c_uncertainty")).alias("uncertainty"), (F.col("depth") + F.col("c_depth")).alias("depth"), "at", F.col("c_place").alias("place"),
        ))
    return found.withColumn("nth", F.row_number().over(of("at", "place"))).where(F.col("nth") <= limits.max_paths).drop("at", "place", "nth")


def event_flow_sql(starts: str, limits: Limits) -> str:
    """DuckDB CTEs that end in `paths` of all starts, a select of source; expects CTE edges."""
    cost = "CASE relation " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in expr.RELATION_COST.items()) + " ELSE 1.0 END"
    penalty = "CASE exactness " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in expr.EXACTNESS_PENALTY.items()) + " END"
    quoted = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    rest = Limits(max(1, limits.max_depth - 2), limits.max_paths, limits.max_edges_visited)
    first = lambda order: f"QUALIFY row_number() OVER (PARTITION BY source ORDER BY {order}) <= {limits.max_paths}"
    return f"""cost0 AS (SELECT *, ({cost})::DOUBLE AS rc, (least(greatest(1 - confidence, 0), 1) + {penalty})::DOUBLE AS unc FROM edges),
con AS (SELECT *, row_number() OVER (PARTITION BY tail_id ORDER BY list_position({quoted(SINKS)}, relation), id) AS nth FROM cost0 WHERE relation IN {tuple(SINKS)}),
pub AS (SELECT p.*, coalesce(sum(1 + many) OVER (PARTITION BY head_id ORDER BY list_position({quoted(SOURCES)}, relation), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS pos
  FROM (SELECT c.*, (SELECT count(*) FROM con WHERE con.tail_id = c.tail_id) AS many FROM cost0 c WHERE relation IN {tuple(SOURCES)} AND head_id IN (SELECT source FROM ({starts}))) p),
base AS (SELECT pub.head_id AS source, pos + nth AS pos, con.head_id AS target, [pub.id, con.id] AS ids, [pub.relation, con.relation] AS rels, [pub.tail_id || chr(1) || pub.id, con.head_id || chr(1) || con.id] AS keys, [pub.exactness, con.exactness] AS exs, [pub.confidence, con.confidence] AS confs,
    pub.rc + pub.unc + con.rc + con.unc + 0.15 AS cost, pub.unc + con.unc AS uncertainty FROM pub JOIN con ON con.tail_id = pub.tail_id WHERE pos + nth <= {limits.max_edges_visited} {first('pos + nth')}),
{walk_sql('SELECT DISTINCT target AS source FROM base', ['CALLS'], [], rest, True)},
calls AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(cost, 6), depth, keys) AS place FROM visited WHERE depth > 0 AND ok AND {limits.max_depth} > 2),
paths AS (SELECT * FROM (
  SELECT source, target, ids, rels, keys, exs, confs, cost, uncertainty, 2 AS depth, pos, 0 AS place FROM base
  UNION ALL SELECT b.source, c.target, list_concat(b.ids, c.ids), list_concat(b.rels, c.rels), list_concat(b.keys, c.keys), list_concat(b.exs, c.exs), list_concat(b.confs, c.confs), b.cost + c.cost + 0.1 * c.depth, b.uncertainty + c.uncertainty, 2 + c.depth, pos, place FROM base b JOIN calls c ON c.source = b.target
) {first('pos, place')})"""


def impact(edges: DataFrame, source: str, limits: Limits) -> DataFrame:
    """Sections of all path queries and the event flow, tagged."""
    out = event_flow(edges, source, limits).withColumn("section", F.lit("event_flow"))
    for name, q in QUERIES.items():
        out = out.unionByName(q.run(edges, source, limits).withColumn("section", F.lit(name)).select(*out.columns))
    return out


def context_paths(edges: DataFrame, origins: DataFrame, limits: Limits) -> DataFrame:
    """The paths of all ten path queries from each origin (source), each list of edges once.

    The queries search what is within reach of the origins, not the whole table each."""
    follows = [([*SOURCES, "CALLS"], list(SINKS)), *((list(q.forward), list(q.reverse)) for q in QUERIES.values())]
    edges = within_reach(edges if "direction" in edges.columns else write_steps(edges), origins, follows, limits.max_depth)
    out = event_flows(edges, origins, limits)
    for q in QUERIES.values():
        out = out.unionByName(q.run_many(edges, origins, limits).select(*out.columns))
    best = F.min_by(F.struct(*out.columns), F.struct(F.round("cost", 6), "target"))
    return out.groupBy("source", F.col("steps.id").alias("edge_list")).agg(best.alias("p")).select("p.*")


def derived_relation(relations: Column) -> Column:
    """The relation a path collapses to; rules in order."""
    has = lambda *names: F.arrays_overlap(relations, F.array(*map(F.lit, names)))
    return (
        F.when(has("CALLS") & has("WRITES", "MUTATES"), "MAY_MUTATE")
        .when(has("CALLS") & has("READS"), "MAY_READ")
        .when(has("EXPOSES") & has("CALLS"), "API_REACHES")
        .when(has(*SOURCES) & has(*SINKS), "ASYNC_REACHES")
        .when(has("MIGRATES", "WRITES_TABLE", "ALTERS_COLUMN", "DEPENDS_ON_SCHEMA"), "SCHEMA_IMPACT")
    )


def closure(paths: DataFrame) -> DataFrame:
    """One derived edge for each (source, relation, target): the cheapest path's."""
    rel = derived_relation(F.col("steps.relation"))
    weak = F.exists("steps", lambda s: s["exactness"].isin("static_heuristic", "inferred"))
    rows = paths.withColumn("derived_relation", rel).where("derived_relation is not null")
    best = F.min(F.struct(F.round("cost", 6).alias("c"), "depth", "keys", F.col("steps.id").alias("ids"), weak.alias("weak"), F.array_min(F.col("steps.confidence")).alias("conf"))).alias("b")
    rows = rows.groupBy("source", F.col("derived_relation").alias("relation"), "target").agg(best)
    return rows.select("source", "relation", "target", F.array_join("b.ids", "|").alias("provenance"), F.when(F.col("b.weak"), "inferred").otherwise("derived_from_verified_edges").alias("exactness"), F.col("b.conf").alias("confidence"))


def may_mutate(edges: DataFrame) -> DataFrame:
    """CALLS joined to WRITES or MUTATES of the callee, as derived edges."""
    base = edges.where(~F.col("derived"))
    call = base.where("relation = 'CALLS'").select(F.col("id").alias("call_id"), F.col("head_id").alias("head"), F.col("tail_id").alias("mid"), F.col("confidence").alias("c1"), F.col("exactness").alias("x1"))
    write = base.where(F.col("relation").isin("WRITES", "MUTATES")).select(F.col("id").alias("write_id"), F.col("head_id").alias("mid"), F.col("tail_id").alias("tail"), F.col("confidence").alias("c2"), F.col("exactness").alias("x2"))
    ok = F.col("x1").isin(expr.PROOF_GRADE) & F.col("x2").isin(expr.PROOF_GRADE)
    return call.join(write, "mid").select("head", F.lit("MAY_MUTATE").alias("relation"), "tail", "call_id", "write_id", F.least("c1", "c2").alias("confidence"), F.when(ok, "derived_from_verified_edges").otherwise("inferred").alias("exactness"))


def path_labels(paths: DataFrame) -> DataFrame:
    """Evidence labels of paths: weakest exactness, confidence, context, metapath."""
    rank = lambda x: expr.lookup(expr.EXACTNESS_RANK, x, 5)
    ranked = F.transform("steps", lambda s, i: F.struct(rank(s["exactness"]).alias("r"), i.alias("i"), s["exactness"].alias("x")))
    conf = expr.clamp(F.coalesce(F.array_min(F.col("steps.confidence")), F.lit(1.0)) / (1 + F.col("uncertainty")))
    return paths.withColumn("exactness", F.array_max(ranked)["x"]).withColumn("confidence", F.round(conf, 6)).withColumn("context", expr.path_context(F.col("steps.context"))).withColumn("metapath", F.array_join(F.col("steps.relation"), "->"))


def score_paths(paths: DataFrame, weights: dict[str, float], bias: float = -3.25, uncertainty_weight: float = 1.75) -> DataFrame:
    """Logistic relevance of paths from their graph features; weights by feature name."""
    rel, n = F.col("steps.relation"), F.size("steps")
    prior = F.when(n == 0, 1.0).otherwise(F.least(F.greatest(F.aggregate(F.transform("steps", lambda s: expr.relation_prior(s["relation"])), F.lit(0.0), lambda a, x: a + x) / n, F.lit(0.001)), F.lit(0.999)))
    conf = expr.clamp(F.array_min(F.col("steps.confidence")) / (1 + F.col("uncertainty")))
    has = lambda names: F.when(F.arrays_overlap(rel, F.array(*map(F.lit, names))), 1.0).otherwise(0.0)
    features = {
        "graph_distance": 1 / (1 + F.col("cost")), "path_length": 1 / (1 + n), "relation_signature": prior, "type_validity": F.lit(1.0),
        "edge_confidence": conf, "test_failure_link": has(expr.TEST_RELATIONS), "security_relation_presence": has(expr.SECURITY_RELATIONS),
    }
    unknown = set(weights) - set(features) - {"exact_symbol_match", "bm25_score", "binary_hamming_score", "rerank_score", "file_centrality", "recent_edit_link"}
    if unknown:
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    z = F.lit(bias) + expr.logit(prior) - uncertainty_weight * (F.col("uncertainty") + (1 - conf) + (1 - prior))
    for k, v in features.items():
        z = z + weights.get(k, 0.0) * v
    return paths.withColumn("logit", F.round(z, 6)).withColumn("probability", F.round(expr.sigmoid(z), 6))


def explain_missing(edges: DataFrame, entities: DataFrame, asked: DataFrame, supported: list[str]) -> DataFrame:
    """asked (head, relation, tail): why there is no such edge, as a ladder of checks."""
    ids = entities.select(F.col("id"))
    a = asked.join(ids.withColumnRenamed("id", "head").withColumn("h", F.lit(1)), "head", "left").join(ids.withColumnRenamed("id", "tail").withColumn("t", F.lit(1)), "tail", "left")
    near = edges.select(F.col("head_id").alias("head"), "relation").distinct().withColumn("r", F.lit(1))
    hit = edges.select(F.col("head_id").alias("head"), "relation", F.col("tail_id").alias("tail")).distinct().withColumn("e", F.lit(1))
    a = a.join(near, ["head", "relation"], "left").join(hit, ["head", "relation", "tail"], "left")
    reason = F.when(F.col("h").isNull() | F.col("t").isNull(), "symbol_not_found").when(~F.col("relation").isin(supported), "relation_unsupported").when(F.col("e").isNotNull(), "found").when(F.col("r").isNull(), "no_relation_from_source").otherwise("exceeds_bound_or_absent")
    return a.select("head", "relation", "tail", reason.alias("reason"))
