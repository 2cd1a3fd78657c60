"""Graph queries over the projected tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import queries as Q
from ..operators import traverse as T
from ..sources import projection as P
from ..sources import store

QUERIES, ORACLES = {}, {}
WITH = f"WITH RECURSIVE {P.ENTITIES_SQL}, {P.EDGES_SQL}"
#: how the projection plays relations it has no edges for
ROLES = {
    "auth_paths": {"CONTAINS": "EXPOSES", "READS": "CHECKS_ROLE"},
    "tests": {"CALLS": "TESTS", "FLOWS_TO": "COVERS"},
    "migrations": {"CALLS": "MIGRATES", "READS": "READS_TABLE", "WRITES": "WRITES_TABLE"},
}
#: query, source, depth, cap on paths
RUNS = {"callers": ("s:1", 2, 2000), "callees": ("c:1", 2, 500), "reads": ("p:1", 2, 500), "writes": ("p:1", 2, 500), "mutations": ("c:1", 3, 300), "dataflow": ("o:1", 2, 300), "auth_paths": ("n:1", 3, 300), "tests": ("s:1", 1, 300), "migrations": ("p:1", 2, 300)}


def _case(roles: dict[str, str]) -> str:
    return "CASE relation " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in roles.items()) + " ELSE relation END" if roles else "relation"


def _with(roles: dict[str, str]) -> str:
    if not roles:
        return WITH
    return WITH.replace(", edges AS (", ", edges0 AS (") + f", edges AS (SELECT * REPLACE ({_case(roles)} AS relation) FROM edges0)"


def _register_paths():
    for name, (source, depth, cap) in RUNS.items():
        q, roles, limits = Q.QUERIES[name], ROLES.get(name, {}), T.Limits(depth, cap, 10_000)

        def run(spark, sf_dir, q=q, roles=roles, source=source, limits=limits):
            e = store.steps(spark, sf_dir)
            return T.presented(q.run(Q.relabel(e, roles) if roles else e, source, limits))

        QUERIES[f"q_find_{name}"] = run
        ORACLES[f"q_find_{name}"] = f"{_with(roles)}, {T.path_sql(source, list(q.forward), list(q.reverse), limits, q.accept_sql(), q.shortest)} {T.PRESENTED_SQL}"


_register_paths()


def add(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_O1 = "SELECT 'o:1' AS source"
_NEAR = T.Limits(2, 200, 10_000)
_TARGET = T.Limits(4, 20, 50_000)
_ALL = ["CONTAINS"]


@add("q_neighbors", f"{WITH} SELECT id, relation, 'forward' AS direction, head_id AS \"from\", tail_id AS \"to\" FROM edges WHERE relation IN ('CALLS', 'READS') AND head_id = 'o:1' UNION ALL SELECT id, relation, 'reverse', tail_id, head_id FROM edges WHERE relation = 'CALLS' AND tail_id = 'o:1'")
def neighbors(spark, sf_dir):
    return T.neighbors(store.steps(spark, sf_dir), "o:1", ["CALLS", "READS"], ["CALLS"]).select("id", "relation", "direction", "from", "to")


@add("q_trace_path", f"{WITH}, {T.path_sql('c:2', _ALL, _ALL, _TARGET, "target = 'c:5'", True)} {T.PRESENTED_SQL}")
def trace_path(spark, sf_dir):
    return T.presented(T.trace_path(store.steps(spark, sf_dir), "c:2", "c:5", _ALL, _TARGET))


@add("q_dijkstra", f"{WITH}, {T.path_sql('c:2', _ALL, _ALL, T.Limits(4, 1, 50_000), "target = 'c:5'", True)} {T.PRESENTED_SQL}")
def dijkstra(spark, sf_dir):
    return T.presented(T.dijkstra(store.steps(spark, sf_dir), "c:2", "c:5", _ALL, _ALL, T.Limits(4, 1, 50_000)))


@add("q_k_shortest", f"{WITH}, {T.path_sql('c:2', ['CALLS', 'WRITES', 'READS', 'FLOWS_TO'], [], T.Limits(3, 50, 10_000), 'true', True)} {T.PRESENTED_SQL}")
def k_shortest(spark, sf_dir):
    return T.presented(T.k_shortest(store.steps(spark, sf_dir), "c:2", ["CALLS", "WRITES", "READS", "FLOWS_TO"], [], T.Limits(3, 50, 10_000)))


@add("q_bfs_budget", f"{WITH}, {T.path_sql('s:2', [], ['CALLS'], T.Limits(2, 1000, 100))} {T.PRESENTED_SQL}")
def bfs_budget(spark, sf_dir):
    return T.presented(T.bounded_bfs(store.steps(spark, sf_dir), "s:2", [], ["CALLS"], T.Limits(2, 1000, 100)))


@add("q_cycle_safe", f"{WITH}, {T.path_sql('r:1', ['CONTAINS'], ['CONTAINS'], T.Limits(3, 500, 5000))} {T.PRESENTED_SQL}")
def cycle_safe(spark, sf_dir):
    return T.presented(T.bounded_bfs(store.steps(spark, sf_dir), "r:1", ["CONTAINS"], ["CONTAINS"], T.Limits(3, 500, 5000)))


def _paths(spark, sf_dir):
    return T.k_shortest(store.steps(spark, sf_dir), "c:1", ["CALLS", "WRITES", "READS"], [], _NEAR)


_PATHS_SQL = f"{WITH}, {T.path_sql('c:1', ['CALLS', 'WRITES', 'READS'], [], _NEAR, 'true', True)}"


@add("q_impact_sections", f"{WITH}" + "".join(f", {n}_ AS (WITH RECURSIVE {T.path_sql('o:1', list(q.forward), list(q.reverse), T.Limits(2, 24, 5000), q.accept_sql(), q.shortest)} SELECT '{n}' AS section, source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, round(cost, 6) AS cost FROM paths)" for n, q in Q.QUERIES.items()) + f", event_flow_ AS (WITH RECURSIVE {Q.event_flow_sql(_O1, T.Limits(2, 24, 5000))} SELECT 'event_flow' AS section, source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, round(cost, 6) AS cost FROM paths) " + " UNION ALL ".join(f"SELECT * FROM {n}_" for n in [*Q.QUERIES, "event_flow"]))
def impact_sections(spark, sf_dir):
    found = Q.impact(store.steps(spark, sf_dir), "o:1", T.Limits(2, 24, 5000))
    return found.select("section", "source", "target", F.array_join(F.col("steps.id"), "|").alias("edge_ids"), F.round("cost", 6).alias("cost"))


_EVENTS = {"READS": "PUBLISHES", "WRITES": "CONSUMES", "FLOWS_TO": "EMITS"}


def _event_flow(name, source, limits):
    starts = f"SELECT '{source}' AS source"
    add(name, f"{_with(_EVENTS)}, {Q.event_flow_sql(starts, limits)} {T.PRESENTED_SQL}")(lambda s, d: T.presented(Q.event_flow(Q.relabel(store.steps(s, d), _EVENTS), source, limits)))


_event_flow("q_find_event_flow", "o:1", T.Limits(4, 300, 10_000))
_event_flow("q_event_flow_budget", "o:1", T.Limits(3, 1000, 12))  # the budget ends among an event's consumers


def _shortest(name, source, forward, reverse, limits):
    add(name, f"{WITH}, {T.path_sql(source, forward, reverse, limits, 'true', True)} {T.PRESENTED_SQL}")(lambda s, d: T.presented(T.k_shortest(store.steps(s, d), source, forward, reverse, limits)))


@add("q_impact_events", f"{_with(_EVENTS)}" + "".join(f", {n}_ AS (WITH RECURSIVE {T.path_sql('o:1', list(q.forward), list(q.reverse), T.Limits(4, 24, 5000), q.accept_sql(), q.shortest)} SELECT '{n}' AS section, source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, round(cost, 6) AS cost FROM paths)" for n, q in Q.QUERIES.items()) + f", event_flow_ AS (WITH RECURSIVE {Q.event_flow_sql(_O1, T.Limits(4, 24, 5000))} SELECT 'event_flow' AS section, source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, round(cost, 6) AS cost FROM paths) " + " UNION ALL ".join(f"SELECT * FROM {n}_" for n in [*Q.QUERIES, "event_flow"]))
def impact_events(spark, sf_dir):
    found = Q.impact(Q.relabel(store.steps(spark, sf_dir), _EVENTS), "o:1", T.Limits(4, 24, 5000))
    return found.select("section", "source", "target", F.array_join(F.col("steps.id"), "|").alias("edge_ids"), F.round("cost", 6).alias("cost"))


# budgets that end among paths of one and of two steps
_shortest("q_k_shortest_budget", "c:2", ["CALLS", "WRITES", "READS", "FLOWS_TO"], [], T.Limits(3, 1000, 40))
_shortest("q_k_shortest_hubs", "s:1", ["CALLS"], ["CALLS"], T.Limits(3, 2000, 900))


@add("q_derived_may_mutate", """WITH l AS (SELECT *, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS lk FROM lineitem WHERE l_returnflag = 'R'),
w AS (SELECT o_orderkey AS o, o_custkey, o_orderstatus, lk, l_partkey, l_tax FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT 'c:' || c_custkey AS head, 'MAY_MUTATE' AS relation, 'p:' || l_partkey AS tail, 'e:co:' || o AS call_id, 'e:op:' || lk AS write_id, least(1.0, round(1 - l_tax, 6))::DOUBLE AS confidence,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'derived_from_verified_edges' ELSE 'inferred' END AS exactness
FROM w JOIN customer ON c_custkey = o_custkey""")
def derived_may_mutate(spark, sf_dir):
    return Q.may_mutate(P.edges(spark, sf_dir))


_DERIVED_SQL = "CASE WHEN list_contains(rels, 'CALLS') AND list_has_any(rels, ['WRITES', 'MUTATES']) THEN 'MAY_MUTATE' WHEN list_contains(rels, 'CALLS') AND list_contains(rels, 'READS') THEN 'MAY_READ' END"


@add("q_closure_from_paths", f"""{_PATHS_SQL}, d AS (SELECT *, {_DERIVED_SQL} AS relation FROM paths)
SELECT source, relation, target, list_aggregate(ids, 'string_agg', '|') AS provenance, CASE WHEN list_has_any(exs, ['static_heuristic', 'inferred']) THEN 'inferred' ELSE 'derived_from_verified_edges' END AS exactness, list_min(confs) AS confidence
FROM d WHERE relation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY round(cost, 6), depth, keys) = 1""")
def closure_from_paths(spark, sf_dir):
    return Q.closure(_paths(spark, sf_dir))


_RANK = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in expr.EXACTNESS_RANK.items()) + " END"


@add("q_path_evidence", f"""{_PATHS_SQL}, x AS (SELECT source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, list_aggregate(rels, 'string_agg', '->') AS metapath, uncertainty, list_min(confs) AS conf,
  list_max(list_transform(exs, lambda x, i: {{'r': {_RANK}, 'i': i, 'x': x}})).x AS exactness,
  list_distinct(list_transform(files, lambda f: CASE WHEN f LIKE '%/tests/%' THEN 'test' ELSE 'production' END)) AS ctx FROM paths)
SELECT source, target, edge_ids, metapath, exactness, round(least(greatest(conf / (1 + uncertainty), 0), 1), 6) AS confidence, CASE WHEN len(ctx) > 1 THEN 'mixed' ELSE ctx[1] END AS context FROM x""")
def path_evidence(spark, sf_dir):
    return Q.path_labels(_paths(spark, sf_dir)).select("source", "target", F.array_join(F.col("steps.id"), "|").alias("edge_ids"), "metapath", "exactness", "confidence", "context")


_WEIGHTS = {"graph_distance": 1.5, "path_length": 0.75, "relation_signature": 1.0, "type_validity": 0.5, "edge_confidence": 1.25, "test_failure_link": 0.8, "security_relation_presence": 0.6}
_PRIOR_SQL = "CASE r " + " ".join(f"WHEN '{n}' THEN {p}" for p, names in expr.RELATION_PRIOR.items() for n in names.split()) + " ELSE 0.68 END"


@add("q_bayes_score", f"""{_PATHS_SQL}, f AS (SELECT *, least(greatest(list_avg(list_transform(rels, lambda r: ({_PRIOR_SQL})::DOUBLE)), 0.001), 0.999) AS prior, least(greatest(list_min(confs) / (1 + uncertainty), 0), 1) AS conf FROM paths),
z AS (SELECT *, -3.25 + ln(prior / (1 - prior)) - 1.75 * (uncertainty + (1 - conf) + (1 - prior)) + 1.5 / (1 + cost) + 0.75 / (1 + len(ids)) + prior + 0.5 + 1.25 * conf AS z FROM f)
SELECT source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, round(z, 6)::DOUBLE AS logit, round(1 / (1 + exp(-z)), 6)::DOUBLE AS probability FROM z""")
def bayes_score(spark, sf_dir):
    return Q.score_paths(_paths(spark, sf_dir), _WEIGHTS).select("source", "target", F.array_join(F.col("steps.id"), "|").alias("edge_ids"), "logit", "probability")


@add("q_risks", f"""{_PATHS_SQL} SELECT DISTINCT 'Changing ' || source || ' may mutate ' || target AS risk FROM paths WHERE list_has_any(rels, ['WRITES', 'MUTATES']) ORDER BY 1 LIMIT 12""")
def risks(spark, sf_dir):
    from ..operators.packet import risks as rule

    return rule(_paths(spark, sf_dir))


@add("q_explain_missing", f"""{WITH}, asked AS (SELECT 'c:' || c_custkey AS head, CASE c_custkey % 4 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'READS' WHEN 2 THEN 'TELEPORTS' ELSE 'CALLS' END AS relation, CASE WHEN c_custkey % 5 = 0 THEN 'x:0' ELSE 'o:1' END AS tail FROM customer)
SELECT head, relation, tail, CASE WHEN head NOT IN (SELECT id FROM entities) OR tail NOT IN (SELECT id FROM entities) THEN 'symbol_not_found' WHEN relation NOT IN ('CALLS', 'READS', 'WRITES') THEN 'relation_unsupported'
  WHEN EXISTS (SELECT 1 FROM edges e WHERE e.head_id = head AND e.relation = asked.relation AND e.tail_id = tail) THEN 'found'
  WHEN NOT EXISTS (SELECT 1 FROM edges e WHERE e.head_id = head AND e.relation = asked.relation) THEN 'no_relation_from_source' ELSE 'exceeds_bound_or_absent' END AS reason FROM asked""")
def explain_missing(spark, sf_dir):
    k = F.col("c_custkey")
    asked = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), k).alias("head"), F.when(k % 4 == 1, "READS").when(k % 4 == 2, "TELEPORTS").otherwise("CALLS").alias("relation"), F.when(k % 5 == 0, "x:0").otherwise("o:1").alias("tail"))
    return Q.explain_missing(P.edges(spark, sf_dir), P.entities(spark, sf_dir), asked, ["CALLS", "READS", "WRITES"])
