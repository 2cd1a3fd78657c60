"""The retrieval funnel over the projected graph, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import funnel as R
from ..operators import queries as Q
from ..operators import traverse as T
from ..sources import projection as P
from ..sources import store
from .graph_queries import _PRIOR_SQL, _with
from .ingest_queries import signature_sql

QUERIES, ORACLES = {}, {}
#: how the projection plays relations that it has no edges for
_ROLES = {"FLOWS_TO": "PUBLISHES", "READS": "CONSUMES"}
_TASKS = [("a", "why does test('order33') fail when the supplier writes to a building customer"), ("b", "who calls test('order34') and test('order3'), and which part prices may change"), ("c", "repository of africa, package nation")]
FUNNEL = R.Funnel(stage1=24, stage2=6, limits=T.Limits(3, 12, 600), budget=500, max_paths=30)


def funnel(s, d):
    """(trace, paths, packet) of three prompts; documents are the entities' names and kinds."""
    entities = P.entities(s, d)
    documents = store.once(s, d, "signatures", lambda: R.signatures(entities.select("id", F.concat_ws(" ", "kind", "name", "qualified_name").alias("text"))))
    tasks = s.createDataFrame(_TASKS, "task string, prompt string")
    return store.once(s, d, "funnel", lambda: R.run(tasks, documents, Q.relabel(store.steps(s, d), _ROLES), entities, FUNNEL))


def _sql(last: str) -> str:
    tasks = " UNION ALL ".join(f"SELECT '{t}' AS task, '{p.replace(chr(39), chr(39) * 2)}' AS prompt" for t, p in _TASKS)
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: f"list_distinct(list_filter(regexp_split_to_array({low(c)}, '[^a-z0-9_.]+'), lambda x: x <> ''))"
    named = " UNION ".join(f"SELECT task, unnest(regexp_extract_all(prompt, '{p}', 1)) AS value FROM tasks" for p in (r"test\(''([^'']*)''\)", r"([a-z]+[A-Z][A-Za-z0-9]*)", r"([A-Z][A-Za-z]*Error)", r"([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)+)\(", r"at ([A-Za-z_][A-Za-z0-9_.]*) \("))
    unit = lambda x: f"least(greatest({x}, 0), 1)"
    starts, limits = "SELECT DISTINCT id AS source FROM second", FUNNEL.limits
    cols = "source, target, ids, rels, keys, exs, confs, cost, uncertainty, depth"
    each = "".join(f", {n}_ AS (WITH RECURSIVE {T.paths_sql(starts, list(q.forward), list(q.reverse), limits, q.accept_sql(), q.shortest)} SELECT {cols} FROM paths)" for n, q in Q.QUERIES.items())
    each += f", event_flow_ AS (WITH RECURSIVE {Q.event_flow_sql(starts, limits)} SELECT {cols} FROM paths)"
    has = lambda *names: "list_has_any(rels, [" + ", ".join(f"'{n}'" for n in names) + "])"
    w = FUNNEL.weights
    z = f"-3.25 + ln(prior / (1 - prior)) - 1.75 * (uncertainty + (1 - conf) + (1 - prior)) + {w['graph_distance']} / (1 + cost) + {w['path_length']} / (1 + len(ids)) + {w['relation_signature']} * prior + {w['type_validity']} + {w['edge_confidence']} * conf + CASE WHEN {has(*expr.TEST_RELATIONS)} THEN {w['test_failure_link']} ELSE 0 END + CASE WHEN {has(*expr.SECURITY_RELATIONS)} THEN {w['security_relation_presence']} ELSE 0 END"
    risks = [
        (has("WRITES", "MUTATES"), "'Changing ' || source || ' may mutate ' || target"), (has("AUTHORIZES", "CHECKS_ROLE", "CHECKS_PERMISSION"), "source || ' participates in an auth/security path'"), (has("PUBLISHES", "EMITS", "CONSUMES", "LISTENS_TO"), "source || ' participates in an async/event flow'"),
        (has("MIGRATES", "ALTERS_COLUMN", "DEPENDS_ON_SCHEMA"), "source || ' has schema migration impact'"), (has("TESTS", "COVERS", "ASSERTS"), "source || ' has test coverage paths to review'"),
    ]
    said = " UNION ".join(f"SELECT task, {text} AS text FROM scored WHERE {cond}" for cond, text in risks)
    return f"""{_with(_ROLES)}, tasks AS ({tasks}),
{signature_sql("SELECT id, concat_ws(' ', kind, name, qualified_name) AS text FROM entities UNION ALL SELECT 'task:' || task, prompt FROM tasks")},
seeds AS (SELECT DISTINCT task, e.id FROM ({named}) v JOIN entities e ON e.name = v.value OR e.qualified_name = v.value),
near AS (SELECT t.task, d.id, d.text, p.text AS prompt, list_sum(list_transform(range(1, 5), lambda i: bit_count(xor(d.signature[i], p.signature[i]))))::INT AS hamming FROM tasks t JOIN signed p ON p.id = 'task:' || t.task, signed d WHERE d.id NOT LIKE 'task:%'),
first_ AS (SELECT n.*, s.id IS NOT NULL AS seed FROM near n LEFT JOIN seeds s ON s.task = n.task AND s.id = n.id QUALIFY row_number() OVER (PARTITION BY n.task ORDER BY hamming, n.id) <= {FUNNEL.stage1} OR seed),
rank_ AS (SELECT *, round(0.35 * {unit(f"len(list_intersect({words('prompt')}, {words('text')})) / len({words('prompt')})")} + 0.35 * {unit("(256 - 2 * hamming) / 256")} + 0.20 * {unit("(256 - 2 * hamming) / 512 + 0.5")} + CASE WHEN seed THEN 10 ELSE 0 END, 6) AS score FROM first_),
second AS (SELECT * FROM rank_ QUALIFY row_number() OVER (PARTITION BY task ORDER BY score DESC, id) <= {FUNNEL.stage2} OR seed)
{each}, found AS ({" UNION ALL ".join(f"SELECT * FROM {n}_" for n in [*Q.QUERIES, "event_flow"])}),
uniq AS (SELECT task, f.* FROM found f JOIN second ON second.id = f.source QUALIFY row_number() OVER (PARTITION BY task, ids ORDER BY round(cost, 6), source, target) = 1),
feat AS (SELECT *, least(greatest(list_avg(list_transform(rels, lambda r: ({_PRIOR_SQL})::DOUBLE)), 0.001), 0.999) AS prior, least(greatest(list_min(confs) / (1 + uncertainty), 0), 1) AS conf FROM uniq),
scored AS (SELECT *, round(1 / (1 + exp(-({z}))), 6)::DOUBLE AS probability, row_number() OVER (PARTITION BY task ORDER BY round(1 / (1 + exp(-({z}))), 6) DESC, round(uncertainty, 6), round(cost, 6), target, keys) AS place FROM feat QUALIFY place <= {FUNNEL.max_paths}),
risk AS (SELECT task, text, row_number() OVER (PARTITION BY task ORDER BY text) - 1 AS pos FROM ({said}) QUALIFY pos < 12),
test AS (SELECT task, text, row_number() OVER (PARTITION BY task ORDER BY text) - 1 AS pos FROM (SELECT DISTINCT task, 'run tests covering ' || target AS text FROM scored WHERE {has(*expr.TEST_RELATIONS)}) QUALIFY pos < 12),
items AS (SELECT task, 'path' AS section, place - 1 AS pos, source || ' ' || list_aggregate(rels, 'string_agg', '->') || ' ' || target AS text, 1 AS o FROM scored UNION ALL SELECT task, 'risk', pos, text, 2 FROM risk UNION ALL SELECT task, 'test', pos, text, 3 FROM test)
{last}"""


_TRACE = f"""SELECT task, '{R.STAGES[0]}' AS stage, id, true AS kept FROM seeds UNION ALL SELECT task, '{R.STAGES[1]}', id, true FROM first_ UNION ALL SELECT task, '{R.STAGES[2]}', id, id IN (SELECT id FROM second s WHERE s.task = first_.task) FROM first_
UNION ALL SELECT task, '{R.STAGES[3]}', id, id IN (SELECT source FROM found) FROM second UNION ALL SELECT DISTINCT task, '{R.STAGES[4]}', source, true FROM scored"""
_PACKET = f"SELECT task, section, pos::INT AS pos, text FROM (SELECT *, sum(octet_length(encode(text))) OVER (PARTITION BY task ORDER BY CASE WHEN pos = 0 THEN 0 ELSE 1 END, o DESC, pos ROWS UNBOUNDED PRECEDING) AS upto FROM items) WHERE floor(upto / 4) <= {FUNNEL.budget}"
_PATHS = "SELECT task, source, target, list_aggregate(ids, 'string_agg', '|') AS edge_ids, list_aggregate(rels, 'string_agg', '->') AS relations, round(cost, 6) AS cost, probability, place::INT AS place FROM scored"
for _name, _at, _last in (("q_funnel_trace", 0, _TRACE), ("q_funnel_paths", 1, _PATHS), ("q_funnel_packet", 2, _PACKET)):
    QUERIES[_name] = lambda s, d, at=_at: funnel(s, d)[at]
    ORACLES[_name] = _sql(_last)
