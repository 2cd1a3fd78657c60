"""Reduction of module records to edges between files, and the SQL of each."""

from __future__ import annotations

from ..operators import intervals as I
from ..operators import reduction as R
from ..sources import modules as M

QUERIES, ORACLES = {}, {}


def add(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_quoted = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_RESOLVED = f"""WITH RECURSIVE {M.SQL},
dec AS (SELECT path AS module, name, min(id) AS id FROM ent WHERE kind IN {_quoted(R.IMPORTABLE)} GROUP BY ALL),
walk AS (
  SELECT DISTINCT module AS m0, name AS n0, module, name, 0 AS depth, []::INT[] AS way FROM imp
  UNION ALL SELECT m0, n0, re.target, coalesce(re.imported, w.name), depth + 1, list_concat(way, [star, seq]) FROM walk w JOIN re ON re.module = w.module AND (exported IS NULL OR exported = w.name) LEFT JOIN dec ON dec.module = w.module AND dec.name = w.name WHERE dec.id IS NULL AND depth < {R.DEPTH}
), res AS (SELECT m0 AS module, n0 AS name, arg_min(dec.id, way) AS id FROM walk w JOIN dec ON dec.module = w.module AND dec.name = w.name GROUP BY m0, n0),
tgt AS (SELECT imp.*, res.id AS target_id FROM imp JOIN res ON res.module = imp.module AND res.name = imp.name)"""
_SCOPED = f"""{_RESOLVED},
scp AS (SELECT call_id, arg_min(x.id, (x.e - x.b, x.id)) AS scope_id FROM cal JOIN ent x ON x.path = cal.file AND x.kind IN {_quoted(R.EXECUTABLE)} AND x.b <= cal.b AND x.e >= cal.e GROUP BY call_id),
sca AS (SELECT cal.*, scp.scope_id, x.b AS sb, x.e AS se FROM cal LEFT JOIN scp ON scp.call_id = cal.call_id LEFT JOIN ent x ON x.id = scp.scope_id),
use AS (SELECT s.*, t.import_id, t.target_id FROM sca s JOIN tgt t ON t.file = s.file AND t.local = s.name
  WHERE NOT EXISTS (SELECT 1 FROM ent d WHERE d.path = s.file AND d.name = s.name AND d.kind IN {_quoted(R.SHADOWING)} AND d.b > t.line AND (d.b <= s.b AND d.e >= s.e OR s.sb <= d.b AND s.se >= d.e)))"""

add("q_import_targets", f"{_RESOLVED} SELECT import_id, target_id FROM tgt")(
    lambda s, d: R.import_targets(M.imports(s, d), R.exported_names(M.entities(s, d)), M.reexports(s, d)).select("import_id", "target_id")
)
add("q_containing_executable", f"{_SCOPED} SELECT file, call_id, scope_id FROM sca WHERE scope_id IS NOT NULL")(
    lambda s, d: R.scoped_calls(M.calls(s, d), M.entities(s, d)).where("scope_id is not null").select("file", "call_id", "scope_id")
)
add("q_enclosing_functions", """WITH """ + M.SQL.strip() + """, f AS (SELECT * FROM ent WHERE kind IN ('Function', 'Method', 'TestCase'))
SELECT a.path AS file, a.id AS inner_id, arg_min(b.id, (b.e - b.b, b.id)) AS outer_id FROM f a JOIN f b ON a.path = b.path AND a.id <> b.id AND b.b <= a.b AND b.e >= a.e GROUP BY 1, 2""")(
    lambda s, d: (lambda f: I.innermost(f, f))(M.entities(s, d).where("kind in ('Function', 'Method', 'TestCase')").withColumnRenamed("path", "file"))
)
add("q_unshadowed_calls", f"{_SCOPED} SELECT DISTINCT call_id, target_id FROM use")(
    lambda s, d: R.unshadowed(R.scoped_calls(M.calls(s, d), M.entities(s, d)), R.import_targets(M.imports(s, d), R.exported_names(M.entities(s, d)), M.reexports(s, d)), M.entities(s, d)).select("call_id", "target_id").distinct()
)
add("q_import_edges", f"""{_SCOPED} SELECT target_id AS head_id, 'ALIASED_BY' AS relation, import_id AS tail_id, file, line FROM tgt
UNION SELECT x.id, 'IMPORTS', target_id, file, line FROM tgt JOIN ent x ON x.path = tgt.file AND x.kind = 'File' UNION SELECT scope_id, 'CALLS', target_id, file, b FROM use WHERE scope_id IS NOT NULL""")(
    lambda s, d: R.import_edges(M.imports(s, d), M.calls(s, d), M.entities(s, d), M.reexports(s, d))
)
_ROOTS = """roo AS (SELECT file, name, name AS cur, [name] AS seen FROM asg UNION ALL SELECT r.file, r.name, a.source, list_append(seen, a.source) FROM roo r JOIN asg a ON a.file = r.file AND a.name = r.cur JOIN asg b ON b.file = r.file AND b.name = a.source WHERE NOT list_contains(seen, a.source)),
rts AS (SELECT r.file, r.name, r.cur AS root FROM roo r JOIN asg a ON a.file = r.file AND a.name = r.cur WHERE a.source IS NULL OR NOT EXISTS (SELECT 1 FROM asg b WHERE b.file = r.file AND b.name = a.source))"""
add("q_assignment_roots", f"WITH RECURSIVE {M.SQL}, {_ROOTS} SELECT file, name, root FROM rts")(lambda s, d: R.assignment_roots(M.assignments(s, d)))
add("q_local_call_flows", f"WITH RECURSIVE {M.SQL}, {_ROOTS} SELECT DISTINCT 'variable:' || c.file || '#' || root AS head_id, 'FLOWS_TO' AS relation, x.id AS tail_id, c.file, c.b AS line FROM cal c JOIN rts ON rts.file = c.file AND rts.name = c.argument JOIN ent x ON x.path = c.file AND x.name = c.name AND x.kind IN ('Function', 'Method')")(
    lambda s, d: R.call_flows(M.calls(s, d), M.entities(s, d), M.assignments(s, d))
)
_low = "lower(name)"
add("q_security_edges", f"""{_SCOPED}, {_ROOTS},
chk AS (SELECT * FROM sca WHERE name IN {_quoted(R.ROLE_CHECKS)} AND literal IS NOT NULL), fun AS (SELECT * FROM ent WHERE kind IN ('Function', 'Method')),
hel AS (SELECT f.id, any_value(f.name) AS name, arg_min(literal, (CASE c.name WHEN 'requireRole' THEN 1 ELSE 2 END, c.b, call_id)) AS role FROM chk c JOIN fun f ON f.path = c.file AND f.b <= c.b AND f.e >= c.e GROUP BY f.id),
age AS (SELECT id, 'middleware:' || id AS agent FROM hel WHERE {_low} LIKE 'require%' OR {_low} LIKE '%middleware' OR contains({_low}, 'guard') OR contains({_low}, 'auth')),
san AS (SELECT id FROM fun WHERE contains({_low}, 'sanitize') OR {_low} LIKE 'escape%' OR contains({_low}, 'cleanhtml') OR {_low} = 'xss'),
gua AS (SELECT r.*, coalesce((SELECT min(target_id) FROM tgt WHERE tgt.file = r.file AND tgt.local = r.guard), (SELECT min(id) FROM fun WHERE fun.path = r.file AND fun.name = r.guard)) AS meant FROM rou r)
SELECT coalesce(agent, scope_id) AS head_id, 'CHECKS_ROLE' AS relation, 'role:' || literal AS tail_id, file, b AS line FROM chk LEFT JOIN age ON age.id = scope_id WHERE scope_id IS NOT NULL
UNION SELECT scope_id, 'CHECKS_ROLE', 'role:' || role, file, b FROM use JOIN hel ON hel.id = target_id WHERE scope_id IS NOT NULL
UNION SELECT 'sanitizer:' || target_id, 'SANITIZES', CASE WHEN contains(argument, '.') THEN 'property:' || u.file || '#' || argument ELSE 'variable:' || u.file || '#' || root END, u.file, b FROM use u JOIN san ON san.id = target_id LEFT JOIN rts ON rts.file = u.file AND rts.name = argument WHERE argument IS NOT NULL AND (contains(argument, '.') OR root IS NOT NULL)
UNION SELECT route_id, 'EXPOSES', 'endpoint:' || method || ' ' || path, file, line FROM rou
UNION SELECT route_id, 'AUTHORIZES', agent, file, line FROM gua JOIN age ON age.id = meant""")(
    lambda s, d: R.security_edges(M.calls(s, d), M.imports(s, d), M.entities(s, d), M.reexports(s, d), M.routes(s, d), M.assignments(s, d))
)
add("q_test_edges", f"""{_RESOLVED}, tca AS (SELECT * FROM ent WHERE kind = 'TestCase'), fst AS (SELECT path AS file, arg_min(id, (b, id)) AS id FROM tca GROUP BY path),
ass AS (SELECT c.*, t.target_id, (SELECT arg_min(x.id, (x.e - x.b, x.id)) FROM tca x WHERE x.path = c.file AND x.b <= c.b AND x.e >= c.e) AS own FROM cal c JOIN tgt t ON t.file = c.file AND t.local = c.name)
SELECT coalesce(own, f.id) AS head_id, 'ASSERTS' AS relation, target_id AS tail_id, a.file, b AS line FROM ass a JOIN fst f ON f.file = a.file
UNION SELECT f.id, 'MOCKS', dec.id, m.file, line FROM moc m JOIN dec ON dec.module = m.module AND dec.name = m.name JOIN fst f ON f.file = m.file
UNION SELECT 'mock:' || m.file || '#' || m.name, 'STUBS', dec.id, m.file, line FROM moc m JOIN dec ON dec.module = m.module AND dec.name = m.name JOIN fst f ON f.file = m.file""")(
    lambda s, d: R.test_edges(M.calls(s, d), M.mocks(s, d), M.imports(s, d), M.entities(s, d), M.reexports(s, d))
)
