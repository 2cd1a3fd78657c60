"""Spans, imports, shadowing, roles, tests and flows against plain references on small records."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import intervals
from weftgraph.operators import reduction as R

SPAN = "file string, id string, start long, `end` long"
ENTITY = "id string, kind string, name string, path string, start long, `end` long"
IMPORT = "import_id string, file string, local string, module string, name string, start long, `end` long"
CALL = "call_id string, file string, name string, literal string, argument string, start long, `end` long"
EXPORT = "module string, exported string, target string, imported string, seq int"
ASSIGNED = "file string, name string, line long, source string"


def _innermost(inner, outer):
    out = {}
    for f, i, s, e in inner:
        around = [(b - a, o) for g, o, a, b in outer if g == f and o != i and a <= s and b >= e]
        if around:
            out[f, i] = min(around)[1]
    return out


@pytest.mark.parametrize("section", [200_000, 7])  # whole files, and sections of a few spans
@pytest.mark.parametrize("nested", [True, False])
def test_innermost_equals_brute_force(spark, monkeypatch, section, nested):
    monkeypatch.setattr(intervals, "SECTION", section)
    rnd, spans = random.Random(9), []
    for f in ("a", "b"):
        def split(lo, hi, depth):
            if hi - lo > 2 and depth < 6:
                spans.append((f, f"{f}{len(spans):03d}", lo, hi))
                mid = rnd.randrange(lo + 1, hi)
                split(lo + rnd.randrange(2), mid, depth + 1)
                split(mid + 1, hi, depth + 1)

        if nested:
            split(1, 200, 0)
        else:
            spans += [(f, f"{f}{k:03d}", *sorted((rnd.randrange(1, 60), rnd.randrange(1, 60)))) for k in range(60)]
    spans += [("a", "twin", *spans[3][2:]), ("a", "twin2", *spans[3][2:])]
    inner = [("a", f"i{k}", *sorted((rnd.randrange(1, 60), rnd.randrange(1, 60)))) for k in range(80)] + spans
    bad = [(None, "x", 1, 2), ("a", "y", None, 2), ("a", "z", 9, 3)]
    df = lambda rows: spark.createDataFrame(rows, SPAN).withColumn("first", F.lit("clash"))
    got = [((r["file"], r["inner_id"]), r["outer_id"]) for r in intervals.innermost(df(inner + bad), df(spans + bad)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _innermost(inner, spans)
    pairs = Counter(map(tuple, intervals.covering(df(inner + bad), df(spans + bad)).collect()))
    assert pairs == Counter((f, i, o) for f, i, s, e in inner for g, o, a, b in spans if f == g and i != o and a <= s and b >= e)
    assert intervals.innermost(df(inner).limit(0), df(spans)).collect() == []


def _resolve(module, name, declared, exports, depth=0):
    """The first declaration that a depth-first walk of the re-exports meets."""
    if depth > R.DEPTH:
        return None
    if (module, name) in declared:
        return declared[module, name]
    for exported, target, imported, _ in sorted((e[1:] for e in exports if e[0] == module), key=lambda e: (e[0] is None, e[3])):
        if exported == name or exported is None and name != "default":
            found = _resolve(target, imported if exported else name, declared, exports, depth + 1)
            if found:
                return found
    return None


def test_reexports_over_chains_cycles_and_ambiguous_names(spark):
    chain = [(f"m{k}", "x", f"m{k + 1}", "x", 1) for k in range(12)]
    exports = chain + [("a", "n", "b", "n", 1), ("b", "n", "a", "n", 1), ("b", "n", "c", "k", 2), ("s", None, "c", None, 2), ("s", None, "d", None, 1), ("s", "own", "c", "k", 9), ("d", None, "s", None, 1), ("r", "default", "c", "k", 1), ("q", None, "r", None, 1)]
    declared = {("m8", "x"): "at8", ("c", "k"): "k", ("d", "k"): "dk", ("c", "z"): "z"}
    rnd = random.Random(1)
    exports += [(f"g{rnd.randrange(12)}", rnd.choice(["u", "v", None]), f"g{rnd.randrange(12)}", rnd.choice(["u", "v"]), k) for k in range(60)]
    declared |= {(f"g{k}", rnd.choice("uv")): f"g{k}" for k in (0, 5)}
    wanted = [(m, n) for m in [f"m{k}" for k in range(13)] + list("abcdsrq") + [f"g{k}" for k in range(12)] for n in ("x", "n", "k", "z", "own", "u", "v", "default")]
    got = R.resolve_exports(spark.createDataFrame(wanted, "module string, name string"), spark.createDataFrame([(*k, v) for k, v in declared.items()], "module string, name string, id string"), spark.createDataFrame(exports, EXPORT))
    want = {(m, n): f for m, n in wanted if (f := _resolve(m, n, declared, exports))}
    assert {(r["module"], r["name"]): r["id"] for r in got.collect()} == want
    assert want["m0", "x"] == "at8" and ("s", "k") in want and want["s", "k"] == "dk" and ("q", "default") not in want
    none = spark.createDataFrame([], EXPORT)
    assert R.resolve_exports(spark.createDataFrame([("c", "k"), ("c", None)], "module string, name string"), spark.createDataFrame([("c", "k", "1")], "module string, name string, id string"), none).count() == 1


@pytest.fixture(scope="module")
def code(spark):
    """Two libraries and files that use them, shadow them, mock and guard them."""
    entities = [
        ("lib", "File", "lib", "lib.ts", 1, 90), ("app", "File", "app", "app.ts", 1, 90), ("pay", "Function", "pay", "lib.ts", 1, 9), ("pay2", "Function", "pay", "lib.ts", 20, 29), ("exp", "Export", "export default main", "lib.ts", 40, 40), ("main", "Function", "main", "lib.ts", 30, 39),
        ("requireStaff", "Function", "requireStaff", "lib.ts", 50, 59), ("sanitizeName", "Function", "sanitizeName", "lib.ts", 60, 69),
        ("outer", "Function", "outer", "app.ts", 10, 40), ("inner", "Method", "inner", "app.ts", 20, 30), ("var", "LocalVariable", "pay", "app.ts", 22, 22), ("late", "Function", "late", "app.ts", 50, 60),
        ("t1", "TestCase", "t1", "app.test.ts", 5, 9), ("t2", "TestCase", "t2", "app.test.ts", 12, 19), ("t2in", "TestCase", "t2in", "app.test.ts", 14, 16),
    ]
    imports = [("i1", "app.ts", "pay", "lib.ts", "pay", 1, 1), ("i2", "app.ts", "run", "lib.ts", "default", 2, 2), ("i3", "app.ts", "gone", "lib.ts", "nothing", 3, 3), ("i4", "app.ts", "guard", "lib.ts", "requireStaff", 4, 4), ("i5", "app.ts", "clean", "lib.ts", "sanitizeName", 5, 5), ("i6", "app.test.ts", "pay", "lib.ts", "pay", 1, 1)]
    calls = [
        ("c1", "app.ts", "pay", None, None, 12, 12), ("c2", "app.ts", "pay", None, None, 25, 25), ("c3", "app.ts", "run", None, "v", 25, 25), ("c4", "app.ts", "pay", None, None, 70, 70), ("c5", "app.ts", "pay", None, None, 55, 55), ("c6", "lib.ts", "checkRole", "admin", None, 52, 52),
        ("c7", "lib.ts", "requireRole", "staff", None, 55, 55), ("c8", "app.ts", "guard", None, None, 15, 15), ("c9", "app.ts", "clean", None, "req.body.name", 15, 15), ("c10", "app.ts", "clean", None, "v", 16, 16), ("c11", "app.ts", "clean", None, "loop", 17, 17), ("c12", "app.ts", "late", None, "v", 18, 18), ("c13", "app.ts", "requireRole", "root", None, 26, 26),
    ]
    assigned = [("app.ts", "v", 3, "w"), ("app.ts", "w", 2, "req"), ("app.ts", "loop", 1, "loop2"), ("app.ts", "loop2", 2, "loop"), ("app.ts", "x", 1, "v"), ("app.ts", "x", 2, None), ("app.ts", "y", 5, "loop")]
    return {"entities": spark.createDataFrame(entities, ENTITY), "imports": spark.createDataFrame(imports, IMPORT), "calls": spark.createDataFrame(calls, CALL), "exports": spark.createDataFrame([], EXPORT), "assigned": spark.createDataFrame(assigned, ASSIGNED)}


def _facts(df):
    assert df.columns == ["head_id", "relation", "tail_id", "file", "line"]
    return {(r["head_id"], r["relation"], r["tail_id"], r["line"]) for r in df.collect()}


def test_import_edges_without_shadowed_calls(code):
    got = _facts(R.import_edges(code["imports"], code["calls"], code["entities"], code["exports"]))
    assert {g for g in got if g[1] == "CALLS"} == {("late", "CALLS", "pay", 55), ("inner", "CALLS", "main", 25), ("outer", "CALLS", "requireStaff", 15), ("outer", "CALLS", "sanitizeName", 15), ("outer", "CALLS", "sanitizeName", 16), ("outer", "CALLS", "sanitizeName", 17)}  # pay is taken over in outer and inner
    assert {g for g in got if g[1] == "IMPORTS"} == {("app", "IMPORTS", "pay", 1), ("app", "IMPORTS", "main", 2), ("app", "IMPORTS", "requireStaff", 4), ("app", "IMPORTS", "sanitizeName", 5)}
    assert {g[2] for g in got if g[1] == "ALIASED_BY"} == {"i1", "i2", "i4", "i5", "i6"}
    none = {k: v.limit(0) for k, v in code.items()}
    assert R.import_edges(none["imports"], none["calls"], none["entities"], none["exports"]).collect() == []


def test_roles_sanitizers_and_routes(spark, code):
    routes = spark.createDataFrame([("r1", "app.ts", "GET", "/a", "guard", 80), ("r2", "app.ts", "POST", "/b", "late", 81), ("r3", "app.ts", "GET", "/c", None, 82)], "route_id string, file string, method string, path string, guard string, line long")
    got = _facts(R.security_edges(code["calls"], code["imports"], code["entities"], code["exports"], routes, code["assigned"]))
    assert {g for g in got if g[1] == "CHECKS_ROLE"} == {("middleware:requireStaff", "CHECKS_ROLE", "role:admin", 52), ("middleware:requireStaff", "CHECKS_ROLE", "role:staff", 55), ("outer", "CHECKS_ROLE", "role:staff", 15), ("inner", "CHECKS_ROLE", "role:root", 26)}  # requireRole comes before checkRole
    assert {g for g in got if g[1] == "SANITIZES"} == {("sanitizer:sanitizeName", "SANITIZES", "property:app.ts#req.body.name", 15), ("sanitizer:sanitizeName", "SANITIZES", "variable:app.ts#w", 16)}
    assert {g for g in got if g[1] == "EXPOSES"} == {("r1", "EXPOSES", "endpoint:GET /a", 80), ("r2", "EXPOSES", "endpoint:POST /b", 81), ("r3", "EXPOSES", "endpoint:GET /c", 82)}
    assert {g for g in got if g[1] == "AUTHORIZES"} == {("r1", "AUTHORIZES", "middleware:requireStaff", 80)}


def test_assertions_mocks_and_flows(spark, code):
    asserted = spark.createDataFrame([("a1", "app.test.ts", "pay", None, None, 15, 15), ("a2", "app.test.ts", "pay", None, None, 30, 30), ("a3", "app.test.ts", "other", None, None, 15, 15)], CALL)
    mocks = spark.createDataFrame([("app.test.ts", "lib.ts", "main", 2), ("app.ts", "lib.ts", "main", 3), ("app.test.ts", "lib.ts", "absent", 4)], "file string, module string, name string, line long")
    got = _facts(R.test_edges(asserted, mocks, code["imports"], code["entities"], code["exports"]))
    assert got == {("t2in", "ASSERTS", "pay", 15), ("t1", "ASSERTS", "pay", 30), ("t1", "MOCKS", "main", 2), ("mock:app.test.ts#main", "STUBS", "main", 2)}
    assert {(r["name"], r["root"]) for r in R.assignment_roots(code["assigned"]).collect()} == {("v", "w"), ("w", "w"), ("x", "x")}
    assert _facts(R.call_flows(code["calls"], code["entities"], code["assigned"])) == {("variable:app.ts#w", "FLOWS_TO", "late", 18)}


def test_long_assignment_chains_end(spark):
    rows = [("f", f"v{k}", k, f"v{k + 1}") for k in range(300)] + [("g", f"v{k}", k, f"v{(k + 1) % 50}") for k in range(50)]
    got = R.assignment_roots(spark.createDataFrame(rows, ASSIGNED)).collect()
    assert {(r["file"], r["root"]) for r in got} == {("f", "v299")} and len(got) == 300


def test_calls_meet_their_scopes_in_one_join(code):
    plan = R.scoped_calls(code["calls"], code["entities"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2, plan  # of calls with scopes, and of spans with the few long files
    targets = R.import_targets(code["imports"], R.exported_names(code["entities"]), code["exports"])
    kept = R.unshadowed(R.scoped_calls(code["calls"], code["entities"]), targets, code["entities"])
    assert "LeftAnti" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["call_id"], r["scope_id"]) for r in kept.where("name = 'pay'").collect()} == {("c4", None), ("c5", "late")}
