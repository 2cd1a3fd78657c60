"""Reduction of what single files say to facts between files: imports, calls, roles, tests, flows.

Inputs are tables of records with a file in each (declarations, imports, re-exports, calls,
assignments), as a parser leaves them; nothing here reads source text. Names are resolved by
joins on (module, name) and fix-points over such pairs, never file by file in one process.
Spans are lines of one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr
from ..sources.shared import materialized
from .intervals import around, covering, innermost, outermost

#: re-exports that are followed from an import
DEPTH = 8
#: modules that are broadcast; more are joined by a shuffle
BROADCAST_MODULES = 50_000
# fixed values
IMPORTABLE = ("Function", "Method", "Class", "LocalVariable", "GlobalVariable", "Table")
EXECUTABLE = ("Function", "Method", "Constructor")
SHADOWING = ("Function", "Method", "Constructor", "Class", "LocalVariable", "GlobalVariable", "Parameter")
ROLE_CHECKS = ("requireRole", "checkRole")


def exported_names(entities: DataFrame) -> DataFrame:
    """(module, name, id): what a module declares for others; of one name the smallest id.

    entities (id, kind, name, path). The name default is an entity of that name (but no
    table), or else the first entity whose name is part of an Export's "export default ...".
    """
    own = entities.where(F.col("kind").isin(*IMPORTABLE)).select(F.col("path").alias("module"), "name", "kind", "id")
    named = own.where("name <> 'default' or kind <> 'Table'").groupBy("module", "name").agg(F.min("id").alias("id"))
    stated = entities.where((F.col("kind") == "Export") & expr.ascii_lower(F.col("name")).contains("export default")).select(F.col("path").alias("module"), F.col("name").alias("stated"), F.col("id").alias("export_id"))
    said = own.where("kind <> 'Table'").join(stated, "module").where(F.contains("stated", F.col("name"))).groupBy("module").agg(F.min_by("id", F.struct("export_id", "id")).alias("id"))
    said = said.join(named.where("name = 'default'").select("module"), "module", "left_anti")
    return named.unionByName(said.select("module", F.lit("default").alias("name"), "id"))


def _reachable(wanted: DataFrame, reexports: DataFrame, depth: int) -> DataFrame:
    """(module): the wanted modules and what their re-exports lead to within depth steps."""
    seen = front = materialized(wanted.select("module").where("module is not null").distinct(), "modules")
    for _ in range(depth):
        further = reexports.join(front, "module").select(F.col("target").alias("module")).where("module is not null").distinct()
        front = materialized(further.join(seen, "module", "left_anti"), "modules")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def resolve_exports(wanted: DataFrame, declared: DataFrame, reexports: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(module, name, id) of the wanted (module, name) pairs that lead to a declaration.

    declared (module, name, id), each pair once. reexports (module, exported, target, imported,
    seq): module offers exported, which is target's imported; a null exported stands for all
    names but default. A pair is what its module declares, or else what the first of its
    re-exports (named ones by seq, then those of all names) that leads somewhere within depth
    steps leads to. Cycles lead nowhere.

    Only what is said in modules that the wanted ones lead to is kept, written once for all rounds.
    The pairs that matter are found downward from the wanted ones, then answered upward, each
    round from the answers of the round before; both end early when nothing changes.
    """
    modules = _reachable(wanted, reexports, depth)
    small = F.broadcast if modules.count() <= BROADCAST_MODULES else (lambda df: df)
    declared = materialized(declared.select("module", "name", "id").join(small(modules), "module", "left_semi"), "declared")
    reexports = materialized(reexports.join(small(modules), "module", "left_semi"), "reexports")
    named = reexports.where("exported is not null").select("module", F.col("exported").alias("name"), "target", "imported", F.struct(F.lit(0).alias("star"), "seq").alias("seq"))
    stars = reexports.where("exported is null").select("module", "target", F.struct(F.lit(1).alias("star"), "seq").alias("seq"))
    seen = front = materialized(wanted.select("module", "name").where("module is not null and name is not null").distinct(), "wanted")
    links = None
    for _ in range(depth):
        open_ = front.join(declared.select("module", "name"), ["module", "name"], "left_anti")
        step = open_.join(named, ["module", "name"]).select("module", "name", "target", F.col("imported").alias("target_name"), "seq")
        step = step.unionByName(open_.where("name <> 'default'").join(stars, "module").select("module", "name", "target", F.col("name").alias("target_name"), "seq"))
        step = materialized(step, "links")
        links = step if links is None else links.unionByName(step)
        front = materialized(step.select(F.col("target").alias("module"), F.col("target_name").alias("name")).distinct().join(seen, ["module", "name"], "left_anti"), "front")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    own = materialized(declared.select("module", "name", "id").join(seen, ["module", "name"], "left_semi"), "own")
    known = own
    for _ in range(depth if links is not None else 0):
        answer = known.select(F.col("module").alias("target"), F.col("name").alias("target_name"), "id")
        led = links.join(answer, ["target", "target_name"]).groupBy("module", "name").agg(F.min_by("id", "seq").alias("id"))
        now = materialized(own.unionByName(led), "known")
        changed = now.join(known.withColumnRenamed("id", "was"), ["module", "name"], "left").where("was is null or was <> id").limit(1)
        known = now
        if not changed.take(1):  # an answer never goes away again
            break
    return known.join(wanted.select("module", "name").distinct(), ["module", "name"], "left_semi")


def import_targets(imports: DataFrame, declared: DataFrame, reexports: DataFrame) -> DataFrame:
    """imports (import_id, file, local, module, name, start, end) that resolve, with the target's id."""
    found = resolve_exports(imports.select("module", "name"), declared, reexports)
    return imports.join(found.withColumnRenamed("id", "target_id"), ["module", "name"])


def scoped_calls(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """calls (call_id, file, name, start, end, ...) with the innermost function around each, if
    there is one: scope_id, scope_start, scope_end. entities (id, kind, path, start, end)."""
    functions = entities.where(F.col("kind").isin(*EXECUTABLE)).select(F.col("path").alias("file"), "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    found = around(calls.select("file", F.col("call_id").alias("id"), "start", "end"), functions)
    calls = calls.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))
    scoped = calls.join(found, ["file", "start", "end"], "left").withColumn("scope", outermost("call_id"))
    return scoped.select(*calls.columns, F.col("scope.id").alias("scope_id"), F.col("scope.start").alias("scope_start"), F.col("scope.end").alias("scope_end"))


def unshadowed(calls: DataFrame, targets: DataFrame, entities: DataFrame) -> DataFrame:
    """Scoped calls of imported names that the import still means, with import_id and target_id.

    A declaration of the name in the file that starts after the import takes over if it covers
    the call, or if it lies in the call's scope (if there is one). Both are questions about one running
    extreme in order of start: the largest end so far, and, from behind, the smallest end. Calls
    and declarations are dealt by file, name and import for both.
    """
    of = targets.select("import_id", "file", F.col("local").alias("name"), F.col("end").alias("import_end"), "target_id")
    used = calls.join(of, ["file", "name"]).withColumn("called", F.lit(True)).withColumn("s", F.col("start"))
    declarations = entities.where(F.col("kind").isin(*SHADOWING)).select(F.col("path").alias("file"), "name", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("end"))
    rows = of.select("import_id", "file", "name", "import_end").distinct().join(declarations, ["file", "name"]).where("s > import_end").drop("import_end").withColumn("called", F.lit(False))
    both, called = used.unionByName(rows, allowMissingColumns=True), F.col("called")
    group = W.partitionBy("file", "name", "import_id")
    end = F.when(~called, F.col("end"))
    both = both.withColumn("covers", F.max(end).over(group.orderBy("s", called).rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("s", F.when(called, F.col("scope_start")).otherwise(F.col("s")))
    both = both.withColumn("inside", F.min(end).over(group.orderBy(F.desc_nulls_last("s"), called).rowsBetween(W.unboundedPreceding, 0)))
    over = (F.col("covers") >= F.col("end")) | F.col("scope_start").isNotNull() & (F.col("inside") <= F.col("scope_end"))
    return both.where(called & ~F.coalesce(over, F.lit(False))).drop("called", "s", "covers", "inside")


def import_edges(imports: DataFrame, calls: DataFrame, entities: DataFrame, reexports: DataFrame) -> DataFrame:
    """(head_id, relation, tail_id, file, line): ALIASED_BY, IMPORTS and CALLS edges of resolved imports.

    imports (import_id, file, local, module, name, start, end), module being a path already;
    calls (call_id, file, name, start, end); entities (id, kind, name, path, start, end), in
    which a file's own entity is of kind File; reexports as in ``resolve_exports``.

    Cases: an import that doesn't resolve gives no edge, nor a call outside all functions, nor
    a shadowed one; a file without an entity has no IMPORTS edge; two imports of one name give
    two sets of edges; ids, names and paths that are null match nothing; empty tables give no rows.
    """
    targets = materialized(import_targets(imports, exported_names(entities), reexports), "targets")
    files = entities.where("kind = 'File'").groupBy(F.col("path").alias("file")).agg(F.min("id").alias("file_id"))
    aliased = targets.select(F.col("target_id").alias("head_id"), F.lit("ALIASED_BY").alias("relation"), F.col("import_id").alias("tail_id"), "file", F.col("start").alias("line"))
    imported = targets.join(files, "file").select(F.col("file_id").alias("head_id"), F.lit("IMPORTS").alias("relation"), F.col("target_id").alias("tail_id"), "file", F.col("start").alias("line"))
    named = calls.join(targets.select("file", F.col("local").alias("name")).distinct(), ["file", "name"], "left_semi")
    called = unshadowed(scoped_calls(named, entities), targets, entities).where("scope_id is not null")
    called = called.select(F.col("scope_id").alias("head_id"), F.lit("CALLS").alias("relation"), F.col("target_id").alias("tail_id"), "file", F.col("start").alias("line"))
    return aliased.unionByName(imported).unionByName(called).distinct()


# ---- roles


def is_middleware(name: Column) -> Column:
    low = expr.ascii_lower(name)
    return low.startswith("require") | low.endswith("middleware") | low.contains("guard") | low.contains("authorize") | low.contains("auth")


def is_sanitizer(name: Column) -> Column:
    low = expr.ascii_lower(name)
    return low.contains("sanitize") | low.startswith("escape") | low.contains("cleanhtml") | (low == "xss")


def security_edges(calls: DataFrame, imports: DataFrame, entities: DataFrame, reexports: DataFrame, routes: DataFrame, assignments: DataFrame) -> DataFrame:
    """(head_id, relation, tail_id, file, line): role checks, sanitised values, exposed and guarded routes.

    calls (call_id, file, name, literal, argument, start, end): literal is the first string among a call's
    arguments, argument its only one; imports, entities, reexports as in ``import_edges``;
    routes (route_id, file, method, path, guard, line); assignments as in ``assignment_roots``.

    * requireRole and checkRole with a literal check role:<literal>, on behalf of the function
      around the call, or of its middleware:<id> if its name is a middleware's.
    * A function that has such a call is a role helper; calls of it from other files by an
      import that isn't shadowed check the role of its first call.
    * A call of an imported sanitizer sanitises its only argument: a property, or the root
      variable of a local one (in sanitizer:<id>, property:<file>#<text>, variable:<file>#<name>).
    * A route exposes endpoint:<method> <path>; its guard authorises it if that names, by import
      or in its own file, a role helper with a middleware.
    """
    scoped = materialized(scoped_calls(calls, entities), "scoped")
    functions = entities.where("kind in ('Function', 'Method')").select(F.col("id").alias("scope_id"), F.col("name").alias("scope_name"), F.col("path").alias("file"))
    checks = scoped.where(F.col("name").isin(*ROLE_CHECKS) & F.col("literal").isNotNull())
    # a helper is every function around a check, not the innermost only
    spans = entities.where("kind in ('Function', 'Method')").select(F.col("path").alias("file"), "id", "start", "end")
    around = covering(checks.select("file", F.col("call_id").alias("id"), "start", "end"), spans).select(F.col("inner_id").alias("call_id"), "outer_id")
    helpers = checks.join(around, "call_id").groupBy(F.col("outer_id").alias("helper_id")).agg(F.min_by("literal", F.struct(F.array_position(F.array(*map(F.lit, ROLE_CHECKS)), F.col("name")), "start", "call_id")).alias("role"))
    helpers = materialized(helpers.join(functions.select(F.col("scope_id").alias("helper_id"), F.col("scope_name").alias("helper")), "helper_id"), "helpers")
    agents = helpers.where(is_middleware(F.col("helper"))).select(F.col("helper_id").alias("scope_id"), F.concat(F.lit("middleware:"), "helper_id").alias("agent"))
    role = lambda c: F.concat(F.lit("role:"), c)
    row = lambda df, head, relation, tail, line="start": df.select(head.alias("head_id"), F.lit(relation).alias("relation"), tail.alias("tail_id"), "file", F.col(line).alias("line"))
    direct = row(checks.where("scope_id is not null").join(agents, "scope_id", "left"), F.coalesce("agent", "scope_id"), "CHECKS_ROLE", role(F.col("literal")))

    targets = materialized(import_targets(imports, exported_names(entities), reexports), "targets")
    used = materialized(unshadowed(scoped, targets, entities), "meant")
    helped = row(used.where("scope_id is not null").join(helpers, F.col("target_id") == F.col("helper_id")), F.col("scope_id"), "CHECKS_ROLE", role(F.col("role")))

    cleaners = functions.where(is_sanitizer(F.col("scope_name"))).select(F.col("scope_id").alias("target_id"))
    roots = assignment_roots(assignments).select("file", F.col("name").alias("argument"), "root")
    cleaned = used.where("argument is not null").join(cleaners, "target_id").join(roots, ["file", "argument"], "left")
    value = F.when(F.col("argument").contains("."), F.concat(F.lit("property:"), "file", F.lit("#"), "argument")).when(F.col("root").isNotNull(), F.concat(F.lit("variable:"), "file", F.lit("#"), "root"))
    cleaned = row(cleaned.withColumn("value", value).where("value is not null"), F.concat(F.lit("sanitizer:"), "target_id"), "SANITIZES", F.col("value"))

    exposed = row(routes, F.col("route_id"), "EXPOSES", F.concat(F.lit("endpoint:"), "method", F.lit(" "), "path"), "line")
    meant = targets.groupBy("file", F.col("local").alias("guard")).agg(F.min("target_id").alias("imported"))
    local = functions.groupBy("file", F.col("scope_name").alias("guard")).agg(F.min("scope_id").alias("local"))
    guarded = routes.where("guard is not null").join(meant, ["file", "guard"], "left").join(local, ["file", "guard"], "left").withColumn("scope_id", F.coalesce("imported", "local"))
    guarded = row(guarded.join(agents, "scope_id"), F.col("route_id"), "AUTHORIZES", F.col("agent"), "line")
    return direct.unionByName(helped).unionByName(cleaned).unionByName(exposed).unionByName(guarded).distinct()


# ---- tests


def test_edges(asserted: DataFrame, mocks: DataFrame, imports: DataFrame, entities: DataFrame, reexports: DataFrame) -> DataFrame:
    """(head_id, relation, tail_id, file, line): ASSERTS, MOCKS and STUBS edges of test files.

    asserted (call_id, file, name, start, end): calls within assertions; those of an import's
    name assert its target, on behalf of the innermost test case (entities of kind TestCase)
    around them, or of the file's first. mocks (file, module, name, line): a mocked export of
    a module is mocked by the file's first test case and stubbed by mock:<file>#<name>. A file
    without a test case gives nothing.
    """
    cases = entities.where("kind = 'TestCase'").select(F.col("path").alias("file"), "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    first = cases.groupBy("file").agg(F.min_by("id", F.struct("start", "id")).alias("first_case"))
    declared = exported_names(entities)
    targets = import_targets(imports, declared, reexports).select("file", F.col("local").alias("name"), "target_id")
    asserted = materialized(asserted.join(targets, ["file", "name"]), "asserted")
    within = innermost(asserted.select("file", F.col("call_id").alias("id"), "start", "end"), cases).select(F.col("inner_id").alias("call_id"), "outer_id")
    asserts = asserted.join(first, "file").join(within, "call_id", "left").select(F.coalesce("outer_id", "first_case").alias("head_id"), F.lit("ASSERTS").alias("relation"), F.col("target_id").alias("tail_id"), "file", F.col("start").alias("line"))
    mocked = mocks.join(declared, ["module", "name"]).join(first, "file")
    by_case = mocked.select(F.col("first_case").alias("head_id"), F.lit("MOCKS").alias("relation"), F.col("id").alias("tail_id"), "file", "line")
    stubs = mocked.select(F.concat(F.lit("mock:"), "file", F.lit("#"), "name").alias("head_id"), F.lit("STUBS").alias("relation"), F.col("id").alias("tail_id"), "file", "line")
    return asserts.unionByName(by_case).unionByName(stubs).distinct()


# ---- local flows


def assignment_roots(assignments: DataFrame) -> DataFrame:
    """(file, name, root): the variable that a variable's value comes from in the end.

    assignments (file, name, line, source): name is assigned from the variable source (null:
    from none); of several in a file the last line counts. A root is a variable whose source
    isn't assigned in the file. Variables that lead into a cycle have no root.

    Steps are doubled each round; once a round reaches no further root, the rest are cycles.
    """
    last = assignments.where("file is not null and name is not null").groupBy("file", "name").agg(F.max_by("source", F.struct("line", "source")).alias("source"))
    last = materialized(last, "assigned")
    known = last.select("file", F.col("name").alias("source"), F.lit(True).alias("known"))
    now = last.join(known, ["file", "source"], "left").select("file", "name", F.when(F.col("known"), F.col("source")).alias("next"))
    now = materialized(now.select("file", "name", F.coalesce("next", "name").alias("at"), F.col("next").isNull().alias("done")), "steps")
    left = now.where("not done").count()
    while left:
        step = now.select("file", F.col("name").alias("at"), F.col("at").alias("further"), F.col("done").alias("ends"))
        now = materialized(now.join(step, ["file", "at"]).select("file", "name", F.when(F.col("done"), F.col("at")).otherwise(F.col("further")).alias("at"), (F.col("done") | F.col("ends")).alias("done")), "steps")
        was, left = left, now.where("not done").count()
        if left == was:
            break
    return now.where("done").select("file", "name", F.col("at").alias("root"))


def call_flows(calls: DataFrame, entities: DataFrame, assignments: DataFrame) -> DataFrame:
    """(head_id, relation, tail_id, file, line): FLOWS_TO edges from the root variable of a
    call's only argument to the function of the file that it calls.

    calls (file, name, argument, start); entities (id, kind, name, path)."""
    functions = entities.where("kind in ('Function', 'Method')").select(F.col("path").alias("file"), "name", F.col("id").alias("tail_id"))
    roots = assignment_roots(assignments).select("file", F.col("name").alias("argument"), "root")
    found = calls.where("argument is not null").join(functions, ["file", "name"]).join(roots, ["file", "argument"])
    return found.select(F.concat(F.lit("variable:"), "file", F.lit("#"), "root").alias("head_id"), F.lit("FLOWS_TO").alias("relation"), "tail_id", "file", F.col("start").alias("line")).distinct()
