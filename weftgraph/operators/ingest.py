"""Ingest-time operators: scope rules, globs, languages, modules, spans, SQL strings, fix-points."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr
from ..sources.shared import materialized
from .intervals import innermost

# fixed values
HARD_DIRS = ("node_modules", ".git", "target", "dist", "__pycache__")
SOFT_DIRS = ("artifacts", "build", "coverage", "generated")
EXTENSIONS = ("ts", "tsx", "js", "jsx")


def glob_regex(pattern: str) -> str:
    """A glob over whole paths or path suffixes; only * is special."""
    body = ".*".join(re.escape(p) for p in pattern.strip("/").split("*"))
    return f"(^|/){body}(/|$)"


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def gitignored(path: Column, rules: list[str]) -> Column:
    """Last matching rule wins; a leading ! negates, a trailing / or leading / are structural."""
    out = F.lit(False)
    for rule in rules:
        negate, body = rule.startswith("!"), rule.lstrip("!")
        pattern = ("^" if body.startswith("/") else "(^|/)") + ".*".join(re.escape(p) for p in body.strip("/").split("*")) + ("/" if body.endswith("/") else "(/|$)")
        out = F.when(path.rlike(pattern), F.lit(not negate)).otherwise(out)
    return out


def scope(path: Column, exclude: list[str], include: list[str], ignored: Column, respect_gitignore: bool = True) -> Column:
    """First rule that applies: explicit exclude, explicit include, hard, soft, gitignore, include."""
    part = lambda dirs: path.rlike("(^|/)(" + "|".join(re.escape(d) for d in dirs) + ")(/|$)")
    soft_out = part(SOFT_DIRS) & (ignored if respect_gitignore else F.lit(False))
    return (
        F.when(matches_any(path, exclude), "explicit_exclude").when(matches_any(path, include), "explicit_include").when(part(HARD_DIRS), "hard_exclude")
        .when(soft_out, "soft_exclude").when(part(SOFT_DIRS), "include_with_warning").when(ignored if respect_gitignore else F.lit(False), "gitignore").otherwise("include")
    )


def module_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer, specifier): the first candidate path that exists in files (path)."""
    parent = F.regexp_replace("importer", "/?[^/]*$", "")
    raw = F.concat_ws("/", F.nullif(parent, F.lit("")), F.regexp_replace("specifier", r"^(\./)+", ""))
    has = raw.rlike(r"\.[A-Za-z0-9]+$")
    options = F.array(*(F.concat(raw, F.lit(f".{e}")) for e in EXTENSIONS), *(F.concat(raw, F.lit(f"/index.{e}")) for e in EXTENSIONS))
    tried = imports.select("importer", "specifier", F.posexplode(F.when(has, F.array(raw)).otherwise(options)).alias("at", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("importer", "specifier").agg(F.min_by("path", "at").alias("target"))


def reexport_depth(links: DataFrame, roots: DataFrame, limit: int = 8) -> DataFrame:
    """links (src, dst): nodes reachable from roots (node) with their least depth, at most limit."""
    seen = roots.select("node", F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, limit + 1):
        front = materialized(front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct(), "front")
        seen = seen.unionByName(front)
        if not front.take(1):
            break
    return seen.groupBy("node").agg(F.min("depth").alias("depth"))


def dependents(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """imports (importer, imported): changed (node) and everything that imports it, transitively.

    Each round joins only the newest nodes; it ends when a round finds none, which cycles
    can't put off. Now and then what was seen is written as one table, so that plans stay short.
    """
    imports = materialized(imports.select("importer", "imported").distinct(), "imports")
    seen = front = changed.select("node").distinct()
    for done in itertools.count(1):
        front = materialized(front.join(imports, F.col("node") == F.col("imported")).select(F.col("importer").alias("node")).distinct().join(seen, "node", "left_anti"), "front")
        if not front.take(1):
            return seen
        seen = seen.unionByName(front)
        if done % 16 == 0:
            seen = materialized(seen, "seen")


def enclosing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The smallest outer (file, id, start, end) that covers each inner (file, id, start, end)."""
    return innermost(inner, outer)


def sql_relation(sql: Column) -> tuple[Column, Column]:
    """(relation, table) of a SQL string literal."""
    tokens = F.filter(F.split(F.translate(expr.ascii_lower(sql), "(),;\n\r\t", "       "), " "), lambda t: t != "")
    after = lambda m: F.get(tokens, F.when(F.array_position(tokens, F.lit(m)) > 0, F.array_position(tokens, F.lit(m)).cast("int")))
    verb = F.get(tokens, 0)
    table = F.when(verb == "select", after("from")).when(verb == "insert", after("into")).when(verb == "update", F.get(tokens, 1)).when(verb == "delete", after("from")).when(verb == "alter", after("table"))
    relation = F.when(verb == "select", "READS_TABLE").when(verb.isin("insert", "update", "delete"), "WRITES_TABLE").when(verb == "alter", "DEPENDS_ON_SCHEMA")
    return F.when(table.isNotNull(), relation), table


def altered_column(sql: Column) -> Column:
    tokens = F.filter(F.split(F.translate(expr.ascii_lower(sql), "(),;\n\r\t", "       "), " "), lambda t: t != "")
    at = F.array_position(tokens, F.lit("column")).cast("int")
    return F.get(tokens, F.when(at > 0, at))


def span_issues(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges (id, path, line) against sources (path, lines): what is wrong with each span."""
    j = edges.join(sources, "path", "left")
    issue = F.when(F.col("line").isNull(), "missing_span").when(F.col("lines").isNull(), "source_unavailable").when(F.col("line") > F.size("lines"), "out_of_range").when(F.trim(F.get("lines", F.col("line") - 1)) == "", "empty_span")
    return j.withColumn("issue", issue).where("issue is not null").select("id", "issue")


def routed_calls(calls: DataFrame) -> DataFrame:
    """Call names to facts by a fixed rule table (first rule that matches)."""
    name = expr.ascii_lower(F.col("name"))
    rules = [(r"\.(get|post|put|delete)$", "EXPOSES", 0.9), (r"(checkrole|requirerole)$", "CHECKS_ROLE", 0.85), (r"authorize$", "AUTHORIZES", 0.85), (r"\.(emit|publish)$", "EMITS", 0.8), (r"\.(on|subscribe)$", "LISTENS_TO", 0.8), (r"^(test|it)$", "TESTS", 0.9), (r"^expect", "ASSERTS", 0.9)]
    relation, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for pattern, rel, conf in reversed(rules):
        relation, confidence = F.when(name.rlike(pattern), rel).otherwise(relation), F.when(name.rlike(pattern), conf).otherwise(confidence)
    return calls.withColumn("relation", relation).withColumn("confidence", confidence).where("relation is not null")


def scope_lookup(uses: DataFrame, parents: DataFrame, symbols: DataFrame) -> DataFrame:
    """Lexical lookup: uses (scope, name) climb parents (scope, parent) to the nearest scope
    that declares the name; symbols (scope, name, id); several ids there mean ambiguous (null).

    The climb ends where the name is found or no parent is left that wasn't tried before.
    """
    declared = symbols.groupBy("scope", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    front = tried = materialized(uses.select(F.col("scope").alias("origin"), "scope", "name").distinct(), "climb")
    found = None
    for depth in itertools.count():
        hit = materialized(front.join(declared, ["scope", "name"]).select("origin", "name", F.lit(depth).alias("depth"), F.when(F.col("n") == 1, F.col("id")).alias("id")), "hit")
        found = hit if found is None else found.unionByName(hit)
        up = front.join(hit, ["origin", "name"], "left_anti").join(parents, "scope").where("parent is not null").select("origin", F.col("parent").alias("scope"), "name").distinct()
        front = materialized(up.join(tried, ["origin", "scope", "name"], "left_anti"), "climb")
        if not front.take(1):
            break
        tried = tried.unionByName(front)
        if depth % 16 == 15:
            tried, found = materialized(tried, "tried"), materialized(found, "found")
    w = W.partitionBy("origin", "name").orderBy("depth")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("origin").alias("scope"), "name", "id")
