"""Column expressions of the graph model: labels, costs, flags, numeric scalars, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
RELATION_COST = {"CALLS": 0.75, "READS": 0.75, "WRITES": 0.75, "MUTATES": 0.75, "FLOWS_TO": 0.75, "EXPOSES": 0.9, "AUTHORIZES": 0.9, "CHECKS_ROLE": 0.9, "CHECKS_PERMISSION": 0.9, "PUBLISHES": 0.9, "EMITS": 0.9, "CONSUMES": 0.9, "LISTENS_TO": 0.9, "MIGRATES": 0.9, "TESTS": 0.9, "COVERS": 0.9}
EXACTNESS_PENALTY = {"exact": 0.0, "compiler_verified": 0.0, "lsp_verified": 0.0, "parser_verified": 0.05, "static_heuristic": 0.35, "dynamic_trace": 0.10, "inferred": 0.50, "derived_from_verified_edges": 0.15}
EXACTNESS_RANK = {"exact": 0, "compiler_verified": 0, "lsp_verified": 0, "parser_verified": 1, "dynamic_trace": 2, "derived_from_verified_edges": 3, "static_heuristic": 4, "inferred": 5}
RELATION_PRIOR = {
    0.84: "CONTAINS DEFINED_IN DEFINES DECLARES EXPORTS IMPORTS CALLS CALLEE ARGUMENT_0 ARGUMENT_1 ARGUMENT_N RETURNS READS WRITES MUTATES FLOWS_TO ASSIGNED_FROM",
    0.70: "AUTHORIZES CHECKS_ROLE CHECKS_PERMISSION SANITIZES VALIDATES EXPOSES PUBLISHES EMITS CONSUMES LISTENS_TO SUBSCRIBES_TO HANDLES SPAWNS AWAITS MIGRATES READS_TABLE WRITES_TABLE ALTERS_COLUMN TESTS ASSERTS MOCKS STUBS COVERS",
    0.76: "MAY_MUTATE MAY_READ API_REACHES ASYNC_REACHES SCHEMA_IMPACT",
}
DERIVED = ["MAY_MUTATE", "MAY_READ", "API_REACHES", "ASYNC_REACHES", "SCHEMA_IMPACT"]
PROOF_GRADE = ["exact", "compiler_verified", "lsp_verified", "parser_verified"]
TEST_RELATIONS = ["TESTS", "ASSERTS", "MOCKS", "STUBS", "COVERS", "FIXTURES_FOR"]
SECURITY_RELATIONS = ["AUTHORIZES", "CHECKS_ROLE", "CHECKS_PERMISSION", "SANITIZES", "VALIDATES", "EXPOSES", "TRUST_BOUNDARY", "SOURCE_OF_TAINT", "SINKS_TO"]
FLAG = {"heuristic": 1, "unresolved": 2, "dynamic_import": 4, "static_resolution": 8, "resolved": 16}
LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "rb": "ruby", "php": "php"}


def lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(F.isnan(c) | c.isNull(), F.lit(0.0)).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return F.log(p / (1 - p))


def uncertainty(confidence: Column, exactness: Column) -> Column:
    return F.least(F.greatest(1 - confidence, F.lit(0.0)), F.lit(1.0)) + lookup(EXACTNESS_PENALTY, exactness, 0.0)


def step_cost(relation: Column, confidence: Column, exactness: Column, depth: Column) -> Column:
    return lookup(RELATION_COST, relation, 1.0) + uncertainty(confidence, exactness) + depth * 0.05


def relation_prior(relation: Column) -> Column:
    return lookup({r: p for p, names in RELATION_PRIOR.items() for r in names.split()}, relation, 0.68)


def is_test_path(path: Column) -> Column:
    p = ascii_lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.contains("/tests/") | p.contains("/test/") | p.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$")


def looks_test(endpoint: Column) -> Column:
    e = ascii_lower(endpoint)
    return e.rlike(r"/tests/|/test/|\.test\.|\.spec\.|#test|testcase|testfile")


def looks_mock(endpoint: Column) -> Column:
    e = ascii_lower(endpoint)
    return e.contains("mock") | e.contains("stub")


def edge_context(relation: Column, path: Column, head: Column, tail: Column) -> Column:
    return (
        F.when(relation.isin("MOCKS", "STUBS") | looks_mock(head) | looks_mock(tail), "mock")
        .when(relation.isin("TESTS", "ASSERTS", "COVERS", "FIXTURES_FOR") | is_test_path(path) | looks_test(head) | looks_test(tail), "test")
        .otherwise("production")
    )


def edge_class(context: Column, relation: Column, exactness: Column, derived: Column) -> Column:
    return (
        F.when(context.isin("mixed", "mock", "test"), context)
        .when(derived | relation.isin(DERIVED) | (exactness == "derived_from_verified_edges"), "derived")
        .when(relation.isin("CALLEE", "ARGUMENT_0", "ARGUMENT_1", "ARGUMENT_N"), "reified_callsite")
        .when(exactness.isin("static_heuristic", "inferred"), "base_heuristic")
        .when(relation.isin("CALLED_BY", "MUTATED_BY"), "unknown")
        .when(exactness.isin(PROOF_GRADE), "base_exact")
        .otherwise("unknown")
    )


def resolution_kind(exactness: Column, derived: Column) -> Column:
    return F.when(derived | (exactness == "derived_from_verified_edges"), "derived_from_verified_edges").when(exactness.isin("static_heuristic", "inferred"), "unresolved_static_heuristic").otherwise("not_recorded")


def flags(exactness: Column, resolution: Column) -> Column:
    r = ascii_lower(resolution)
    bit = lambda cond, name: F.when(cond, F.lit(FLAG[name])).otherwise(0)
    return (
        bit(exactness.isin("static_heuristic", "inferred"), "heuristic")
        .bitwiseOR(bit(r.contains("unresolved"), "unresolved"))
        .bitwiseOR(bit(r.contains("dynamic"), "dynamic_import"))
        .bitwiseOR(bit(r.contains("static"), "static_resolution"))
        .bitwiseOR(bit(r.contains("resolved") & ~r.contains("unresolved"), "resolved"))
    )


def quantised(confidence: Column) -> Column:
    return F.round(clamp(confidence) * 1000).cast("long")


def path_context(contexts: Column) -> Column:
    """Lattice over a path's step contexts; any two kinds are mixed."""
    kinds = F.array_distinct(contexts)
    return F.when(F.size(kinds) == 0, "production").when((F.size(kinds) > 1) | F.array_contains(kinds, "mixed"), "mixed").otherwise(F.element_at(kinds, 1))


def symbol_tokens(text: Column) -> Column:
    """camelCase and non-alphanumeric split, lowercased, two letters or more, a set."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(ascii_lower(F.trim(spaced)), " "), lambda t: F.length(t) >= 2)))


def signature_tokens(text: Column) -> Column:
    """Tokens of [A-Za-z0-9_.], ASCII-lowercased, in order."""
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9_.]+"), lambda t: t != "")


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ascii_lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
