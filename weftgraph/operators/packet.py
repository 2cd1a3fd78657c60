"""Evidence packets: risks, recommended tests, snippets, token budgets, prompt seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr


def risk_sentences() -> Column:
    """What a path says about risk. The sentences are fixed output text."""
    has = lambda *names: F.arrays_overlap(F.col("steps.relation"), F.array(*map(F.lit, names)))
    said = [
        F.when(has("WRITES", "MUTATES"), F.concat(F.lit("Changing "), "source", F.lit(" may mutate "), "target")),
        F.when(has("AUTHORIZES", "CHECKS_ROLE", "CHECKS_PERMISSION"), F.concat("source", F.lit(" participates in an auth/security path"))),
        F.when(has("PUBLISHES", "EMITS", "CONSUMES", "LISTENS_TO"), F.concat("source", F.lit(" participates in an async/event flow"))),
        F.when(has("MIGRATES", "ALTERS_COLUMN", "DEPENDS_ON_SCHEMA"), F.concat("source", F.lit(" has schema migration impact"))),
        F.when(has("TESTS", "COVERS", "ASSERTS"), F.concat("source", F.lit(" has test coverage paths to review"))),
    ]
    return F.array_compact(F.array(*said))


def risks(paths: DataFrame, cap: int = 12) -> DataFrame:
    """Sorted distinct risk sentences of paths, the first twelve."""
    return paths.select(F.explode(risk_sentences()).alias("risk")).distinct().orderBy("risk").limit(cap)


def recommended_tests(paths: DataFrame, cap: int = 12) -> DataFrame:
    hit = F.arrays_overlap(F.col("steps.relation"), F.array(*map(F.lit, expr.TEST_RELATIONS)))
    return paths.where(hit).select(F.concat(F.lit("run tests covering "), "target").alias("test")).distinct().orderBy("test").limit(cap)


def snippet(text: Column, first: Column, last: Column, lines: int = 4) -> Column:
    """Up to four trimmed lines of a 1-based line range, joined by blanks."""
    part = F.slice(F.split(text, "\n"), first, F.least(last - first + 1, F.lit(lines)))
    return F.trim(F.array_join(F.transform(part, lambda x: F.trim(x)), " "))


def compact(items: DataFrame, budget_tokens: int) -> DataFrame:
    """items (task, section, pos, bytes): those kept within the budget of bytes / 4 tokens.

    Sections are given up in this order: snippets, paths, risks, tests; within a section
    from its end, the first item of each section last.
    """
    order = F.when(F.col("section") == "snippet", 0).when(F.col("section") == "path", 1).when(F.col("section") == "risk", 2).otherwise(3)
    pop = items.withColumn("first", F.when(F.col("pos") == 0, 1).otherwise(0)).withColumn("o", order)
    keep = W.partitionBy("task").orderBy(F.col("first").desc(), F.col("o").desc(), "pos").rowsBetween(W.unboundedPreceding, 0)
    return pop.withColumn("upto", F.sum("bytes").over(keep)).where(F.floor(F.col("upto") / 4) <= budget_tokens).drop("first", "o")


def prompt_seeds(prompts: DataFrame) -> DataFrame:
    """prompts (task, text): ordered distinct seeds (task, kind, value, line, first position)."""
    rows = prompts.select("task", F.posexplode(F.split("text", "\n")).alias("row", "s"))
    found = lambda kind, pattern, group=1: F.transform(F.regexp_extract_all("s", F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    seeds = F.concat(
        found("stack_trace", r"at ([A-Za-z_][A-Za-z0-9_.]*) \("),
        found("error", r"([A-Z][A-Za-z]*Error)"),
        found("path", r"([A-Za-z0-9_./-]+\.(?:ts|js|py|rs|go|java))"),
        found("line", r":(\d+)"),
        found("test_name", r"test\('([^']*)'\)"),
        found("symbol", r"([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)+)\("),
        found("identifier", r"([a-z]+[A-Z][A-Za-z0-9]*)"),
    )
    out = rows.select("task", "row", F.posexplode(seeds).alias("at", "seed")).select("task", "row", "at", "seed.kind", "seed.value")
    return out.groupBy("task", "kind", "value").agg(F.min(F.struct("row", "at"))["row"].cast("int").alias("first_row"))
