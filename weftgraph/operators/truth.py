"""Graph-truth gate: observed edges against what cases expect and forbid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialized


def _named(entities: DataFrame) -> DataFrame:
    """(case_id, key, id): what an entity may be called in an expectation: its id, name or qualified name."""
    return entities.select("case_id", "id", F.explode(F.array_distinct(F.array_compact(F.array("id", "name", "qualified_name")))).alias("key"))


def _semantics(edge: str = "") -> Column:
    """Whether an edge's derivation, exactness and confidence are what is expected."""
    of = lambda name: F.col(edge + name)
    allowed = F.col("allowed").isNull() | F.array_contains("allowed", of("exactness"))
    floor = F.col("floor").isNull() | (of("confidence") >= F.col("floor"))
    return (of("derived") == F.col("want_derived")) & allowed & floor


def match_edges(expected: DataFrame, observed: DataFrame, entities: DataFrame) -> DataFrame:
    """expected with edge_id, by_span and verdict.

    expected (case_id, expected_id, relation, head, tail, file, line, forbidden, want_derived,
    allowed, floor); observed (case_id, id, seq, head_id, relation, tail_id, file, line,
    exactness, confidence, derived); entities (case_id, id, name, qualified_name).

    An expected edge is matched by the first observed one (by seq, then id) of its relation and file
    whose ends are called so and whose line is right, or else by the first with another line
    (by_span false). Verdicts: matched; semantics if the match isn't derived or exact as
    expected; wrong_direction if only the reverse edge is there; missing. A forbidden edge
    is found only with its line and semantics, and clear otherwise.

    Edges are put under the names that are looked for and reduced there, so expectations meet
    one row for their pair of names and one for its line, however many entities share a name; forbidden
    ones meet the different semantics of the edges of their line.

    Cases: an edge whose ends aren't known entities matches nothing; two expectations may have one
    match; a null line is never right; a null allowed or floor asks for nothing; repeated
    expectations are judged each; empty tables give no rows.
    """
    want = materialized(expected, "expected")
    ends = ["case_id", "relation", "file", "head", "tail"]
    reverse = want.select("case_id", "relation", "file", F.col("tail").alias("head"), F.col("head").alias("tail"))
    sought = want.select("case_id", F.explode(F.array("head", "tail")).alias("key")).distinct()
    names = materialized(_named(entities).join(sought, ["case_id", "key"], "left_semi"), "names")
    called = lambda e: names.select("case_id", F.col("id").alias(f"{e}_id"), F.col("key").alias(e))
    named = observed.join(called("head"), ["case_id", "head_id"]).join(called("tail"), ["case_id", "tail_id"])
    kinds = ["derived", "exactness", "confidence"]
    met = named.join(want.select(*ends).union(reverse).distinct(), ends, "left_semi").select(*ends, "line", "seq", "id", *kinds)
    met = materialized(met, "met")

    first = F.min(F.struct("seq", "id", *kinds))
    anys, lines = met.groupBy(*ends).agg(first.alias("any")), met.where("line is not null").groupBy(*ends, "line").agg(first.alias("spanned"))
    asked = ["want_derived", "allowed", "floor"]
    of_kind = met.join(want.where("forbidden").select(*ends, "line").distinct(), [*ends, "line"], "left_semi").groupBy(*ends, "line", *kinds).agg(F.min(F.struct("seq", "id")).alias("first"))
    exact = want.where("forbidden").select(*ends, "line", *asked).distinct().join(of_kind, [*ends, "line"]).where(_semantics()).groupBy(*ends, "line", *asked).agg(F.min("first").alias("exact"))
    exact = exact.select(*(F.col(c).alias(f"f_{c}") for c in (*ends, "line", *asked)), "exact")
    same = [F.col(c) == F.col(f"f_{c}") for c in (*ends, "line")] + [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in asked]
    back = anys.select("case_id", "relation", "file", F.col("head").alias("tail"), F.col("tail").alias("head"), F.lit(True).alias("reverse"))
    judged = want.join(anys, ends, "left").join(back, ends, "left").join(lines, [*ends, "line"], "left").join(exact, same, "left")
    judged = judged.withColumn("nearest", F.coalesce("spanned", "any")).withColumn("as_expected", _semantics("nearest."))
    edge = F.when(F.col("forbidden"), F.col("exact.id")).otherwise(F.col("nearest.id"))
    verdict = (
        F.when(F.col("forbidden"), F.when(F.col("exact").isNotNull(), "forbidden_found").otherwise("clear"))
        .when(F.col("any").isNotNull(), F.when(F.col("as_expected"), "matched").otherwise("semantics"))
        .when(F.col("reverse"), "wrong_direction").otherwise("missing")
    )
    return judged.select(*expected.columns, edge.alias("edge_id"), F.when(edge.isNotNull(), F.col("spanned").isNotNull()).alias("by_span"), verdict.alias("verdict"))


def relation_metrics(judged: DataFrame, observed: DataFrame) -> DataFrame:
    """(relation, expected, matched, forbidden, found, observed, precision, recall) over all cases.

    An observed edge is right if some expectation is matched by it; precision counts the
    observed edges of relations that are expected, and is null without any.
    """
    hit = F.col("verdict").isin("matched", "semantics")
    told = judged.groupBy("relation").agg(
        F.count_if(~F.col("forbidden")).alias("expected"), F.count_if(~F.col("forbidden") & hit).alias("matched"), F.count_if("forbidden").alias("forbidden"), F.count_if(F.col("verdict") == "forbidden_found").alias("found"),
    )
    used = judged.where(hit).select("case_id", F.col("edge_id").alias("id"), "relation").distinct().groupBy("relation").agg(F.count("*").alias("right"))
    seen = observed.groupBy("relation").agg(F.count("*").alias("observed"))
    out = told.join(seen, "relation", "left").join(used, "relation", "left").fillna(0, ["observed", "right"])
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return out.select("relation", "expected", "matched", "forbidden", "found", "observed", share("right", "observed").alias("precision"), share("matched", "expected").alias("recall"))


def gate(judged: DataFrame, require_span: bool = True) -> DataFrame:
    """(case_id, passed, failures): a case passes if nothing expected is missing, reversed, off its
    line (if spans are asked for) or otherwise than expected, and nothing forbidden is there."""
    bad = ~F.col("verdict").isin("matched", "clear")
    if require_span:
        bad = bad | ((F.col("verdict") == "matched") & ~F.col("by_span"))
    return judged.groupBy("case_id").agg(F.count_if(bad).alias("failures")).select("case_id", (F.col("failures") == 0).alias("passed"), "failures")
