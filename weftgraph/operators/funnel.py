"""The retrieval funnel: prompts in, verified evidence packets out, with a trace of every stage.

0. Exact seeds: names in the prompt that are entities. All documents are candidates.
1. Binary sieve: the documents nearest to the prompt by signature; seeds pass in any case.
2. Rerank by shared tokens, signature likeness and seed; seeds pass in any case.
3. Graph verification: all ten path queries from what is left; what has no path is dropped.
4. Packet: paths in order of their score, with risks and tests, within a token budget.

Several tasks run side by side. Their prompts are a stated query set, sent to every document;
only their best candidates are ranked, and only the candidates of stage 2 (stage2 for each task,
and its seeds) start searches, all of them together.

Cases: a task without seeds has none to keep; a prompt without tokens shares none; null
prompts count as empty; documents with a null id are left out; of documents that share an
id the greatest text is kept; ties go to the smaller id; no documents, or no tasks, give an
empty trace and packet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr, hashing
from ..sources.shared import materialized
from . import packet, queries, vector
from .traverse import Limits

DIMS = 256
# fixed values: what the packet's reader expects the stages to be called
STAGES = ("stage0_exact_seed_extraction", "stage1_binary_sieve", "stage2_compressed_rerank", "stage3_exact_graph_verification", "stage4_context_packet")


@dataclass(frozen=True)
class Funnel:
    stage1: int = 32
    stage2: int = 16
    limits: Limits = Limits(6, 16, 2048)
    budget: int = 1200
    max_paths: int = 64
    weights: dict[str, float] = field(default_factory=lambda: {"graph_distance": 1.5, "path_length": 0.75, "relation_signature": 1.0, "type_validity": 0.5, "edge_confidence": 1.25, "test_failure_link": 0.8, "security_relation_presence": 0.6})


def signatures(documents: DataFrame) -> DataFrame:
    """(id, text, signature) of documents (id, text), written once for all later funnels."""
    d = documents.where("id is not null").groupBy("id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return materialized(d.withColumn("signature", hashing.signature256("text")), "signatures")


def exact_seeds(tasks: DataFrame, entities: DataFrame) -> DataFrame:
    """(task, id): entities (id, name, qualified_name) that a prompt names as a symbol, identifier or error."""
    found = packet.prompt_seeds(tasks.select("task", F.coalesce("prompt", F.lit("")).alias("text")))
    named = found.where("kind in ('symbol', 'identifier', 'error', 'stack_trace', 'test_name')").select("task", "value").distinct()
    keys = entities.select("id", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("value"))
    return keys.join(F.broadcast(named), "value").select("task", "id").distinct()  # the prompts' few names


def sieve(tasks: DataFrame, documents: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(task, id, text, words, hamming, exact_seed): for each task its k nearest documents, and its seeds."""
    asked = tasks.select("task", F.coalesce("prompt", F.lit("")).alias("prompt"))
    asked = materialized(asked.withColumn("asked", hashing.signature256("prompt")).withColumn("words", F.array_distinct(expr.signature_tokens(F.col("prompt")))).drop("prompt"), "prompts")
    # the stated query set against all documents
    met = documents.join(F.broadcast(asked)).withColumn("hamming", vector.hamming(F.col("signature"), F.col("asked")).cast("int")).drop("signature", "asked")
    # at most DIMS + 1 distances of a task; only documents up to the k-th's distance are ranked
    upto = F.sum("n").over(W.partitionBy("task").orderBy("hamming"))
    bound = met.groupBy("task", "hamming").agg(F.count("*").alias("n")).withColumn("before", upto - F.col("n")).where(F.col("before") < k).groupBy("task").agg(F.max("hamming").alias("bound"))
    bound = materialized(bound, "bound")
    nth = F.row_number().over(W.partitionBy("task").orderBy("hamming", "id"))
    near = met.join(F.broadcast(bound), "task").where("hamming <= bound").drop("bound").withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
    kept = near.unionByName(met.join(F.broadcast(seeds), ["task", "id"], "left_semi")).distinct()
    return kept.join(seeds.withColumn("exact_seed", F.lit(True)), ["task", "id"], "left").withColumn("exact_seed", F.coalesce("exact_seed", F.lit(False)))


def reranked(sieved: DataFrame, n: int) -> DataFrame:
    """(task, id, score, exact_seed): the n best of each task, and its seeds."""
    shared = F.size(F.array_intersect("words", F.array_distinct(expr.signature_tokens(F.col("text")))))
    rows = sieved.withColumn("text_score", F.when(F.size("words") > 0, shared / F.size("words")).otherwise(0.0)).withColumn("stage1", (DIMS - 2 * F.col("hamming")).cast("double"))
    rows = rows.withColumn("vector_score", F.col("stage1") / DIMS).withColumn("metadata_score", F.lit(0.0)).withColumn("score", F.round(vector.rerank_score(), 6))
    nth = F.row_number().over(W.partitionBy("task").orderBy(F.desc("score"), "id"))
    return rows.withColumn("nth", nth).where((F.col("nth") <= n) | F.col("exact_seed")).select("task", "id", "score", "exact_seed")


def run(tasks: DataFrame, documents: DataFrame, steps: DataFrame, entities: DataFrame, funnel: Funnel = Funnel()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trace, paths, packet) of tasks (task, prompt).

    documents come from ``signatures``; steps is a step table; entities (id, name,
    qualified_name) are what prompts may name. trace (task, stage, id, kept): what each
    stage keeps and drops, from stage 1 on what it was given (stage 0 keeps seeds and all
    documents, so only seeds are listed). paths (task, source, target, edge_ids, relations,
    cost, probability, place). packet (task, section, pos, text).
    """
    seeds = materialized(exact_seeds(tasks, entities), "seeds")
    known = documents.select("id", "text", "signature")
    # a seed without a document is one by itself
    bare = seeds.select("id").distinct().join(known.select("id"), "id", "left_anti").select("id", F.col("id").alias("text")).withColumn("signature", hashing.signature256("text"))
    first = materialized(sieve(tasks, known.unionByName(bare), seeds, funnel.stage1), "sieved")
    second = materialized(reranked(first, funnel.stage2), "reranked")
    origins = second.select(F.col("id").alias("source")).distinct()
    found = materialized(queries.context_paths(steps, origins, funnel.limits), "verified")
    third = second.join(found.select(F.col("source").alias("id")).distinct(), "id", "left_semi").select("task", "id")

    of_task = second.select("task", F.col("id").alias("source")).join(found, "source")
    best = F.min_by(F.struct(*found.columns), F.struct(F.round("cost", 6), "source"))
    unique = of_task.groupBy("task", F.col("steps.id").alias("edge_list")).agg(best.alias("p")).select("task", "p.*")
    scored = queries.score_paths(unique, funnel.weights)
    place = F.row_number().over(W.partitionBy("task").orderBy(F.desc("probability"), F.round("uncertainty", 6), F.round("cost", 6), "target", "keys"))
    scored = materialized(scored.withColumn("place", place).where(F.col("place") <= funnel.max_paths), "scored")

    relations = F.array_join(F.col("steps.relation"), "->")
    paths = scored.select("task", "source", "target", F.array_join(F.col("steps.id"), "|").alias("edge_ids"), relations.alias("relations"), F.round("cost", 6).alias("cost"), "probability", "place")
    lines = paths.select("task", F.lit("path").alias("section"), (F.col("place") - 1).alias("pos"), F.concat("source", F.lit(" "), "relations", F.lit(" "), "target").alias("text"))
    listed = lambda df, name, cap=12: df.distinct().withColumn("pos", F.row_number().over(W.partitionBy("task").orderBy("text")) - 1).where(F.col("pos") < cap).select("task", F.lit(name).alias("section"), "pos", "text")
    said = scored.select("task", F.explode(packet.risk_sentences()).alias("text"))
    tests = scored.where(F.arrays_overlap(F.col("steps.relation"), F.array(*map(F.lit, expr.TEST_RELATIONS)))).select("task", F.concat(F.lit("run tests covering "), "target").alias("text"))
    items = lines.unionByName(listed(said, "risk")).unionByName(listed(tests, "test")).withColumn("bytes", F.octet_length("text"))
    kept = packet.compact(items, funnel.budget).select("task", "section", "pos", "text")

    stage = lambda n, df, kept_: df.select("task", F.lit(STAGES[n]).alias("stage"), "id", F.lit(kept_).alias("kept"))
    gone = lambda a, b: a.select("task", "id").join(b.select("task", "id"), ["task", "id"], "left_anti")
    trace = stage(0, seeds, True).unionByName(stage(1, first, True)).unionByName(stage(2, second, True)).unionByName(stage(2, gone(first, second), False))
    trace = trace.unionByName(stage(3, third, True)).unionByName(stage(3, gone(second, third), False))
    shown = scored.select("task", F.col("source").alias("id")).distinct()
    return trace.unionByName(stage(4, shown, True)), paths, kept
