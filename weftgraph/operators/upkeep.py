"""Upkeep of the fact store: counts, integrity, dictionaries, text rows, routing, seeds and relation scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr
from ..sources.shared import materialized


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table, each counted by its own partial aggregate."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in tables.items()))


def listed(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The first rows in key order, one for each key, the least (a top-k per partition, then one merge)."""
    return least_of(rows, [key]).orderBy(key).limit(limit)


def least_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key: the least by its other columns, in their order."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__row")).select(*(F.col(c) if c in keys else F.col(f"__row.{c}") for c in rows.columns))


def broken_references(rows: DataFrame, keys: Sequence[str], parents: DataFrame, parent_key: str) -> DataFrame:
    """(key_column, rows): rows whose key, not null, has no parent; key columns without any are left out."""
    known = parents.select(F.col(parent_key).alias("__k"))
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key_column"), F.col(k).alias("__k")) for k in keys))).alias("c")).select("c.*").where("__k is not null")
    return cells.join(known, "__k", "left_anti").groupBy("key_column").agg(F.count("*").alias("rows"))


def interned(rows: DataFrame, value: str, known: DataFrame) -> DataFrame:
    """Dictionary (value, id) after interning: known values keep their ids, new ones follow the greatest in value order.

    New ids need no window over all values: values are cut into ranges, written once (so that
    every reader sees the same ranges), numbered within each, and a range starts after the
    sum of those before it, a window over one row for each range. A null isn't interned.
    """
    new = rows.select(F.col(value).alias("value")).where("value is not null").distinct().join(known.select("value"), "value", "left_anti")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = new.repartitionByRange(parts, "value").sortWithinPartitions("value").select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    ranged = materialized(ranged, "interned")
    upto = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", (upto - F.col("n")).alias("before"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    fresh = ranged.join(F.broadcast(before), "part").select("value", (F.lit(top) + F.col("before") + 1 + F.col("at")).alias("id"))
    return known.select("value", F.col("id").cast("long").alias("id")).unionByName(fresh)


def pruned(dictionary: DataFrame, used: Sequence[DataFrame]) -> DataFrame:
    """Dictionary rows whose id some table of (id) still uses."""
    return dictionary.join(reduce(DataFrame.unionByName, (u.select("id") for u in used)), "id", "left_semi")


def next_id(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """One more than the greatest id of all tables (1 if all are empty)."""
    tops = reduce(DataFrame.unionByName, (t.agg(F.max(key).alias("top")) for t in tables))
    return tops.agg((F.coalesce(F.max("top"), F.lit(0)) + 1).cast("long").alias("next_id"))


def missing_fields(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, missing): names of the fields that are null or empty, for rows that lack any."""
    absent = F.array_compact(F.array(*(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields)))
    return rows.select(key, absent.alias("missing")).where(F.size("missing") > 0)


def fts_rows(entities: DataFrame) -> DataFrame:
    """Text-index rows (kind, id, path, line, title, body) of entities."""
    return entities.select(F.lit("entity").alias("kind"), "id", "path", "line", F.col("name").alias("title"), F.concat_ws(" ", "kind", "name", "qualified_name").alias("body"))


def fts_upsert(index: DataFrame, new: DataFrame, stale_paths: DataFrame) -> DataFrame:
    """Index rows after all of the stale paths went and new ones (the least of those that share it) replaced those of their (kind, id)."""
    left = index.join(stale_paths.select("path"), "path", "left_anti").join(new.select("kind", "id"), ["kind", "id"], "left_anti")
    return left.unionByName(least_of(new, ["kind", "id"]))


def baseline_query(prompt: Column) -> Column:
    """The first eight words of three or more characters, lowercased."""
    return F.slice(F.filter(F.split(expr.ascii_lower(prompt), "[^a-z0-9_]+"), lambda w: F.length(w) >= 3), 1, 8)


def edge_route(relation: Column, exactness: Column, head_known: Column, tail_known: Column) -> Column:
    """Where an edge is stored: with the facts, with the heuristic rows, or nowhere."""
    return F.when(~(head_known & tail_known), "dropped").when(exactness.isin("static_heuristic", "inferred"), "heuristic").otherwise("facts")


def union_seeds(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, hamming, exact_seed) of hits (id, hamming) and seeds (id): a seed that is a hit keeps its distance."""
    s = seeds.select("id").distinct().withColumn("exact_seed", F.lit(True))
    return hits.groupBy("id").agg(F.min("hamming").alias("hamming")).join(s, "id", "full_outer").select("id", "hamming", F.coalesce("exact_seed", F.lit(False)).alias("exact_seed"))


def merged_seeds(rows: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """Trimmed values, not empty, each once, at the least position."""
    trimmed = rows.select(group, F.trim(value).alias("value"), F.col(pos).alias("pos")).where("value <> ''")
    return trimmed.groupBy(group, "value").agg(F.min("pos").alias("pos"))


def dropped(before: DataFrame, after: DataFrame, preserved: DataFrame) -> DataFrame:
    return before.select("id").distinct().join(after, "id", "left_anti").join(preserved, "id", "left_anti")


def batch_starts(rows: DataFrame, count: str, size: str, new_size: str, max_count: int = 128, max_size: int = 32 << 20) -> DataFrame:
    """Whether a batch of count files and size bytes is closed before a file of new_size bytes."""
    full = (F.col(count) > 0) & ((F.col(count) >= max_count) | (F.col(size) + F.col(new_size) > max_size))
    return rows.withColumn("starts", full)


def repo_path(path: Column) -> Column:
    """Forward slashes only, without empty and '.' parts."""
    parts = F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/")


def relation_scores(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Precision and recall of each task's relations.

    expected, observed: (task, relation, source, target), whose text an expectation matches by
    containment, ignoring case. The denominator of precision counts observed rows of expected
    relations only. Joined by (task, relation), so only texts of one relation are compared.
    """
    e = expected.select("task", "relation", expr.ascii_lower(F.col("source")).alias("es"), expr.ascii_lower(F.col("target")).alias("et")).distinct()
    o = observed.select("task", "relation", expr.ascii_lower(F.col("source")).alias("os"), expr.ascii_lower(F.col("target")).alias("ot")).distinct()
    met = e.join(o, ["task", "relation"]).where(F.contains("os", F.col("es")) & F.contains("ot", F.col("et")))
    relevant = o.join(e.select("task", "relation").distinct(), ["task", "relation"], "left_semi")
    n = lambda df, name: df.groupBy("task").agg(F.count("*").alias(name))
    found, right = n(met.select("task", "relation", "es", "et").distinct(), "found"), n(met.select("task", "relation", "os", "ot").distinct(), "right_")
    all_ = n(e, "expected").join(found, "task", "left").join(right, "task", "left").join(n(relevant, "seen"), "task", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.round(F.col(a) / F.col(b), 6))
    return all_.select("task", "expected", "found", share("right_", "seen").alias("precision"), share("found", "expected").alias("recall"))


def context_ratios(cases: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Micro-averaged ratios over all cases; null where the denominator is 0."""
    return cases.agg(*(F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6).alias(name) for name, (a, b) in pairs.items()))


def symbol_matches(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """(task, symbol, rank): the first rank at which an expected symbol is named, in full or as the last part of a name."""
    tail = F.element_at(F.split("name", r"::|\.|/"), -1)
    names = ranked.select("task", "rank", F.explode(F.array_distinct(F.array("name", tail))).alias("symbol"))
    return names.join(expected.select("task", "symbol").distinct(), ["task", "symbol"]).groupBy("task", "symbol").agg(F.min("rank").alias("rank"))
