"""Relational operators of the fact store: counts, labels, pages, samples, upserts, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.sum(F.col("derived").cast("long")).alias("derived"))


def fact_mix(edges: DataFrame) -> DataFrame:
    """Counts by exactness, class and context in one pass over the labelled edges."""
    pair = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).alias("value")) for k in ("exactness", "edge_class", "context"))))
    return edges.select(pair.alias("p")).groupBy("p.label", "p.value").agg(F.count("*").alias("edges"))


def label_precision(samples: DataFrame, group: str) -> DataFrame:
    """samples (group, verdict in true_positive / false_positive / wrong_span / other)."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    out = samples.groupBy(group).agg(n("true_positive").alias("tp"), n("false_positive").alias("fp"), n("wrong_span").alias("wrong_span"), F.count("*").alias("samples"))
    return out.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 4)))


def collisions(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("collisions"))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_meta(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    total = rows.agg(F.count("*").alias("total"))
    more = F.col("total") > offset + limit
    shown = F.greatest(F.least(F.col("total") - offset, F.lit(limit)), F.lit(0)).cast("long")
    return total.select("total", F.lit(offset).cast("long").alias("offset"), shown.alias("returned"), more.alias("truncated"), F.when(more, F.lit(offset + limit).cast("long")).alias("next_offset"))


def seeded_sample(rows: DataFrame, key: Column, seed: int, n: int) -> DataFrame:
    """n rows from min + seed mod width upwards on an integer key, wrapping once."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.limit(0)
    width = high - low + 1
    return rows.withColumn("__at", F.pmod(key - (low + seed % width), F.lit(width))).orderBy("__at", *rows.columns).limit(n).drop("__at")


def accounting(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows and payload bytes of text columns for each table, largest first."""
    out = None
    for name, (df, cols) in tables.items():
        size = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cols), F.lit(0)).cast("long"))
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("bytes"), "name")


def local_ids(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    return rows.withColumn("local_id", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key: a partially aggregated max_by, no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def delete_cascade(edges: DataFrame, entities: DataFrame, stale_paths: DataFrame) -> DataFrame:
    """Edges that survive when the facts of stale paths, and edges at their entities, go."""
    gone = entities.join(stale_paths, "path", "left_semi").select("id")
    left = edges.join(stale_paths, "path", "left_anti")
    left = left.join(gone.withColumnRenamed("id", "head_id"), "head_id", "left_anti")
    return left.join(gone.withColumnRenamed("id", "tail_id"), "tail_id", "left_anti")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, hash) manifests: unchanged, changed, added, deleted, renamed (with its old path)."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    both = o.join(n, "path", "full_outer")
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    both = both.withColumn("state", state)
    left = both.where("state = 'deleted'").groupBy(F.col("old_hash").alias("new_hash")).agg(F.min("path").alias("old_path"))
    out = both.join(left, "new_hash", "left")
    renamed = (F.col("state") == "added") & F.col("old_path").isNotNull()
    return out.select("path", F.when(renamed, "renamed").otherwise(F.col("state")).alias("state"), F.when(renamed, F.col("old_path")).alias("old_path"))


def endpoint_violations(edges: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (relation, head kind, tail kind) isn't allowed; allowed is a fixed lookup."""
    k = entities.select("id", "kind")
    e = edges.join(k.select(F.col("id").alias("head_id"), F.col("kind").alias("head_kind")), "head_id").join(k.select(F.col("id").alias("tail_id"), F.col("kind").alias("tail_kind")), "tail_id")
    return e.join(F.broadcast(allowed), ["relation", "head_kind", "tail_kind"], "left_anti").select("id", "relation", "head_kind", "tail_kind")
