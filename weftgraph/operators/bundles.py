"""Fact bundles: merging what each file says, and moving facts from store to store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialized

#: payloads of more bytes than this are kept beside the rows
LARGE = 64 << 10


def reduce_bundles(rows: DataFrame, by: str = "path", key: str = "id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(facts, warnings) of all bundles' rows (kind, path, id, seq, ...).

    A bundle (path) keeps the first of its rows (by seq) of each kind and id; of all bundles'
    rows of one kind and id the first path's is the fact. Warnings (kind, path, id, what,
    times) say where another payload was met: local, within a bundle, a time for each such
    row; global, in a later bundle. What is a payload: all columns but path and seq.

    Payloads are compared by hash, partially aggregated by id, so an id that very many bundles
    have isn't gathered, and the order in which bundles arrive doesn't matter. Rows with a null
    id or path are left out; of rows equal in seq the least hash counts as first.
    """
    rows = rows.where(F.col(by).isNotNull() & F.col(key).isNotNull())
    payload = sorted(c for c in rows.columns if c not in (by, seq))
    rows = materialized(rows.withColumn("__hash", F.xxhash64(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))), "bundles")
    counts = rows.groupBy("kind", by, key, "__hash").agg(F.count("*").alias("n"), F.min(seq).alias("least"))
    local = counts.groupBy("kind", by, key).agg(F.min(F.struct("least", "__hash")).alias("first"), F.sum("n").alias("all"), F.min_by("n", F.struct("least", "__hash")).alias("own"))
    local = materialized(local.select("kind", by, key, F.col("first.__hash").alias("hash"), F.col("first.least").alias("least"), (F.col("all") - F.col("own")).alias("times")), "local")
    first = materialized(local.groupBy("kind", key).agg(F.min(F.struct(by, "hash", "least")).alias("f")).select("kind", key, F.col(f"f.{by}").alias("__path"), F.col("f.hash").alias("__fact"), F.col("f.least").alias("__least")), "first")
    at_fact = (F.col(by) == F.col("__path")) & (F.col("__hash") == F.col("__fact")) & (F.col(seq) == F.col("__least"))
    facts = rows.join(first, ["kind", key]).where(at_fact).drop("__hash", "__path", "__fact", "__least").dropDuplicates(["kind", key])
    within = local.where("times > 0").select("kind", by, key, F.lit("local").alias("what"), F.col("times").cast("long").alias("times"))
    between = local.join(first, ["kind", key]).where("hash <> __fact").select("kind", by, key, F.lit("global").alias("what"), F.lit(1).cast("long").alias("times"))
    return facts, within.unionByName(between)


# ---- large payloads


def materialize_payloads(events: DataFrame, payload: str = "payload", large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(events, payloads): payloads of more than large bytes are replaced by a reference.

    The reference is JSON with the payload's sha256 and bytes; payloads (sha256, bytes,
    payload) has each different one once. Null payloads stay null.
    """
    is_large = F.octet_length(payload) > large
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    reference = F.to_json(F.struct(digest.alias("payload_sha256"), F.octet_length(payload).alias("payload_bytes")))
    payloads = events.where(is_large).select(digest.alias("sha256"), F.octet_length(payload).cast("long").alias("bytes"), F.col(payload).alias("payload"))
    # equal digests are equal payloads: only digests are compared, and one of each is kept
    payloads = payloads.groupBy("sha256", "bytes").agg(F.first("payload").alias("payload"))
    return events.withColumn(payload, F.when(is_large, reference).otherwise(F.col(payload))), payloads


def restore_payloads(events: DataFrame, payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The events that ``materialize_payloads`` was given. Raises when read if a payload is missing."""
    sha = F.get_json_object(payload, "$.payload_sha256")
    asked = events.withColumn("__sha", F.when(sha.isNotNull() & F.get_json_object(payload, "$.payload_bytes").isNotNull() & (F.octet_length(payload) < 200), sha))
    joined = asked.join(payloads.select(F.col("sha256").alias("__sha"), F.col("payload").alias("__payload")), "__sha", "left")
    whole = F.when(F.col("__sha").isNull(), F.col(payload)).when(F.col("__payload").isNotNull(), F.col("__payload")).otherwise(F.raise_error(F.concat(F.lit("no payload "), "__sha")))
    return joined.withColumn(payload, whole).drop("__sha", "__payload").select(*events.columns)


# ---- bundles on disk


def _facts(table: DataFrame) -> tuple[int, str]:
    """(number of rows, order-free digest) of a table."""
    m = F.md5(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    piece = lambda at: F.coalesce(F.sum(F.conv(F.substring("m", at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    r = table.select(m.alias("m")).agg(F.count("*").alias("n"), piece(1).alias("a"), piece(16).alias("b")).first()
    return r["n"], f"{r['a']}:{r['b']}"


def export_bundle(tables: dict[str, DataFrame], folder: str, payloads: dict[str, str] | None = None) -> None:
    """Write tables as lines of JSON under folder, which must be new, and a manifest with each
    one's schema, number of rows and digest at the end.

    payloads names, by table, a column whose large values go to a table of their own. Files
    are committed by Spark: a task that fails or is tried again leaves none of its own, and a
    folder without a manifest is no bundle.
    """
    manifest, spark = {}, next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        column = (payloads or {}).get(name)
        kept = table
        if column:
            kept, apart = materialize_payloads(table, column)
            apart.write.parquet(f"{folder}/payloads/{name}")
        kept.write.option("ignoreNullFields", "false").json(f"{folder}/tables/{name}")
        n, digest = _facts(table)
        manifest[name] = {"schema": table.schema.json(), "rows": n, "digest": digest, "payload": column}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def import_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle, after comparing each with the manifest."""
    from pyspark.sql.types import StructType

    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    out = {}
    for name, said in manifest.items():
        table = spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).json(f"{folder}/tables/{name}")
        if said["payload"]:
            table = restore_payloads(table, spark.read.parquet(f"{folder}/payloads/{name}"), said["payload"])
        if _facts(table) != (said["rows"], said["digest"]):
            raise ValueError(f"table {name} of the bundle is not what its manifest says")
        out[name] = table
    return out
