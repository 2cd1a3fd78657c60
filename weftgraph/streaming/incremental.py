"""Micro-batches: changed-file upserts and event-log replay with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest
from ..sources.shared import shared_path


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole versions under root, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    done = [p.getName() for p in names if p.getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def stream_latest(spark: SparkSession, pattern: str, schema, keys: list[str], order: list[str], files_per_batch: int = 1, root: str | None = None) -> DataFrame:
    """Read what matches pattern as a stream, keep the latest row of each key in versioned
    tables (one for each micro-batch), and return the last version.

    A batch is idempotent: version n is made from the last version before it and batch n
    alone, so a batch that is tried again overwrites its own version. All state is in root:
    the stream's progress and the versions, so a call with the root of an earlier one goes on
    from there and reads new files only.
    """
    root = root or shared_path(spark, "stream")

    def step(batch: DataFrame, n: int) -> None:
        past = [v for v in _versions(batch.sparkSession, root) if v < n]
        rows = batch.sparkSession.read.schema(schema).parquet(f"{root}/v{past[-1]}").unionByName(batch) if past else batch
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{root}/v{n}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/progress").foreachBatch(step).start()
    query.awaitTermination()
    made = _versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v{made[-1]}") if made else spark.createDataFrame([], schema)


def replay(lines: DataFrame) -> DataFrame:
    """lines (pos, value) of a JSONL event log: aggregates for each run.

    Malformed lines count apart (run null); events without a required field count as valid
    and as incomplete; the status is that of the run's last event that has one.
    """
    schema = "run_id string, event_type string, tool string, status string, latency_ms long"
    e = lines.select("pos", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), "value")
    e = e.select("pos", "e.*", F.try_parse_json("value").isNull().alias("bad"))
    missing = F.col("run_id").isNull() | F.col("event_type").isNull() | F.col("status").isNull()
    return e.groupBy(F.when(~F.col("bad"), F.col("run_id")).alias("run_id")).agg(
        F.count(F.when(~F.col("bad"), 1)).alias("events"), F.count(F.when(F.col("bad"), 1)).alias("malformed"), F.count(F.when(~F.col("bad") & missing, 1)).alias("incomplete"),
        F.count_distinct("tool").alias("tools"), F.max_by("status", F.when(~F.col("bad") & F.col("status").isNotNull(), F.col("pos"))).alias("last_status"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_ms"),
    )
