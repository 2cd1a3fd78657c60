"""The edge store: edges as steps in both directions, laid out for traversal.

A step table has from, to and direction beside an edge's columns. Each edge is stored once,
by relation, as it comes: neither dealt by its nodes nor written for both directions, which
would move several times the tables. A step table reads it from either end; a traversal
reads the relations that it follows and meets them with its frontier, which is small. It is
written once for an application and the files of an input folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from . import projection
from .shared import shared_path

T = TypeVar("T")
#: steps in one bucket of nodes, about
BUCKET_STEPS = 4_000_000
#: relations that a task writes side by side; with more, it sorts
WRITERS = 24
_KNOWN: dict[tuple, object] = {}


def snapshot(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of a folder's files: what is kept for it holds only while these stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(path, True)
    files = []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(files))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What make writes for this application and the present files of sf_dir, made at first use."""
    key = (spark.sparkContext.applicationId, name, sf_dir, snapshot(spark, sf_dir))
    if key not in _KNOWN:
        _KNOWN[key] = make()
    return _KNOWN[key]


def bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def as_steps(edges: DataFrame) -> DataFrame:
    """Every edge twice: from head to tail, and back."""
    if "context" not in edges.columns:
        edges = edges.withColumn("context", expr.edge_context(F.col("relation"), F.col("path"), F.col("head_id"), F.col("tail_id")))
    way = lambda name, a, b: edges.select("id", "relation", "exactness", "confidence", "context", F.lit(name).alias("direction"), F.col(a).alias("from"), F.col(b).alias("to"))
    # a union, so that what is asked of direction and relation is asked of either side's files
    return way("forward", "head_id", "tail_id").unionByName(way("reverse", "tail_id", "head_id"))


def write_steps(edges: DataFrame) -> DataFrame:
    """The step table of edges, written to the shared folder."""
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "steps")
    if "context" not in edges.columns:
        edges = edges.withColumn("context", expr.edge_context(F.col("relation"), F.col("path"), F.col("head_id"), F.col("tail_id")))
    kept = edges.select("id", "relation", "exactness", "confidence", "context", "head_id", "tail_id").write.partitionBy("relation")
    # a writer for each of a few relations: rows aren't sorted by relation, which spills
    writers, was = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
    spark.conf.set(writers, str(WRITERS))
    try:
        kept.parquet(path)
    finally:
        spark.conf.set(writers, was)
    stored = spark.read.schema("id string, exactness string, confidence double, context string, head_id string, tail_id string, relation string").parquet(path)
    buckets = 1 + 2 * stored.count() // BUCKET_STEPS
    return as_steps(stored).withColumn("bucket", bucket(F.col("from"), buckets)).withMetadata("bucket", {"buckets": buckets})


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step table of the projected edges of sf_dir."""
    return once(spark, sf_dir, "steps", lambda: write_steps(projection.edges(spark, sf_dir, whole=True)))
