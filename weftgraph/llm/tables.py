"""Reading tables, the shared folder, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window as W

from ..sources.shared import materialized as materialize  # noqa: F401  (for the operators)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def held_out(doc_id: Column, k: int, r: int) -> Column:
    return F.coalesce(fold(doc_id, k) == r, F.lit(False))


def sample_ids(labelled: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """(doc_id, label, seen): at most per_class documents of each label value, those with the
    smallest seeded hash; seen is the number of rows that carry the value.

    labelled has doc_id and the label; rows with a null in either are left out. A document
    counts once under each of its values, however many rows say so. Values are not limited
    in number: documents are counted by value (partially aggregated), a value with many is
    first thinned by a bound on the hash to about twice per_class, and only then ranked, so
    no class is gathered whole.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(label, "doc_id").agg(F.count("*").alias("times"))
    counts = rows.groupBy(label).agg(F.sum("times").alias("seen"), F.count("*").alias("distinct"))
    # place of the hash in 0..1; a share of 2 k / n keeps fewer than k with a chance of e**(-k/4)
    place = F.xxhash64(F.col("doc_id"), F.lit(seed)) / F.lit(float(1 << 64)) + 0.5
    near = rows.join(counts, label).where(place <= F.lit(2.0 * per_class + 200) / F.col("distinct"))
    ranked = near.withColumn("__rank", F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")))
    return ranked.where(F.col("__rank") <= per_class).select("doc_id", label, "seen")


#: ids that may be broadcast, about 30 bytes each; more are joined by a shuffle
BROADCAST_IDS = 1_000_000


def sample_texts(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, seen, text) of the sampled documents, one row for each of ids.

    Of several texts under one doc_id the smallest is taken (null counts as empty); ids
    without a document are left out. Texts are whole, however long: only their number is
    bounded, so what is learned keeps features of them, taken slice by slice, not the texts.
    """
    ids = materialize(ids, "sample")
    few = ids.count() <= BROADCAST_IDS
    docs = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.join(F.broadcast(ids) if few else ids, "doc_id")
    return found.groupBy("doc_id", label, "seen").agg(F.min("text").alias("text"))


def extended(schema: StructType, *more: tuple[str, str]) -> StructType:
    """A copy of schema with columns added; columns of the same name are replaced."""
    names = {n for n, _ in more}
    return StructType([f for f in schema.fields if f.name not in names] + [StructField(n, _parse_datatype_string(t)) for n, t in more])


#: rows of text that a Python worker gets at once; whole documents are a few kB each
ARROW_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after seeing to it that its session sends Python workers small Arrow batches.

    The default of 10,000 rows is some 100 MB of documents for each running task, in the
    JVM and again in Python. A session that asks for less is left as it is. The setting is
    the session's, as Spark has none for a single plan: it holds for later plans as well.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df
