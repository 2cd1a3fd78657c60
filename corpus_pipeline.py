"""Corpus pipeline: toxicity, near copies, repeated passages, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; ``run`` writes
each stage's rows to the shared folder and reads them back as the next one's docs.

Cases: a stage keeps rows that its operator can't judge (null or empty text, null doc_id);
repeated rows are copies of each other and the copy stage keeps one; rows of one doc_id with
different texts are different documents, of which the leak stage drops those that leak;
extra columns are carried along; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, jaccard_join, mixture, substring_dedup, toxicity
from weftgraph.llm.tables import materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (learned from the documents and labels at hand) doesn't reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="__toxic")
    return scored.where("__toxic < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the least doc_id."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id has as well."""
    found = substring_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item lies.

    Rows are told apart by id and text, as in the copy stage, so a row without an id goes if
    it leaks, and another text under a leaking row's id stays.
    """
    own = F.xxhash64("text")
    leaks = decontaminate.find_leaks(docs.select(F.struct("doc_id", own.alias("hash")).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    leaks = materialize(leaks.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.hash").alias("__hash")).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    return docs.withColumn("__own", own).join(leaks, same, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their leaf's budget reads them."""
    return mixture.mix(docs).select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("mixture", mix_sources),
]

#: the toxicity model can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
