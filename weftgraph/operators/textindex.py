"""A stored inverted index: postings with positions, in segments that are added and merged.

On the shared folder an index has
  postings/segment=s/bucket=b   (term, id, dl, at): the places of a term in a document of dl terms;
                                a term's bucket is its hash, so a query reads its terms' buckets only
  documents/segment=s           (id, dl)
  deleted/segment=s             (id): documents of earlier segments that this one replaces or deletes
  manifest/version=v            one row, written last: the segments in force and the live documents'
                                number and length, so a search needs no pass over the documents

A batch of new, changed or deleted documents becomes one segment; nothing that was written is
changed. A posting counts if its segment is in force and no later one has deleted its document.
``merge`` writes the live postings of all segments as one. A reader keeps the version that it
opened; a failed write leaves no manifest and so changes nothing. One writer at a time.

A term that most documents have fills its bucket; a bucket's rows are dealt to SALT_DOCS
documents a file, so such a term is written and read by many tasks.

Cases: rows with a null id are left out; of rows that share an id in one batch the greatest
text is kept; null and empty texts are documents of no terms; very long texts are one row a
term, with all its places; deleting what isn't there changes nothing; extra columns are
dropped; an empty index finds nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..sources.shared import materialized, shared_path
from .search import fts_terms, query_phrases

BUCKETS = 64
#: documents whose postings of one bucket share a task, about
SALT_DOCS = 500_000
POSTING = "term string, id string, dl long, at array<int>, segment int, bucket int"
DOCUMENT = "id string, dl long, segment int"
DELETED = "id string, segment int"
MANIFEST = "segments array<int>, next int, n long, total long, buckets int, version int"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: terms that are sorted at a time, about; a document is never cut
TERMS_AT_ONCE = 2_000_000


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, id, dl, at) of rows (id, dl, terms). A document's places are all in its row, so they are
    put together where it is read; a row a place is never made."""
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + TERMS_AT_ONCE, side="right")))
            part = batch.slice(start, end - start)
            start = end
            terms = part.column("terms")
            flat, owner = terms.flatten().dictionary_encode(), pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            code = flat.indices.to_numpy(zero_copy_only=False)
            first = np.searchsorted(owner, np.arange(part.num_rows))
            order = np.lexsort((code, owner))  # stable: a term's places stay in order
            code, owner, at = code[order], owner[order], (order - first[owner[order]]).astype(np.int32)
            heads = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
            row = pa.array(owner[heads])
            yield pa.RecordBatch.from_arrays([
                flat.dictionary.take(pa.array(code[heads])), part.column("id").take(row), part.column("dl").take(row), pa.ListArray.from_arrays(pa.array(np.r_[heads, len(at)].astype(np.int32)), pa.array(at)),
            ], names=["term", "id", "dl", "at"])


def _moved(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(k))


@dataclass(frozen=True)
class TextIndex:
    """One version of an index; ids are strings."""

    spark: SparkSession
    root: str
    segments: tuple[int, ...]
    next_segment: int
    n: int
    total: int
    buckets: int
    version: int

    @staticmethod
    def create(spark: SparkSession, root: str | None = None, buckets: int = BUCKETS) -> TextIndex:
        """An empty index in a new folder."""
        return TextIndex(spark, root or shared_path(spark, "text-index"), (), 0, 0, 0, buckets, -1)._commit()

    @staticmethod
    def open(spark: SparkSession, root: str) -> TextIndex:
        """The newest version of the index in a folder."""
        r = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("version")).first()
        return TextIndex(spark, root, tuple(r["segments"]), r["next"], r["n"], r["total"], r["buckets"], r["version"])

    def _commit(self) -> TextIndex:
        row = [(list(self.segments), self.next_segment, self.n, self.total, self.buckets)]
        self.spark.createDataFrame(row, MANIFEST.removesuffix(", version int")).coalesce(1).write.parquet(f"{self.root}/manifest/version={self.version + 1}")
        return TextIndex(self.spark, self.root, self.segments, self.next_segment, self.n, self.total, self.buckets, self.version + 1)

    # ---- reading

    def _live(self, table: str, schema: str) -> DataFrame:
        """Rows of the segments in force whose document no later segment has deleted."""
        if not self.segments:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{table}").where(F.col("segment").isin(list(self.segments)))
        if len(self.segments) == 1:
            return rows
        gone = self.spark.read.schema(DELETED).parquet(f"{self.root}/deleted").where(F.col("segment").isin(list(self.segments[1:])))
        gone = gone.groupBy(F.col("id").alias("gone")).agg(F.max("segment").alias("until"))
        return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("segment") < F.col("until")), "left_anti")

    def documents(self) -> DataFrame:
        """(id, dl) of all live documents."""
        return self._live("documents", DOCUMENT).select("id", "dl")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, id, dl, at) of the live postings, of these terms only; reads their buckets."""
        live = self._live("postings", POSTING)
        if terms is not None:
            own = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets)).distinct().collect()]  # the query's terms
            live = live.where(F.col("bucket").isin(own) & F.col("term").isin(terms))
        return live.select("term", "id", "dl", "at")

    def matches(self, phrases: list[tuple[str, ...]]) -> DataFrame:
        """(id, dl, tf): documents that have one of the phrases, and how often each; a phrase is
        its terms one after another, occurrences may overlap."""
        terms = sorted({t for p in phrases for t in p})
        found = self.postings(terms).groupBy("id").agg(F.first("dl").alias("dl"), *(F.first(F.when(F.col("term") == t, F.col("at")), ignorenulls=True).alias(f"t{k}") for k, t in enumerate(terms)))
        none = F.expr("cast(array() as array<int>)")
        places = lambda t: F.coalesce(F.col(f"t{terms.index(t)}"), none)
        counts = []
        for p in phrases:
            starts = places(p[0])
            for k, t in enumerate(p[1:], 1):
                starts = F.array_intersect(starts, _moved(places(t), k))
            counts.append(F.size(starts))
        return found.select("id", "dl", F.array(*counts).alias("tf")).where(F.exists("tf", lambda x: x > 0))

    def search(self, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score): the k best live documents by BM25 over the query's phrases."""
        phrases = query_phrases(query)
        if not phrases or not self.n:
            return self.spark.createDataFrame([], "id string, score double")
        hits = materialized(self.matches(phrases), "hits")
        df = hits.agg(*(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(phrases)))).first()
        mean, score = self.total / self.n or 1.0, F.lit(0.0)
        for i in range(len(phrases)):
            tf, idf = F.col("tf")[i], max(math.log((self.n - df[i] + 0.5) / (df[i] + 0.5)), 1e-6)
            score = score + F.lit(idf) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / mean))
        return hits.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def phrase(self, text: str) -> DataFrame:
        """(id, tf): live documents that hold the terms of text one after another, and how often."""
        terms = tuple(re.findall("[a-z0-9]+", text.lower()))
        if not terms:
            return self.spark.createDataFrame([], "id string, tf int")
        return self.matches([terms]).select("id", F.col("tf")[0].alias("tf"))

    # ---- writing

    def _write(self, segment: int, postings: DataFrame, documents: DataFrame, n: int) -> None:
        salt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 + n // SALT_DOCS))
        postings = postings.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).repartition("bucket", salt)
        postings.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{self.root}/postings/segment={segment}")
        documents.select("id", "dl").write.parquet(f"{self.root}/documents/segment={segment}")

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> TextIndex:
        """The index after changed documents (id, text) were put in for those of their ids, and
        deleted ones (id) taken out; an id in both is put in."""
        s = self.next_segment
        empty = self.spark.createDataFrame([], "id string, text string")
        rows = (empty if changed is None else changed).where("id is not null").select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        rows = rows.groupBy("id").agg(F.max("text").alias("text")).select("id", fts_terms(F.col("text")).alias("terms"))
        rows = materialized(rows.withColumn("dl", F.size("terms").cast("long")), "terms")
        out = rows.select("id")
        if deleted is not None:
            out = out.unionByName(deleted.select(F.col("id").cast("string").alias("id")))
        gone = materialized(self.documents().join(out.distinct(), "id", "left_semi"), "gone")
        postings = rows.select("id", "dl", "terms").mapInArrow(_postings_of, "term string, id string, dl long, at array<int>")
        added, lost = (df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first() for df in (rows, gone))
        self._write(s, postings, rows, added[0])
        gone.select("id").write.parquet(f"{self.root}/deleted/segment={s}")
        return TextIndex(self.spark, self.root, (*self.segments, s), s + 1, self.n + added[0] - lost[0], self.total + added[1] - lost[1], self.buckets, self.version)._commit()

    def merge(self) -> TextIndex:
        """The same documents in one segment."""
        if len(self.segments) < 2:
            return self
        s = self.next_segment
        self._write(s, self.postings(), self.documents(), self.n)
        self.spark.createDataFrame([], "id string").write.parquet(f"{self.root}/deleted/segment={s}")
        return TextIndex(self.spark, self.root, (s,), s + 1, self.n, self.total, self.buckets, self.version)._commit()
