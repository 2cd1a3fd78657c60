"""Binary signatures, int8 vectors, prefix cosine and weighted reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import materialized


def sign_words(v: Column, dims: int) -> Column:
    """Sign bits packed into 64-bit words; a component >= 0 sets its bit."""
    bit = lambda i: F.when(F.element_at(v, i + 1) >= 0, F.shiftleft(F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))
    words = []
    for w in range(0, dims, 64):
        acc = bit(w)
        for i in range(w + 1, min(w + 64, dims)):
            acc = acc.bitwiseOR(bit(i))
        words.append(acc)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_topk(vectors: DataFrame, query: list[int], dims: int, k: int) -> DataFrame:
    """vectors (id, words): the k nearest to the query's words by (hamming, id)."""
    q = F.array(*(F.lit(w).cast("long") for w in query))
    h = hamming(F.col("words"), q)
    return vectors.select("id", h.alias("hamming"), (dims - 2 * h).alias("similarity")).orderBy("hamming", "id").limit(k)


#: words of all signatures of a block, at most (8 MB)
BLOCK_WORDS = 1 << 20


def hamming_neighbours(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, id, hamming): the k other rows nearest to each query row of vectors (id, words), by (hamming, id).

    Queries and rows may both be many: queries are dealt into groups and rows into blocks of
    bounded size, a unit is one group against one block and gives its k best for each query,
    and the best of all blocks are kept. Rows with a null id or words take no part; words of
    one length are compared with each other; repeated rows are rows of their own.
    """
    rows = vectors.where("id is not null and words is not null").select("id", F.col("words").cast("array<bigint>").alias("words"), F.size("words").alias("width"), F.monotonically_increasing_id().alias("row"))
    rows = materialized(rows.where("width > 0"), "signatures")
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).where("q > 0").withColumnRenamed("width", "of_width")
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_WORDS) / F.col("of_width")))
    sizes = sizes.select("of_width", F.ceil(F.col("n") / most).cast("int").alias("blocks"), F.ceil(F.col("q") / most).cast("int").alias("groups"))
    dealt = rows.join(sizes, F.col("width") == F.col("of_width"))
    mixed, unit = F.xxhash64("row"), ["width", "group", "block"]
    asks = dealt.where(is_query).withColumn("group", F.pmod(F.shiftrightunsigned(mixed, 32), F.col("groups")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    held = dealt.withColumn("block", F.pmod(mixed, F.col("blocks")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("query", F.lit(False))
    both = asks.unionByName(held).select(*unit, "row", "id", "words", "query")

    def nearest(table: pa.Table) -> pa.Table:
        query, width = table["query"].to_numpy(), table["width"][0].as_py()
        words = table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
        row, name = table["row"].to_numpy(), table["id"].to_numpy()
        own = np.flatnonzero(~query)
        own = own[np.lexsort((row[own], name[own]))]
        out = [np.zeros((5, 0), np.int64)]
        for a in np.flatnonzero(query).tolist():
            h = np.bitwise_count(words[own] ^ words[a]).sum(axis=1, dtype=np.int64)
            h[row[own] == row[a]] = 64 * width + 1  # itself comes last
            best = np.argsort(h, kind="stable")[:k]
            best = best[h[best] <= 64 * width]
            out.append(np.stack([np.full(len(best), row[a]), np.full(len(best), name[a]), row[own[best]], name[own[best]], h[best]]))
        cols = np.concatenate(out, axis=1)
        return pa.table(dict(zip(("query_row", "query_id", "row", "id", "hamming"), map(pa.array, cols))))

    kind = vectors.schema["id"].dataType.simpleString()
    found = both.withColumn("id", F.col("id").cast("long")).groupBy(*unit).applyInArrow(nearest, "query_row long, query_id long, row long, id long, hamming long")
    nth = F.row_number().over(W.partitionBy("query_row").orderBy("hamming", "id", "row"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("query_id").cast(kind).alias("query_id"), F.col("id").cast(kind).alias("id"), F.col("hamming").cast("int").alias("hamming"))


def int8(v: Column) -> tuple[Column, Column]:
    """(int8 components, scale): scaled so that the largest magnitude is 127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    q = F.transform(v, lambda x: F.when(top == 0, F.lit(0)).otherwise(F.round(x.cast("double") / top * 127)).cast("int"))
    return q, top / 127


def prefix_cosine(a: Column, b: Column, dims: int) -> Column:
    """Cosine of int8 prefixes mapped to 0..1; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, 1, dims), F.slice(y, 1, dims), lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise((dot(a, b) / norm + 1) / 2)


def rerank_score() -> Column:
    """Weighted sum of text_score, vector_score, stage1 and metadata_score; 10 more for an exact seed."""
    unit = lambda c: F.least(F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    stage1 = unit(F.col("stage1") / 512 + 0.5)
    return 0.35 * unit(F.col("text_score")) + 0.35 * unit(F.col("vector_score")) + 0.20 * stage1 + 0.10 * unit(F.col("metadata_score")) + F.when(F.col("exact_seed"), 10.0).otherwise(0.0)


def rerank(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, text_score, vector_score, stage1, metadata_score, exact_seed): weighted sum,
    exact seeds first; seeds cut by the limit come back with score 10."""
    ranked = rows.select("id", "exact_seed", F.round(rerank_score(), 6).alias("score"))
    kept = ranked.orderBy(F.desc("score"), F.desc("exact_seed"), "id").limit(k)
    cut = ranked.where("exact_seed").join(kept.select("id"), "id", "left_anti").withColumn("score", F.lit(10.0))
    return kept.unionByName(cut)
