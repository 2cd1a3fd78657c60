"""Full-text and symbol search: postings, BM25, overlap, substring scans, ranked symbols."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..sources.shared import materialized


def fts_terms(text: Column) -> Column:
    """Terms as the index splits them: ASCII-lowercased runs of letters and digits."""
    return F.filter(F.split(expr.ascii_lower(text), "[^a-z0-9]+"), lambda t: t != "")


def query_phrases(query: str) -> list[tuple[str, ...]]:
    """Query tokens (runs of [A-Za-z0-9_.] of two characters or more), each as the index terms
    that must follow one another: foo_bar is the phrase (foo, bar)."""
    found = (tuple(t for t in re.split(r"[^a-z0-9]+", token.lower()) if t) for token in re.split(r"[^A-Za-z0-9_.]+", query) if len(token) >= 2)
    return list(dict.fromkeys(p for p in found if p))


def query_terms(query: str) -> list[str]:
    """The distinct index terms of a query's tokens."""
    return list(dict.fromkeys(t for p in query_phrases(query) for t in p))


def bm25(docs: DataFrame, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): the k best documents; docs (id, text).

    One pass over the texts counts the terms of each and the occurrences of each query phrase
    by regular expressions, without making token lists; all that follows reads those counts.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    low = expr.ascii_lower(F.coalesce("text", F.lit("")))
    # a phrase's later terms are looked at, not consumed, so that occurrences may overlap
    rule = lambda p: "(?<![a-z0-9])" + p[0] + ("(?=[^a-z0-9]+" + "[^a-z0-9]+".join(p[1:]) + "(?![a-z0-9]))" if p[1:] else "(?![a-z0-9])")
    counted = docs.select("id", low.alias("low")).select("id", F.regexp_count("low", F.lit("[a-z0-9]+")).alias("dl"), F.array(*(F.regexp_count("low", F.lit(rule(p))) for p in phrases)).alias("tf"))
    counted = materialized(counted, "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(phrases)))).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i in range(len(phrases)):
        tf, idf = F.col("tf")[i], max(math.log((n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)), 1e-6)
        score = score + F.lit(idf) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))
    hit = F.exists("tf", lambda x: x > 0)
    return counted.where(hit).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def overlap(docs: DataFrame, query_tokens: list[str], k: int) -> DataFrame:
    """Share of the query's tokens that a document has, top k."""
    q = F.array(*map(F.lit, query_tokens))
    hit = F.size(F.array_intersect(q, F.array_distinct(expr.signature_tokens(F.col("text")))))
    return docs.select("id", F.round(hit / len(query_tokens), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def overlap_join(items: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(item_id, doc_id, overlap): all items (item_id, text) against all docs (doc_id, text),
    pairs in which the document has at least this share (over 0) of the item's distinct tokens.

    Of an item's n tokens m = ceil(least n) must be shared, so a match has one of any n - m + 1
    of them: its rarest are joined by equality with the documents' tokens. No match is lost.
    Pairs that meet are told apart by row and compared in full. Items and documents may both
    be many: nothing is collected, and what is broadcast is for the planner to decide by size.
    """
    tokens = lambda df, key, row: materialized(df.select(key, F.array_distinct(expr.signature_tokens(F.col("text"))).alias(row[0])).withColumn(row, F.monotonically_increasing_id()), row)
    q, k = tokens(items, "item_id", "q_row").where(F.size("q") > 0), tokens(docs, "doc_id", "k_row")
    asked = q.select("q_row", F.size("q").alias("n"), F.explode("q").alias("token"))
    held = materialized(k.select("k_row", F.explode("k").alias("token")).join(asked.select("token").distinct(), "token", "left_semi"), "held")
    ranked = asked.join(held.groupBy("token").agg(F.count("*").alias("df")), "token", "left")
    rare = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), F.lit(1), F.first(F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int"))
    prefix = ranked.groupBy("q_row").agg(rare.alias("rare")).select("q_row", F.explode("rare.token").alias("token"))
    pairs = prefix.join(held, "token").select("q_row", "k_row").distinct()
    share = F.size(F.array_intersect("q", "k")) / F.size("q")
    met = pairs.join(q, "q_row").join(k, "k_row").withColumn("share", share).where(F.col("share") >= least)
    return met.select("item_id", "doc_id", F.round("share", 6).alias("overlap"))


def source_scan(docs: DataFrame, needle: str, limit: int) -> DataFrame:
    """Lines that hold needle, ASCII case folded: (id, line, text)."""
    rows = docs.select("id", F.posexplode(F.split("text", "\n")).alias("at", "value"))
    return rows.where(expr.ascii_lower(F.col("value")).contains(needle.lower())).select("id", (F.col("at") + 1).alias("line"), "value").orderBy("id", "line").limit(limit)


def symbol_search(entities: DataFrame, query: str, k: int) -> DataFrame:
    """Additive ranking of (id, name, qualified_name, path) for a query string.

    exact name 140, qualified name 130, suffix 82, prefix 52, qualified prefix 38, path 36,
    token share times 42, subsequence 14.
    """
    q = query.lower()
    name, qname, path = (expr.ascii_lower(F.col(c)) for c in ("name", "qualified_name", "path"))
    tokens = sorted({t for t in re.sub("[^A-Za-z0-9]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", query)).lower().split() if len(t) >= 2})
    share = F.size(F.array_intersect(F.array(*map(F.lit, tokens or [""])), expr.symbol_tokens(F.col("qualified_name")))) / max(len(tokens), 1)
    sub = name.rlike(".*".join(re.escape(c) for c in q))
    pts = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    score = (
        pts(name == q, 140) + pts(qname == q, 130) + pts(qname.endswith(q) & (qname != q), 82) + pts(name.startswith(q) & (name != q), 52)
        + pts(qname.startswith(q) & (qname != q), 38) + pts(path.contains(q), 36) + 42 * share + pts(sub & (name != q), 14)
    )
    return entities.select("id", "qualified_name", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "qualified_name", "id").limit(k)
