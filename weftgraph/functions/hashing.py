"""FNV-1a hashes, stable ids and text signatures as Arrow-batched functions.

The wrapping 64-bit multiply overflows in ANSI SQL, so these run in numpy over whole
Arrow batches: one vector step for each byte position, not one call for each row.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

# fixed values
OFFSET, PRIME, LOW_SEED, GOLDEN = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B185EBCA87, 0x9E3779B97F4A7C15


def fnv_many(texts: list[bytes], seed: int) -> np.ndarray:
    size = np.array([len(t) for t in texts], np.int64)
    body = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    first = np.cumsum(size) - size
    h = np.full(len(texts), seed, np.uint64)
    for i in range(int(size.max()) if len(size) else 0):
        live = np.flatnonzero(size > i)
        h[live] = (h[live] ^ body[first[live] + i]) * np.uint64(PRIME)
    return h


_TOKEN = re.compile(r"[^A-Za-z0-9_.]+")


@pandas_udf(StringType())
def fnv64_hex(text: pd.Series) -> pd.Series:
    """FNV-1a 64 of the UTF-8 bytes, 16 hex digits; null stays null."""
    return pd.Series([None if t is None else f"{h:016x}" for t, h in zip(text, fnv_many([(t or "").encode() for t in text], OFFSET).tolist())])


@pandas_udf(StringType())
def stable_id(prefix: pd.Series, parts: pd.Series) -> pd.Series:
    """prefix and 128 bits over parts (joined by U+001F), each part NUL-terminated."""
    raw = [b"".join(p.encode() + b"\0" for p in (t or "").split("\x1f")) for t in parts]
    return pd.Series([f"{p}{a:016x}{b:016x}" for p, a, b in zip(prefix, fnv_many(raw, OFFSET).tolist(), fnv_many(raw, LOW_SEED).tolist())])


@pandas_udf(ArrayType(LongType()))
def signature256(text: pd.Series) -> pd.Series:
    """256 sign bits of seeded token hashes, a bit set where the vote is >= 0.

    Tokens of all texts of a batch are hashed at once, some hundred thousand at a time.
    """
    words = [[x for x in _TOKEN.split(t or "") if x] or ([t.strip()] if t and t.strip() else []) for t in text]
    bounds = np.append(0, np.cumsum([len(w) for w in words]))
    out = np.empty((len(words), 4), np.int64)
    start = 0
    while start < len(words):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + 200_000, "right")) - 1)
        place, distinct = pd.factorize(np.array([x.lower() for w in words[start:end] for x in w], object))
        raw = [x.encode() for x in distinct.tolist()]
        own = bounds[start : end + 1] - bounds[start]
        for w in range(4):
            h = fnv_many(raw, (OFFSET ^ (w * GOLDEN)) & (2**64 - 1))
            h ^= h >> np.uint64(32)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(h) else np.zeros((0, 64), np.uint8)
            total = np.zeros((len(place) + 1, 64), np.int32)
            np.cumsum(bits[place], axis=0, out=total[1:], dtype=np.int32)
            ones = total[own[1:]] - total[own[:-1]]
            out[start:end, w] = np.packbits(2 * ones >= np.diff(own)[:, None], axis=1, bitorder="little").view(np.int64).ravel()
        start = end
    return pd.Series(out.tolist())


def int8_of_text(dims: int):
    """A function of a text: dims components, each the sum of its tokens' low hash bytes less 128, within -127..127.

    Tokens are as in ``signature256``, hashed with the component's number as seed; a text
    without tokens is hashed whole, trimmed, and an empty one has zeros.
    """

    @pandas_udf(ArrayType(IntegerType()))
    def vectors(text: pd.Series) -> pd.Series:
        words = [[x for x in _TOKEN.split(t or "") if x] or ([t.strip()] if t and t.strip() else []) for t in text]
        bounds = np.append(0, np.cumsum([len(w) for w in words]))
        distinct, place = np.unique(np.array([x.translate(_LOWER) for w in words for x in w], object), return_inverse=True)
        raw = [x.encode() for x in distinct.tolist()]
        out = np.zeros((len(words), dims), np.int64)
        for d in range(dims):
            h = fnv_many(raw, OFFSET ^ ((d * GOLDEN) & (2**64 - 1)))
            total = np.zeros(len(place) + 1, np.int64)
            np.cumsum((((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.int64) - 128)[place], out=total[1:])
            out[:, d] = total[bounds[1:]] - total[bounds[:-1]]
        return pd.Series(np.clip(out, -127, 127).astype(np.int32).tolist())

    return vectors


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fact_digests(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact, label, facts, digest): a digest of all entities of each kind, of all edges of
    each relation, and of the whole graph.

    Order plays no part and no task gathers a relation: canonical lines are hashed, hashes
    are summed with their number in 256 ranges, and only the ranges' sums are gathered. Sums,
    unlike XOR, also see facts that are repeated.
    """
    line = lambda tag, *cols: F.concat_ws("|", F.lit(tag), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    span = F.concat("path", F.lit(":"), "line")
    c = F.col
    nodes = entities.select(F.lit("entity").alias("fact"), c("kind").alias("label"), line("entity", c("id"), c("kind"), c("name"), c("qualified_name"), c("path"), span).alias("line"))
    confidence = F.format_string("%.6f", "confidence")
    links = edges.select(F.lit("edge").alias("fact"), c("relation").alias("label"), line("edge", c("id"), c("head_id"), c("relation"), c("tail_id"), span, c("exactness"), confidence, c("edge_class"), c("context"), c("derived")).alias("line"))
    m = nodes.unionByName(links).select("fact", "label", F.md5(F.encode("line", "UTF-8")).alias("m"))
    part = lambda at: F.sum(F.conv(F.substring("m", at, 15), 16, 10).cast("decimal(20,0)"))
    ranges = m.groupBy("fact", "label", F.substring("m", 1, 2).alias("range")).agg(F.count("*").alias("n"), part(3).alias("s1"), part(18).alias("s2"))
    digest = lambda *cols: F.md5(F.encode(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *cols))), "\n"), "UTF-8"))
    labels = ranges.groupBy("fact", "label").agg(F.sum("n").alias("facts"), digest("range", "n", "s1", "s2").alias("digest"))  # at most 256 ranges
    # a row for each kind and relation
    return labels.unionByName(labels.agg(F.lit("graph").alias("fact"), F.lit("all").alias("label"), F.sum("facts").alias("facts"), digest("fact", "label", "facts", "digest").alias("digest")))
