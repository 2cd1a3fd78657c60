"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two documents are linked if the sets of their five-word shingles (lowercased words
between ASCII white space) have Jaccard similarity of at least 0.8.

1. Texts with the same words (two 64-bit hashes of the whole word sequence) form one copy
   class; only one row of it goes on, known by a row number, so rows that share a doc_id
   but not their words stay apart.
2. MinHash signatures (128 values) are cut into 32 bands of 4. Every pair at 0.8 meets in
   a band but for a chance of 5e-8. Band buckets are star edges, components of which are
   families: all links lie within a family.
3. Within a family pairs compare MinHash values step by step and are dropped once the
   posterior probability (uniform prior) that their similarity reaches the threshold
   is below 1e-9. A large family is cut into blocks, and each pair of blocks is a unit of
   work of its own, so no group is gathered whole and no pair is emitted. Signatures alone
   are dealt to the units first; shingle sets follow only for texts that have a surviving
   pair there, and decide it exactly. A unit returns its members' link counts and a spanning
   forest of its links.
4. Components of the forests are the classes.

Counting the links of k different texts that are all alike needs their pairs: a unit holds
2 BLOCK of them, so each signature (512 bytes) is dealt k / BLOCK times.

Cases: a text of one to four words has the one shingle of all its words; a null, empty or
wordless text has none and is linked to nothing (not even to its like); very long texts are
read whole; rows with null doc_id are given null class and no links; repeated rows are
copies of each other; rows of one doc_id with different texts are different documents, and
each row gets the class and links of its own text. Other columns are dropped by ``join`` and
kept by ``keep_one``. Empty tables give no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .components import components
from .tables import bounded_batches, materialize, read

WORDS, THRESHOLD = 5, 0.8
HASHES, BANDS = 128, 32
TOLERANCE = 1e-9
STEPS = (16, 32, 64, 96, 128)
BLOCK = 1024
#: rows (representatives, as often as they are dealt) handled in one Python call, on average
PACK = 1000
_A = np.random.default_rng(7).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches of n MinHash values at which P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is the
    lower tail of Binomial(n + 1, threshold) at m.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes in text order, bounds by text, word hashes, word bounds)."""
    starts, ends, bounds = at.split_words(data, offsets)
    h = at.hash_spans(data, starts, ends)
    first, owner = at.window_starts(bounds, words)
    out = at.rolling(h, words)[first] if len(first) else np.zeros(0, np.uint64)
    size = np.diff(bounds)
    short = np.flatnonzero((size > 0) & (size < words))
    if len(short):  # all words of a short text make one shingle
        extra = np.array([at.rolling(h[bounds[i] : bounds[i + 1]], int(size[i]))[0] ^ np.uint64(size[i]) for i in short], np.uint64)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, np.searchsorted(owner, np.arange(len(size) + 1)), h, bounds


def minhash(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, HASHES) of 32-bit MinHash values; texts without shingles have zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        cut, held = bounds[full], np.empty_like(sh)
        for k in range(HASHES):
            np.multiply(sh, _A[k], out=held)
            out[full, k] = np.minimum.reduceat(held, cut) >> np.uint64(32)
    return out


def _word_keys(h: np.ndarray, wb: np.ndarray) -> list[np.ndarray]:
    """Order-sensitive sums of word hashes: two hashes of the whole word sequence of each text."""
    place = (np.arange(len(h)) - np.repeat(wb[:-1], np.diff(wb))).astype(np.uint64)
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(at.mix(h ^ at.mix(place + np.uint64(salt))), out=total[1:])
        keys.append((total[wb[1:]] - total[wb[:-1]]).astype(np.int64))
    return keys


def _signatures(batches):
    for batch in batches:
        for part in at.slices(batch, "text"):
            sh, bounds, h, wb = shingles(*at.text_bytes(part.column(2)))
            sig = minhash(sh, bounds)
            keys = _word_keys(h, wb)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys[0]), pa.array(keys[1]), pa.array(np.diff(wb), pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "text_hash", "k1", "k2", "n_words", "sig"])


def _bands(batches):
    rows = HASHES // BANDS
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, HASHES).astype(np.uint64)
        key = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = at.mix(key ^ sig[:, r::rows])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(key.ravel().astype(np.int64))], names=["rep", "band"])


def _candidate_sets(batches):
    """(word keys, shingle set as sorted 64-bit values) of texts."""
    for batch in batches:
        for part in at.slices(batch, "text"):
            sh, bounds, h, wb = shingles(*at.text_bytes(part.column(0)))
            sets = [np.unique(sh[bounds[i] : bounds[i + 1]]).tobytes() for i in range(part.num_rows)]
            keys = _word_keys(h, wb)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(sets, pa.binary())], names=["k1", "k2", "shingles"])


def _survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in left, j in right) that Bayesian pruning leaves; i < j within one list."""
    least = {n: least_matches(n) for n in STEPS}
    same = np.zeros((len(left), len(right)), np.uint8)
    for k in range(STEPS[0]):
        same += sig[left, k][:, None] == sig[right, k][None, :]
    i, j = np.nonzero(same >= least[STEPS[0]])
    count = same[i, j].astype(np.int32)
    i, j = left[i], right[j]
    if left is right:
        keep = i < j
        i, j, count = i[keep], j[keep], count[keep]
    for a, b in zip(STEPS, STEPS[1:]):
        count = count + np.concatenate([(sig[i[s : s + 65536], a:b] == sig[j[s : s + 65536], a:b]).sum(axis=1) for s in range(0, max(len(i), 1), 65536)])
        keep = count >= least[b]
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def _verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs have exact Jaccard similarity of at least threshold."""
    if not len(i):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets])
    if len(i) < 2000:
        inter = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    else:  # many pairs of few texts: products of 0/1 matrices, some columns at a time
        used = np.unique(np.concatenate([i, j]))
        row = np.zeros(len(sets), int)
        row[used] = np.arange(len(used))
        values = np.concatenate([sets[k] for k in used])
        who = np.repeat(np.arange(len(used)), size[used])
        _, code, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[code] > 1
        code, who = code[shared], who[shared]
        place = np.cumsum(times > 1) - 1
        code = place[code]
        order = np.argsort(code, kind="stable")
        code, who = code[order], who[order]
        total = np.zeros((len(used), len(used)), np.float32)
        width = 4096
        for c in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, [c, c + width])
            m = np.zeros((len(used), width), np.float32)
            m[who[a:b], code[a:b] - c] = 1
            total += m @ m.T
        inter = total[row[i], row[j]]
    return inter >= threshold * (size[i] + size[j] - inter) - 1e-9


def _sides(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a unit's two blocks; the same array twice if it has one."""
    kinds = np.unique(blocks)
    left = np.flatnonzero(blocks == kinds[0])
    return left, left if len(kinds) == 1 else np.flatnonzero(blocks == kinds[1])


def _unit(reps: np.ndarray, copies: np.ndarray, blocks: np.ndarray, sig: np.ndarray, sets: list[np.ndarray]):
    """Links of one family, or between two blocks of one: (rep, linked copies, parent) rows."""
    i, j = _survivors(sig, *_sides(blocks))
    ok = _verify(sets, i, j)
    i, j = i[ok], j[ok]
    links = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
    parent = np.arange(len(reps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    top = np.array([root(k) for k in range(len(reps))], int)
    touched = np.flatnonzero(links > 0)
    return reps[touched], links[touched].astype(np.int64), reps[top[touched]]


def _units(table):
    """(rows of one unit, its signatures) for each unit of a pack with two members or more."""
    unit = table["unit"].to_numpy()
    order = np.lexsort((table["rep"].to_numpy(), unit, table["family"].to_numpy()))
    family, unit = table["family"].to_numpy()[order], unit[order]
    sigs = table["sig"].to_pylist()
    new = np.append(True, (unit[1:] != unit[:-1]) | (family[1:] != family[:-1])) if len(unit) else np.zeros(0, bool)
    cut = np.append(np.flatnonzero(new), len(unit))
    for a, b in zip(cut, cut[1:]):
        if b - a > 1:
            own = order[a:b]
            yield own, np.frombuffer(b"".join(sigs[k] for k in own), np.uint32).reshape(b - a, HASHES)


def _sieve(table):
    """Members of a pack's units that have a surviving pair there."""
    kept = [np.zeros(0, np.int64)]
    block = table["block"].to_numpy()
    for own, sig in _units(table):
        i, j = _survivors(sig, *_sides(block[own]))
        kept.append(own[np.unique(np.concatenate([i, j]))])
    out = table.select(["family", "unit", "blocks", "block", "rep"]).take(pa.array(np.concatenate(kept)))
    at.release()
    return out


def _pack(table):
    """Links of all units of one pack."""
    reps, copies, blocks = (table[c].to_numpy() for c in ("rep", "copies", "block"))
    sets, out = table["shingles"].to_pylist(), []
    for own, sig in _units(table):
        out.append(_unit(reps[own], copies[own], blocks[own], sig, [np.frombuffer(sets[k], np.uint64) for k in own]))
    cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    del sets
    at.release()
    return pa.table({"rep": pa.array(cols[0], pa.int64()), "links": pa.array(cols[1], pa.int64()), "parent": pa.array(cols[2], pa.int64())})


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs, a row for each copy class): both have the word keys."""
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.lower(F.col("text")).alias("text"))
    rows = texts.mapInArrow(_signatures, "doc_id long, text_hash long, k1 long, k2 long, n_words long, sig binary")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "signatures")  # numbers that stay, once written
    known = rows.where("doc_id is not null and n_words > 0")
    classes = materialize(known.groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies")), "classes")
    reps = known.select(F.col("row").alias("rep"), "sig").join(classes.hint("shuffle_hash"), "rep")
    reps = materialize(reps.select("rep", "copies", "k1", "k2", F.col("first.doc_id").alias("doc_id"), "sig"), "representatives")

    banded = materialize(reps.select("rep", "sig").mapInArrow(_bands, "rep long, band long"), "bands")
    buckets = banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    families = components(banded.join(buckets, "band").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    families = families.select(F.col("u").alias("rep"), F.col("label").alias("family"))

    # blocks: a family of k representatives is dealt into ceil(k / BLOCK) blocks by hash
    sizes = families.groupBy("family").agg(F.count("*").alias("k")).select("family", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    member = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(reps.drop("doc_id"), "rep")
    member = materialize(member, "families")
    low, high = F.least("block", "other").cast("long"), F.greatest("block", "other")
    dealt = member.select("family", "blocks", "block", "rep", "sig").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("unit", low * F.col("blocks") + high)

    def packed(df: DataFrame, rows_: int) -> DataFrame:
        return df.withColumn("pack", F.pmod(F.xxhash64("family", "unit"), F.lit(max(1, rows_ // PACK)))).groupBy("pack")

    near = packed(dealt, member.agg(F.sum("blocks")).first()[0] or 0).applyInArrow(_sieve, "family long, unit long, blocks int, block int, rep long")
    near = materialize(near, "near")
    wanted = near.select("rep").distinct()
    texts_of = reps.select("rep", "doc_id", "k1", "k2").join(wanted, "rep", "left_semi")
    sets = texts.join(texts_of.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(_candidate_sets, "k1 long, k2 long, shingles binary")
    sets = sets.join(texts_of.select("rep", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["rep"]).select("rep", "shingles")
    held = near.join(member.select("rep", "copies", "sig"), "rep").join(sets, "rep")
    found = packed(held, near.count()).applyInArrow(_pack, "rep long, links long, parent long")
    found = materialize(found, "links")

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("rep").alias("u"), F.col("parent").alias("v")))
    by_class = classes.join(linked, "rep", "left").join(label.withColumnRenamed("u", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = by_class.where("links is not null").groupBy("label").agg(F.min("first").alias("keeper"))
    by_class = by_class.join(least, "label", "left")
    by_class = by_class.select("k1", "k2", "first", F.coalesce("keeper", "first").alias("keeper"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "text_hash", "k1", "k2", "n_words"), by_class


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, representative, n_links for every row of docs (doc_id, text).

    class_id: least doc_id of the documents connected by links. representative: least
    doc_id of those with the same words. n_links: rows linked to this one, copies included.
    """
    rows, by_class = _linked(docs)
    real = F.expr("doc_id is not null and n_words > 0")
    return rows.join(by_class, ["k1", "k2"], "left").select(
        "doc_id",
        F.when(real, F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(real, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("representative"),
        F.when(real, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each class the row of the least doc_id stays (ties: the
    least text hash), and of rows that repeat id and text one. Rows with null doc_id stay."""
    rows, by_class = _linked(docs)
    known = rows.where("doc_id is not null")
    lost = known.where("n_words > 0").join(by_class, ["k1", "k2"]).where("keeper.doc_id <> doc_id or keeper.text_hash <> text_hash")
    lost = materialize(lost.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "lost")
    twice = materialize(known.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).count().where("count > 1").drop("count"), "twice")
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__own") == F.col("__hash"))
    # both sides grow with the documents: always a merge of two shuffles, at every size
    kept = docs.withColumn("__own", F.xxhash64("text")).join(lost.hint("merge"), same, "left_anti")
    if twice.take(1):
        once = kept.join(twice, same, "left_anti")
        kept = once.unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__own"]))
    return kept.drop("__own")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of every document."""
    return join(read(spark, sf_dir, "documents"))
