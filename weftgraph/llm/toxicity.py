"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and 1-skip bigrams of the lowercased
text. FTRL-proximal gives every coordinate its own rate and, with the L1 term, exact
zeros, so what is broadcast is a list of (index, weight) whose length is bounded by the
hash space (2**BITS) and in practice is a few thousand.

The sample holds so many rows of each class at most; the bias is then moved by the log of
the ratio in which the two classes were thinned, so it is that of all labelled rows. How
much a positive row counts for against a negative one is a parameter (``positive``).

Cases: null or empty text has no feature and scores by the bias alone; very long texts are
read whole, a slice at a time; repeated rows score alike and equal texts tie; labels that
are null, or whose document is absent, are not learned from, and a document with both
labels counts under each; with no labelled row at all the model is one bias of -1, so
every score is 0.269 and nothing is predicted toxic. Extra columns are kept by ``score``
and never read, one named like the output is replaced. Tables without rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import bounded_batches, extended, held_out, read, sample_ids, sample_texts

BITS = 20
#: documented bound on what is learned from: rows of each class
SAMPLE_PER_CLASS = 6000
SEED = 10


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.0
    epochs: int = 5
    #: a feature is learned if so many sample texts have it; others only blur the credit
    min_texts: int = 5
    #: weight of a positive row's gradient
    positive: float = 4.0


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights of a logistic model; index lists are sorted."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature index, text index) of all n-grams and skip-grams, repeats included."""
    starts, ends, bounds = at.split_words(data, offsets, at.NON_ALNUM)
    h = at.hash_spans(data, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    shift = np.uint64(64 - BITS)
    found, texts = [at.mix(h) >> shift], [owner]
    for gap, salt in ((1, 0x51), (2, 0xA7)):  # bigram, skip-gram
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = at.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(salt)) >> shift
            found.append(pair[same])
            texts.append(owner[:-gap][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(texts)


def _by_text(index: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct feature indexes of each text."""
    key = np.unique((owner.astype(np.int64) << BITS) | index)
    cut = np.searchsorted(key >> BITS, np.arange(n + 1))
    key &= (1 << BITS) - 1
    return [key[cut[i] : cut[i + 1]].astype(np.int32) for i in range(n)]


def fit_rows(rows: list[np.ndarray], y: np.ndarray, p: Ftrl = Ftrl(), seen: dict[float, float] | None = None) -> ToxicityModel:
    """Per-coordinate FTRL-proximal over one pass per epoch; the order is fixed by the seed.

    seen: rows of each class among all labelled ones, if these rows are a sample.
    """
    size = (1 << BITS) + 1  # the last is the bias, free of L1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1
    order_of = np.random.default_rng(SEED)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == bias, 0.0, p.l1)
        w = -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    texts = np.zeros(size, np.int32)
    for r in rows:
        texts[r] += 1  # indexes of a row are distinct
    rows = [np.append(r[texts[r] >= p.min_texts], np.int32(bias)) for r in rows]
    cost = np.where(y > 0.5, p.positive, 1.0)
    for _ in range(p.epochs):
        for k in order_of.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            g = cost[k] * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[k])
            was = n[i]
            n[i] = was + g * g
            z[i] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / p.alpha * w
    everywhere = np.flatnonzero(np.abs(z[:bias]) > p.l1)
    w = weights(everywhere)
    keep = w != 0
    b = float(weights(np.array([bias]))[0]) if len(rows) else -1.0
    own = {c: int((y == c).sum()) for c in (0.0, 1.0)}
    if seen and min(own.values()):
        b += float(np.log(seen[1.0] / own[1.0]) - np.log(seen[0.0] / own[0.0]))
    return ToxicityModel(everywhere[keep].astype(np.int32), w[keep].astype(np.float32), b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, params: Ftrl = Ftrl()) -> ToxicityModel:
    """Learn from a bounded sample of labelled rows, in one task; only the weights reach the driver."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    # one row for each of at most 2 per_class labels, with its different features
    sample = sample_texts(docs, sample_ids(known, "y", per_class, SEED), "y").select("doc_id", "text", F.col("y").cast("double"), F.col("seen").cast("double"))

    def extract(batches):
        for batch in batches:
            for part in at.slices(batch):
                found = _by_text(*features(*at.text_bytes(pc.utf8_lower(part.column(1)))), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.int32())), part.column(2), part.column(3)], names=["doc_id", "f", "y", "seen"])

    def train(batches):
        held, seen = [], {}
        for b in batches:
            seen |= dict(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            cut, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            held += [(i, flat[x:y].copy(), label_) for i, x, y, label_ in zip(b.column(0).to_pylist(), cut, cut[1:], b.column(2).to_pylist())]
        held.sort(key=lambda r: (r[0], len(r[1]), r[2]))
        m = fit_rows([r[1] for r in held], np.array([r[2] for r in held]), params, seen)
        del held
        at.release()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.index, -1), pa.int32()), pa.array(np.append(m.weight.astype(np.float64), m.bias), pa.float64())], names=["i", "w"])

    found = sample.mapInArrow(extract, "doc_id long, f array<int>, y double, seen double").repartition(1).mapInArrow(train, "i int, w double").toPandas()
    found = found.sort_values("i")
    bias = float(found["w"][found["i"] == -1].iloc[0]) if (found["i"] == -1).any() else -1.0
    found = found[found["i"] >= 0]
    return ToxicityModel(found["i"].to_numpy(np.int32), found["w"].to_numpy(np.float32), bias)


def score(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """docs with a score in 0..1 added; all other columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))
    docs = bounded_batches(docs).drop(out)
    names = docs.columns

    def run(batches):
        index, weight, bias = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[index] = weight
        for batch in batches:
            for part in at.slices(batch):
                i, owner = features(*at.text_bytes(pc.utf8_lower(part.column(names.index("text")))))
                keep = np.flatnonzero(w[i])
                key = np.unique((owner[keep].astype(np.int64) << BITS) | i[keep])
                total = np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)], part.num_rows) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*names, out])

    schema = extended(docs.schema, (out, "double"))
    return docs.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; folds by crc32(doc_id) mod 5."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
