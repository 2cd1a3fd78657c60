"""Quality: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled covariance and then
towards a scaled identity. Its Cholesky factor is computed once and kept together with the
factor's inverse, so a Mahalanobis distance is one product with a triangular matrix. A
text's score is the logistic of the difference of the two log densities (half the squared
distances, plus log determinants and log priors). The priors are the shares of the classes
among all rows learned from, whatever the bound on the sample takes of each.

Cases: null text counts as empty; the statistics of an empty text are all zero and it is
scored like any other; very long texts are read whole, a slice at a time; rows whose label
is null or whose document is absent are not learned from, and a document with both labels
counts under each; if only one class was seen its prior decides (score 1 or 0); if none
was, the score is 0.5. Repeated rows score alike and equal texts tie; other columns pass
through unread, one named like the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import bounded_batches, extended, held_out, read, sample_ids, sample_texts

#: documented bound on what is learned from: rows of each class
SAMPLE_PER_CLASS = 20_000
SEED = 9

_B = np.arange(256)
_CLASS = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "space": at.WHITESPACE,
    "newline": _B == 10,
    "stop": np.isin(_B, [ord(c) for c in ".?"]),
    "bang": _B == ord("!"),
    "comma": np.isin(_B, [ord(c) for c in ",;:"]),
    "symbol": np.isin(_B, [ord(c) for c in "#$%&*@^~=+<>/\\_{}[]"]),
    "bar": _B == ord("|"),
    "high": _B >= 128,
}
STATISTICS = ["log_words", "log_bytes", "word_len", "word_len_sd", *_CLASS, "distinct", "top_word", "repeated_pairs", "log_line"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text: logs of counts, logs of ratios."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    starts, ends, bounds = at.split_words(data, offsets)
    length = (ends - starts).astype(float)
    words = np.diff(bounds).astype(float)
    per = np.maximum(words, 1)
    mean = at.sums(length, bounds) / per
    sd = np.sqrt(np.maximum(at.sums(length * length, bounds) / per - mean * mean, 0))
    body = data[: int(offsets[-1])]
    share = {k: at.sums(mask[body], offsets) for k, mask in _CLASS.items()}
    h = at.hash_spans(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(bounds))

    def spread(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, largest count of a key) of each text."""
        if not len(key):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((key, who))
        k, w = key[order], who[order]
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])))
        count = np.diff(np.append(new, len(k)))
        top = np.zeros(n)
        np.maximum.at(top, w[new], count)
        return np.bincount(w[new], minlength=n).astype(float), top

    distinct, top = spread(h, owner)
    pair_ok = owner[1:] == owner[:-1]
    pairs, _ = spread((h[:-1] * np.uint64(3) + h[1:])[pair_ok], owner[:-1][pair_ok])
    bytes_ = np.maximum(size, 1)
    columns = [np.log1p(words), np.log1p(size), mean, sd]
    columns += [np.log(share[k] / bytes_ + 1e-3) for k in _CLASS]
    columns += [distinct / np.maximum(np.sqrt(words), 1), np.log(top / per + 1e-3), np.log((words - 1 - pairs).clip(0) / per + 1e-2), np.log1p(size / (share["newline"] + 1))]
    out = np.stack(columns, axis=1)
    out[size == 0] = 0
    return out


@dataclass(frozen=True)
class Gaussian:
    log_prior: float
    mean: np.ndarray
    whiten: np.ndarray  # inverse of the lower Cholesky factor of the shrunk covariance
    half_log_det: float

    @classmethod
    def of(cls, prior: float, mean: np.ndarray, covariance: np.ndarray) -> Gaussian:
        factor = np.linalg.cholesky(covariance)
        return cls(float(np.log(prior)), mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.log_prior - 0.5 * (z * z).sum(axis=1) - self.half_log_det


@dataclass(frozen=True)
class Qda:
    centre: np.ndarray
    scale: np.ndarray
    classes: dict[int, Gaussian]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        if len(self.classes) == 1:
            return np.full(len(x), float(next(iter(self.classes))))
        x = (x - self.centre) / self.scale
        gap = self.classes[1].log_density(x) - self.classes[0].log_density(x)
        return 1 / (1 + np.exp(-np.clip(gap, -35, 35)))


def fit_rows(x: np.ndarray, y: np.ndarray, seen: dict[int, int] | None = None, to_pooled: float = 0.05, to_identity: float = 0.01) -> Qda:
    """seen: rows of each class among all that there are to learn from; else those of y."""
    if not len(x):
        return Qda(np.zeros(0), np.ones(0), {})
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    own = {c: z[y == c] for c in (0, 1) if (y == c).any()}
    seen = {c: (seen or {}).get(c, len(v)) for c, v in own.items()}
    cov = {c: np.cov(v.T, bias=True).reshape(z.shape[1], z.shape[1]) for c, v in own.items()}
    pooled = sum(len(v) * cov[c] for c, v in own.items()) / len(z)
    classes = {}
    for c, v in own.items():
        s = (1 - to_pooled) * cov[c] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        classes[c] = Gaussian.of(seen[c] / sum(seen.values()), v.mean(axis=0), s)
    return Qda(centre, scale, classes)


def with_statistics(docs: DataFrame, out: str = "stats") -> DataFrame:
    """docs with the statistics of its text as an array column; text itself is dropped."""
    docs = bounded_batches(docs).drop(out)
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part in at.slices(batch):
                found = statistics(*at.text_bytes(part.column(part.schema.get_field_index("text"))))
                stats = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), stats], names=[*names, out])

    return docs.mapInArrow(run, extended(docs.drop("text").schema, (out, "array<double>")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Qda:
    """Learn from a bounded sample of labelled rows; the driver gets their statistics only.

    Labels other than 0 and 1 are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    sample = sample_texts(docs, sample_ids(known, "y", per_class, SEED), "y")
    got = with_statistics(sample).orderBy("doc_id", "y").toPandas()
    x = np.array(got["stats"].tolist()).reshape(len(got), len(STATISTICS))
    return fit_rows(x, got["y"].to_numpy(int), dict(zip(got["y"], got["seen"])))


def score(docs: DataFrame, model: Qda, out: str = "score") -> DataFrame:
    """docs with a score in 0..1 added (higher: label 1 is likelier)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two vectors and two small matrices
    docs = bounded_batches(docs).drop(out)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in at.slices(batch):
                p = sent.value.score(statistics(*at.text_bytes(part.column(names.index("text")))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*names, out])

    return docs.mapInArrow(run, extended(docs.schema, (out, "double")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; folds by crc32(doc_id) mod 3."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
