"""Language ID: family first, then one-versus-one linear SVMs within the family.

Features are the relative frequencies of hashed byte trigrams of the lowercased text,
ASCII non-letters taken as blanks; a text's margin is the mean weight of its trigrams, so
whole texts are scored in one linear pass. Both levels are one-versus-one linear SVMs: between
families, then between the languages of the winning family.

Every duel is trained in a task of its own, on the sample's rows of its two sides, and gives
the weights that it has (of trigrams that its sample holds) as one row. The model keeps a row
of weights for each trigram that any duel uses; it is broadcast, and refused above
MAX_MODEL_BYTES. Codes outside FAMILIES are put into families by their first letter, so that
the number of duels stays far below that of all pairs. A text is judged by the duels between
families and then by those of its family only.

Cases: null texts and texts without a letter give ``und`` with score 0; very long texts are
read whole, a slice at a time; a family with one learned language needs no second level;
with nothing to learn from all texts give ``und``. Rows with null lang are not learned
from; a document with two langs counts under each. Ties go to the smaller name. Repeated
rows score alike; other columns pass through ``predict`` unread, those named like an
output are replaced. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import bounded_batches, extended, held_out, materialize, read, sample_ids, sample_texts

BITS = 18
#: documented bound on what is broadcast: bytes of all weights
MAX_MODEL_BYTES = 512 << 20
#: documented bound on what is learned from: documents of each language
SAMPLE_PER_LANG = 1500
SEED = 2
#: fixed values: ISO 639-1 codes by family; any other code is of the family "other-" and its first letter
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "uz"],
    "semitic": ["ar", "he", "mt", "am"],
    "indo-iranian": ["bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ps", "sd", "ur"],
    "sinitic": ["zh", "yue", "wuu"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, f"other-{code[:1]}")


@dataclass(frozen=True)
class LangModel:
    """Pairwise classifiers: names[k] = (positive, negative), column k of weights, bias[k]; row r of
    weights is that of the trigram index[r], the last row (zeros) that of all others."""

    families: dict[str, list[str]] = field(default_factory=dict)
    names: list[tuple[str, str]] = field(default_factory=list)
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def rows(self) -> np.ndarray:
        """Row of weights of every possible trigram."""
        out = np.full(1 << BITS, len(self.index), np.int32)
        out[self.index] = np.arange(len(self.index))
        return out


def assembled(families: dict[str, list[str]], pairs: list[tuple[str, str, str]], found: list[tuple[int, float, np.ndarray, np.ndarray]]) -> LangModel:
    """The model of trained duels: (number, bias, trigrams, weights) of each."""
    found = sorted(found, key=lambda f: f[0])
    index = np.unique(np.concatenate([f[2] for f in found])).astype(np.int64)
    if 4 * (len(index) + 1) * len(found) > MAX_MODEL_BYTES:
        raise ValueError("the model is too large to broadcast: learn fewer languages at once")
    weights = np.zeros((len(index) + 1, len(found)), np.float32)
    for k, (_, _, i, w) in enumerate(found):
        weights[np.searchsorted(index, i), k] = w
    return LangModel(families, [pairs[f[0]][1:] for f in found], index, weights, np.array([f[1] for f in found]))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each trigram, bounds by text); texts are kept apart and padded by nothing."""
    b = _FOLD[data].astype(np.uint32)
    n = int(offsets[-1])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = b[:n] | (b[1 : n + 1] << np.uint32(8)) | (b[2 : n + 2] << np.uint32(16))
    code *= np.uint32(0x9E3779B1)
    index = (code >> np.uint32(32 - BITS)).astype(np.int64)
    size = np.diff(offsets)
    ok = np.ones(n, bool)  # a trigram may not reach into the next text
    for back in (1, 2):
        at_end = offsets[1:][size >= back] - back
        ok[at_end] = False
    keep = np.flatnonzero(ok)
    return index[keep], np.searchsorted(keep, offsets)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, lam: float) -> tuple[np.ndarray, float]:
    """Pegasos with an averaged last half; rows are sparse unit vectors."""
    w, total, b, tb, kept = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0
    order, t, scale = np.random.default_rng(SEED), 0, 1.0
    steps = epochs * len(rows)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            t += 1
            rate = 1 / (lam * (t + 100))
            i, x = rows[k]
            margin = y[k] * (scale * (w[i] @ x) + b)
            scale *= 1 - rate * lam
            if margin < 1:
                w[i] += rate * y[k] / scale * x
                b += 0.1 * y[k] * rate * lam
            if t > steps // 2 and t % 50 == 0:
                total += scale * w
                tb += b
                kept += 1
    return (total / kept, tb / kept) if kept else (scale * w, b)


def duels(langs: list[str]) -> tuple[dict[str, list[str]], list[tuple[str, str, str]]]:
    """(languages by family, (level, positive, negative) of every classifier), all in order of name."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    found = [("family", a, b) for a, b in combinations(sorted(families), 2)]
    return families, found + [("lang", a, b) for f in sorted(families) for a, b in combinations(families[f], 2)]


def fit_duel(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, norm: float, epochs: int = 4, lam: float = 1e-3) -> tuple[np.ndarray, float]:
    """rows: (indexes, relative frequencies), used linearly, scaled to a usual length (norm) of one."""
    w, c = _svm([(i, x / norm) for i, x in rows], y, epochs, lam)
    return (w / norm).astype(np.float32), c


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LangModel:
    """Learn from a bounded sample of the rows that carry a language."""
    sample = sample_texts(docs.where("text is not null"), sample_ids(docs.where("text is not null"), "lang", per_lang, SEED), "lang")

    def extract(batches):
        for batch in batches:
            for part in at.slices(batch):
                index, bounds = trigrams(*at.text_bytes(pc.utf8_lower(part.column(2))))
                idx, val = [], []
                for k in range(part.num_rows):
                    i, c = np.unique(index[bounds[k] : bounds[k + 1]], return_counts=True)
                    idx.append(i.astype(np.int32))
                    val.append((c / max(c.sum(), 1)).astype(np.float32))
                norm = [float(np.sqrt((x.astype(np.float64) ** 2).sum())) for x in val]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), pa.array(norm, pa.float64())], names=["doc_id", "lang", "i", "x", "norm"])

    rows = sample.select("doc_id", "lang", "text").mapInArrow(extract, "doc_id long, lang string, i array<int>, x array<float>, norm double").where(F.size("i") > 0)
    rows = materialize(rows, "langid")
    norm = rows.agg(F.percentile("norm", 0.5)).first()[0] or 1.0
    families, pairs = duels([r[0] for r in rows.select("lang").distinct().collect()])  # the learned languages
    if not pairs:
        return LangModel(families)
    of = {x: f for f, names in families.items() for x in names}
    # which duels a language's rows are sent to, and on which side they stand there
    sides = [(lang, k, 1.0 if (of[lang] if level == "family" else lang) == a else -1.0) for k, (level, a, b) in enumerate(pairs) for lang in of if (of[lang] if level == "family" else lang) in (a, b)]
    sent = rows.join(F.broadcast(docs.sparkSession.createDataFrame(sides, "lang string, duel int, side double")), "lang")

    def train(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")]).combine_chunks()
        held = [(i.values.to_numpy(), x.values.to_numpy().astype(np.float64)) for i, x in zip(table["i"], table["x"])]
        w, c = fit_duel(held, table["side"].to_numpy(), norm)
        i = np.flatnonzero(w).astype(np.int32)
        return pa.table({"duel": pa.array([key[0].as_py()], pa.int32()), "bias": pa.array([float(c)]), "i": pa.array([i.tobytes()], pa.binary()), "w": pa.array([w[i].tobytes()], pa.binary())})

    # a row of at most 2 MB for each duel; a small part of that, as a duel's sample has few of all trigrams
    found = sent.groupBy("duel").applyInArrow(train, "duel int, bias double, i binary, w binary").collect()
    return assembled(families, pairs, [(r["duel"], r["bias"], np.frombuffer(r["i"], np.int32), np.frombuffer(r["w"], np.float32)) for r in found])


def _duel(names: list[str], pairs: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one vote among names: (winner's place, share of confidence)."""
    votes, margin = np.zeros((n, len(names))), np.zeros((n, len(names)))
    for a, b in combinations(range(len(names)), 2):
        m = pairs[names[a], names[b]]
        votes[:, a] += m >= 0
        votes[:, b] += m < 0
        margin[:, a] += m
        margin[:, b] -= m
    best = np.argmax(votes + 1e-3 * np.tanh(margin), axis=1)
    least = np.full(n, np.inf)
    for k in range(len(names)):
        for o in range(len(names)):
            if k != o:
                m = pairs[names[k], names[o]] if k < o else -pairs[names[o], names[k]]
                least = np.where(best == k, np.minimum(least, m), least)
    return best, np.where(np.isinf(least), 1.0, 1 / (1 + np.exp(-np.clip(2 * least, -35, 35))))


def classify(model: LangModel, row_of: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; row_of is model.rows()."""
    n = len(offsets) - 1
    families = sorted(model.families)
    out, score = np.full(n, "und", object), np.zeros(n)
    if not families:
        return out.tolist(), score
    index, bounds = trigrams(data, offsets)
    rows, count = row_of[index], np.maximum(np.diff(bounds), 1)
    number = {name: k for k, name in enumerate(model.names)}
    margins = lambda rows, bounds, count, names: {p: at.sums(model.weights[rows, number[p]], bounds) / count + model.bias[number[p]] for p in combinations(names, 2)}
    best, sure = _duel(families, margins(rows, bounds, count, families), n)
    for k, f in enumerate(families):
        langs, at_ = model.families[f], np.flatnonzero(best == k)
        if not len(at_):
            continue
        inner, more = np.zeros(len(at_), int), np.ones(len(at_))
        if len(langs) > 1:  # the trigrams of this family's texts only
            size = np.diff(bounds)[at_]
            own = np.append(0, np.cumsum(size))
            taken = rows[np.repeat(bounds[at_] - own[:-1], size) + np.arange(own[-1])]
            inner, more = _duel(langs, margins(taken, own, count[at_], langs), len(at_))
        out[at_] = np.array(langs, object)[inner]
        score[at_] = sure[at_] * more
    return out.tolist(), score


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """docs with lang_pred and score added; texts without a letter are ``und``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_MODEL_BYTES
    docs = bounded_batches(docs).drop("lang_pred", "score")
    names = docs.columns

    def run(batches):
        row_of = sent.value.rows()
        for batch in batches:
            for part in at.slices(batch):
                text, letter = pc.utf8_lower(part.column(names.index("text"))), part.column(len(names))
                langs, score = classify(sent.value, row_of, *at.text_bytes(text))
                ok = np.asarray(letter.fill_null(False).to_numpy(zero_copy_only=False), bool)
                langs = [v if k else "und" for v, k in zip(langs, ok)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(langs, pa.string()), pa.array(np.where(ok, score, 0.0))], names=[*names, "lang_pred", "score"])

    schema = extended(docs.schema, ("lang_pred", "string"), ("score", "double"))
    return docs.withColumn("__letter", F.col("text").rlike(r"\p{L}")).mapInArrow(run, schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; folds by crc32(doc_id) mod 5."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5, 0) & F.col("text").isNotNull()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
