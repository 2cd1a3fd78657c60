"""Classifiers against plain re-implementations and on held-out rows of the driver's labels."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import arrowtext as at
from weftgraph.llm import langid, quality, toxicity
from weftgraph.llm.tables import sample_ids

LARGER = "/root/testdata/sf0.01"


def _auc(score, y):
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]
    return float(np.mean(pairs))


@pytest.mark.parametrize("query,label,least", [(toxicity.op10_toxicity, "toxic", 0.9), (quality.op9_quality, "quality", 0.95)])
def test_held_out_auc(query, label, least, spark):
    got = query(spark, LARGER).where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where(f"{label} is not null").toPandas()
    assert _auc(got["score"].to_numpy(), got[label].to_numpy()) > least


# ---- sampling


def test_every_label_is_learned_however_many(spark):
    rows = spark.range(12_000).selectExpr("id as doc_id", "cast(id % 6000 as string) as lang")
    got = sample_ids(rows, "lang", 1, 2)
    assert got.count() == 6000 and got.select("lang").distinct().count() == 6000


def test_sample_is_the_smallest_hashes_and_counts_all(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as y").unionAll(spark.createDataFrame([(0, 0), (None, 1), (5, None), (1, 0), (1, 0)], "doc_id long, y int"))
    got = sample_ids(rows, "y", 300, 7).collect()
    want = [r[0] for r in rows.where("y = 0 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7))).limit(300).collect()]
    assert {r["doc_id"] for r in got if r["y"] == 0} == set(want)
    assert {r["y"]: r["seen"] for r in got} == {0: 18_003, 1: 2000}


# ---- op10


def _ftrl(rows, y, p, seen):
    """Textbook FTRL-proximal, one coordinate at a time."""
    count = {}
    for r in rows:
        for i in r.tolist():
            count[i] = count.get(i, 0) + 1
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        l1 = 0.0 if i == "bias" else p.l1
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    order = np.random.default_rng(toxicity.SEED)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            own = [i for i in rows[k].tolist() if count[i] >= p.min_texts] + ["bias"]
            w = {i: weight(i) for i in own}
            g = (p.positive if y[k] else 1.0) * (1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y[k])
            for i in own:
                was = n.get(i, 0.0)
                n[i] = was + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / p.alpha * w[i]
    w = {i: weight(i) for i in z}
    shift = math.log(seen[1.0] / y.sum()) - math.log(seen[0.0] / (1 - y).sum())
    return w, w["bias"] + shift


def test_ftrl_equals_textbook():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, 25)) + (" bad word here" if i % 4 == 0 else "") for i in range(120)]
    y = np.array([float(i % 4 == 0) for i in range(120)])
    rows = toxicity._by_text(*toxicity.features(*at.text_bytes(pa.array(texts))), len(texts))
    p, seen = toxicity.Ftrl(l1=0.5, epochs=3), {0.0: 900.0, 1.0: 60.0}
    model = toxicity.fit_rows(rows, y, p, seen)
    w, bias = _ftrl(rows, y, p, seen)
    want = {i: v for i, v in w.items() if v and i != "bias"}
    got = dict(zip(model.index.tolist(), model.weight.tolist()))
    assert got.keys() == want.keys() and len(want) > 20
    assert abs(model.bias - bias) < 1e-6 and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_features_are_grams_and_skip_grams():
    index, owner = toxicity.features(*at.text_bytes(pa.array(["a b c", None, "a b"])))
    assert np.bincount(owner, minlength=3).tolist() == [3 + 2 + 1, 0, 2 + 1]
    assert set(index[owner == 2].tolist()) < set(index[owner == 0].tolist())


def test_prior_does_not_follow_the_bound(spark):
    """A bound on the sample of the larger class leaves the average score where it was."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 20)), int(i % 20 == 0)) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("quality", F.col("toxic"))
    mean = lambda m, model: m.score(d, model).agg(F.avg("score")).first()[0]
    whole, part = (mean(toxicity, toxicity.fit(d, d, per_class=k, params=toxicity.Ftrl(positive=1.0, l1=50.0))) for k in (2000, 100))
    assert abs(whole - 0.05) < 0.03 and abs(part - whole) < 0.03
    whole, part = (quality.fit(d, d, per_class=k).classes[1].log_prior for k in (2000, 100))
    assert whole == part == pytest.approx(math.log(0.05))


# ---- op9


def test_statistics_equal_plain_counts():
    text = "Some words, and Some words again!\nA line: 42 | 7? $x é"
    got = dict(zip(quality.STATISTICS, quality.statistics(*at.text_bytes(pa.array([text])))[0]))
    words, raw = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
    share = lambda chars: math.log(sum(b in chars.encode() for b in raw) / len(raw) + 1e-3)
    length = [len(w.encode()) for w in words]
    assert got["log_words"] == pytest.approx(math.log1p(len(words))) and got["log_bytes"] == pytest.approx(math.log1p(len(raw)))
    assert got["word_len"] == pytest.approx(np.mean(length)) and got["word_len_sd"] == pytest.approx(np.std(length))
    assert got["digit"] == pytest.approx(share("0123456789")) and got["comma"] == pytest.approx(share(",;:")) and got["bar"] == pytest.approx(share("|"))
    assert got["distinct"] == pytest.approx(len(set(words)) / math.sqrt(len(words)))
    assert got["top_word"] == pytest.approx(math.log(max(words.count(w) for w in words) / len(words) + 1e-3))
    pairs = list(zip(words, words[1:]))
    assert got["repeated_pairs"] == pytest.approx(math.log((len(pairs) - len(set(pairs))) / len(words) + 1e-2))


def test_qda_equals_textbook():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    y = (x[:, 0] + rng.normal(size=400) > 1).astype(int)
    x[y == 1] *= 1.5
    seen, a, b = {0: 5000, 1: 300}, 0.05, 0.01
    got = quality.fit_rows(x, y, seen, a, b).score(x)
    z = (x - x.mean(0)) / x.std(0)
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    pooled = sum((y == c).sum() * cov[c] for c in (0, 1)) / len(z)
    density = []
    for c in (0, 1):
        s = (1 - a) * cov[c] + a * pooled
        s = (1 - b) * s + b * np.trace(s) / 6 * np.eye(6)
        e = z - z[y == c].mean(0)
        density.append(math.log(seen[c] / 5300) - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.abs(got - 1 / (1 + np.exp(-(density[1] - density[0])))).max() < 1e-6


# ---- op2


def test_svm_equals_textbook():
    rng = np.random.default_rng(6)
    rows, y = [], []
    for k in range(60):
        i = np.unique(rng.integers(0, 40, 12) + (40 if k % 2 else 30)).astype(np.int32)
        rows.append((i, rng.random(len(i))))
        y.append(1.0 if k % 2 else -1.0)
    got, bias = langid._svm(rows, np.array(y), 3, 1e-2)
    w, b, total, tb, kept, t = np.zeros(1 << langid.BITS), 0.0, np.zeros(1 << langid.BITS), 0.0, 0, 0
    order = np.random.default_rng(langid.SEED)
    for _ in range(3):
        for k in order.permutation(60):
            t += 1
            rate = 1 / (1e-2 * (t + 100))
            i, x = rows[k]
            inside = y[k] * (w[i] @ x + b) < 1
            w *= 1 - rate * 1e-2
            if inside:
                w[i] += rate * y[k] * x
                b += 0.1 * y[k] * rate * 1e-2
            if t > 90 and t % 50 == 0:
                total, tb, kept = total + w, tb + b, kept + 1
    assert np.abs(got - total / kept).max() < 1e-6 and abs(bias - tb / kept) < 1e-6


def test_trigrams_stay_within_texts():
    index, bounds = langid.trigrams(*at.text_bytes(pa.array(["abcd", "ab", None, "abc"])))
    assert np.diff(bounds).tolist() == [2, 0, 0, 1] and index[0] == index[bounds[3]]


def test_two_levels_of_duels(spark):
    words = {"en": "the and of", "de": "der und von", "fr": "le et de", "es": "el y de los", "nl": "het en van"}
    rows = [(i, f"{words[g]} {words[g]} {i}", g) for i in range(200) for g in [list(words)[i % 5]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    assert sorted(model.families) == ["germanic", "romance"] and len(model.names) == 1 + 3 + 1
    assert langid.predict(d, model).where("lang = lang_pred").count() == 200
    long, tie = langid.predict(spark.createDataFrame([(1, words["de"] * 50_000), (2, words["de"])], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert long["lang_pred"] == tie["lang_pred"] == "de"
