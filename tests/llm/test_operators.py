"""Operators against brute force or SQL on small fixtures, and the edge cases of their docstrings."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import arrowtext as at
from weftgraph.llm import decontaminate, fingerprint, jaccard_join, langid, license_scan, mixture, quality, registry, substring_dedup, toxicity, warc_revisit
from weftgraph.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows; an extra column with a clashing name."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, base), (2, None), (3, ""), (4, base + " extra"), (4, base + " extra"), (5, "word"), (6, "x " * 20000), (None, base), (7, "É\nß 漢字"), (8, base)]
    df = spark.createDataFrame([(i, t, None if i == 5 else "en", None if i == 6 else "src1", 0) for i, t in rows], DOCS)
    return df.withColumn("score", F.lit("clash")).withColumn("n_words", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_words_and_hashes():
    texts = ["a  b", "", "longer-than-eight-bytes x", None, "b"]
    data, offsets = at.text_bytes(pa.array(texts))
    starts, ends, bounds = at.split_words(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["a", "b", "longer-than-eight-bytes", "x", "b"]
    assert np.diff(bounds).tolist() == [2, 0, 2, 0, 1]
    h = at.hash_spans(data, starts, ends)
    assert h[1] == h[4] and len(set(h.tolist())) == 4


# ---- 1


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [[vocab[k] for k in rng.integers(0, 400, n)] for n in (6, 15, 30, 50)]
    texts = []
    for n in range(40):
        words = [vocab[k] for k in rng.integers(0, 400, 120)]
        item = list(items[n % 4])
        for _ in range(int(rng.integers(0, len(item) // 4 + 1))):
            p = int(rng.integers(0, len(item)))
            item[p : p + 1] = [[], ["new"], [item[p], "more"]][int(rng.integers(0, 3))]
        p = int(rng.integers(0, 120))
        words[p:p] = item if n % 5 else []
        texts.append(words)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(d, b).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            least = min(_lev(item, t[s : s + len(item)]) for s in range(max(1, len(t) - len(item) + 1)))
            if least <= int(0.2 * len(item) + 1e-9):
                want[i, k] = least
    assert got == want and len(want) > 10


def test_leak_edge_cases(odd, none, spark):
    b = spark.createDataFrame([(1, "two three four five six"), (None, "two"), (2, None), (3, "")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_leaks(odd, b).collect()} == {1, 4, 8, None}
    assert decontaminate.find_leaks(none, b).count() == 0 and decontaminate.find_leaks(odd, b.limit(0)).count() == 0


# ---- 2, 9, 10


def test_language_on_held_out(spark, sf_dir):
    got = langid.op2_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.85


def test_language_edge_cases(odd, none):
    model = langid.fit(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert got[2] == got[3] == ("und", 0.0) and got[1][0] == "en"
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.LangModel()).collect()} == {"und"}


def test_quality_separates(spark):
    good = [(i, f"Plain words number {i} in a sentence that goes on for a while. And then it ends.") for i in range(60)]
    bad = [(100 + i, f"$$$ {i} ### !!! WORDS!! *** %%% {i * 7}") for i in range(60)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    got = quality.score(d, quality.fit(d, labels)).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] < 100) for r in got)


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in rng.integers(0, 200, 40)]
        if i % 3 == 0:
            words[5], words[20] = "nasty", "awful"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d.where("doc_id < 240").select("doc_id", "toxic"))
    got = toxicity.score(d, model).where("doc_id >= 240").collect()
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) >= 58
    assert len(model.index) < 2000


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edge_cases(module, label, odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (3, None), (99, 1)], f"doc_id long, {label} int")
    got = module.score(odd, module.fit(odd, labels))
    assert got.count() == odd.count() and all(0 <= r["score"] <= 1 for r in got.collect())
    assert module.score(none, module.fit(none, labels)).count() == 0
    assert module.score(odd, module.fit(odd, labels.limit(0))).count() == odd.count()


# ---- 3


def _cut(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) if t else [] for i, t in docs}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark, sf_dir, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op3_substring_dedup(spark, sf_dir).collect()}
    assert got == _cut(docs)


def test_substring_dedup_edge_cases(odd, none):
    rows = substring_dedup.dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["text"] == "" and by[8]["n_removed"] == 14 and by[1]["n_removed"] == 0 and by[None]["n_removed"] == 0
    assert by[2]["text"] is None and by[3]["text"] == "" and by[4]["text"] == "extra" and by[1]["score"] == "clash" and by[6]["n_words"] == 20000
    assert substring_dedup.dedup(none).count() == 0


# ---- 4, 5, 6


def test_revisit_edge_cases(spark):
    rows = [
        (1, "response", "http://www.a.com/x/", 10, "e1", None, {"ETag": "e1", "X": "1"}, "d1", 5), (2, "response", "https://A.com/x#f", 20, None, "lm", None, "d2", 6),
        (3, "revisit", "http://a.com/x?utm_source=q", 15, "e1", None, {"Date": "15", "X": "2"}, None, None), (4, "revisit", "http://a.com/x", 20, "e9", None, None, None, None),
        (5, "revisit", "http://a.com/x", 99, None, "other", None, None, None), (6, "revisit", None, 99, None, None, None, None, None), (7, "revisit", "http://a.com/x", None, None, None, None, None, None),
        (8, "revisit", "http://a.com/x", 200_000, None, "lm", None, None, None),
    ]
    schema = "record_id long, record_type string, url string, date long, etag string, last_modified string, headers map<string,string>, payload_digest string, payload_length long"
    got = {r["record_id"]: r for r in warc_revisit.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {3: "resolved", 4: "mismatch", 5: "mismatch", 6: "unresolved", 7: "unresolved", 8: "resolved"}
    assert got[3]["headers"] == {"etag": "e1", "x": "1", "date": "15"} and got[8]["response_id"] == 2
    assert warc_revisit.resolve(spark.createDataFrame([], schema)).count() == 0


def test_license_edge_cases(spark, odd, none):
    rows = [(1, "some words of another kind\nReleased under the MIT License.\nand more of them"), (2, "released under the mit license"), (3, license_scan.TEMPLATES["ISC:text"]), (4, None), (5, "")]
    got = {(r["doc_id"], r["kind"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "line", "MIT"), (2, "text", "MIT"), (3, "text", "ISC")}
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0


def _runs_by_force(text):
    """Every run of two or more lines that aren't blank, compared with every template."""
    from collections import Counter

    def pairs(words):
        return Counter(zip(words, words[1:]))

    lines = [(i, re.sub("[^a-z0-9]+", " ", x.lower()).split()) for i, x in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[1]]
    best = {}
    for name, body in sorted(license_scan.TEMPLATES.items()):
        b = pairs(re.sub("[^a-z0-9]+", " ", body.lower()).split())
        size = sum(b.values())
        for k in range(len(lines)):
            first = lines[k][1] + (lines[k + 1][1][:1] if k + 1 < len(lines) else [])
            if not pairs(first).keys() & b.keys():
                continue
            words = list(lines[k][1])
            for e in range(k + 1, len(lines)):
                last = [words[-1]] + lines[e][1] + (lines[e + 1][1][:1] if e + 1 < len(lines) else [])
                words = words + lines[e][1]
                n = len(words) - 1
                dice = 2 * sum((pairs(words) & b).values()) / (n + size)
                if dice >= 0.8 - 1e-12 and pairs(last).keys() & b.keys() and (k, e) != (0, len(lines) - 1):
                    new = (-dice, n, name, lines[e][0])
                    best[lines[k][0]] = min(best.get(lines[k][0], new), new)
    at, out = sorted(best), set()
    for x, pos in enumerate(at):
        mine, before, after = best[pos], best[at[x - 1]] if x else None, best[at[x + 1]] if x + 1 < len(at) else None
        if not (before and before[3] >= pos and before[:2] <= mine[:2]) and not (after and at[x + 1] <= mine[3] and after[:2] < mine[:2]):
            out.add((pos, mine[2], round(-mine[0], 6)))
    return out


def test_licenses_of_several_lines_inside_longer_texts(spark):
    import random
    import textwrap

    mit, isc = license_scan.TEMPLATES["MIT:text"], license_scan.TEMPLATES["ISC:text"]
    parts = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    code = "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(60))
    texts = {1: f"import os\n\n{parts}\n\n{code}", 2: "an intro line\n" + "\n".join(textwrap.wrap(mit, 60)) + "\n" + code, 3: f"x\r\n{parts}\r\n{code}".replace("\n", "\r\n"), 4: "some\nLicensed under the\nMIT License.\nother words", 5: f"{parts}\n{code}\n{parts}\n{code}"}
    draw = random.Random(5)
    for i in range(6, 30):  # edited, wrapped anywhere, with other lines around and between
        words = [draw.choice(["the", "license", "x"]) if draw.random() < 0.06 else w for w in draw.choice([mit, isc]).split()]
        texts[i] = code[:300] + "\n" + "".join(w + (draw.choice(["\n", "\n\n", "\r\n"]) if draw.random() < 0.1 else " ") for w in words) + "\nof the software and the license\n" + code[:200]
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["pos"], r["template"], r["dice"]) for r in license_scan.scan_runs(df).collect()}
    assert {x[0] for x in got if x[2] == "MIT:text"} >= {1, 2, 3, 5} and (4, 1, "MIT:licensed", 1.0) in got and sum(x[0] == 5 for x in got) == 2
    assert got == {(i, *x) for i, t in texts.items() for x in _runs_by_force(t)}


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("b", "y", "s3", 1000)], "domain string, lang string, source string, tokens long")
    m = mixture.Mixture(budget_share=0.5, max_epochs=1)
    got = {r["source"]: r["granted"] for r in mixture.budgets(leaves, m).collect()}
    assert got == {"s1": 10, "s2": 492, "s3": 502}


def test_mixture_edge_cases(odd, none):
    assert mixture.mix(none).count() == 0
    assert mixture.mix(odd, mixture.Mixture(budget_share=1.0)).count() >= odd.count() - 3


# ---- 7


def test_jaccard_equals_brute_force(spark, sf_dir, docs):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    inv = defaultdict(list)
    links, label = defaultdict(int), {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in sorted(sets.items()):
        seen = defaultdict(int)
        for g in s:
            for j in inv[g]:
                seen[j] += 1
            inv[g].append(i)
        for j, n in seen.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.op7_jaccard_join(spark, sf_dir).collect()}
    assert got == {i: (root(i), links[i]) for i in sets}


def test_jaccard_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"v{i}"] + base[101:])) for i in range(40)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 39)}


def test_jaccard_texts_under_one_id(spark, tmp_path):
    import corpus_pipeline as c

    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    text = lambda w, i: " ".join(w[:i] + ["changed"] + w[i + 1 :] if i else w)
    rows = [(1, text(a, 0)), (1, text(b, 0)), (2, text(a, 59)), (3, text(b, 59)), (4, text(b, 0)), (5, "on its own and so on"), (5, "on its own and so on"), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(docs).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 1, 2), (5, 5, 1), (5, 5, 1), (6, 6, 0), (6, 6, 0)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in c.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted([(1, text(a, 0)), (1, text(b, 0)), (5, "on its own and so on"), (6, "")])


def test_jaccard_edge_cases(odd, none):
    rows = jaccard_join.join(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[8]["class_id"] == 1 and by[2]["n_links"] == by[3]["n_links"] == 0 and by[None]["class_id"] is None
    assert jaccard_join.join(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (2, 6)], "u long, v long")
    assert {r["u"]: r["label"] for r in components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 8: 8, 9: 8}


def test_least_matches_rises():
    assert [jaccard_join.least_matches(n) for n in (16, 64, 128)] == sorted(jaccard_join.least_matches(n) for n in (16, 64, 128))


# ---- 8


def test_edited_texts_and_equal_fingerprints(spark, sf_dir, docs):
    ordered = sorted(docs, reverse=True)
    want = {}
    for k, (i, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    rows = fingerprint.op8_fingerprint(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == want
    text = dict(docs)
    marks = defaultdict(set)
    for r in rows:
        marks[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(m) == 1 for m in marks.values())


def test_fingerprint_edge_cases(odd, none, spark):
    assert fingerprint.fingerprints(odd).count() == odd.count()
    assert fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 3


# ---- pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "decontaminate", "mixture"] and c.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = c.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() == jaccard_join.join(docs).select("class_id").distinct().count()
    leaks = {r[0] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").collect()}
    assert c.drop_leaks(spark, docs, sf_dir).count() == docs.count() - len(leaks)
    cut = c.cut_repeats(spark, docs, sf_dir)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_pipeline_edge_cases(spark, sf_dir, odd, none):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
        assert stage(spark, none, sf_dir).count() == 0, name
    # nothing to learn from: no document is toxic; clean and unreadable rows stay
    assert c.drop_toxic(spark, odd, sf_dir).count() == odd.count()


def test_pipeline_runs_whole(spark, sf_dir, docs):
    import corpus_pipeline as c

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = c.run(spark, sf_dir)
    assert out.columns == source.columns
    rows, text = out.collect(), dict(docs)
    assert rows and {r["doc_id"] for r in rows} <= text.keys()
    toxic = {r["doc_id"] for r in source.join(c.drop_toxic(spark, source, sf_dir).select("doc_id"), "doc_id", "left_anti").collect()}
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(source.where(~F.col("doc_id").isin(list(toxic) or [-1])), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert not toxic & {r["doc_id"] for r in rows}
    # an item may have been cut out of a leaking text as a repeat before the leak stage saw it
    assert all(len(r["text"].split()) < len(text[r["doc_id"]].split()) for r in rows if r["doc_id"] in leaks)
    whole = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for r in rows:  # texts are cut, never added to
        kept = iter(whole[r["doc_id"]])
        assert all(w in kept for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
