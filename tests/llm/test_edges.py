"""Cases that must not lose rows or crash: clashing ids, wide ids, long items, repeated headers, split entries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, fingerprint, mixture, warc_revisit

TEXT = "doc_id long, text string"


# ---- op1


def test_lsh_meets_its_recall():
    rng = np.random.default_rng(3)
    for n in (6, 15, 37, 60, decontaminate.MAX_WORDS):
        k = int(decontaminate.edits(n))
        a = rng.integers(0, 2**40, (800, n)).astype(np.uint64)
        b = a.copy()
        for row in b:
            w = row.tolist()
            for _ in range(k // 2 + 1):
                p = int(rng.integers(0, len(w)))
                w[p : p + 1] = [[], [int(rng.integers(2**40))], [w[p], int(rng.integers(2**40))]][int(rng.integers(0, 3))]
            row[:] = (w + rng.integers(0, 2**40, n).tolist())[:n]
        near = decontaminate.levenshtein(a, np.full(800, n), b, np.full(800, n)) <= k
        (ca, oa), (cb, ob) = decontaminate.codes(a), decontaminate.codes(b)
        met = ((ca == cb) & oa & ob).any(axis=1)
        assert near.sum() > 200 and met[near].mean() >= 0.995
        # and it decides: texts that have nothing in common do not meet
        assert ((ca == np.roll(cb, 1, axis=0)) & oa & np.roll(ob, 1, axis=0)).any(axis=1).mean() < 0.01


def test_long_items_and_texts_under_one_id(spark):
    rng = np.random.default_rng(2)
    long = [f"w{k}" for k in rng.integers(0, 50_000, 20_000)]
    items = [(1, " ".join(long)), (2, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six seven"), (2, "one two three four five six seven")]
    items += [(10 + i, f"short item number {i} of many") for i in range(300)]
    docs = [(1, "x " * 50 + " ".join(long[3000:3400])), (2, "so one two three four five six seven it is"), (3, "an alpha beta gamma delta epsilon zeta"), (4, "clean text of no item " * 20), (5, " ".join(long))]
    block = decontaminate.Items([i for i, _ in items], [t for _, t in items])
    assert sum(s.words.nbytes + s.code.nbytes + s.row.nbytes for s in block.sizes) < 3_000_000
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2, 2): 0, (3, 2): 0, (5, 1): 0}  # 400 words of 20,000 are no leak of the item


# ---- op4


def test_repeated_header_names(spark):
    rows = [
        (1, "response", "http://a.com/", 10, "e1", None, {"ETag": "e1", "etag": "e1b", "X": "1", "x": None}, "d", 5),
        (2, "revisit", "http://a.com/", 70, "e1", None, {"Vary": "b", "VARY": "a", "date": "70"}, None, None), (2, "revisit", "http://a.com/", 70, "e1", None, {"Vary": "b", "VARY": "a", "date": "70"}, None, None),
        (3, "revisit", "http://a.com/", 11, None, None, None, None, None), (4, "revisit", "http://a.com/", 90_000, None, None, None, None, None), (5, "revisit", "http://a.com/", 10, None, None, None, None, None),
    ]
    schema = "record_id long, record_type string, url string, date long, etag string, last_modified string, headers map<string,string>, payload_digest string, payload_length long"
    got = warc_revisit.resolve(spark.createDataFrame(rows, schema).withColumn("day", F.lit("clash"))).collect()
    assert Counter((r["record_id"], r["outcome"]) for r in got) == {(2, "resolved"): 2, (3, "resolved"): 1, (4, "resolved"): 1, (5, "unresolved"): 1}
    assert next(r for r in got if r["record_id"] == 2)["headers"] == {"etag": "e1, e1b", "x": "1", "vary": "a, b", "date": "70"}


def test_latest_earlier_response_at_every_level(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "response" if rng.random() < 0.4 else "revisit", f"http://h{int(rng.integers(0, 3))}.com/", int(rng.integers(0, 4) * 86_400 + rng.integers(0, 300)), None, None, None, "d", 1) for i in range(400)]
    schema = "record_id long, record_type string, url string, date long, etag string, last_modified string, headers map<string,string>, payload_digest string, payload_length long"
    got = {r["record_id"]: r["response_id"] for r in warc_revisit.resolve(spark.createDataFrame(rows, schema)).collect()}
    want = {r[0]: max(((o[3], o[0]) for o in rows if o[1] == "response" and o[2] == r[2] and o[3] < r[3]), default=(None, None))[1] for r in rows if r[1] == "revisit"}
    assert got == want


# ---- op6


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("share", [0.3, 0.5, 1.7])
def test_mix_reads_what_is_granted(spark, share):
    """Twins of one doc_id, null ids and equal rows are chosen one by one."""
    rows = [(None, "a b c", "en", "src1"), (None, "d e", "en", "src1"), (None, None, "en", "src1"), (1, "f g h i", "en", "src1"), (1, "j", "en", "src1"), (2, "k l", "en", "src1")]
    rows += [(3, "m n o", "en", "src1")] * 7 + [(4, "p q", "de", None)] * 3 + [(i, "x y z", "fr", "src7") for i in range(10, 20)]
    m = mixture.Mixture(budget_share=share, max_epochs=4)
    docs = _docs(spark, rows).withColumn("rows", F.lit("clash")).withColumn("copies", F.create_map(F.lit("k"), F.lit("v")))
    chosen = mixture.select(mixture._leaves(docs), m).collect()
    got = mixture.mix(docs, m)
    assert got.columns == docs.columns
    mixed = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert sum(mixed.values()) == sum(r["copies"] * r["rows"] + r["more"] for r in chosen)
    tokens = sum(n * len((t or "").split()) for (_, t), n in mixed.items())
    granted = {(r["domain"], r["lang"], r["source"]): r["granted"] for r in mixture.budgets(mixture._leaves(docs).groupBy("domain", "lang", F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("tokens").alias("tokens")), m).collect()}
    assert tokens <= sum(granted.values()) <= share * sum(len((r[1] or "").split()) for r in rows) + 1e-6


def test_split_entry_keeps_whole_epochs(spark):
    m = mixture.Mixture(budget_share=1.5, max_epochs=4)
    assert mixture.mix(_docs(spark, [(1, "a b", "en", "s")] * 5), m).count() == 7  # 15 tokens: two each


# ---- op8


def _paragraphs(t):
    return {x for x in re.findall(r"[ \t]*([^\n]{80,159}?[.!?](?=[ \t])|[^\n]{160}\S*|[^\n]+)", t, flags=re.A) if x.strip(" ")}


def test_fingerprint_strings_are_enough(spark):
    rng = np.random.default_rng(9)
    lines = [f"line number {k} of the text" for k in range(3000)]
    pairs = [(0, 0, 0), (1, 1, 0), (1, 1, 1), (5, 9, 3), (40, 45, 38), (40, 400, 30), (200, 210, 195), (300, 20, 0), (600, 600, 599), (90, 95, 5)]
    rows, want = [], []
    for k, (a, b, both) in enumerate(pairs):
        pick = rng.permutation(3000)[: a + b - both]
        rows.append((k, "\n".join(lines[i] for i in pick[:a]), "\n".join(lines[i] for i in pick[a - both :])))
        want.append(both / (a + b - both) if a + b else 1.0)
    d = spark.createDataFrame(rows, "k int, x string, y string")
    for c in "xy":
        d = d.withColumn("s", fingerprint.digests(F.col(c))).withColumn("g", F.expr(fingerprint._sketch("s"))).withColumn(f"f{c}", fingerprint.written(F.size("s").cast("long"), F.col("g"))).drop("s", "g")
    d = spark.createDataFrame(d.select("k", "fx", "fy").collect(), "k int, fx string, fy string")
    got = [r[0] for r in d.select(fingerprint.likeness_of("fx", "fy").alias("near"), "k").orderBy("k").collect()]
    assert np.abs(np.array(got) - want).max() < 0.02 and sum(abs(a - b) < 1e-9 for a, b in zip(got, want)) >= 8


def test_empty_groups_have_no_cells_and_add_nothing(spark):
    """Groups without digests, most of those of a set dealt again and again, are neither kept nor peeled cell by cell."""
    rng = np.random.default_rng(3)
    sets = [sorted(rng.integers(-(2**63), 2**63 - 1, n).tolist()) for n in (0, 1, 25, 400)]
    d = spark.createDataFrame(list(enumerate(sets)), "k int, s array<bigint>").withColumn("g", F.expr(fingerprint._sketch("s")))
    assert any(len(g) == 0 for g in d.where("k = 3").first()["g"])
    d = d.withColumn("p", F.expr(fingerprint._peeled("g"))).withColumn("w", fingerprint.written(F.size("s").cast("long"), F.col("g"))).withColumn("again", F.expr(fingerprint.parsed("w")[1]))
    for r in d.orderBy("k").collect():
        assert {len(g) for g in r["g"]} <= {0, fingerprint.CELLS} and r["again"] == r["g"] and len(r["w"]) == 8 + 22 * fingerprint.CELLS * len(r["g"])
        assert sum(c["n"] for g in r["g"] for c in g) == 3 * len(r["s"]) and set(r["p"]["ds"]) <= set(r["s"]) and len(r["p"]["ds"]) + r["p"]["rest"] <= len(r["s"])
        assert r["k"] == 3 or sorted(r["p"]["ds"]) == r["s"]
    assert len(r["p"]["ds"]) > 390


def test_wide_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 4)
    ids = [2**63 - 1, -(2**63), 0, 5, 6, 7, 8, 9, 10, 11, *([3] * 12), *([None] * 10)]
    rows = [(i, f"text {k} of id {i}") for k, i in enumerate(ids)]
    d = spark.createDataFrame(rows, TEXT).withColumn("hash", F.xxhash64("text"))
    ordered = [r[0] for r in d.orderBy(F.col("doc_id").desc_nulls_last(), "hash", "text").select("text").collect()]
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(d).collect()}
    assert got == {t: ordered[(k + 1) % len(ordered)] for k, t in enumerate(ordered)}


def test_short_texts_share_their_first_half(spark):
    rng = np.random.default_rng(1)
    sentence = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 5000, n)) + "."
    rows = [(i, " ".join(sentence(8) for _ in range(8))) for i in range(40)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, TEXT)).collect()
    assert all(r["near_edited"] > r["near_next"] == 0 for r in got)


def test_likeness_equals_set_counts(spark, sf_dir):
    docs = sorted((tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    want = defaultdict(float)
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        a, b, c = _paragraphs(t), _paragraphs(t[: len(t) - half] + after[:half]), _paragraphs(after)
        want[i] = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
    got = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in fingerprint.op8_fingerprint(spark, sf_dir).collect()}
    off = [max(abs(u - v) for u, v in zip(got[i], want[i])) for i in want]
    assert got.keys() == want.keys() and np.mean([x < 1e-9 for x in off]) > 0.97 and max(off) < 0.25
