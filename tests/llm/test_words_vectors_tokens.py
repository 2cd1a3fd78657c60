"""Spelling variants, hard negatives and byte-level BPE against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import arrowtext as at
from weftgraph.llm import byte_bpe, hard_negatives, spelling

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "Hello hello HELLO world's end, it'll do"), (2, None), (3, ""), (3, "  \n\t x"), (None, "naïve café 漢字 😀"), (5, "word " * 30000), (5, "word " * 30000), (6, "z" * 3000), (7, "'")]
    return spark.createDataFrame([(i, t, None) for i, t in rows], DOCS).withColumn("ids", F.lit("clash")).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))


# ---- 13


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def words(ranks):
    return byte_bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def kind_of():
    return byte_bpe.kinds()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _digests(texts, library):
    out = []
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


def test_every_document_is_encoded_as_the_library_does(spark, sf_dir, ranks, library, odd):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        got = byte_bpe.digests(docs, ranks)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert Counter(map(tuple, got.collect())) == _digests([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], library)
    assert byte_bpe.digests(odd.limit(0), ranks).collect() == []


def test_other_columns_stay_and_clashes_are_replaced(odd, ranks):
    got = byte_bpe.encode(odd, ranks)
    assert dict(got.dtypes)["ids"] == "array<int>" and set(got.columns) == set(odd.columns)
    assert {r.word for r in got.collect()} == {"clash"}


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sstrevmldl19é½漢　 \x1c.A"), st.characters(exclude_categories=["Cs"]))), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_pretokens_are_the_patterns_matches(kind_of, texts):
    data, offsets = at.text_bytes(pa.array(texts, pa.string()))
    cut, bounds = byte_bpe.pretokens(data, offsets, kind_of)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert [data[x:y].tobytes().decode() for x, y in zip(cut[a:b], cut[a + 1 : b + 1])] == regex.findall(tokenizers.PATTERN, text)


def test_the_hash_is_minimal_and_perfect(ranks, words):
    keys = sorted(ranks)
    data = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
    ends = np.cumsum([len(k) for k in keys])
    starts = np.append(0, ends[:-1])
    assert words.find(data, starts, ends, at.hash_spans(data, starts, ends)).tolist() == [ranks[k] for k in keys]
    assert sorted(words.rank.tolist()) == sorted(ranks.values()) and len(words.rank) == len(ranks)
    strange = [b"qzqzqz", b"\xff\xfe\xfd", b" the the", b""]
    data = np.frombuffer(b"".join(strange) + bytes(8), np.uint8)
    ends = np.cumsum([len(k) for k in strange])
    starts = np.append(0, ends[:-1])
    assert words.find(data, starts, ends, at.hash_spans(data, starts, ends)).tolist() == [-1] * 4


def test_merging_takes_the_lowest_rank_and_the_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaab": 258, b"ba": 259}

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not ranked:
                return [ranks[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(3)
    for _ in range(300):
        piece = bytes(rnd.choice(b"aab") for _ in range(rnd.randrange(1, 14)))
        assert byte_bpe.merge(piece, ranks) == plain(piece)
    assert len(byte_bpe.merge(b"a" * 200_000, ranks)) == 100_000  # n log n


def test_what_is_not_a_vocabulary_is_refused(spark, words):
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        byte_bpe.decode_ids(np.array([10**6], np.int32), np.array([0, 1]), words)


# ---- 12


def _hard_negatives(rows, positives=5, negatives=10):
    rows = [(i, [int(np.floor(256 * np.float64(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v, y) in enumerate(rows):
        if i % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for m, (j, w, z) in enumerate(rows) if m != k and len(w) == len(v)]
            scored.sort(key=lambda s: s[:2])
            for s, j, _ in [s for s in scored if s[2] == y][:positives]:
                close = [c for c in scored if c[2] != y and 30 * -s <= 100 * -c[0] <= 90 * -s][:negatives]
                out += [(i, j, r + 1, c[1], -s, -c[0]) for r, c in enumerate(close)]
    return Counter(out)


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 22), (24, 60)])  # one block, and many of a few rows
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "FEWEST", sizes[0])
    monkeypatch.setattr(hard_negatives, "MOST", sizes[1])
    rnd = np.random.default_rng(5)
    rows = [(int(i), (rnd.integers(-3, 6, 6) / 8).tolist(), int(rnd.integers(0, 3))) for i in range(0, 1200, 4)]
    rows += [(400, rows[100][1], rows[100][2])] * 2  # repeated anchors
    rows += [(900, None, 1), (901, [0.5] * 6, None), (902, [None] + [0.5] * 5, 1), (903, [float("nan")] + [0.5] * 5, 1), (904, [float("inf")] * 6, 1), (905, [], 1), (None, [0.5] * 6, 1)]
    rows += [(2000, [1.0, 0.5], 0), (2001, [1.0, 0.25], 0), (2002, [0.5, 0.5], 1), (-100, [0.0] * 6, 0)]  # other lengths, scores of nought
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("clash")).repartition(3)
    got = hard_negatives.mine(hard_negatives.prepared(df), F.expr("id % 100 = 0"))
    assert Counter(map(tuple, got.collect())) == _hard_negatives(rows)
    assert hard_negatives.mine(hard_negatives.prepared(df.limit(0)), F.expr("id % 100 = 0")).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**20, 1.0], 0), (1, [2.0**21, 3.0], 0), (2, [2.0**20, 5.0], 1), (3, [2.0**20, 7.0], 1)]
    got = hard_negatives.mine(hard_negatives.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), F.expr("id % 100 = 0"))
    assert Counter(map(tuple, got.collect())) == _hard_negatives(rows)


# ---- 11


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("block", [2048, 2])
def test_no_pair_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rnd = random.Random(11)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(4, 8))) for _ in range(400)} | {"aaaaaa", "aaaaaaa", "bananas", "banana", "×÷×÷×÷", "×÷×÷×"}
    df = spark.createDataFrame([(w, i + 5) for i, w in enumerate(sorted(words))], "word string, n long")
    got = [frozenset((r.a, r.b)) for r in spelling.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and _near(a, b)}


def test_forms_and_roots(spark):
    rows = [("colours", 5000), ("colour", 1000), ("coloure", 100), ("cloloure", 10), ("colouri", 10), ("unlike", 5), ("gardens", 50), ("gardenz", 10), ("gardeny", 9)]
    got = {r.word: tuple(r)[1:] for r in spelling.group(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["colour"] == ("colours", "colours", 1000, 3, 5000)
    assert got["coloure"] == ("colours", "colours", 100, 4, 5000)  # the most frequent near word
    assert got["cloloure"] == ("coloure", "colours", 10, 1, 100)
    assert got["colours"] == (None, "colours", 5000, 3, None)
    assert got["unlike"] == (None, "unlike", 5, 0, None)
    assert got["gardenz"] == ("gardens", "gardens", 10, 2, 50) and got["gardens"][0] is None
    ties = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdea", 25)], "word string, n long")
    assert {r.word: r.form for r in spelling.group(ties).collect()}["abcdef"] == "abcdea"
    assert spelling.group(ties.limit(0)).collect() == []


def test_runs_of_odd_and_long_texts(spark, monkeypatch, odd):
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = [(i, w.translate(lower)) for i, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    for piece in (spelling.PIECE, 64):  # "z" * 3000 is a run longer than a piece
        monkeypatch.setattr(spelling, "PIECE", piece)
        assert Counter(map(tuple, spelling.runs(odd).collect())) == Counter(runs)
    want = Counter()
    for i, w in runs:
        h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
        want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    assert Counter(r.word for r in spelling.misspell(spelling.runs(odd)).collect()) == want
