"""Small literal graphs: order, caps, cycles, hashes."""

import re

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import hashing
from weftgraph.operators import ingest, metrics, queries, relational, search, traverse


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(f"e{i}", a, "CALLS", b, "src/a.ts", i, "exact", 1.0, False) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")])]
    return spark.createDataFrame(rows, "id string, head_id string, relation string, tail_id string, path string, line int, exactness string, confidence double, derived boolean")


def ids(df):
    return [r["edge_ids"] for r in traverse.presented(df).collect()]


def test_callees_in_discovery_order_and_cycle_safe(chain):
    found = queries.QUERIES["callees"].run(chain, "a", traverse.Limits(6, 32))
    assert sorted(ids(found)) == ["e0", "e0|e1", "e3", "e3|e4"]


def test_caps(chain):
    assert len(ids(queries.QUERIES["callees"].run(chain, "a", traverse.Limits(6, 2)))) == 2
    with pytest.raises(ValueError):
        traverse.Limits(0)


def test_dijkstra_prefers_the_cheaper(chain):
    assert ids(traverse.dijkstra(chain, "a", "c", ["CALLS"], [])) == ["e0|e1"]


def test_missing_source_has_no_paths(chain):
    assert ids(queries.QUERIES["callers"].run(chain, "nobody")) == []


def test_fnv(spark):
    assert spark.createDataFrame([("a",)], "t string").select(hashing.fnv64_hex("t")).first()[0] == "af63dc4c8601ec8c"


def test_signature_of_blank_text_sets_all_bits(spark):
    got = spark.createDataFrame([("",), (None,)], "t string").select(hashing.signature256("t").alias("s")).collect()
    assert all(r["s"] == [-1, -1, -1, -1] for r in got)


def test_metrics_conventions(spark):
    truth = spark.createDataFrame([("t1", "a"), ("t1", "b")], "task string, item string")
    found = spark.createDataFrame([("t1", "a"), ("t2", "z")], "task string, item string")
    got = {r["task"]: (r["precision"], r["recall"]) for r in metrics.prf1(truth, found).collect()}
    assert got == {"t1": (1.0, 0.5), "t2": (0.0, 0.0)}


def test_percentile_is_not_interpolated(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 10)], "g string, v double")
    assert metrics.percentile_ceil(rows, "g", "v", 0.5).first()["percentile"] == 3.0


def test_upsert_and_keep_first(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "x"), (2, "z")]


def test_gitignore_last_match_wins(spark):
    df = spark.createDataFrame([("a/x.log",), ("keep/x.log",), ("build/y.ts",)], "p string")
    got = [r[0] for r in df.select(ingest.gitignored(F.col("p"), ["*.log", "!keep/*", "build/"])).collect()]
    assert got == [True, False, True]


def test_query_terms():
    assert search.query_terms("Foo_bar x a.b") == ["foo", "bar", "a", "b"]


def test_fact_digests_see_every_fact(spark):
    nodes = spark.createDataFrame([("a", "Method", "a", "q.a", "src/a.ts", 1), ("b", "Table", "b", "q.b", "src/b.ts", 2)], "id string, kind string, name string, qualified_name string, path string, line int")
    rows = [(f"e{i}", "a", r, "b", "src/a.ts", i, "exact", 1.0, False, "base_exact", "production") for i, r in enumerate(["CONTAINS", "CALLS", "READS", "READS"])]
    schema = "id string, head_id string, relation string, tail_id string, path string, line int, exactness string, confidence double, derived boolean, edge_class string, context string"
    digests = lambda e, n: {(r["fact"], r["label"]): (r["facts"], r["digest"]) for r in hashing.fact_digests(n, spark.createDataFrame(e, schema)).collect()}
    old = digests(rows, nodes)
    assert {k: v[0] for k, v in old.items()} == {("entity", "Method"): 1, ("entity", "Table"): 1, ("edge", "CONTAINS"): 1, ("edge", "CALLS"): 1, ("edge", "READS"): 2, ("graph", "all"): 6}
    assert digests(rows[::-1], nodes) == old
    changed = lambda new: {k for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert changed(digests(rows[:3] + [rows[3][:7] + (0.9,) + rows[3][8:]], nodes)) == {("edge", "READS"), ("graph", "all")}
    assert changed(digests(rows + [rows[1]], nodes)) == {("edge", "CALLS"), ("graph", "all")}
    assert changed(digests(rows + [rows[1]] * 2, nodes)) == {("edge", "CALLS"), ("graph", "all")}
    assert changed(digests(rows, nodes.where("id = 'a'"))) == {("entity", "Table"), ("graph", "all")}


def test_overlap_join_takes_all_items_and_loses_none(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(1 + i % 7)) for i in range(40)] + [(40, ""), (41, None), (41, "w1 w2")]
    docs = [(i, text(i % 9)) for i in range(60)] + [(60, None), (1, "w1 w2 w3")]
    own = lambda t: set((t or "").split())
    want = sorted((a, b, round(len(own(q) & own(k)) / len(own(q)), 6)) for a, q in items for b, k in docs if own(q) and len(own(q) & own(k)) / len(own(q)) >= 0.5)
    got = search.overlap_join(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 0.5)
    assert sorted(map(tuple, got.collect())) == want and len({w[0] for w in want}) > 30


def test_dependents_of_a_chain_longer_than_any_bound(spark):
    imports = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(55)] + [("n0", "n3")], "importer string, imported string")
    got = [r["node"] for r in ingest.dependents(imports, spark.createDataFrame([("n0",)], "node string")).collect()]
    assert sorted(got) == sorted(f"n{i}" for i in range(56))


def test_scope_lookup_climbs_to_the_top_and_ends_on_cycles(spark):
    parents = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(12)] + [("a", "b"), ("b", "a"), ("s12", None)], "scope string, parent string")
    symbols = spark.createDataFrame([("s12", "x", 1), ("s2", "y", 2), ("s3", "y", 3), ("s1", "z", 4), ("s1", "z", 5), ("s2", "z", 6)], "scope string, name string, id long")
    uses = spark.createDataFrame([("s0", "x"), ("s0", "y"), ("s3", "y"), ("s0", "z"), ("s0", "none"), ("a", "x")], "scope string, name string")
    got = sorted(map(tuple, ingest.scope_lookup(uses, parents, symbols).collect()), key=str)
    assert got == sorted([("s0", "x", 1), ("s0", "y", 2), ("s3", "y", 3), ("s0", "z", None)], key=str)


def test_phrases_and_plain_terms(spark):
    docs = spark.createDataFrame([(1, "foo bar x"), (2, "bar foo"), (3, "Foo-BAR foo.bar"), (4, None), (5, "foobar"), (6, "a a a")], "id int, text string")
    assert search.query_phrases("foo_bar x a.b") == [("foo", "bar"), ("a", "b")]
    assert [r["id"] for r in search.bm25(docs, "foo_bar", 10).collect()] == [3, 1]
    assert {r["id"] for r in search.bm25(docs, "foo bar", 10).collect()} == {1, 2, 3}
    assert [r["id"] for r in search.bm25(docs, "a_a", 10).collect()] == [6] and search.bm25(docs, "?", 10).count() == 0


def test_signature_equals_votes(spark):
    def plain(t):
        tokens = [x for x in re.split(r"[^A-Za-z0-9_.]+", t) if x] or [t.strip()]
        out = []
        for w in range(4):
            votes = [0] * 64
            for x in tokens:
                h = (hashing.OFFSET ^ (w * hashing.GOLDEN)) & (2**64 - 1)
                for byte in x.lower().encode():
                    h = ((h ^ byte) * 1099511628211) & (2**64 - 1)
                h ^= h >> 32
                votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
            word = sum(1 << b for b, v in enumerate(votes) if v >= 0)
            out.append(word - (1 << 64) if word >> 63 else word)
        return out

    texts = ["one two Two", "\u00e9\u00e9", "a.b_c d", "x " * 300]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).select("i", hashing.signature256("t").alias("s")).orderBy("i").select("s").collect()]
    assert got == [plain(t) for t in texts]


def test_step_table_in_buckets(chain, monkeypatch):
    from weftgraph.sources import store

    monkeypatch.setattr(store, "BUCKET_STEPS", 2)
    steps = store.write_steps(chain)
    assert steps.schema["bucket"].metadata["buckets"] > 1
    assert sorted(ids(queries.QUERIES["callees"].run(steps, "a", traverse.Limits(6, 32)))) == ["e0", "e0|e1", "e3", "e3|e4"]
    assert [r["to"] for r in traverse.neighbors(steps, "a", ["CALLS"], ["CALLS"]).collect()] == ["b", "c", "d"]


def test_stream_merges_batches_and_goes_on(spark, tmp_path):
    from weftgraph.streaming.incremental import stream_latest

    def put(name, rows):
        spark.createDataFrame(rows, "k int, n int, v string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    schema = spark.createDataFrame([], "k int, n int, v string").schema
    put("a", [(1, 1, "a"), (2, 1, "b")])
    put("b", [(1, 2, "c"), (3, 1, "d")])
    run = lambda: sorted(tuple(r) for r in stream_latest(spark, str(tmp_path / "in" / "*"), schema, ["k"], ["n"], root=str(tmp_path / "state")).collect())
    assert run() == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    put("c", [(2, 5, "e"), (3, 0, "late")])
    assert run() == [(1, 2, "c"), (2, 5, "e"), (3, 1, "d")]
    assert run() == [(1, 2, "c"), (2, 5, "e"), (3, 1, "d")]


def test_interning_keeps_known_ids_and_goes_on_after_them(spark):
    from weftgraph.operators import upkeep

    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("z",)], "v string")
    known = spark.createDataFrame([("z", 7)], "value string, id int")
    assert {(r["value"], r["id"]) for r in upkeep.interned(rows, "v", known).collect()} == {("z", 7), ("a", 8), ("b", 9)}
    assert {(r["value"], r["id"]) for r in upkeep.interned(rows, "v", known.limit(0)).collect()} == {("a", 1), ("b", 2), ("z", 3)}
    assert upkeep.interned(rows.limit(0), "v", known.limit(0)).count() == 0


def test_upkeep_of_empty_tables(spark):
    from weftgraph.operators import upkeep

    none = spark.createDataFrame([], "id long, hamming int")
    assert upkeep.next_id([none, none], "id").first()[0] == 1
    assert upkeep.union_seeds(none, none).count() == 0
    assert upkeep.counts({"a": none}).collect()[0]["rows"] == 0
    assert upkeep.context_ratios(none, {"x": ("hamming", "id")}).first()[0] is None


def test_hamming_neighbours_equal_brute_force(spark, monkeypatch):
    import numpy as np

    from weftgraph.operators import vector

    rnd = np.random.default_rng(4)
    rows = [(int(i), rnd.integers(-(2**63), 2**63 - 1, 2).tolist()) for i in range(0, 900, 3)] + [(300, [1, 1]), (300, [1, 1]), (None, [1, 1]), (7, None), (1000, [5]), (1001, [4])]
    want = []
    for a, (i, w) in enumerate(rows):
        if i is not None and w and i % 100 == 0:
            near = sorted((sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(w, v)), j) for b, (j, v) in enumerate(rows) if b != a and j is not None and v and len(v) == len(w))
            want += [(i, j, h) for h, j in near[:6]]
    for block in (1 << 20, 64):
        monkeypatch.setattr(vector, "BLOCK_WORDS", block)
        got = vector.hamming_neighbours(spark.createDataFrame(rows, "id long, words array<bigint>"), F.expr("id % 100 = 0"), 6)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_repo_paths_lose_empty_and_dot_parts(spark):
    from weftgraph.operators import upkeep

    said = {"src/": "src", "a/./b": "a/b", " ./x\\y//z/. ": "x/y/z", "": "", "..": "..", "/": ""}
    df = spark.createDataFrame([(k,) for k in said], "p string")
    assert {r["p"]: r["q"] for r in df.withColumn("q", upkeep.repo_path(F.col("p"))).collect()} == said


def test_of_rows_with_one_key_the_least_is_kept(spark):
    from weftgraph.operators import upkeep

    rows = spark.createDataFrame([("k", 2, None), ("k", 1, "b"), ("k", 1, "a"), ("j", 5, "c"), (None, 1, "x")], "key string, n int, s string")
    assert sorted(map(tuple, upkeep.least_of(rows, ["key"]).collect()), key=str) == [("j", 5, "c"), ("k", 1, "a"), (None, 1, "x")]
    assert [r["key"] for r in upkeep.listed(rows.where("key is not null"), "key", 1).collect()] == ["j"]
    assert upkeep.listed(rows.select("key").where("key is not null"), "key", 5).count() == 2


def test_steps_are_stored_once_and_not_dealt(spark, chain, sf_dir):
    from weftgraph.sources import projection, store

    steps = store.write_steps(chain)
    files = steps.inputFiles()
    assert spark.read.parquet(*files).count() == chain.count() and steps.count() == 2 * chain.count()
    assert len(steps.where("direction = 'forward' and relation = 'CALLS'").inputFiles()) <= len(files)
    plain = lambda df: sorted(map(tuple, df.select("id", "head_id", "relation", "tail_id", "path", "line", "exactness", "confidence", "derived").collect()))
    assert plain(projection.edges(spark, sf_dir)) == plain(projection.edges(spark, sf_dir, whole=True))
