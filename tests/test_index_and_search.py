"""Stored indexes, best-first search and event flow against plain references."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import expr
from weftgraph.operators import queries as Q
from weftgraph.operators import traverse as T
from weftgraph.operators.search import bm25
from weftgraph.operators.symbols import SymbolIndex
from weftgraph.operators.textindex import TextIndex
from weftgraph.sources import store

# ---- stored text index


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "foo", "bar", "Foo-Bar", "foo_bar", "x1", "the"]
    return {f"d{i}": " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40))) for i in range(120)}


def _same(spark, index, texts, query="foo_bar the alpha x1.the"):
    docs = spark.createDataFrame(sorted(texts.items()), "id string, text string")
    rows = lambda df: sorted((r["id"], round(r["score"], 6)) for r in df.collect())
    assert rows(index.search(query, 1000)) == rows(bm25(docs, query, 1000))
    assert index.n == len(texts)


def test_search_equals_the_scan_through_upkeep(spark, texts):
    docs = lambda part: spark.createDataFrame(sorted(part.items()), "id string, text string")
    now = dict(texts)
    index = TextIndex.create(spark, buckets=8).apply(docs(now))
    _same(spark, index, now)
    changed = {"d3": "foo bar foo bar", "d4": "", "new": "the alpha foo_bar", "d5": "bar foo"}
    now = {k: v for k, v in (now | changed).items() if k not in ("d7", "d8", "d9")}
    second = index.apply(docs(changed), spark.createDataFrame([("d7",), ("d8",), ("d9",), ("absent",)], "id string"))
    _same(spark, second, now)
    _same(spark, index, texts)  # a reader keeps its version
    third = second.apply(docs({"d7": "the the the", "d3": "alpha"}))
    now |= {"d7": "the the the", "d3": "alpha"}
    _same(spark, third, now)
    merged = third.merge()
    assert len(merged.segments) == 1
    _same(spark, merged, now)
    _same(spark, TextIndex.open(spark, merged.root), now)
    assert merged.total == sum(r["dl"] for r in merged.documents().collect())


def test_a_search_reads_its_terms_buckets_only(spark, texts):
    index = TextIndex.create(spark, buckets=16).apply(spark.createDataFrame(sorted(texts.items()), "id string, text string"))
    plan = index.postings(["foo"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("bucket=")[1].split("/")[0] for f in index.postings(["foo"]).inputFiles()}
    assert len(read) >= 1 and {r["term"] for r in index.postings(["foo"]).collect()} == {"foo"}


def test_phrases_and_odd_documents(spark):
    rows = [("a", "x foo bar foo bar"), ("b", None), ("c", ""), (None, "foo bar"), ("d", "foo  BAR"), ("e", "bar foo"), ("f", "aa aa aa"), ("d", "foo")]
    index = TextIndex.create(spark).apply(spark.createDataFrame(rows, "id string, text string").withColumn("dl", F.lit("clash")))
    assert {r["id"]: r["tf"] for r in index.phrase("foo bar").collect()} == {"a": 2, "d": 1}  # of two texts of d the greater one stays
    assert {r["id"]: r["tf"] for r in index.phrase("aa aa").collect()} == {"f": 2}  # occurrences overlap
    assert index.n == 6 and index.phrase("nothing here").collect() == [] and index.search("", 5).collect() == []
    empty = TextIndex.create(spark)
    assert empty.search("foo", 5).collect() == [] and empty.merge() is empty and empty.apply(None, spark.createDataFrame([("x",)], "id string")).n == 0


def test_a_write_that_fails_changes_nothing(spark):
    index = TextIndex.create(spark).apply(spark.createDataFrame([("a", "foo")], "id string, text string"))
    broken = spark.createDataFrame([("b", "foo")], "id string, text string").withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        index.apply(broken)
    again = TextIndex.open(spark, index.root)
    assert again.version == index.version and [r["id"] for r in again.search("foo", 5).collect()] == ["a"]


# ---- symbols


def test_symbol_features(spark):
    entities = spark.createDataFrame(
        [
            ("1", "Function", "Login", "auth::Login", "src/auth.ts", {"doc": "entry", "none": None}), ("2", "Function", "LoginForm", "auth::LoginForm", "src/form.ts", {}), ("3", "TestCase", "checks", "t.checks", "src/auth.test.ts", None),
            ("4", "Function", "other", "a.b.other", "src/o.ts", {}), ("5", "Class", "lxoxgxixn", "m.lxoxgxixn", "lib/x.ts", {}), ("6", "Function", "far", "m.far", "lib/f.ts", {"tag": "login"}), ("7", "Function", None, None, None, None),
        ], "id string, kind string, name string, qualified_name string, path string, metadata map<string, string>",
    )
    edges = spark.createDataFrame([("3", "TESTS", "1"), ("4", "CALLS", "1"), ("4", "CALLS", "missing")], "head_id string, relation string, tail_id string")
    index = SymbolIndex.create(entities, edges, spark.createDataFrame([("src/auth.ts",)], "path string"))
    got = {r["id"]: r for r in index.search(" Login ", 10).collect()}
    assert set(got) == {"1", "2", "3", "4", "5", "6"}
    assert got["1"]["score"] == pytest.approx(140 + 82 + 42 + 8 * 2 / 12 + 1, abs=1e-5) and got["1"]["features"]["recent_edit_signal"] == 0.2
    assert got["2"]["score"] == 52 + 14  # "loginform" is one token
    assert got["3"]["score"] == pytest.approx(18 + 42 + 8 / 12, abs=1e-5) and got["3"]["features"]["source_test_role"] == 1.0
    assert got["4"]["score"] == pytest.approx(18 + 42 + 8 * 2 / 12, abs=1e-5) and got["4"]["matched_terms"] == ["login"]
    assert got["5"]["features"] == {"fuzzy_match": 0.65} and got["6"]["score"] == 28 + 42
    assert [r["id"] for r in index.search("Login", 2).collect()] == ["1", "6"]
    assert {r["id"] for r in index.search("tests auth::login", 10).where("features['relation_neighbor_text'] is not null").collect()} == set()
    assert {r["id"] for r in index.search("tests login", 10).where("features['relation_neighbor_text'] is not null").collect()} == {"3"}  # over relation and text
    assert index.search("login test", 10).where("id = '3'").first()["score"] == pytest.approx(18 * 0 + 42 + 8 / 12 + 12, abs=1e-5)
    assert index.search("  ", 5).collect() == [] and index.search("login", 0).collect() == []


# ---- best-first search


def _edges(spark, rows):
    e = spark.createDataFrame(rows, "id string, head_id string, relation string, tail_id string, exactness string, confidence double")
    return e.withColumn("path", F.lit("src/a.ts")).withColumn("context", F.lit("production"))


def _cost(relation, exactness, confidence, depth):
    return expr.RELATION_COST.get(relation, 1.0) + min(max(1 - confidence, 0), 1) + expr.EXACTNESS_PENALTY[exactness] + depth * 0.05


def _heap(rows, source, forward, reverse, limits, accept=lambda path: True):
    """One heap, one path at a time; equal costs by length, then step keys."""
    heap, out, visited = [(0.0, 0, [], source, [source], 0.0)], [], 0
    while heap:
        rc, depth, keys, node, seen, cost = heapq.heappop(heap)
        if depth and accept(keys):
            out.append((tuple(k.split("\x01")[1] for k in keys), rc))
            if len(out) >= limits.max_paths:
                return out
        if depth >= limits.max_depth:
            continue
        steps = [(t, i, r, x, c) for i, h, r, t, x, c in rows if r in forward and h == node] + [(h, i, r, x, c) for i, h, r, t, x, c in rows if r in reverse and t == node]
        for to, i, r, x, c in steps:
            visited += 1
            if visited > limits.max_edges_visited:
                return out
            if to not in seen:
                grown = cost + _cost(r, x, c, depth + 1)
                heapq.heappush(heap, (round(grown, 6), depth + 1, [*keys, f"{to}\x01{i}"], to, [*seen, to], grown))
    return out


@pytest.mark.parametrize("budget", [7, 60])
def test_best_first_equals_a_heap(spark, budget):
    rnd = random.Random(budget)
    rows = [(f"e{i}", f"n{rnd.randrange(14)}", rnd.choice(["CALLS", "READS", "EXPOSES"]), f"n{rnd.randrange(14)}", rnd.choice(["exact", "parser_verified", "static_heuristic", "inferred"]), rnd.choice([1.0, 0.9, 0.5])) for i in range(50)]
    steps = store.write_steps(_edges(spark, rows))
    for limits in (T.Limits(4, 500, budget), T.Limits(3, 5, budget)):
        got = T.k_shortest(steps, "n1", ["CALLS", "READS"], ["EXPOSES", "CALLS"], limits)
        assert [(tuple(s["id"] for s in r["steps"]), round(r["cost"], 6)) for r in got.collect()] == _heap(rows, "n1", ["CALLS", "READS"], ["EXPOSES", "CALLS"], limits)
    limits = T.Limits(3, 400, budget)
    many = T.best_first(steps, spark.createDataFrame([("n1",), ("n2",), ("n3",), ("nowhere",)], "source string"), ["CALLS"], ["READS"], limits).where("accepted").orderBy("source", "place").collect()
    for n in ("n1", "n2", "n3", "nowhere"):  # each origin has a budget of its own
        assert [(tuple(s["id"] for s in r["steps"]), round(r["cost"], 6)) for r in many if r["source"] == n] == _heap(rows, n, ["CALLS"], ["READS"], limits)


def test_event_flow_reaches_handlers_within_its_budget(spark):
    rows = [("1", "publisher", "EMITS", "UserCreated", "static_heuristic", 0.7), ("2", "listener", "LISTENS_TO", "UserCreated", "static_heuristic", 0.7), ("3", "listener", "CALLS", "handler", "exact", 1.0), ("4", "producer", "PUBLISHES", "users.created", "static_heuristic", 0.7), ("5", "consumer", "CONSUMES", "users.created", "static_heuristic", 0.7), ("6", "handler", "CALLS", "mail", "exact", 1.0), ("7", "publisher", "PUBLISHES", "silence", "exact", 1.0)]
    steps = store.write_steps(_edges(spark, rows))
    flow = lambda source, *limits: [tuple(s["id"] for s in r["steps"]) for r in Q.event_flow(steps, source, T.Limits(*limits)).collect()]
    assert flow("publisher", 4, 32, 100) == [("1", "2"), ("1", "2", "3"), ("1", "2", "3", "6")]
    assert flow("publisher", 3, 32, 100) == [("1", "2"), ("1", "2", "3")]
    assert flow("publisher", 2, 32, 100) == [("1", "2")] and flow("publisher", 4, 2, 100) == [("1", "2"), ("1", "2", "3")]
    assert flow("publisher", 4, 32, 2) == []  # "silence" and "UserCreated" are looked at, its listener isn't
    assert flow("publisher", 4, 32, 3) == [("1", "2"), ("1", "2", "3"), ("1", "2", "3", "6")]
    assert flow("producer", 4, 32, 100) == [("4", "5")] and flow("nobody", 4, 32, 100) == []


def test_what_is_kept_for_a_folder_follows_its_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    made = []
    make = lambda: made.append(1) or len(made)
    assert store.once(spark, str(tmp_path), "x", make) == store.once(spark, str(tmp_path), "x", make) == 1
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert store.once(spark, str(tmp_path), "x", make) == 2


def test_symbol_index_keeps_no_copies_of_neighbours(spark):
    entities = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("Function").alias("kind"), F.concat(F.lit("name"), "id").alias("name"), F.concat(F.lit("m.name"), "id").alias("qualified_name"), F.lit("src/a.ts").alias("path"))
    edges = spark.range(400).select(F.col("id").cast("string").alias("head_id"), F.lit("CALLS").alias("relation"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda x: x.cast("string"))).alias("tail_id"))
    index = SymbolIndex.create(entities, edges)
    folders = spark._jvm.org.apache.hadoop.fs.Path(index.root)
    found = folders.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(folders)
    rows = sum(spark.read.parquet(s.getPath().toString()).count() for s in found)
    assert rows == 400 + edges.count()  # each entity and each edge once
    many = index.search_many(["name7", "  ", "calls"], 30)
    for query in ("name7", "calls"):
        plain = lambda df: sorted((r["id"], r["score"], sorted(r["features"].items()), r["matched_terms"]) for r in df.collect())
        assert plain(many.where(F.col("query") == query).drop("query")) == plain(index.search(query, 30)) and len(plain(index.search(query, 30))) == 30


def test_postings_are_made_where_a_document_is_read(spark, texts, monkeypatch):
    import pyarrow as pa

    from weftgraph.operators import textindex

    monkeypatch.setattr(textindex, "TERMS_AT_ONCE", 7)  # many pieces of a batch
    rows = [(f"d{i}", ws.split()) for i, ws in enumerate(["b a b", "", "a " * 20, "c a", "", "z b z"])]
    batch = pa.RecordBatch.from_pylist([{"id": i, "dl": len(w), "terms": w} for i, w in rows], schema=pa.schema([("id", pa.string()), ("dl", pa.int64()), ("terms", pa.list_(pa.string()))]))
    for piece in (batch, batch.slice(2, 3), batch.slice(1, 1)):
        got = {(r["term"], r["id"], r["dl"], tuple(r["at"])) for out in textindex._postings_of(iter([piece])) for r in out.to_pylist()}
        assert got == {(t, i, len(w), tuple(k for k, x in enumerate(w) if x == t)) for i, w in ((r["id"], r["terms"]) for r in piece.to_pylist()) for t in w}
