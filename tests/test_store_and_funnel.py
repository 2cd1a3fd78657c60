"""The fact store, bundles, the graph-truth gate and the funnel on small cases."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import bundles, funnel, truth
from weftgraph.operators import queries as Q
from weftgraph.operators import traverse as T
from weftgraph.sources import store
from weftgraph.streaming import factstore
from weftgraph.streaming.factstore import EVIDENCE, FactStore, stream_changes

FACTS = {"entities": "path string, id string", "edges": "path string, id string, head string"}


def _frames(spark, files, evidence=()):
    """files: path to (hash, entity ids, edge ids)."""
    rows = lambda k: [(p, i) for p, f in files.items() for i in f[k]]
    return (
        spark.createDataFrame([(p, f[0]) for p, f in files.items()], "path string, hash string"),
        {"entities": spark.createDataFrame(rows(1), FACTS["entities"]), "edges": spark.createDataFrame([(p, i, "h") for p, i in rows(2)], FACTS["edges"])},
        spark.createDataFrame(list(evidence), EVIDENCE),
    )


def _paths(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def _state(s):
    return {t: sorted((r["path"], r["id"]) for r in s.read(t).collect()) for t in ("entities", "edges", "evidence")} | {"files": sorted(r["path"] for r in s.read("files").collect())}


@pytest.fixture(scope="module")
def history(spark):
    """A store after an initial load, a change with deletions, and a rename."""
    first = {f"f{k}.ts": (f"h{k}", [f"a{k}", f"b{k}"], [f"e{k}"]) for k in range(12)}
    files, facts, evidence = _frames(spark, first, [("f0.ts", "p0", ["f0.ts", "f1.ts"]), ("f2.ts", "p2", ["f2.ts", "f3.ts"]), ("f4.ts", "p4", ["f4.ts"]), ("f5.ts", "p5", ["f0.ts"])])
    v1, done1 = FactStore.create(spark, FACTS, parts=8).apply(0, files, facts, None, evidence)
    files, facts, evidence = _frames(spark, {"f1.ts": ("new", ["a1"], []), "f4.ts": ("h4", ["ignored"], []), "g.ts": ("hg", ["g"], ["eg"])}, [("f1.ts", "p1", ["f1.ts", "g.ts"])])
    v2, done2 = v1.apply(1, files, facts, _paths(spark, "f3.ts", "absent.ts", None), evidence)
    files, facts, evidence = _frames(spark, {"moved/f6.ts": ("h6", ["a6"], ["e6"])})
    v3, done3 = v2.apply(2, files, facts, _paths(spark, "f6.ts"), evidence)
    return v1, v2, v3, done1, done2, done3


def test_three_batches_equal_a_rebuild(spark, history):
    v1, v2, v3, done1, done2, done3 = history
    assert done1["indexed"] == 12 and done1["new"] == 12
    assert {k: done2[k] for k in ("indexed", "new", "deleted", "renamed", "unchanged", "facts_removed", "evidence_removed")} == {"indexed": 2, "new": 1, "deleted": 1, "renamed": 0, "unchanged": 1, "facts_removed": 6, "evidence_removed": 2}
    assert done3["renamed"] == 1 and done3["deleted"] == 1
    now = {f"f{k}.ts": (f"h{k}", [f"a{k}", f"b{k}"], [f"e{k}"]) for k in (0, 2, 4, 5, 7, 8, 9, 10, 11)} | {"f1.ts": ("new", ["a1"], []), "g.ts": ("hg", ["g"], ["eg"]), "moved/f6.ts": ("h6", ["a6"], ["e6"])}
    files, facts, evidence = _frames(spark, now, [("f4.ts", "p4", ["f4.ts"]), ("f5.ts", "p5", ["f0.ts"]), ("f1.ts", "p1", ["f1.ts", "g.ts"])])
    rebuilt, _ = FactStore.create(spark, FACTS, parts=8).apply(0, files, facts, None, evidence)
    assert _state(v3) == _state(rebuilt) and v3.digest() == rebuilt.digest() and v3.differing(rebuilt) == []
    assert _state(v1) != _state(v2) and v1.digest() != v2.digest()  # a reader keeps its version
    assert v3.has_facts("moved/f6.ts") and not v3.has_facts("f6.ts") and not v3.has_facts("absent.ts")


def test_untouched_partitions_keep_their_files(history):
    v1, v2, v3, *_ = history
    kept = {k for k in v2.written if v2.written[k] == v1.written.get(k)}
    assert kept and len(kept) < len(v2.written)
    differ = set(v1.differing(v2))
    assert {int(k.split("/")[1]) for k in v2.written if v2.written[k] != v1.written.get(k)} >= differ and differ
    for k in kept:
        table, part = k.split("/")
        assert glob.glob(os.path.join(v1.root, table, f"v={v1.written[k]}", f"part={part}", "*.parquet"))
        assert not glob.glob(os.path.join(v1.root, table, f"v={v2.version}", f"part={part}"))


def test_a_batch_again_or_without_changes_makes_no_version(spark, history):
    *_, v3 = history[:3]
    files, facts, evidence = _frames(spark, {"z.ts": ("z", ["z"], [])})
    assert v3.apply(2, files, facts, None, evidence) == (v3, {"passed_over": 1})
    again, done = v3.apply(3, *_frames(spark, {"g.ts": ("hg", ["other"], [])})[:2])
    assert again is v3 and done == {"unchanged": 1}
    assert FactStore.open(spark, v3.root).version == v3.version
    broken = {"entities": facts["entities"].withColumn("id", F.raise_error(F.lit("broken")).cast("string"))}
    with pytest.raises(Exception, match="broken"):
        v3.apply(4, files, broken)
    assert _state(FactStore.open(spark, v3.root)) == _state(v3)


def test_a_stream_of_changes_goes_on_after_a_restart(spark, tmp_path):
    def extract(rows):
        live = rows.where("hash is not null")
        return live.select("path", "hash"), {"entities": live.select("path", F.col("hash").alias("id"))}, rows.where("hash is null").select("path"), None

    source = str(tmp_path / "changes")
    write = lambda rows, n: spark.createDataFrame(rows, "path string, hash string").coalesce(1).write.mode("append").parquet(source)
    write([("a", "1"), ("b", "1")], 0)
    write([("b", "2"), ("c", "1"), ("a", None)], 1)
    s = stream_changes(spark, FactStore.create(spark, {"entities": FACTS["entities"]}, parts=4), source, extract)
    write([("c", None), ("d", "1")], 2)
    s = stream_changes(spark, s, source, extract)
    assert {r["path"] for r in s.read("files").collect()} <= {"a", "b", "c", "d"} and s.batch == 2
    assert "d" in {r["path"] for r in s.read("files").collect()}


def test_facts_are_written_once(spark, monkeypatch):
    kept = []
    plain = factstore.materialized
    monkeypatch.setattr(factstore, "materialized", lambda df, name: kept.append((name, df.columns)) or plain(df, name))
    s, _ = FactStore.create(spark, FACTS, parts=4).apply(0, *_frames(spark, {"f.ts": ("h", ["a", "b"], ["e"])})[:2])
    assert s.read("edges").count() == 1 and not any("head" in columns for _, columns in kept)


# ---- bundles


def test_bundles_in_any_order_give_the_same_facts(spark):
    rows = [("entity", "b.ts", "x", 1, "one"), ("entity", "a.ts", "x", 2, "two"), ("entity", "a.ts", "x", 3, "three"), ("entity", "a.ts", "x", 4, "two"), ("entity", "c.ts", "x", 1, "two"), ("edge", "b.ts", "x", 1, "one"), ("entity", None, "x", 1, "n"), ("entity", "a.ts", None, 1, "n"), ("entity", "d.ts", "y", 1, None)]
    for order in (rows, rows[::-1]):
        facts, warnings = bundles.reduce_bundles(spark.createDataFrame(order, "kind string, path string, id string, seq int, said string").repartition(3))
        assert {(r["kind"], r["id"]): (r["path"], r["said"]) for r in facts.collect()} == {("entity", "x"): ("a.ts", "two"), ("edge", "x"): ("b.ts", "one"), ("entity", "y"): ("d.ts", None)}
        assert {tuple(r) for r in warnings.collect()} == {("entity", "a.ts", "x", "local", 1), ("entity", "b.ts", "x", "global", 1)}


def test_a_bundle_comes_back_whole_or_not_at_all(spark, tmp_path):
    big = "é" * 40_000
    events = spark.createDataFrame([(1, big), (2, "small"), (3, None), (4, big), (5, '{"payload_sha256": "x"}')], "id long, payload string")
    folder = str(tmp_path / "b")
    bundles.export_bundle({"events": events, "none": events.limit(0)}, folder, {"events": "payload"})
    back = bundles.import_bundle(spark, folder)
    assert sorted(map(tuple, back["events"].collect()), key=str) == sorted(map(tuple, events.collect()), key=str) and back["none"].collect() == []
    assert spark.read.parquet(f"{folder}/payloads/events").count() == 1
    spark.createDataFrame([(9, "more")], "id long, payload string").write.mode("append").json(f"{folder}/tables/events")
    with pytest.raises(ValueError):
        bundles.import_bundle(spark, folder)
    broken = events.withColumn("payload", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        bundles.export_bundle({"events": broken}, str(tmp_path / "c"))
    with pytest.raises(Exception):
        bundles.import_bundle(spark, str(tmp_path / "c"))


# ---- graph truth


def test_verdicts_of_the_gate(spark):
    entities = spark.createDataFrame([("k", "1", "login", "auth::login"), ("k", "2", "save", "db::save"), ("k", "3", "save", "file::save"), ("other", "1", "login", None)], "case_id string, id string, name string, qualified_name string")
    edge = lambda i, seq, h, t, line, x="exact", c=1.0, d=False: ("k", i, seq, h, "CALLS", t, "a.ts", line, x, c, d)
    observed = spark.createDataFrame([edge("e1", 1, "1", "3", 9), edge("e2", 2, "1", "2", 5, "inferred", 0.5), edge("e3", 3, "2", "1", 7), edge("e4", 4, "1", "gone", 5)], "case_id string, id string, seq long, head_id string, relation string, tail_id string, file string, line long, exactness string, confidence double, derived boolean")
    want = lambda i, h, t, line=5, bad=False, allowed=None, floor=None: ("k", i, "CALLS", h, t, "a.ts", line, bad, False, allowed, floor)
    expected = spark.createDataFrame(
        [want(1, "login", "save"), want(2, "login", "file::save"), want(3, "login", "db::save", 5, False, ["exact"]), want(4, "login", "db::save", 5, False, None, 0.9), want(5, "file::save", "login", 9), want(6, "login", "gone"), want(7, "login", "save", 5, True), want(8, "login", "save", 5, True, ["exact"]), want(9, "save", "auth::login", None)],
        "case_id string, expected_id long, relation string, head string, tail string, file string, line long, forbidden boolean, want_derived boolean, allowed array<string>, floor double",
    )
    judged = truth.match_edges(expected, observed, entities)
    assert {r["expected_id"]: (r["verdict"], r["edge_id"], r["by_span"]) for r in judged.collect()} == {
        1: ("matched", "e2", True), 2: ("matched", "e1", False), 3: ("semantics", "e2", True), 4: ("semantics", "e2", True), 5: ("wrong_direction", None, None), 6: ("missing", None, None), 7: ("forbidden_found", "e2", True), 8: ("clear", None, None), 9: ("matched", "e3", False),
    }
    assert truth.gate(judged).first() == ("k", False, 7) and truth.gate(judged, require_span=False).first()["failures"] == 5
    assert truth.match_edges(expected.limit(0), observed, entities).collect() == []


def test_many_entities_and_edges_of_one_name(spark):
    n = 2000  # expectations by entities of their name by edges are 12 million rows
    ids = spark.range(n).select(F.lit("k").alias("case_id"), F.col("id"))
    node = lambda tag, name: ids.select("case_id", F.concat(F.lit(tag), "id").alias("id"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("qualified_name"))
    entities = node("a", "save").unionByName(node("b", "load"))
    observed = ids.crossJoin(spark.range(3).select(F.col("id").alias("j"))).select("case_id", F.concat(F.lit("e"), "id", F.lit("-"), "j").alias("id"), F.col("id").alias("seq"), F.concat(F.lit("a"), "id").alias("head_id"), F.lit("CALLS").alias("relation"), F.concat(F.lit("b"), (F.col("id") + F.col("j")) % n).alias("tail_id"), F.lit("f.ts").alias("file"), (F.col("id") % 5).alias("line"), F.when(F.col("id") % 2 == 0, "exact").otherwise("inferred").alias("exactness"), F.lit(1.0).alias("confidence"), F.lit(False).alias("derived"))
    expected = ids.select("case_id", F.col("id").alias("expected_id"), F.lit("CALLS").alias("relation"), F.when(F.col("id") % 4 == 3, "load").otherwise("save").alias("head"), F.when(F.col("id") % 4 == 3, "save").otherwise("load").alias("tail"), F.lit("f.ts").alias("file"), (F.col("id") % 7).alias("line"), (F.col("id") % 4 == 2).alias("forbidden"), F.lit(False).alias("want_derived"), F.when(F.col("id") % 3 == 0, F.array(F.lit("exact"))).alias("allowed"), F.lit(None).cast("double").alias("floor"))
    got = {r["expected_id"]: (r["verdict"], r["edge_id"], r["by_span"]) for r in truth.match_edges(expected, observed, entities).collect()}
    for i in range(n):
        line, only = i % 7, i % 3 == 0
        if i % 4 == 3:
            want = ("wrong_direction", None, None)
        elif i % 4 == 2:
            at = next((s for s in range(n) if s % 5 == line and (not only or s % 2 == 0)), None)
            want = ("clear", None, None) if at is None else ("forbidden_found", f"e{at}-0", True)
        else:
            at = line if line < 5 else 0
            want = ("semantics" if only and at % 2 else "matched", f"e{at}-0", line < 5)
        assert got[i] == want, i


# ---- several origins at once, and the funnel


def test_searches_find_within_reach_what_they_find_in_all(spark, sf_dir):
    steps, limits = Q.relabel(store.steps(spark, sf_dir), {"FLOWS_TO": "PUBLISHES", "READS": "CONSUMES"}), T.Limits(3, 9, 120)
    origins = spark.createDataFrame([("c:1",), ("o:1",), ("nowhere",)], "source string")
    rows = lambda df: sorted((r["source"], tuple(s["id"] for s in r["steps"]), round(r["cost"], 6)) for r in df.collect())
    follows = [(list(q.forward), list(q.reverse)) for q in (Q.QUERIES["callees"], Q.QUERIES["mutations"])]
    near = T.within_reach(steps, origins, follows, limits.max_depth)
    assert 0 < near.count() < steps.count() / 10
    for name in ("callees", "mutations"):
        assert rows(Q.QUERIES[name].run_many(near, origins, limits)) == rows(Q.QUERIES[name].run_many(steps, origins, limits))


def test_a_level_over_its_limit_leaves_the_table_whole(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_ROWS", 2)
    steps = store.steps(spark, sf_dir)
    assert T.within_reach(steps, spark.createDataFrame([("c:1",)], "source string"), [(["CALLS"], ["CALLS"])], 3) is steps


def test_a_sieve_ranks_the_documents_up_to_the_kth_distance(spark):
    documents = funnel.signatures(spark.range(300).select(F.col("id").cast("string"), F.concat(F.lit("word"), F.col("id") % 40, F.lit(" order")).alias("text")))
    tasks = spark.createDataFrame([("t", "word3 order"), ("u", "nothing")], "task string, prompt string")
    got = funnel.sieve(tasks, documents, spark.createDataFrame([("u", "299")], "task string, id string"), 9)
    near = sorted(r["id"] for r in got.where("task = 't'").collect())
    assert set(near) >= {str(3 + 40 * k) for k in range(8)}
    assert len(near) == 9 and got.where("task = 'u' and not exact_seed").count() in (8, 9) and got.where("task = 'u' and exact_seed").count() == 1
    assert "<= bound" in got._jdf.queryExecution().optimizedPlan().toString()


def test_many_origins_are_searched_as_each_alone(spark, sf_dir):
    steps, limits = Q.relabel(store.steps(spark, sf_dir), {"FLOWS_TO": "PUBLISHES", "READS": "CONSUMES"}), T.Limits(3, 9, 120)
    origins = ["c:1", "o:1", "s:1", "p:1", "nowhere"]
    frame = spark.createDataFrame([(x,) for x in origins], "source string")
    rows = lambda df: sorted((r["source"], tuple(s["id"] for s in r["steps"]), round(r["cost"], 6)) for r in df.collect())
    for name in ("callers", "mutations"):
        alone = [r for x in origins for r in rows(Q.QUERIES[name].run(steps, x, limits))]
        assert rows(Q.QUERIES[name].run_many(steps, frame, limits)) == sorted(alone) and alone
    assert rows(Q.event_flows(steps, frame, limits)) == sorted(r for x in origins for r in rows(Q.event_flow(steps, x, limits)))


def test_the_funnel_keeps_seeds_and_drops_what_has_no_path(spark):
    entities = spark.createDataFrame([("1", "saveOrder", "db::saveOrder"), ("2", "loadOrder", "db::loadOrder"), ("3", "lonely", "x::lonely"), ("4", "orders", "db::orders")], "id string, name string, qualified_name string")
    rows = [("e1", "2", "CALLS", "1", "exact", 1.0), ("e2", "1", "WRITES", "4", "exact", 1.0), ("e3", "9", "TESTS", "1", "exact", 1.0)]
    edges = spark.createDataFrame(rows, "id string, head_id string, relation string, tail_id string, exactness string, confidence double").withColumn("path", F.lit("a.ts")).withColumn("context", F.lit("production"))
    documents = funnel.signatures(spark.createDataFrame([("1", "save the order"), ("2", "load an order"), ("3", "nothing at all"), (None, "x"), ("4", None), ("2", "a")], "id string, text string"))
    tasks = spark.createDataFrame([("t", "why does saveOrder fail"), ("u", None), ("v", "nothing at all")], "task string, prompt string")
    trace, paths, packet = funnel.run(tasks, documents, store.write_steps(edges), entities, funnel.Funnel(stage1=2, stage2=1, limits=T.Limits(3, 8, 100), budget=1000))
    got = {(r["task"], r["stage"][:6], r["id"]): r["kept"] for r in trace.collect()}
    assert got["t", "stage0", "1"] and got["t", "stage1", "1"] and got["t", "stage2", "1"] and got["t", "stage3", "1"] and got["t", "stage4", "1"]
    assert got["v", "stage2", "3"] and got["v", "stage3", "3"] is False and ("v", "stage4", "3") not in got
    assert sum(k[:2] == ("v", "stage2") for k in got) == 2
    assert {(r["relations"], r["target"]) for r in paths.where("task = 't' and source = '1'").collect()} == {("CALLS", "2"), ("WRITES", "4"), ("TESTS", "9")}
    text = [(r["section"], r["text"]) for r in packet.where("task = 't'").orderBy("section", "pos").collect()]
    assert ("risk", "Changing 1 may mutate 4") in text and ("test", "run tests covering 9") in text and sum(s == "path" for s, _ in text) >= 3
    none = funnel.run(tasks.limit(0), documents, store.write_steps(edges), entities)
    assert all(df.collect() == [] for df in none)


# ---- templates


def test_expanded_templates_equal_direct_extraction(spark):
    from weftgraph.operators import templates

    def direct(path):
        module = path.rsplit(".", 1)[0].replace("/", "::")
        return [(path, k, n, q) for k, n, q in (("Module", module, module), ("Function", "f", f"{module}.f"), ("Method", "g", f"{module}::f::g"), ("Import", "x", "lib.x"), ("Function", "odd", f"{module}s.f"))]

    paths = ["b/two.ts", "a/one.test.ts", "c", "d/e.js"]
    entities = spark.createDataFrame([r for p in paths for r in direct(p)], "path string, kind string, name string, qualified_name string").withColumn("line", F.lit(1)).withColumn("id", templates.entity_id(F.col("path"), F.col("kind"), F.col("qualified_name")))
    of = {(r["path"], r["name"]): r["id"] for r in entities.collect()}
    edges = spark.createDataFrame([(p, of[p, "f"], "CALLS", of[p, "g"], 3) for p in paths] + [(p, of[p, "f"], "CALLS", "gone", 4) for p in paths], "path string, head_id string, relation string, tail_id string, line int")
    files = spark.createDataFrame([("b/two.ts", "h"), ("a/one.test.ts", "h"), ("c", "h"), ("d/e.js", "other"), (None, "h"), ("z", None)], "path string, hash string")
    instances, t_entities, t_edges = templates.split(files, entities, edges)
    assert t_entities.count() == 10 and t_edges.count() == 4 and {r["canonical"] for r in instances.collect()} == {"a/one.test.ts", "d/e.js"}
    made = templates.expand_entities(instances, t_entities)
    # a name that only starts like the module's stays the canonical file's
    plain = lambda df: sorted(tuple(r) for r in df.where("name <> 'odd' and kind <> 'Module'").select("path", "id", "kind", "qualified_name").collect())
    assert plain(made) == plain(entities)
    assert {(r["path"], r["head_id"], r["tail_id"]) for r in templates.expand_edges(instances, t_entities, t_edges).collect()} == {(p, of[p, "f"], of[p, "g"]) for p in paths}


def test_template_joins_are_not_broadcast_by_estimates(spark, sf_dir):
    from weftgraph.operators import templates
    from weftgraph.plans import store_queries

    instances, t_entities, t_edges = templates.split(*store_queries._contents(spark, sf_dir))
    for made in (templates.expand_edges(instances, t_entities, t_edges), templates.expand_entities(instances, t_entities)):
        assert "Broadcast" not in made._jdf.queryExecution().sparkPlan().toString()  # facts come from generators, so estimates miss their number
