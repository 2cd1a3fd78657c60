"""Ingest, hashing, streaming and packet queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr, hashing
from ..operators import ingest as I
from ..operators import packet as K
from ..operators import queries as Q
from ..operators import relational as R
from ..operators import search as S
from ..operators import traverse as T
from ..sources import projection as P
from ..sources import store
from ..sources.shared import materialized
from ..streaming import incremental
from .graph_queries import WITH
from .table_queries import _LABELS as LABELS

QUERIES, ORACLES = {}, {}
t = P.table


def add(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_PATH = lambda: F.regexp_replace("url", r"^[a-z]+://[^/]*/|[?#].*$", "")
_pages = lambda s, d: t(s, d, "pages").select("page_id", F.concat(F.element_at(F.array(*map(F.lit, ("src", "build", "node_modules", "docs", "generated"))), (F.col("page_id") % 5 + 1).cast("int")), F.lit("/"), _PATH()).alias("path"))
_PG = "pg AS (SELECT page_id, ['src', 'build', 'node_modules', 'docs', 'generated'][1 + (page_id % 5)::INT] || '/' || regexp_replace(url, '^[a-z]+://[^/]*/|[?#].*$', '', 'g') AS path FROM pages)"
_RULES = ["*.html", "build/", "!docs/*", "/generated"]
_IGN = "CASE WHEN regexp_matches(path, '^generated(/|$)') THEN true WHEN regexp_matches(path, '(^|/)docs/.*(/|$)') THEN false WHEN regexp_matches(path, '(^|/)build/') THEN true WHEN regexp_matches(path, '(^|/).*\\.html(/|$)') THEN true ELSE false END"
add("q_gitignore_last_match", f"WITH {_PG} SELECT page_id, {_IGN} AS ignored FROM pg")(lambda s, d: _pages(s, d).select("page_id", I.gitignored(F.col("path"), _RULES).alias("ignored")))
add("q_glob_match", f"WITH {_PG} SELECT page_id, regexp_matches(path, '(^|/)docs/.*/1.*(/|$)') OR regexp_matches(path, '(^|/)src/en(/|$)') AS hit FROM pg")(lambda s, d: _pages(s, d).select("page_id", I.matches_any(F.col("path"), ["docs/*/1*", "src/en"]).alias("hit")))
add("q_scope_decision", f"""WITH {_PG}, g AS (SELECT *, {_IGN} AS ignored FROM pg) SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)docs/fr(/|$)') THEN 'explicit_exclude' WHEN regexp_matches(path, '(^|/)node_modules/en(/|$)') THEN 'explicit_include' WHEN starts_with(path, 'node_modules/') THEN 'hard_exclude'
  WHEN (starts_with(path, 'build/') OR starts_with(path, 'generated/')) THEN CASE WHEN ignored THEN 'soft_exclude' ELSE 'include_with_warning' END WHEN ignored THEN 'gitignore' ELSE 'include' END AS decision FROM g""")(
    lambda s, d: _pages(s, d).select("page_id", I.scope(F.col("path"), ["docs/fr"], ["node_modules/en"], I.gitignored(F.col("path"), _RULES)).alias("decision"))
)
_EXT = ["ts", "py", "rs", "hpp", "cjs", "txt"]
add("q_detect_language", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' WHEN 3 THEN 'cpp' WHEN 4 THEN 'javascript' END AS language FROM part")(
    lambda s, d: t(s, d, "part").select("p_partkey", expr.language(F.concat("p_name", F.lit("."), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("p_partkey") % 6 + 1).cast("int")))).alias("language"))
)
_SQLS = ["SELECT a FROM t{} WHERE x", "INSERT INTO t{} (a) VALUES (1)", "UPDATE t{} SET a = 1", "DELETE FROM t{};", "ALTER TABLE t{} ADD COLUMN c{}", "BEGIN t{}"]


def _sqls(s, d):
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.replace(F.lit(x), F.lit("{}"), (k % 17).cast("string")) for x in _SQLS)), (k % 6 + 1).cast("int"))
    return t(s, d, "orders").select("o_orderkey", text.alias("sql"))


add("q_sql_table_relation", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'READS_TABLE' WHEN 4 THEN 'DEPENDS_ON_SCHEMA' ELSE 'WRITES_TABLE' END AS relation, 't' || o_orderkey % 17 AS tbl FROM orders WHERE o_orderkey % 6 <> 5")(
    lambda s, d: _sqls(s, d).select("o_orderkey", I.sql_relation(F.col("sql"))[0].alias("relation"), I.sql_relation(F.col("sql"))[1].alias("tbl")).where("relation is not null")
)
add("q_sql_altered_column", "SELECT o_orderkey, 'c' || o_orderkey % 17 AS col FROM orders WHERE o_orderkey % 6 = 4")(lambda s, d: _sqls(s, d).select("o_orderkey", I.altered_column(F.col("sql")).alias("col")).where("col is not null"))


@add("q_module_candidates", """WITH f AS (SELECT 'src/m' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.tsx' END AS path FROM documents WHERE doc_id % 4 <> 1),
i AS (SELECT 'src/app' || doc_id || '.ts' AS importer, './m' || doc_id AS specifier, 'src/m' || doc_id AS raw FROM documents)
SELECT importer, specifier, path AS target FROM i JOIN f ON path IN (raw || '.ts', raw || '.js', raw || '/index.tsx')""")
def module_candidates(s, d):
    k = F.col("doc_id")
    files = t(s, d, "documents").where(k % 4 != 1).select(F.concat(F.lit("src/m"), k, F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".js").otherwise("/index.tsx")).alias("path"))
    imports = t(s, d, "documents").select(F.concat(F.lit("src/app"), k, F.lit(".ts")).alias("importer"), F.concat(F.lit("./m"), k).alias("specifier"))
    return I.module_targets(imports, files)


add("q_reexport_depth", "WITH RECURSIVE l AS (SELECT n_nationkey AS src, n_nationkey + 3 AS dst FROM nation), w AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN l ON src = node WHERE depth < 8) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1")(
    lambda s, d: I.reexport_depth(t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") + 3).cast("long").alias("dst")), s.createDataFrame([(0,)], "node long"))
)
add("q_resolver_impact", f"{WITH}, w AS (SELECT 's:1' AS node UNION SELECT head_id FROM edges JOIN w ON tail_id = node WHERE relation IN ('CALLS', 'CONTAINS')) SELECT node FROM w")(
    lambda s, d: I.dependents(P.edges(s, d).where("relation in ('CALLS', 'CONTAINS')").select(F.col("head_id").alias("importer"), F.col("tail_id").alias("imported")), s.createDataFrame([("s:1",)], "node string"))
)
_SP = "sp AS (SELECT 'f' || l_orderkey % 500 AS file, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS id, (l_partkey % 100)::INT AS s, (l_partkey % 100 + l_quantity)::INT AS e FROM lineitem)"


@add("q_enclosing_span", f"WITH {_SP} SELECT a.file, a.id AS inner_id, arg_min(b.id, (b.e - b.s, b.id)) AS outer_id FROM sp a JOIN sp b ON a.file = b.file AND b.s <= a.s AND b.e >= a.e AND a.id <> b.id GROUP BY ALL")
def enclosing_span(s, d):
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"))
    sp = t(s, d, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey") % 500).alias("file"), key.alias("id"), (F.col("l_partkey") % 100).cast("int").alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity")).cast("int").alias("end"))
    return I.enclosing(sp, sp)


@add("q_span_issues", "WITH e AS (SELECT doc_id AS id, doc_id % 23 AS line, doc_id AS path FROM documents UNION ALL SELECT -1 - doc_id, 1, -1 FROM documents WHERE doc_id < 5), s AS (SELECT doc_id AS path, string_split(text, chr(10)) AS l FROM documents) SELECT id, CASE WHEN l IS NULL THEN 'source_unavailable' WHEN line + 1 > len(l) THEN 'out_of_range' WHEN trim(l[line + 1]) = '' THEN 'empty_span' END AS issue FROM e LEFT JOIN s USING (path) WHERE issue IS NOT NULL AND line + 1 <> 0 AND NOT (l IS NULL AND line <> 1)")
def span_issues(s, d):
    docs = t(s, d, "documents")
    e = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 23 + 1).cast("int").alias("line"), F.col("doc_id").alias("path")).unionAll(docs.where("doc_id < 5").select(-1 - F.col("doc_id"), F.lit(2), F.lit(-1).cast("long")))
    return I.span_issues(e, docs.select(F.col("doc_id").alias("path"), F.split("text", "\n").alias("lines")))


_CALLS = ["app.get", "requireRole", "bus.emit", "expectThat", "plain", "it"]
add("q_call_rules", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'EXPOSES' WHEN 1 THEN 'CHECKS_ROLE' WHEN 2 THEN 'EMITS' WHEN 3 THEN 'ASSERTS' ELSE 'TESTS' END AS relation, CASE o_orderkey % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 WHEN 2 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM orders WHERE o_orderkey % 6 <> 4")(
    lambda s, d: I.routed_calls(t(s, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _CALLS)), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("name"))).select("o_orderkey", "relation", "confidence")
)


@add("q_scope_lookup", """WITH RECURSIVE sy AS (SELECT 'n:' || c_nationkey AS scope, c_mktsegment AS name, min(c_custkey) AS id, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'r:' || n_regionkey, 'BUILDING', min(n_nationkey), 1 FROM nation GROUP BY ALL),
u AS (SELECT DISTINCT 'n:' || n_nationkey AS scope, m AS name, 'r:' || n_regionkey AS up FROM nation, (SELECT DISTINCT c_mktsegment AS m FROM customer))
SELECT u.scope, u.name, CASE WHEN a.scope IS NOT NULL THEN CASE WHEN a.n = 1 THEN a.id END ELSE b.id END AS id FROM u LEFT JOIN sy a ON a.scope = u.scope AND a.name = u.name LEFT JOIN sy b ON b.scope = u.up AND b.name = u.name WHERE a.scope IS NOT NULL OR b.scope IS NOT NULL""")
def scope_lookup(s, d):
    n, c = t(s, d, "nation"), t(s, d, "customer")
    own = lambda tag, k: F.concat(F.lit(tag), F.col(k))
    symbols = c.select(own("n:", "c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id")).unionAll(n.groupBy(own("r:", "n_regionkey").alias("scope")).agg(F.lit("BUILDING").alias("name"), F.min("n_nationkey").cast("long").alias("id")))
    segments = F.explode(F.array(*map(F.lit, [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(50).collect()])))  # a handful of segments
    return I.scope_lookup(n.select(own("n:", "n_nationkey").alias("scope"), segments.alias("name")), n.select(own("n:", "n_nationkey").alias("scope"), own("r:", "n_regionkey").alias("parent")), symbols)


_FNV = "format('{{:016x}}', list_reduce(list_prepend({seed}::UHUGEINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"
add("q_fnv64", "SELECT n_nationkey, " + _FNV.format(seed="14695981039346656037", x="n_name") + " AS h FROM nation")(lambda s, d: t(s, d, "nation").select("n_nationkey", hashing.fnv64_hex("n_name").alias("h")))
_BYTES = "list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::UHUGEINT)"
_FOLD = "list_reduce(list_prepend({seed}::UHUGEINT, {bytes}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_PARTS = f"list_concat(list_append({_BYTES.format(x='path')}, 0::UHUGEINT), list_append({_BYTES.format(x='part')}, 0::UHUGEINT))"
_hex = lambda seed: "format('{:016x}', " + _FOLD.format(seed=seed, bytes="b") + "::UBIGINT)"
add("q_stable_id", f"{WITH}, x AS (SELECT id, {_PARTS} AS b FROM (SELECT id, path, lower(kind) || ':' || name AS part FROM entities)) SELECT id, 'repo://e/' || {_hex(hashing.OFFSET)} || {_hex(hashing.LOW_SEED)} AS stable_id FROM x")(lambda s, d: P.entities(s, d).select("id", hashing.stable_id(F.lit("repo://e/"), F.concat_ws("\x1f", "path", F.concat_ws(":", F.lower("kind"), "name"))).alias("stable_id")))


def signature_sql(rows: str) -> str:
    """DuckDB CTEs that end in `signed` (id, text, signature) of rows, a select of id and text: four words
    of sign bits. Each distinct token is hashed once for each word, then votes are counted bit by bit."""
    word = lambda w: _FOLD.format(seed=(hashing.OFFSET ^ (w * hashing.GOLDEN)) & (2**64 - 1), bytes=_BYTES.format(x="w")) + f"::UBIGINT AS h{w}"
    votes = ", ".join(f"sum((h{w} >> {b}) & 1)::BIGINT AS v{w}_{b}" for w in range(4) for b in range(64))
    bits = lambda w: " + ".join(f"CASE WHEN 2 * coalesce(v{w}_{b}, 0) >= coalesce(n, 0) THEN {1 << b if b < 63 else -(1 << 63)}::HUGEINT ELSE 0 END" for b in range(64))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""src AS ({rows}), tok AS (SELECT id, unnest(list_filter(regexp_split_to_array({low}, '[^a-z0-9_.]+'), lambda x: x <> '')) AS w FROM src), raw AS (SELECT w, {", ".join(map(word, range(4)))} FROM (SELECT DISTINCT w FROM tok)),
mix AS (SELECT w, {", ".join(f"xor(h{w}, h{w} >> 32) AS h{w}" for w in range(4))} FROM raw), sum_ AS (SELECT id, count(*) AS n, {votes} FROM tok JOIN mix USING (w) GROUP BY id),
signed AS (SELECT d.id, d.text, [{", ".join(f"({bits(w)})::BIGINT" for w in range(4))}] AS signature FROM src d LEFT JOIN sum_ ON sum_.id = d.id)"""


add("q_text_signature", f"WITH {signature_sql('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, signature FROM signed")(lambda s, d: t(s, d, "documents").select("doc_id", hashing.signature256("text").alias("signature")))
_INT8_DIMS = 32
add("q_int8_of_text", "WITH d AS (SELECT c_custkey AS id, c_name || ' ' || c_mktsegment || ' Repo_' || c_custkey % 3 || '-' || c_name AS text FROM customer), k AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_.]+'), lambda x: x <> '')) AS w FROM d), "
    "u AS (SELECT w, " + ", ".join(_FOLD.format(seed=(hashing.OFFSET ^ ((i * hashing.GOLDEN) & (2**64 - 1))), bytes=_BYTES.format(x="w")) + f"::UBIGINT AS h{i}" for i in range(_INT8_DIMS)) + " FROM (SELECT DISTINCT w FROM k)) "
    "SELECT id, [" + ", ".join(f"least(greatest(sum((xor(h{i}, h{i} >> 32) & 255)::BIGINT - 128), -127), 127)::INT" for i in range(_INT8_DIMS)) + "] AS v FROM k JOIN u USING (w) GROUP BY id")(
    lambda s, d: t(s, d, "customer").select(F.col("c_custkey").alias("id"), hashing.int8_of_text(_INT8_DIMS)(F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" Repo_"), F.col("c_custkey") % 3, F.lit("-"), "c_name")).alias("v"))
)
add("q_file_digest_xor", "SELECT lang, bit_xor(('0x' || substr(md5(text), 1, 15))::BIGINT) AS digest, count(*) AS files FROM documents GROUP BY 1")(
    lambda s, d: t(s, d, "documents").groupBy("lang").agg(F.bit_xor(F.conv(F.substring(F.md5(F.encode("text", "UTF-8")), 1, 15), 16, 10).cast("long")).alias("digest"), F.count("*").alias("files"))
)
add("q_graph_fact_hash", f"{WITH} SELECT relation, md5(string_agg(head_id || '|' || tail_id, chr(10) ORDER BY head_id || '|' || tail_id)) AS digest FROM edges WHERE relation = 'CONTAINS' GROUP BY 1")(
    lambda s, d: P.edges(s, d).where("relation = 'CONTAINS'").groupBy("relation").agg(F.md5(F.encode(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "head_id", "tail_id"))), "\n"), "UTF-8")).alias("digest"))
)
_ALL_FACTS = f"""{WITH}, {LABELS}, fact AS (
  SELECT 'entity' AS fact, kind AS label, concat_ws('|', 'entity', id, kind, name, qualified_name, path, path || ':' || line) AS line_ FROM entities
  UNION ALL SELECT 'edge', relation, concat_ws('|', 'edge', id, head_id, relation, tail_id, path || ':' || line, exactness, printf('%.6f', confidence), edge_class, context, derived) FROM full_),
h AS (SELECT fact, label, md5(line_) AS m FROM fact),
b AS (SELECT fact, label, substr(m, 1, 2) AS bucket, count(*) AS n, sum(('0x' || substr(m, 3, 15))::BIGINT) AS s1, sum(('0x' || substr(m, 18, 15))::BIGINT) AS s2 FROM h GROUP BY ALL),
l AS (SELECT fact, label, sum(n)::BIGINT AS facts, md5(string_agg(concat_ws('|', bucket, n, s1, s2), chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY ALL)
SELECT * FROM l UNION ALL SELECT 'graph', 'all', sum(facts)::BIGINT, md5(string_agg(concat_ws('|', fact, label, facts, digest), chr(10) ORDER BY fact, label)) FROM l"""
add("q_graph_fact_hash_all", _ALL_FACTS)(lambda s, d: hashing.fact_digests(P.entities(s, d), P.labelled(P.edges(s, d))))
add("q_affected_paths", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")(
    lambda s, d: t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).union(t(s, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()
)
add("q_object_id_lookup", "SELECT c_custkey AS id, 'current' AS source FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, 'history' FROM (SELECT DISTINCT o_custkey FROM orders) h WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = 0)")(
    lambda s, d: _objects(s, d)
)


def _objects(s, d):
    now = t(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    past = t(s, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(now, "id", "left_anti")
    return now.withColumn("source", F.lit("current")).unionByName(past.withColumn("source", F.lit("history")))


# ---- streaming

_EV = "user_id, event_id, event_type, value"


@add("q_incremental_stream", f"SELECT {_EV} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def incremental_stream(s, d):
    schema = t(s, d, "events").schema
    return incremental.stream_latest(s, f"{d}/event[s].parquet", schema, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type", "value")


@add("q_trace_replay", "WITH e AS (SELECT *, event_id % 10 = 7 AS bad FROM events) SELECT CASE WHEN NOT bad THEN 'run' || user_id % 20 END AS run_id, count(*) FILTER (NOT bad) AS events, count(*) FILTER (bad) AS malformed, count(*) FILTER (NOT bad AND event_id % 13 = 0) AS incomplete, count(DISTINCT CASE WHEN NOT bad THEN event_type END) AS tools, arg_max(CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'ok' ELSE 'error' END, event_id) FILTER (NOT bad AND event_id % 13 <> 0) AS last_status, coalesce(sum(CASE WHEN NOT bad THEN floor(value) END), 0)::BIGINT AS latency_ms FROM e GROUP BY 1")
def trace_replay(s, d):
    k = F.col("event_id")
    good = F.to_json(F.struct(F.concat(F.lit("run"), F.col("user_id") % 20).alias("run_id"), F.lit("tool_call").alias("event_type"), F.col("event_type").alias("tool"), F.when(k % 13 != 0, F.when(k % 2 == 0, "ok").otherwise("error")).alias("status"), F.floor("value").alias("latency_ms")))
    lines = t(s, d, "events").select(k.alias("pos"), F.when(k % 10 == 7, F.lit("{broken")).otherwise(good).alias("value"))
    return incremental.replay(lines)


# ---- evidence packet: seeds, candidates, graph paths, evidence, budget


@add("q_context_pack")
def context_pack(s, d):
    """Seeds named in a prompt, callees and writes around them, evidence within a budget."""
    edges, nodes = store.steps(s, d), P.entities(s, d)
    seeds = [r["id"] for r in S.symbol_search(nodes.where("kind = 'Function'"), "customer", 2).collect()]  # two seeds
    paths = None
    for seed in seeds:
        for name in ("callees", "mutations"):
            found = Q.QUERIES[name].run(edges, seed, T.Limits(2, 12, 5000))
            paths = found if paths is None else paths.unionByName(found)
    paths = materialized(Q.path_labels(T.unique_paths(paths)).where("context = 'production'").orderBy("cost", "target", "keys").limit(24), "packet")
    item = paths.select(F.col("source").alias("task"), F.lit("path").alias("section"), F.concat("source", F.lit(" "), "metapath", F.lit(" "), "target").alias("text"))
    risk = K.risks(paths).select(F.split_part("risk", F.lit(" "), F.lit(2)).alias("task"), F.lit("risk").alias("section"), F.col("risk").alias("text"))
    rows = R.local_ids(item.unionByName(risk).withColumn("g", F.concat("task", "section")), "g", ["text"]).withColumn("pos", F.col("local_id") - 1).withColumn("bytes", F.octet_length("text"))
    return K.compact(rows.select("task", "section", "pos", "text", "bytes"), 400).select("task", "section", "pos", "text")
