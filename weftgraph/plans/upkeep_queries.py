"""Upkeep queries of the fact store over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep as U
from ..sources import projection as P
from .graph_queries import WITH

QUERIES, ORACLES = {}, {}


def add(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


t, c = P.table, F.col
add("q_counts", f"{WITH} SELECT 'entities' AS name, count(*) AS rows FROM entities UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(DISTINCT path) FROM entities")(
    lambda s, d: U.counts({"entities": P.entities(s, d), "edges": P.edges(s, d), "files": P.entities(s, d).select("path").distinct()})
)
add("q_list_heuristic_edges", f"{WITH} SELECT id, head_id, relation, tail_id FROM edges WHERE exactness = 'static_heuristic' ORDER BY id LIMIT 200")(
    lambda s, d: U.listed(P.edges(s, d).where("exactness = 'static_heuristic'").select("id", "head_id", "relation", "tail_id"), "id", 200)
)
add("q_list_files", f"{WITH} SELECT DISTINCT path FROM entities ORDER BY path LIMIT 100")(lambda s, d: U.listed(P.entities(s, d).select("path"), "path", 100))
add("q_entities_by_file", f"{WITH} SELECT id, kind, name FROM entities WHERE path = 'src/supplier.ts'")(lambda s, d: P.entities(s, d).where("path = 'src/supplier.ts'").select("id", "kind", "name"))
add("q_foreign_keys", """WITH x AS (SELECT 'l_orderkey' AS key_column, l_orderkey AS k FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey FROM lineitem)
SELECT key_column, count(*) AS rows FROM x WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k) GROUP BY 1""")(
    lambda s, d: U.broken_references(t(s, d, "lineitem"), ["l_orderkey", "l_partkey"], t(s, d, "orders"), "o_orderkey")
)


@add("q_intern", """WITH k AS (SELECT n_name AS value, (10 * n_nationkey + 5)::BIGINT AS id FROM nation), v AS (SELECT DISTINCT o_clerk AS value FROM (SELECT 'clerk' || o_custkey AS o_clerk FROM orders UNION ALL SELECT n_name FROM nation))
SELECT value, id FROM k UNION ALL SELECT value, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY value) FROM v WHERE value NOT IN (SELECT value FROM k)""")
def intern(s, d):
    known = t(s, d, "nation").select(c("n_name").alias("value"), (10 * c("n_nationkey") + 5).cast("long").alias("id"))
    rows = t(s, d, "orders").select(F.concat(F.lit("clerk"), "o_custkey").alias("name")).unionByName(t(s, d, "nation").select(c("n_name").alias("name")))
    return U.interned(rows, "name", known)


add("q_prune_dictionary", "SELECT c_custkey AS id, c_name AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders UNION ALL SELECT user_id FROM events)")(
    lambda s, d: U.pruned(t(s, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("value")), [t(s, d, "orders").select(c("o_custkey").alias("id")), t(s, d, "events").select(c("user_id").alias("id"))])
)
add("q_next_id", "SELECT (coalesce(max(m), 0) + 1)::BIGINT AS next_id FROM (SELECT max(o_orderkey) AS m FROM orders UNION ALL SELECT max(c_custkey) FROM customer)")(
    lambda s, d: U.next_id([t(s, d, "orders").select(c("o_orderkey").alias("k")), t(s, d, "customer").select(c("c_custkey").alias("k"))], "k")
)
add("q_missing_metadata", "SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR text = '' THEN 'text' END, CASE WHEN lang IS NULL OR lang = '' THEN 'lang' END, CASE WHEN source IS NULL OR source = '' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents WHERE text IS NULL OR text = '' OR lang IS NULL OR lang = '' OR source IS NULL OR source = ''")(
    lambda s, d: U.missing_fields(t(s, d, "documents"), "doc_id", ["text", "lang", "source"]).withColumn("missing", F.array_join("missing", ","))
)


@add("q_fts_upsert", f"""{WITH} SELECT 'entity' AS kind, id, path, line, CASE WHEN kind = 'Package' THEN upper(name) || '!' ELSE name END AS title, kind || ' ' || CASE WHEN kind = 'Package' THEN upper(name) || '!' ELSE name END || ' ' || qualified_name AS body
FROM entities WHERE kind = 'Package' OR path <> 'src/tests/low.ts'""")
def fts_upsert(s, d):
    e = P.entities(s, d)
    new = e.where("kind = 'Package'").withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return U.fts_upsert(U.fts_rows(e), U.fts_rows(new), s.createDataFrame([("src/tests/low.ts",)], "path string"))


add("q_baseline_query", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+'), lambda x: length(x) >= 3)[1:8], ' ') AS query FROM benchmark")(
    lambda s, d: t(s, d, "benchmark").select("item_id", F.array_join(U.baseline_query(c("text")), " ").alias("query"))
)


@add("q_edge_routes", f"{WITH} SELECT route, count(*) AS edges FROM (SELECT CASE WHEN h.id IS NULL OR t.id IS NULL THEN 'dropped' WHEN e.exactness IN ('static_heuristic', 'inferred') THEN 'heuristic' ELSE 'facts' END AS route FROM edges e LEFT JOIN entities h ON h.id = e.head_id AND h.kind <> 'Package' LEFT JOIN entities t ON t.id = e.tail_id AND t.kind <> 'Package') GROUP BY 1")
def edge_routes(s, d):
    kept = P.entities(s, d).where("kind <> 'Package'")
    side = lambda k: kept.select(c("id").alias(f"{k}_id"), F.lit(True).alias(k))
    e = P.edges(s, d).select("relation", "exactness", "head_id", "tail_id").join(side("head"), "head_id", "left").join(side("tail"), "tail_id", "left")
    known = lambda k: F.coalesce(k, F.lit(False))
    return e.select(U.edge_route(c("relation"), c("exactness"), known("head"), known("tail")).alias("route")).groupBy("route").agg(F.count("*").alias("edges"))


add("q_union_seeds", "WITH h AS (SELECT o_custkey AS id, min(o_orderkey % 64)::INT AS hamming FROM orders GROUP BY 1), s AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000) SELECT coalesce(h.id, s.id) AS id, hamming, s.id IS NOT NULL AS exact_seed FROM h FULL JOIN s ON h.id = s.id")(
    lambda s, d: U.union_seeds(t(s, d, "orders").select(c("o_custkey").alias("id"), (c("o_orderkey") % 64).cast("int").alias("hamming")), t(s, d, "customer").where("c_acctbal > 5000").select(c("c_custkey").alias("id")))
)
add("q_merge_seeds", "SELECT o_custkey AS task, trim(o_orderpriority || ' ') AS value, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2")(
    lambda s, d: U.merged_seeds(t(s, d, "orders").select(c("o_custkey").alias("task"), F.concat("o_orderpriority", F.lit(" ")).alias("seed"), "o_orderkey"), "task", "seed", "o_orderkey")
)
add("q_dropped_ids", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events)")(
    lambda s, d: U.dropped(t(s, d, "customer").select(c("c_custkey").alias("id")), t(s, d, "orders").select(c("o_custkey").alias("id")), t(s, d, "events").select(c("user_id").alias("id")))
)
add("q_batch_starts", "SELECT doc_id, doc_id % 130 > 0 AND (doc_id % 130 >= 128 OR n_chars * 20000 + n_chars > 33554432) AS starts FROM documents")(
    lambda s, d: U.batch_starts(t(s, d, "documents").select("doc_id", (c("doc_id") % 130).alias("n"), (c("n_chars") * 20000).alias("size"), "n_chars"), "n", "size", "n_chars").select("doc_id", "starts")
)
_PATHS = ("' ./src//'", "'/lib\\'", "'././a/'", "'a/./b/'", "'x//./y\\./'", "''")  # what stands before the names
add("q_repo_paths", "SELECT p_partkey AS id, array_to_string(list_filter(string_split(replace(trim(p), '\\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path FROM (SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_PATHS)) + " END || p_name || CASE p_partkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '/./' ELSE '' END AS p FROM part)")(
    lambda s, d: t(s, d, "part").select(c("p_partkey").alias("id"), U.repo_path(F.concat(F.element_at(F.array(*(F.lit(x[1:-1]) for x in _PATHS)), (c("p_partkey") % 6 + 1).cast("int")), "p_name", F.when(c("p_partkey") % 4 == 0, "/").when(c("p_partkey") % 4 == 1, "/./").otherwise(""))).alias("path"))
)


@add("q_relation_score", """WITH o AS (SELECT DISTINCT o_custkey AS task, CASE o_orderstatus WHEN 'F' THEN 'CALLS' ELSE 'READS' END AS relation, lower('Src' || o_orderkey) AS os, lower('Tgt' || o_orderpriority) AS ot FROM orders),
e AS (SELECT DISTINCT c_custkey AS task, 'CALLS' AS relation, 'src' || c_custkey % 10 AS es, 'tgt' || (1 + c_custkey % 5) AS et FROM customer),
m AS (SELECT * FROM e JOIN o USING (task, relation) WHERE contains(os, es) AND contains(ot, et)),
f AS (SELECT task, count(DISTINCT (es, et)) AS found, count(DISTINCT (os, ot)) AS right_ FROM m GROUP BY 1), n AS (SELECT task, count(*) AS expected FROM e GROUP BY 1),
s AS (SELECT task, count(*) AS seen FROM o WHERE relation = 'CALLS' AND task IN (SELECT task FROM e) GROUP BY 1)
SELECT task, expected, coalesce(found, 0) AS found, CASE WHEN coalesce(seen, 0) = 0 THEN 0 ELSE round(coalesce(right_, 0) / seen, 6) END::DOUBLE AS precision, round(coalesce(found, 0) / expected, 6)::DOUBLE AS recall FROM n LEFT JOIN f USING (task) LEFT JOIN s USING (task)""")
def relation_score(s, d):
    o = t(s, d, "orders").select(c("o_custkey").alias("task"), F.when(c("o_orderstatus") == "F", "CALLS").otherwise("READS").alias("relation"), F.concat(F.lit("Src"), "o_orderkey").alias("source"), F.concat(F.lit("Tgt"), "o_orderpriority").alias("target"))
    k = c("c_custkey")
    e = t(s, d, "customer").select(k.alias("task"), F.lit("CALLS").alias("relation"), F.concat(F.lit("src"), k % 10).alias("source"), F.concat(F.lit("tgt"), 1 + k % 5).alias("target"))
    return U.relation_scores(e, o)


add("q_context_ratios", "SELECT round(sum(quality) / nullif(count(*), 0), 6)::DOUBLE AS quality_share, round(sum(toxic) / nullif(sum(quality), 0), 6)::DOUBLE AS toxic_per_quality, round(sum(toxic) / nullif(sum(0), 0), 6)::DOUBLE AS none FROM labels")(
    lambda s, d: U.context_ratios(t(s, d, "labels").select("quality", "toxic", F.lit(1).alias("one"), F.lit(0).alias("zero")), {"quality_share": ("quality", "one"), "toxic_per_quality": ("toxic", "quality"), "none": ("toxic", "zero")})
)


@add("q_symbol_matches", r"""WITH r AS (SELECT o_custkey AS task, o_orderkey AS rank, 'src/orders.' || o_orderpriority AS name FROM orders), x AS (SELECT task, rank, name AS symbol FROM r UNION SELECT task, rank, regexp_extract(name, '([^./]*)$', 1) FROM r)
SELECT task, symbol, min(rank) AS rank FROM x WHERE symbol IN ('1-URGENT', 'src/orders.5-LOW') AND task IN (SELECT c_custkey FROM customer) GROUP BY ALL""")
def symbol_matches(s, d):
    ranked = t(s, d, "orders").select(c("o_custkey").alias("task"), c("o_orderkey").alias("rank"), F.concat(F.lit("src/orders."), "o_orderpriority").alias("name"))
    expected = t(s, d, "customer").select(c("c_custkey").alias("task"), F.explode(F.array(F.lit("1-URGENT"), F.lit("src/orders.5-LOW"))).alias("symbol"))
    return U.symbol_matches(expected, ranked)
