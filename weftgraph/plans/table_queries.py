"""Relational, search, vector and metric queries over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import metrics as M
from ..operators import packet as K
from ..operators import relational as R
from ..operators import search as S
from ..operators import vector as V
from ..sources import projection as P
from .graph_queries import WITH

QUERIES, ORACLES = {}, {}


def add(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


t = P.table
# ---- facts and labels

add("q_entities", f"{WITH} SELECT id, kind, name, qualified_name, path, line FROM entities")(lambda s, d: P.entities(s, d))
add("q_edges", f"{WITH} SELECT * FROM edges")(lambda s, d: P.edges(s, d))
add("q_edges_by_head_relation", f"{WITH} SELECT * FROM edges WHERE head_id = 'o:2' AND relation = 'CALLS'")(lambda s, d: P.edges(s, d).where("head_id = 'o:2' and relation = 'CALLS'"))
add("q_edges_by_tail_relation", f"{WITH} SELECT * FROM edges WHERE tail_id = 'p:2' AND relation IN ('READS', 'WRITES')")(lambda s, d: P.edges(s, d).where("tail_id = 'p:2' and relation in ('READS', 'WRITES')"))
add("q_exact_symbol", f"{WITH} SELECT id, name, qualified_name FROM entities WHERE id = 's:3' OR name = 'NATION_3' OR qualified_name = 'src::part.ts.x'")(
    lambda s, d: P.entities(s, d).where("id = 's:3' or name = 'NATION_3' or qualified_name = 'src::part.ts.x'").select("id", "name", "qualified_name")
)
add("q_relation_counts", f"{WITH} SELECT relation, count(*) AS edges, sum(derived::INT)::BIGINT AS derived FROM edges GROUP BY 1")(lambda s, d: R.relation_counts(P.edges(s, d)))
_LABELS = """lab AS (SELECT *, CASE WHEN path LIKE '%/tests/%' THEN 'test' ELSE 'production' END AS context FROM edges),
full_ AS (SELECT *, CASE WHEN context = 'test' THEN 'test' WHEN exactness IN ('static_heuristic', 'inferred') THEN 'base_heuristic' ELSE 'base_exact' END AS edge_class,
  CASE WHEN exactness IN ('static_heuristic', 'inferred') THEN 'unresolved_static_heuristic' ELSE 'not_recorded' END AS resolution FROM lab)"""
add("q_fact_mix", f"{WITH}, {_LABELS} SELECT 'exactness' AS label, exactness AS value, count(*) AS edges FROM full_ GROUP BY ALL UNION ALL SELECT 'edge_class', edge_class, count(*) FROM full_ GROUP BY ALL UNION ALL SELECT 'context', context, count(*) FROM full_ GROUP BY ALL")(lambda s, d: R.fact_mix(P.labelled(P.edges(s, d))))
add("q_edge_labels", f"{WITH}, {_LABELS} SELECT id, context, edge_class, resolution, CASE WHEN resolution = 'not_recorded' THEN 0 ELSE 1 | 2 | 8 END::INT AS flags, CAST(round(confidence * 1000) AS BIGINT) AS confidence_q FROM full_")(
    lambda s, d: P.labelled(P.edges(s, d)).select("id", "context", "edge_class", "resolution", "flags", expr.quantised(F.col("confidence")).alias("confidence_q"))
)
_PEN = "CASE exactness WHEN 'exact' THEN 0 WHEN 'parser_verified' THEN 0.05 ELSE 0.35 END"
add("q_step_cost", f"{WITH} SELECT id, round((1 - confidence) + {_PEN}, 6)::DOUBLE AS uncertainty, round(CASE WHEN relation = 'CONTAINS' THEN 1.0 ELSE 0.75 END + (1 - confidence) + {_PEN} + 0.05, 6)::DOUBLE AS cost FROM edges")(
    lambda s, d: P.edges(s, d).select("id", F.round(expr.uncertainty(F.col("confidence"), F.col("exactness")), 6).alias("uncertainty"), F.round(expr.step_cost(F.col("relation"), F.col("confidence"), F.col("exactness"), F.lit(1.0)), 6).alias("cost"))
)
add("q_downgrade_unresolved", f"{WITH}, {_LABELS} SELECT id, CASE WHEN context = 'test' AND exactness = 'parser_verified' THEN 'static_heuristic' ELSE exactness END AS exactness, CASE WHEN context = 'test' AND exactness = 'parser_verified' THEN least(confidence, 0.55) ELSE confidence END::DOUBLE AS confidence FROM full_")(
    lambda s, d: P.labelled(P.edges(s, d)).withColumn("down", F.expr("context = 'test' and exactness = 'parser_verified'")).select("id", F.when(F.col("down"), "static_heuristic").otherwise(F.col("exactness")).alias("exactness"), F.when(F.col("down"), F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence")).alias("confidence"))
)


@add("q_relation_allows_violations", f"{WITH} SELECT e.id, e.relation, h.kind AS head_kind, t.kind AS tail_kind FROM edges e JOIN entities h ON h.id = e.head_id JOIN entities t ON t.id = e.tail_id WHERE (e.relation, h.kind, t.kind) NOT IN (('CONTAINS', 'Repository', 'Package'), ('CALLS', 'Function', 'Method'), ('CALLS', 'Method', 'Method'), ('READS', 'Method', 'Table'), ('WRITES', 'Method', 'Table'))")
def relation_allows_violations(s, d):
    rows = [("CONTAINS", "Repository", "Package"), ("CALLS", "Function", "Method"), ("CALLS", "Method", "Method"), ("READS", "Method", "Table"), ("WRITES", "Method", "Table")]
    return R.endpoint_violations(P.edges(s, d, whole=True), P.entities(s, d), s.createDataFrame(rows, "relation string, head_kind string, tail_kind string"))


@add("q_edge_class_issues", f"{WITH}, {_LABELS} SELECT id, CASE edge_class WHEN 'test' THEN 'test_mock_edge' ELSE 'heuristic_edge' END AS issue FROM full_ WHERE edge_class IN ('test', 'base_heuristic')")
def edge_class_issues(s, d):
    c = F.col
    issues = F.array_compact(F.array(
        F.when(c("relation").isin(expr.DERIVED) & ~c("derived"), "derived_not_flagged"), F.when(c("derived"), "derived_without_provenance"),
        F.when(c("edge_class") == "base_heuristic", "heuristic_edge"), F.when(c("edge_class").isin("test", "mock", "mixed"), "test_mock_edge"), F.when(c("edge_class") == "unknown", "unknown_edge"),
    ))
    return P.labelled(P.edges(s, d)).select("id", F.explode(issues).alias("issue"))


@add("q_label_precision", "SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS wrong_span, count(*) AS samples, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1 AND toxic = 0) + count(*) FILTER (quality = 0), 0), 4) AS precision FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def label_precision(s, d):
    v = F.when(F.col("quality") == 0, "false_positive").when(F.col("toxic") == 0, "true_positive").otherwise("wrong_span")
    return R.label_precision(t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "source"), "doc_id").withColumn("verdict", v), "source")


add("q_collisions", "SELECT count(*) AS collisions FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)")(lambda s, d: R.collisions(t(s, d, "lineitem"), "l_orderkey", "l_linenumber"))
add("q_unresolved_page", f"{WITH}, {_LABELS} SELECT f.id, h.name AS head, t.name AS tail FROM full_ f JOIN entities h ON h.id = f.head_id JOIN entities t ON t.id = f.tail_id WHERE f.relation = 'CALLS' AND (f.exactness = 'static_heuristic' OR lower(f.resolution) LIKE '%unresolved%') ORDER BY f.id LIMIT 50 OFFSET 20")(
    lambda s, d: R.page(_unresolved(s, d), ["id"], 20, 50)
)


def _unresolved(s, d):
    e, n = P.labelled(P.edges(s, d)), P.entities(s, d)
    calls = e.where(F.expr("relation = 'CALLS' and (exactness = 'static_heuristic' or lower(resolution) like '%unresolved%')")).select("id", "head_id", "tail_id")
    return calls.join(n.select(F.col("id").alias("head_id"), F.col("name").alias("head")), "head_id").join(n.select(F.col("id").alias("tail_id"), F.col("name").alias("tail")), "tail_id").select("id", "head", "tail")


add("q_page_meta", "SELECT count(*) AS total, 100::BIGINT AS offset, greatest(least(count(*) - 100, 50), 0)::BIGINT AS returned, count(*) > 150 AS truncated, CASE WHEN count(*) > 150 THEN 150 END::BIGINT AS next_offset FROM orders")(lambda s, d: R.page_meta(t(s, d, "orders"), 100, 50))
add("q_sample_edges_seeded", "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) - min(o_orderkey) + 1 AS w FROM orders) SELECT o_orderkey, o_custkey FROM orders, b ORDER BY (((o_orderkey - lo - 12345 % w) % w) + w) % w, o_orderkey LIMIT 64")(
    lambda s, d: R.seeded_sample(t(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), 12345, 64)
)
add("q_storage_accounting", "SELECT 'documents' AS name, count(*) AS rows, sum(strlen(text) + strlen(lang) + strlen(source))::BIGINT AS bytes FROM documents UNION ALL SELECT 'pages', count(*), sum(strlen(url) + strlen(html))::BIGINT FROM pages UNION ALL SELECT 'benchmark', count(*), sum(strlen(text))::BIGINT FROM benchmark")(
    lambda s, d: R.accounting({"documents": (t(s, d, "documents"), ["text", "lang", "source"]), "pages": (t(s, d, "pages"), ["url", "html"]), "benchmark": (t(s, d, "benchmark"), ["text"])})
)
add("q_row_number_local_ids", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))::INT AS local_id FROM lineitem")(
    lambda s, d: R.local_ids(t(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "day"])
)
add("q_latest_upsert", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")(lambda s, d: R.latest(t(s, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"]))
add("q_keep_first", "SELECT md5(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")(lambda s, d: R.keep_first(t(s, d, "documents").select(F.md5(F.encode("text", "UTF-8")).alias("hash"), "doc_id"), ["hash"], ["doc_id"]))
add("q_upsert", "SELECT doc_id, lang, 0 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled', 1 FROM labels")(
    lambda s, d: R.upsert(t(s, d, "documents").select("doc_id", "lang", F.lit(0).alias("version")), t(s, d, "labels").select("doc_id", F.lit("labelled").alias("lang"), F.lit(1).alias("version")), ["doc_id"])
)
add("q_delete_cascade", f"{WITH}, gone AS (SELECT id FROM entities WHERE path = 'src/tests/low.ts') SELECT id, relation FROM edges WHERE path <> 'src/tests/low.ts' AND head_id NOT IN (SELECT id FROM gone) AND tail_id NOT IN (SELECT id FROM gone)")(
    lambda s, d: R.delete_cascade(P.edges(s, d, whole=True), P.entities(s, d), s.createDataFrame([("src/tests/low.ts",)], "path string")).select("id", "relation")
)


def _manifest(s, d, new):
    docs = t(s, d, "documents")
    if new:  # some files changed, some moved, some gone, some added
        docs = docs.where("doc_id % 7 <> 3").withColumn("path", F.when(F.col("doc_id") % 11 == 5, F.concat(F.lit("moved/"), "doc_id")).otherwise(F.concat(F.lit("doc/"), "doc_id")))
        body = F.when(F.col("doc_id") % 13 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    else:
        docs = docs.where("doc_id % 9 <> 4").withColumn("path", F.concat(F.lit("doc/"), "doc_id"))
        body = F.col("text")
    return docs.select("path", F.md5(F.encode(F.concat(body, F.lit("#"), "doc_id"), "UTF-8")).alias("hash"))


add("q_manifest_diff", """WITH o AS (SELECT 'doc/' || doc_id AS path, md5(text || '#' || doc_id) AS h FROM documents WHERE doc_id % 9 <> 4),
n AS (SELECT CASE WHEN doc_id % 11 = 5 THEN 'moved/' || doc_id ELSE 'doc/' || doc_id END AS path, md5(CASE WHEN doc_id % 13 = 1 THEN text || '!' ELSE text END || '#' || doc_id) AS h FROM documents WHERE doc_id % 7 <> 3),
b AS (SELECT coalesce(o.path, n.path) AS path, o.h AS oh, n.h AS nh FROM o FULL JOIN n ON o.path = n.path)
SELECT b.path, CASE WHEN b.oh IS NULL AND g.path IS NOT NULL THEN 'renamed' WHEN b.oh IS NULL THEN 'added' WHEN nh IS NULL THEN 'deleted' WHEN b.oh = nh THEN 'unchanged' ELSE 'changed' END AS state, CASE WHEN b.oh IS NULL THEN g.path END AS old_path
FROM b LEFT JOIN (SELECT oh, min(path) AS path FROM b WHERE nh IS NULL GROUP BY 1) g ON b.nh = g.oh""")(lambda s, d: R.manifest_diff(_manifest(s, d, False), _manifest(s, d, True)))
add("q_content_template_dups", "WITH h AS (SELECT doc_id, lang, md5(text) AS hash FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY hash, lang) AS template FROM h QUALIFY count(*) OVER (PARTITION BY hash, lang) > 1")(lambda s, d: _templates(s, d))


def _templates(s, d):
    h = t(s, d, "documents").select("doc_id", "lang", F.md5(F.encode("text", "UTF-8")).alias("hash"))
    g = h.groupBy("hash", "lang").agg(F.min("doc_id").alias("template"), F.count("*").alias("n")).where("n > 1")
    return h.join(g, ["hash", "lang"]).select("doc_id", "template")


# ---- search

_Q = "the anthly reheer was token"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_docs = lambda s, d: t(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
add("q_bm25_topk", f"""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({_LOW.format('text')}, '[^a-z0-9]+'), lambda x: x <> '') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d), q AS (SELECT unnest(['the', 'anthly', 'reheer', 'was', 'token']) AS term),
p AS (SELECT id, term, len(toks) AS dl, len(list_filter(toks, lambda x: x = term)) AS tf FROM d, q), f AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY 1)
SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6)::DOUBLE AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, id LIMIT 20""")(lambda s, d: S.bm25(_docs(s, d), _Q, 20))
add("q_bm25_like", f"SELECT doc_id AS id, round(len(list_intersect(['anthly', 'reheer', 'the', 'of'], regexp_split_to_array({_LOW.format('text')}, '[^a-z0-9_.]+'))) / 4, 6)::DOUBLE AS score FROM documents WHERE score > 0 ORDER BY score DESC, id LIMIT 50")(lambda s, d: S.overlap(_docs(s, d), ["anthly", "reheer", "the", "of"], 50))
add("q_source_scan", f"SELECT id, line, value FROM (SELECT doc_id AS id, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains({_LOW.format('value')}, 'license') ORDER BY id, line LIMIT 200")(lambda s, d: S.source_scan(_docs(s, d), "license", 200))
add("q_symbol_search", f"""{WITH}, l AS (SELECT id, qualified_name, lower(name) AS n, lower(qualified_name) AS q, lower(path) AS p, list_distinct(string_split(trim(regexp_replace(lower(regexp_replace(qualified_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS k FROM entities WHERE kind IN ('Package', 'Repository', 'Method'))
SELECT id, qualified_name, round(CASE WHEN n = 'nation_1' THEN 140 ELSE 0 END + CASE WHEN q = 'nation_1' THEN 130 ELSE 0 END + CASE WHEN q LIKE '%nation\\_1' ESCAPE '\\' AND q <> 'nation_1' THEN 82 ELSE 0 END + CASE WHEN starts_with(n, 'nation_1') AND n <> 'nation_1' THEN 52 ELSE 0 END
 + CASE WHEN starts_with(q, 'nation_1') AND q <> 'nation_1' THEN 38 ELSE 0 END + CASE WHEN contains(p, 'nation_1') THEN 36 ELSE 0 END + 42.0 * len(list_intersect(['nation'], k)) / 1 + CASE WHEN regexp_matches(n, 'n.*a.*t.*i.*o.*n.*_.*1') AND n <> 'nation_1' THEN 14 ELSE 0 END, 6)::DOUBLE AS score
FROM l WHERE score > 0 ORDER BY score DESC, qualified_name, id LIMIT 20""")(lambda s, d: S.symbol_search(P.entities(s, d).where("kind in ('Package', 'Repository', 'Method')"), "nation_1", 20))
add("q_symbol_tokens", r"SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(p_name || 'FooBar' || p_brand, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 2))) AS tokens FROM part")(
    lambda s, d: t(s, d, "part").select(F.col("p_partkey").alias("id"), expr.symbol_tokens(F.concat("p_name", F.lit("FooBar"), "p_brand")).alias("tokens"))
)
add("q_token_overlap", f"""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array({_LOW.format('text')}, '[^a-z0-9_.]+'), lambda x: x <> '')) AS q FROM benchmark WHERE item_id < 5),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array({_LOW.format('text')}, '[^a-z0-9_.]+'), lambda x: x <> '')) AS k FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(q, k)) / len(q), 6)::DOUBLE AS overlap FROM b, d WHERE len(list_intersect(q, k)) / len(q) >= 0.5""")(lambda s, d: _overlaps(s, d))


def _overlaps(s, d):
    # five fixed items against all documents: the items are the broadcast side
    b = t(s, d, "benchmark").where("item_id < 5").select("item_id", F.array_distinct(expr.signature_tokens(F.col("text"))).alias("q"))
    k = t(s, d, "documents").select("doc_id", F.array_distinct(expr.signature_tokens(F.col("text"))).alias("k"))
    share = F.size(F.array_intersect("q", "k")) / F.size("q")
    return k.join(F.broadcast(b), share >= 0.5).select("item_id", "doc_id", F.round(share, 6).alias("overlap"))


_TOK = f"list_distinct(list_filter(regexp_split_to_array({_LOW.format('text')}, '[^a-z0-9_.]+'), lambda x: x <> ''))"
add("q_token_overlap_all", f"""WITH b AS (SELECT row_number() OVER () AS bi, item_id, {_TOK} AS q FROM benchmark), d AS (SELECT row_number() OVER () AS di, doc_id, {_TOK} AS k FROM documents),
bt AS (SELECT bi, item_id, len(q) AS n, unnest(q) AS w FROM b), dt AS (SELECT di, doc_id, unnest(k) AS w FROM d)
SELECT item_id, doc_id, round(count(*) / n, 6)::DOUBLE AS overlap FROM bt JOIN dt USING (w) GROUP BY bi, di, item_id, doc_id, n HAVING count(*) / n >= 0.5""")(
    lambda s, d: S.overlap_join(t(s, d, "benchmark").select("item_id", "text"), t(s, d, "documents").select("doc_id", "text"), 0.5)
)


# ---- vectors

_V = "list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN 1 ELSE 0 END)"


@add("q_hamming_topk", f"WITH s AS (SELECT vec_id AS id, {_V} AS b FROM embeddings), q AS (SELECT b AS qb FROM s WHERE id = 0), h AS (SELECT id, list_sum(list_transform(list_zip(b, qb), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS hamming FROM s, q) SELECT id, hamming, 64 - 2 * hamming AS similarity FROM h ORDER BY hamming, id LIMIT 32")
def hamming_topk(s, d):
    v = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), V.sign_words(F.col("embedding"), 64).alias("words"))
    query = v.where("id = 0").first()
    return V.hamming_topk(v, query["words"], 64, 32)


@add("q_hamming_neighbours", f"""WITH s AS (SELECT vec_id AS id, {_V} AS b FROM embeddings), h AS (SELECT q.id AS query_id, s.id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.b[i] <> s.b[i] THEN 1 ELSE 0 END))::INT AS hamming FROM s q, s WHERE q.id % 100 = 0 AND q.id <> s.id)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hamming, id) <= 10""")
def hamming_neighbours(s, d):
    """Every row whose id is divisible by 100 against all rows."""
    v = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), V.sign_words(F.col("embedding"), 64).alias("words"))
    return V.hamming_neighbours(v, F.expr("id % 100 = 0"), 10)


@add("q_int8_quantise", "SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN m = 0 THEN 0 ELSE round(x::DOUBLE / m * 127) END::INT) AS q, round(m / 127, 9) AS scale FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)")
def int8_quantise(s, d):
    q, scale = V.int8(F.col("embedding"))
    return t(s, d, "embeddings").select(F.col("vec_id").alias("id"), q.alias("q"), F.round(scale, 9).alias("scale"))


@add("q_matryoshka_cosine", "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: round(x::DOUBLE / m * 127)::INT::DOUBLE) AS q FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)), z AS (SELECT q AS zq FROM v WHERE id = 1) SELECT id, round((list_cosine_similarity(q[1:32], zq[1:32]) + 1) / 2, 6)::DOUBLE AS cos32, round((list_cosine_similarity(q, zq) + 1) / 2, 6)::DOUBLE AS cos64 FROM v, z")
def matryoshka_cosine(s, d):
    v = t(s, d, "embeddings").select(F.col("vec_id").alias("id"), V.int8(F.col("embedding"))[0].alias("q"))
    z = F.array(*map(F.lit, v.where("id = 1").first()["q"]))
    return v.select("id", F.round(V.prefix_cosine(F.col("q"), z, 32), 6).alias("cos32"), F.round(V.prefix_cosine(F.col("q"), z, 64), 6).alias("cos64"))


@add("q_rerank", """WITH r AS (SELECT vec_id AS id, round(0.35 * ((vec_id % 10) / 10) + 0.35 * ((vec_id % 7) / 7) + 0.20 * least(greatest(((vec_id % 100) - 50) / 512 + 0.5, 0), 1) + 0.10 * (label % 2) + CASE WHEN vec_id % 50 = 0 THEN 10 ELSE 0 END, 6)::DOUBLE AS score, vec_id % 50 = 0 AS exact_seed FROM embeddings),
k AS (SELECT id, exact_seed, score FROM r ORDER BY score DESC, exact_seed DESC, id LIMIT 8) SELECT * FROM k UNION ALL SELECT id, exact_seed, 10.0 FROM r WHERE exact_seed AND id NOT IN (SELECT id FROM k)""")
def rerank(s, d):
    i = F.col("vec_id")
    rows = t(s, d, "embeddings").select(i.alias("id"), ((i % 10) / 10).alias("text_score"), ((i % 7) / 7).alias("vector_score"), (i % 100 - 50).cast("double").alias("stage1"), (F.col("label") % 2).cast("double").alias("metadata_score"), (i % 50 == 0).alias("exact_seed"))
    return V.rerank(rows, 8)


# ---- metrics

_found = lambda s, d: t(s, d, "lineitem").where("l_returnflag <> 'N'").select((F.col("l_orderkey") % 50).alias("task"), (F.col("l_partkey") % 40).alias("item"))
_truth = lambda s, d: t(s, d, "lineitem").where("l_quantity > 30").select((F.col("l_orderkey") % 53).alias("task"), (F.col("l_partkey") % 40).alias("item"))
add("q_prf1", """WITH t AS (SELECT DISTINCT l_orderkey % 53 AS task, l_partkey % 40 AS item FROM lineitem WHERE l_quantity > 30), f AS (SELECT DISTINCT l_orderkey % 50 AS task, l_partkey % 40 AS item FROM lineitem WHERE l_returnflag <> 'N'),
n AS (SELECT coalesce(t.task, f.task) AS task, count(*) FILTER (t.task IS NOT NULL AND f.task IS NOT NULL) AS hit, count(t.task) AS t, count(f.task) AS f FROM t FULL JOIN f ON t.task = f.task AND t.item = f.item GROUP BY 1),
p AS (SELECT task, CASE WHEN f = 0 THEN CASE WHEN t = 0 THEN 1.0 ELSE 0.0 END ELSE hit / f END AS p, CASE WHEN t = 0 THEN CASE WHEN f = 0 THEN 1.0 ELSE 0.0 END ELSE hit / t END AS r FROM n)
SELECT task, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM p""")(lambda s, d: M.prf1(_truth(s, d), _found(s, d)))


@add("q_ranked_metrics", """WITH w AS (SELECT DISTINCT user_id % 40 AS task, event_type AS item FROM events WHERE value > 60), r AS (SELECT user_id % 40 AS task, row_number() OVER (PARTITION BY user_id % 40 ORDER BY value DESC, event_id)::INT AS rank, event_type AS item FROM events),
h AS (SELECT r.* FROM r SEMI JOIN w ON r.task = w.task AND r.item = w.item), b AS (SELECT task, count(DISTINCT CASE WHEN rank <= 10 THEN item END) AS hits, min(rank) AS first_, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM h GROUP BY 1), n AS (SELECT task, count(*) AS want FROM w GROUP BY 1)
SELECT task, round(coalesce(hits, 0) / want, 6)::DOUBLE AS recall_at_k, round(coalesce(1 / first_, 0), 6)::DOUBLE AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(want, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6)::DOUBLE AS ndcg FROM n LEFT JOIN b USING (task)""")
def ranked_metrics(s, d):
    from pyspark.sql.window import Window as W

    e = t(s, d, "events").withColumn("task", F.col("user_id") % 40)
    ranked = e.select("task", F.row_number().over(W.partitionBy("task").orderBy(F.desc("value"), "event_id")).alias("rank"), F.col("event_type").alias("item"))
    return M.ranked_metrics(e.where("value > 60").select("task", F.col("event_type").alias("item")), ranked, 10)


_scored = lambda s, d: t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.least(F.col("n_chars"), F.lit(3999)) / 4000).alias("p"), F.col("quality").cast("double").alias("y"))
_SC = "WITH s AS (SELECT least(n_chars, 3999) / 4000 AS p, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id))"
add("q_calibration_buckets", f"{_SC}, b AS (SELECT least(floor(p * 10), 9)::INT AS bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM s GROUP BY 1) SELECT r.i::INT AS bucket, coalesce(n, 0) AS n, mean_p, observed FROM range(10) r(i) LEFT JOIN b ON b.bucket = r.i")(lambda s, d: M.calibration(_scored(s, d), s))
add("q_brier", f"{_SC} SELECT round(avg((p - y) ** 2), 6) AS brier, count(*) AS n FROM s")(lambda s, d: M.brier(_scored(s, d)))
add("q_percentile_ceil", "WITH e AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[ceil((len(v) - 1) * 0.95)::INT + 1] AS percentile FROM e")(lambda s, d: M.percentile_ceil(t(s, d, "events"), "event_type", "value", 0.95))
add("q_aggregate_baselines", "SELECT event_type AS baseline, round(avg(value), 6) AS mean, round(max(value), 6) AS worst, count(*) AS runs FROM events WHERE value > 1 GROUP BY 1")(lambda s, d: t(s, d, "events").where("value > 1").groupBy(F.col("event_type").alias("baseline")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("worst"), F.count("*").alias("runs")))
add("q_gap_classify", "SELECT c_custkey, CASE WHEN abs(c_acctbal - 5000) <= 500 THEN 'tie' WHEN c_acctbal > 5000 THEN 'win' ELSE 'loss' END AS gap FROM customer")(lambda s, d: t(s, d, "customer").select("c_custkey", M.gap(F.col("c_acctbal"), F.lit(5000.0), 500.0).alias("gap")))
add("q_regressions", "WITH n AS (SELECT event_type AS name, avg(value) AS ms FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS name, avg(value) AS ms FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT name, round(n.ms, 6) AS now_ms, round(b.ms, 6) AS base_ms, n.ms - b.ms > 1 AND n.ms / b.ms > 1.25 AS degraded FROM n JOIN b USING (name)")(
    lambda s, d: M.regressions(*(t(s, d, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("ms")) for k in (0, 1))).select("name", F.round("now_ms", 6).alias("now_ms"), F.round("base_ms", 6).alias("base_ms"), "degraded")
)
add("q_verdicts", "SELECT o_orderpriority AS dimension, CASE max(CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 1 THEN 'unknown' ELSE 'pass' END AS verdict FROM orders GROUP BY 1")(
    lambda s, d: M.worst(t(s, d, "orders").select(F.col("o_orderpriority").alias("dimension"), F.when(F.col("o_orderstatus") == "P", "fail").when(F.col("o_orderstatus") == "O", "unknown").otherwise("pass").alias("verdict")), "dimension")
)
add("q_path_sequence", "SELECT o_custkey AS task, count(*) AS n FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders GROUP BY 1) WHERE len(r) >= 2 AND len(list_filter(range(1, len(r)), lambda i: r[i] = 'F' AND r[i + 1] = 'O')) > 0 GROUP BY 1")(lambda s, d: _sequences(s, d))


def _sequences(s, d):
    rel = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    o = t(s, d, "orders").groupBy("o_custkey").agg(rel.alias("r"))
    return o.where(M.contains_sequence(F.col("r"), ["F", "O"])).groupBy(F.col("o_custkey").alias("task")).agg(F.count("*").alias("n"))


# ---- packets

add("q_packet_compaction", """WITH i AS (SELECT o_custkey AS task, CASE o_orderkey % 4 WHEN 0 THEN 'snippet' WHEN 1 THEN 'path' WHEN 2 THEN 'risk' ELSE 'test' END AS section, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey)::INT - 1 AS pos, 100 + o_orderkey % 900 AS bytes FROM orders),
u AS (SELECT *, sum(bytes) OVER (PARTITION BY task ORDER BY CASE WHEN pos = 0 THEN 1 ELSE 0 END DESC, CASE section WHEN 'snippet' THEN 0 WHEN 'path' THEN 1 WHEN 'risk' THEN 2 ELSE 3 END DESC, pos ROWS UNBOUNDED PRECEDING) AS upto FROM i)
SELECT task, section, pos, bytes, upto::BIGINT AS upto FROM u WHERE floor(upto / 4) <= 600""")(lambda s, d: _packets(s, d))


def _packets(s, d):
    from pyspark.sql.window import Window as W

    k = F.col("o_orderkey")
    section = F.when(k % 4 == 0, "snippet").when(k % 4 == 1, "path").when(k % 4 == 2, "risk").otherwise("test")
    rows = t(s, d, "orders").select(F.col("o_custkey").alias("task"), section.alias("section"), (F.row_number().over(W.partitionBy("o_custkey", k % 4).orderBy("o_orderkey")) - 1).alias("pos"), (100 + k % 900).alias("bytes"))
    return K.compact(rows, 600)


add("q_snippets", "SELECT doc_id, trim(array_to_string(list_transform(string_split(text, chr(10))[2:4], lambda x: trim(x)), ' ')) AS snippet FROM documents")(
    lambda s, d: t(s, d, "documents").select("doc_id", K.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))
)


@add("q_prompt_seeds", r"""WITH p AS (SELECT o_orderkey AS task, unnest(['error: TypeError in src/orders/f' || o_orderkey % 5 || '.ts:' || o_orderkey % 90, 'at app.run' || o_orderkey % 3 || ' (x)', 'check loadOrder and svc.find_all(id)']) AS l, unnest([0, 1, 2]) AS row_ FROM orders),
s AS (SELECT task, row_, 'stack_trace' AS kind, unnest(regexp_extract_all(l, 'at ([A-Za-z_][A-Za-z0-9_.]*) \(', 1)) AS value FROM p UNION ALL SELECT task, row_, 'error', unnest(regexp_extract_all(l, '([A-Z][A-Za-z]*Error)', 1)) FROM p
 UNION ALL SELECT task, row_, 'path', unnest(regexp_extract_all(l, '([A-Za-z0-9_./-]+\.(?:ts|js|py|rs|go|java))', 1)) FROM p UNION ALL SELECT task, row_, 'line', unnest(regexp_extract_all(l, ':(\d+)', 1)) FROM p
 UNION ALL SELECT task, row_, 'symbol', unnest(regexp_extract_all(l, '([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)+)\(', 1)) FROM p UNION ALL SELECT task, row_, 'identifier', unnest(regexp_extract_all(l, '([a-z]+[A-Z][A-Za-z0-9]*)', 1)) FROM p)
SELECT task, kind, value, min(row_)::INT AS first_row FROM s GROUP BY ALL""")
def prompt_seeds(s, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("error: TypeError in src/orders/f"), k % 5, F.lit(".ts:"), k % 90, F.lit("\nat app.run"), k % 3, F.lit(" (x)\ncheck loadOrder and svc.find_all(id)"))
    return K.prompt_seeds(t(s, d, "orders").select(k.alias("task"), text.alias("text")))
