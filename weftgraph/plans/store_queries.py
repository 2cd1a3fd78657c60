"""Queries of the fact store, bundles and the graph-truth gate over the tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import bundles as B
from ..operators import templates, truth
from ..sources.modules import line_key
from ..sources.projection import table as t
from ..sources.shared import shared_path
from ..streaming.factstore import FactStore

QUERIES, ORACLES = {}, {}
c = F.col


def add(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# ---- files that change: customers are files, orders their entities, lines their edges

FACTS = {"entities": "path string, id long, kind string", "edges": "path string, id string, head long, tail long"}


def _of(path, rows):
    """(files, facts, evidence) of customers (c_custkey, ...) under the path that a column gives them."""
    return rows.select(path(c("c_custkey")).alias("path"), F.md5(F.concat_ws("|", "c_name", "salt").cast("binary")).alias("hash"), c("c_custkey").alias("k"))


def _home(k):
    return F.concat(F.lit("src/c"), k, F.lit(".ts"))


def _moved(k):
    return F.concat(F.lit("src/moved/c"), k, F.lit(".ts"))


def _batch(s, d, files, even=False):
    orders = t(s, d, "orders").join(files.select("path", "k"), c("o_custkey") == c("k"))
    if even:  # of changed files every second order is left
        orders = orders.where((c("k") % 10 != 3) | (c("o_orderkey") % 2 == 0))
    lines = t(s, d, "lineitem").join(orders.select("path", "o_orderkey"), c("l_orderkey") == c("o_orderkey"))
    facts = {
        "entities": orders.select("path", c("o_orderkey").alias("id"), F.lit("Function").alias("kind")),
        "edges": lines.select("path", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("id"), c("l_orderkey").alias("head"), c("l_partkey").alias("tail")),
    }
    evidence = orders.select("path", F.concat(F.lit("ev:"), "o_orderkey").alias("id"), F.array("path", _home(1 + (c("o_orderkey") * 7) % 1000)).alias("files"))
    return files.select("path", "hash"), facts, evidence


def changed_store(s, d) -> FactStore:
    """Three batches: all but every tenth file; changed, deleted and late ones; renamed and unchanged ones."""
    customer, last = t(s, d, "customer").withColumn("salt", F.lit("a")), c("c_custkey") % 10
    store = FactStore.create(s, FACTS, parts=16)
    files, facts, evidence = _batch(s, d, _of(_home, customer.where(last != 9)))
    store, _ = store.apply(0, files, facts, None, evidence)
    files, facts, evidence = _batch(s, d, _of(_home, customer.where(last.isin(3, 9)).withColumn("salt", F.lit("b"))), even=True)
    store, _ = store.apply(1, files, facts, customer.where(last == 7).select(_home(c("c_custkey")).alias("path")), evidence)
    files, facts, evidence = _batch(s, d, _of(_moved, customer.where(last == 1)).unionByName(_of(_home, customer.where(last == 2))))
    store, _ = store.apply(2, files, facts, customer.where(last == 1).select(_home(c("c_custkey")).alias("path")), evidence)
    return store


_CHANGED = """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 1 THEN 'src/moved/c' ELSE 'src/c' END || c_custkey || '.ts' AS path FROM customer WHERE c_custkey % 10 <> 7),
o AS (SELECT f.*, orders.*, 1 + (o_orderkey * 7) % 1000 AS other FROM f JOIN orders ON o_custkey = k WHERE k % 10 <> 3 OR o_orderkey % 2 = 0)"""


@add("q_changed_files", f"""{_CHANGED} SELECT 'files' AS fact, path, '' AS id FROM f UNION ALL SELECT 'entities', path, o_orderkey::VARCHAR FROM o
UNION ALL SELECT 'edges', path, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) FROM o JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT 'evidence', path, 'ev:' || o_orderkey FROM o
  WHERE k % 10 = 1 OR other NOT IN (SELECT c_custkey FROM customer) OR k % 10 IN (3, 9) AND other % 10 <> 1 OR k % 10 NOT IN (1, 3, 9) AND other % 10 NOT IN (1, 3, 7, 9)""")
def changed_files(s, d):
    store = changed_store(s, d)
    parts = [store.read(name).select(F.lit(name).alias("fact"), "path", (F.lit("") if name == "files" else c("id").cast("string")).alias("id")) for name in ("files", "entities", "edges", "evidence")]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- bundles


def _bundled(s, d):
    """Lines as facts of their suppliers' bundles; what a part says differs from bundle to bundle."""
    lines = t(s, d, "lineitem")
    seq = line_key("")
    one = lambda kind, key, said: lines.select(F.lit(kind).alias("kind"), F.concat(F.lit("s"), c("l_suppkey") % 40).alias("path"), key.alias("id"), said.alias("said"), seq.alias("seq"))
    return one("entity", F.concat(F.lit("p"), c("l_partkey") % 300), F.when(c("l_orderkey") % 9 == 0, c("l_returnflag")).otherwise("same")).unionByName(one("edge", F.concat(F.lit("o"), "l_orderkey"), c("l_linestatus")))


_BUNDLED = """WITH b AS (SELECT 'entity' AS kind, 's' || l_suppkey % 40 AS path, 'p' || l_partkey % 300 AS id, CASE WHEN l_orderkey % 9 = 0 THEN l_returnflag ELSE 'same' END AS said, concat_ws(':', '', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS seq FROM lineitem
  UNION ALL SELECT 'edge', 's' || l_suppkey % 40, 'o' || l_orderkey, l_linestatus, concat_ws(':', '', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) FROM lineitem),
f AS (SELECT *, first_value(said) OVER (PARTITION BY kind, path, id ORDER BY seq) AS own, first_value(said) OVER (PARTITION BY kind, id ORDER BY path, seq) AS fact FROM b)"""
add("q_bundle_facts", f"{_BUNDLED} SELECT kind, path, id, said, seq FROM b QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY path, seq) = 1")(lambda s, d: B.reduce_bundles(_bundled(s, d))[0])
add("q_bundle_warnings", f"{_BUNDLED} SELECT kind, path, id, 'local' AS what, count(*) AS times FROM f WHERE said <> own GROUP BY ALL UNION ALL SELECT DISTINCT kind, path, id, 'global', 1 FROM f WHERE own <> fact")(lambda s, d: B.reduce_bundles(_bundled(s, d))[1])


@add("q_bundle_roundtrip", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def bundle_roundtrip(s, d):
    folder = shared_path(s, "bundle")
    B.export_bundle({"documents": t(s, d, "documents"), "labels": t(s, d, "labels")}, folder, {"documents": "text"})
    return B.import_bundle(s, folder)["documents"].select("doc_id", "lang", "source", "n_chars", F.md5(c("text").cast("binary")).alias("text_md5"))


add("q_large_payloads", "SELECT sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes, count(*) AS events FROM documents WHERE octet_length(encode(text)) > 16384 GROUP BY ALL")(lambda s, d: _large(s, d))


def _large(s, d):
    events, payloads = B.materialize_payloads(t(s, d, "documents").select("doc_id", c("text").alias("payload")), large=16384)
    refers = events.select(F.get_json_object("payload", "$.payload_sha256").alias("sha256")).where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("events"))
    return payloads.select("sha256", "bytes").join(refers, "sha256")


# ---- templates: a third of all files have one content


def _contents(s, d):
    """(files, entities, edges): what direct extraction finds in every file; it depends on path and contents only."""
    k = c("c_custkey")
    rows = t(s, d, "customer").select(F.concat(F.lit("src/c"), k, F.lit(".v.ts")).alias("path"), F.when(k % 3 == 0, 0).otherwise(k % 250).cast("long").alias("h"))
    module, n = templates.module_of(c("path")), (c("h") % 4 + 2).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.lit("Function").alias("kind"), F.concat(F.lit("fn"), j).alias("name"), F.concat(module, F.lit("."), F.lit("fn"), j).alias("qualified_name"), (j * 3 + 1).alias("line")))
    more = F.array(F.struct(F.lit("Module").alias("kind"), module.alias("name"), module.alias("qualified_name"), F.lit(1).alias("line")), F.struct(F.lit("Import").alias("kind"), F.lit("x").alias("name"), F.concat(F.lit("static_reference:x"), "h").alias("qualified_name"), F.lit(1).alias("line")))
    entities = rows.select("path", F.explode(F.concat(made, more)).alias("e")).select("path", templates.entity_id(c("path"), c("e.kind"), c("e.qualified_name")).alias("id"), "e.*")
    own = lambda j: templates.entity_id(c("path"), F.lit("Function"), F.concat(module, F.lit(".fn"), j))
    j = c("j")
    links = rows.withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
    tail = F.when(j + 1 < n, own(j + 1)).when(c("h") % 5 == 0, F.lit("gone")).otherwise(templates.entity_id(c("path"), F.lit("Import"), F.concat(F.lit("static_reference:x"), "h")))
    return rows.select("path", F.concat(F.lit("h"), "h").alias("hash")), entities, links.select("path", own(j).alias("head_id"), F.lit("CALLS").alias("relation"), tail.alias("tail_id"), (j * 3 + 2).alias("line"))


_MD5 = lambda *x: "md5(concat_ws(chr(31), " + ", ".join(x) + "))"
_CONTENTS = f"""WITH r AS (SELECT 'src/c' || c_custkey || '.v.ts' AS path, 'src::c' || c_custkey || '.v' AS m, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 250 END AS h FROM customer), j AS (SELECT *, h % 4 + 2 AS n, unnest(range(0, h % 4 + 2)) AS j FROM r),
ent AS (SELECT path, 'Function' AS kind, 'fn' || j AS name, m || '.fn' || j AS qualified_name, (j * 3 + 1)::INT AS line FROM j UNION ALL SELECT path, 'Module', m, m, 1 FROM r UNION ALL SELECT path, 'Import', 'x', 'static_reference:x' || h, 1 FROM r),
lnk AS (SELECT path, 'e:' || {_MD5("path", "'Function'", "m || '.fn' || j")} AS head_id, 'e:' || CASE WHEN j + 1 < n THEN {_MD5("path", "'Function'", "m || '.fn' || (j + 1)")} ELSE {_MD5("path", "'Import'", "'static_reference:x' || h")} END AS tail_id, (j * 3 + 2)::INT AS line FROM j WHERE j + 1 < n OR h % 5 <> 0)"""
add("q_template_entities", f"{_CONTENTS} SELECT path, 'e:' || {_MD5('path', 'kind', 'qualified_name')} AS id, kind, qualified_name, line FROM ent")(
    lambda s, d: (lambda i, e, x: templates.expand_entities(i, e))(*templates.split(*_contents(s, d))).select("path", "id", "kind", "qualified_name", "line")
)
add("q_template_edges", f"{_CONTENTS} SELECT path, 'x:' || {_MD5('head_id', chr(39) + 'CALLS' + chr(39), 'tail_id', 'path', 'line::VARCHAR')} AS id, head_id, 'CALLS' AS relation, tail_id, line FROM lnk")(lambda s, d: templates.expand_edges(*templates.split(*_contents(s, d))))


# ---- graph truth: nations are cases, their customers' orders the observed calls


def _case(s, d):
    rows = t(s, d, "orders").join(t(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    o, k = c("o_orderkey"), c("o_custkey")
    case, file = c("c_nationkey").cast("string"), F.concat(F.lit("src/c"), k % 20, F.lit(".ts"))
    relation = F.when(o % 3 == 0, "READS").otherwise("CALLS")
    status = F.when(c("o_orderstatus") == "F", "exact").when(c("o_orderstatus") == "O", "parser_verified").otherwise("static_heuristic")
    observed = rows.where(o % 17 != 0).select(
        case.alias("case_id"), F.concat(F.lit("e"), o).alias("id"), o.alias("seq"), F.concat(F.lit("c"), k).alias("head_id"), relation.alias("relation"), F.concat(F.lit("o"), o).alias("tail_id"), file.alias("file"), (o % 90).alias("line"),
        status.alias("exactness"), (F.lit(1.0) - (o % 5) / 10).alias("confidence"), (o % 19 == 0).alias("derived"),
    )
    entities = rows.select(case.alias("case_id"), F.explode(F.array(
        F.struct(F.concat(F.lit("c"), k).alias("id"), c("c_name").alias("name"), F.concat(F.lit("m::"), "c_name").alias("qualified_name")),
        F.struct(F.concat(F.lit("o"), o).alias("id"), F.concat(F.lit("order"), o % 400).alias("name"), F.concat(F.lit("m::order"), o).alias("qualified_name")),
    )).alias("e")).select("case_id", "e.*").distinct()
    head, tail = F.when(o % 2 == 0, F.concat(F.lit("c"), k)).otherwise(c("c_name")), F.when(o % 4 < 2, F.concat(F.lit("order"), o % 400)).otherwise(F.concat(F.lit("m::order"), o))
    back = o % 7 == 0
    expected = rows.select(
        case.alias("case_id"), o.alias("expected_id"), relation.alias("relation"), F.when(back, tail).otherwise(head).alias("head"), F.when(back, head).otherwise(tail).alias("tail"), F.when(o % 13 == 0, "src/other.ts").otherwise(file).alias("file"),
        F.when(o % 11 == 0, o % 90 + 1).otherwise(o % 90).alias("line"), (o % 5 == 4).alias("forbidden"), F.lit(False).alias("want_derived"), F.when(o % 6 == 1, F.array(F.lit("exact"))).alias("allowed"), F.when(o % 8 == 3, 0.8).alias("floor"),
    )
    return expected, observed, entities


_CASE = """WITH r AS (SELECT *, c_nationkey::VARCHAR AS case_id, o_orderkey AS o, CASE WHEN o_orderkey % 3 = 0 THEN 'READS' ELSE 'CALLS' END AS relation, 'src/c' || o_custkey % 20 || '.ts' AS f FROM orders JOIN customer ON o_custkey = c_custkey),
obs AS (SELECT case_id, 'e' || o AS id, o AS seq, 'c' || o_custkey AS head_id, relation, 'o' || o AS tail_id, f AS file, o % 90 AS line, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'parser_verified' ELSE 'static_heuristic' END AS exactness, 1.0::DOUBLE - (o % 5) / 10 AS confidence, o % 19 = 0 AS derived FROM r WHERE o % 17 <> 0),
nam AS (SELECT DISTINCT case_id, unnest([x, n, q]) AS key, x AS id FROM (SELECT case_id, 'c' || o_custkey AS x, c_name AS n, 'm::' || c_name AS q FROM r UNION SELECT case_id, 'o' || o, 'order' || o % 400, 'm::order' || o FROM r)),
ex0 AS (SELECT *, CASE WHEN o % 2 = 0 THEN 'c' || o_custkey ELSE c_name END AS a, CASE WHEN o % 4 < 2 THEN 'order' || o % 400 ELSE 'm::order' || o END AS b FROM r),
exp AS (SELECT case_id, o AS expected_id, relation, CASE WHEN o % 7 = 0 THEN b ELSE a END AS head, CASE WHEN o % 7 = 0 THEN a ELSE b END AS tail, CASE WHEN o % 13 = 0 THEN 'src/other.ts' ELSE f END AS file, CASE WHEN o % 11 = 0 THEN o % 90 + 1 ELSE o % 90 END AS line,
  o % 5 = 4 AS forbidden, CASE WHEN o % 6 = 1 THEN 'exact' END AS only_, CASE WHEN o % 8 = 3 THEN 0.8 END AS floor FROM ex0),
can AS (SELECT e.*, v.id, v.seq, v.line = e.line AS ok, NOT v.derived AND (only_ IS NULL OR only_ = exactness) AND (floor IS NULL OR confidence >= floor) AS sem FROM exp e JOIN nam h ON h.case_id = e.case_id AND h.key = e.head JOIN nam t ON t.case_id = e.case_id AND t.key = e.tail
  JOIN obs v ON v.case_id = e.case_id AND v.relation = e.relation AND v.file = e.file AND v.head_id = h.id AND v.tail_id = t.id),
rev AS (SELECT DISTINCT e.expected_id FROM exp e JOIN nam h ON h.case_id = e.case_id AND h.key = e.tail JOIN nam t ON t.case_id = e.case_id AND t.key = e.head
  JOIN obs v ON v.case_id = e.case_id AND v.relation = e.relation AND v.file = e.file AND v.head_id = h.id AND v.tail_id = t.id),
fac AS (SELECT expected_id, arg_min(id, (seq, id)) FILTER (ok) AS spanned, arg_min(id, (seq, id)) AS anyone, arg_min(id, (seq, id)) FILTER (ok AND sem) AS exact_, arg_min(sem, (NOT ok, seq, id)) AS sem FROM can GROUP BY 1),
jud AS (SELECT e.*, CASE WHEN forbidden THEN exact_ ELSE coalesce(spanned, anyone) END AS edge_id, spanned IS NOT NULL AS spanned_, CASE WHEN forbidden THEN CASE WHEN exact_ IS NOT NULL THEN 'forbidden_found' ELSE 'clear' END WHEN anyone IS NOT NULL THEN CASE WHEN sem THEN 'matched' ELSE 'semantics' END
  WHEN rev.expected_id IS NOT NULL THEN 'wrong_direction' ELSE 'missing' END AS verdict FROM exp e LEFT JOIN fac ON fac.expected_id = e.expected_id LEFT JOIN rev ON rev.expected_id = e.expected_id)"""
add("q_truth_verdicts", f"{_CASE} SELECT case_id, expected_id, edge_id, CASE WHEN edge_id IS NOT NULL THEN spanned_ END AS by_span, verdict FROM jud")(lambda s, d: truth.match_edges(*_case(s, d)).select("case_id", "expected_id", "edge_id", "by_span", "verdict"))
add("q_truth_gate", f"{_CASE} SELECT case_id, count(*) FILTER (verdict NOT IN ('matched', 'clear') OR verdict = 'matched' AND NOT spanned_) = 0 AS passed, count(*) FILTER (verdict NOT IN ('matched', 'clear') OR verdict = 'matched' AND NOT spanned_) AS failures FROM jud GROUP BY 1")(lambda s, d: truth.gate(truth.match_edges(*_case(s, d))))


@add("q_truth_metrics", f"""{_CASE}, u AS (SELECT relation, count(DISTINCT (case_id, edge_id)) AS n FROM jud WHERE verdict IN ('matched', 'semantics') GROUP BY 1), v AS (SELECT relation, count(*) AS n FROM obs GROUP BY 1)
SELECT jud.relation, count(*) FILTER (NOT forbidden) AS expected, count(*) FILTER (NOT forbidden AND verdict IN ('matched', 'semantics')) AS matched, count(*) FILTER (forbidden) AS forbidden, count(*) FILTER (verdict = 'forbidden_found') AS found, any_value(v.n) AS observed,
  round(any_value(u.n) / any_value(v.n), 6)::DOUBLE AS precision, round(matched / expected, 6)::DOUBLE AS recall FROM jud LEFT JOIN u ON u.relation = jud.relation LEFT JOIN v ON v.relation = jud.relation GROUP BY 1""")
def truth_metrics(s, d):
    expected, observed, entities = _case(s, d)
    return truth.relation_metrics(truth.match_edges(expected, observed, entities), observed)
