"""Queries of the stored text and symbol indexes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.symbols import SymbolIndex
from ..operators.textindex import TextIndex
from ..sources import projection as P
from ..sources.store import once
from .graph_queries import WITH

QUERIES, ORACLES = {}, {}


def add(name, sql):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"list_filter(regexp_split_to_array({_LOW.format('text')}, '[^a-z0-9]+'), lambda x: x <> '')"
#: two words, a phrase of two terms and one of three; terms are cut at all but letters and digits
_QUERY = [["the"], ["anthly"], ["of", "the"], ["to", "the", "and"]]
_TEXT = " ".join("_".join(p) for p in _QUERY)


def _documents(s, d):
    return P.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


def text_index(s, d) -> TextIndex:
    """The index of all documents."""
    return once(s, d, "text-index", lambda: TextIndex.create(s).apply(_documents(s, d)))


def symbol_index(s, d) -> SymbolIndex:
    """The index of all entities; what a projection has no field for is its metadata."""
    return once(s, d, "symbol-index", lambda: SymbolIndex.create(P.entities(s, d).withColumn("metadata", F.create_map(F.lit("kind"), "kind", F.lit("line"), F.col("line").cast("string"))), P.edges(s, d)))


def _counted(phrases, docs="documents"):
    """SQL: (id, dl, tf0, tf1, ...): how often each document of at least one phrase has each."""
    places = lambda p: f"len(list_filter(range(1, len(k) - {len(p) - 2}), lambda i: " + " AND ".join(f"k[i + {j}] = '{w}'" for j, w in enumerate(p)) + "))"
    return f"d AS (SELECT doc_id::VARCHAR AS id, {_TERMS} AS k FROM {docs}), c AS (SELECT id, len(k) AS dl, " + ", ".join(f"{places(p)} AS tf{i}" for i, p in enumerate(phrases)) + " FROM d)"


def _bm25(phrases, k, docs="documents"):
    one = lambda i: f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))"
    return f"{_counted(phrases, docs)}, s AS (SELECT count(*) AS n, avg(dl) AS mean, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(phrases))) + f" FROM c) SELECT id, round({' + '.join(map(one, range(len(phrases))))}, 6)::DOUBLE AS score FROM c, s WHERE {' + '.join(f'tf{i}' for i in range(len(phrases)))} > 0 ORDER BY score DESC, id LIMIT {k}"


@add("q_fts_search", f"WITH {_bm25(_QUERY, 200)}")
def fts_search(s, d):
    return text_index(s, d).search(_TEXT, 200)


@add("q_fts_phrase", f"WITH {_counted([['of', 'the']])} SELECT id, tf0::INT AS tf FROM c WHERE tf0 > 0")
def fts_phrase(s, d):
    return text_index(s, d).phrase("of the")


#: documents whose number ends in 3 are changed, in 7 taken out; the segments are merged at the end or not
_CHANGED = "changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'of the ' || coalesce(text, '') || ' anthly' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7)"


def _upkept(s, d) -> TextIndex:
    return once(s, d, "text-index-upkept", lambda: _upkeep(s, d))


def _upkeep(s, d) -> TextIndex:
    docs = _documents(s, d)
    ends = lambda n: F.col("id").endswith(str(n))
    index = TextIndex.create(s).apply(docs.where(~ends(5)))
    index = index.apply(docs.where(ends(3)).withColumn("text", F.concat(F.lit("of the "), F.coalesce("text", F.lit("")), F.lit(" anthly"))), docs.where(ends(7)))
    return index.apply(docs.where(ends(5)))


add("q_fts_upkeep", f"WITH {_CHANGED}, {_bm25(_QUERY, 200, 'changed')}")(lambda s, d: _upkept(s, d).search(_TEXT, 200))
add("q_fts_merged", f"WITH {_CHANGED}, {_counted([['of', 'the'], ['anthly']], 'changed')} SELECT id, dl, tf0::INT AS of_the, tf1::INT AS anthly FROM c WHERE tf0 + tf1 > 0")(
    lambda s, d: _upkept(s, d).merge().matches([("of", "the"), ("anthly",)]).select("id", "dl", F.col("tf")[0].alias("of_the"), F.col("tf")[1].alias("anthly"))
)


def _symbols(query, tokens, k):
    low = lambda c: _LOW.format(c)
    among = "(" + ", ".join(f"'{w}'" for w in tokens) + ")"
    pts = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    fuzzy = "%".join(ch.replace("_", "\\_") for ch in query)
    rules = [
        ("n = '{0}'", 140), ("q = '{0}'", 130), ("q <> '{0}' AND (ends_with(q, '.{0}') OR ends_with(q, '::{0}'))", 82), ("n <> '{0}' AND starts_with(n, '{0}')", 52), ("q <> '{0}' AND starts_with(q, '{0}')", 38),
        ("contains(p, '{0}')", 36), ("contains(ns, '{0}')", 22), ("contains(m, '{0}')", 28), ("near", 18), ("n <> '{0}' AND n LIKE '%" + fuzzy + "%' ESCAPE '\\'", 14),
    ]
    points = " + ".join(pts(rule.replace("{0}", query), n) for rule, n in rules)
    return f"""{WITH}, l AS (SELECT id, qualified_name, kind, path, {low('name')} AS n, {low('qualified_name')} AS q, {low('path')} AS p, {low("'kind ' || kind || ' line ' || line")} AS m FROM entities),
f AS (SELECT *, regexp_replace(q, '(.*)::.*', '\\1') AS ns, n || ' ' || q || ' ' || p || ' ' || m AS x FROM l),
w AS (SELECT head_id AS b, tail_id AS id, {low('relation')} AS r FROM edges UNION ALL SELECT tail_id, head_id, {low('relation')} FROM edges),
near AS (SELECT DISTINCT w.id FROM w JOIN f ON f.id = w.b WHERE contains(r || ' ' || x, '{query}')),
tok AS (SELECT id, unnest(regexp_split_to_array(x, '[^a-z0-9]+')) AS k FROM f),
has AS (SELECT id, k FROM tok WHERE k IN {among} UNION SELECT w.id, k FROM w JOIN tok ON tok.id = w.b WHERE k IN {among} UNION SELECT id, r FROM w WHERE r IN {among}),
t AS (SELECT id, count(DISTINCT k) AS hits FROM has GROUP BY id), g AS (SELECT id, count(*) AS degree FROM w GROUP BY id),
s AS (SELECT f.id, qualified_name, {points} + 42.0 * coalesce(hits, 0) / {len(tokens)} AS base, coalesce(hits, 0) / {len(tokens)} AS token_match, least(coalesce(degree, 0) / 12, 1) AS central
  FROM (SELECT f.*, near.id IS NOT NULL AS near FROM f LEFT JOIN near ON near.id = f.id) f LEFT JOIN t ON t.id = f.id LEFT JOIN g ON g.id = f.id)
SELECT id, qualified_name, round(token_match, 6)::DOUBLE AS token_match, round(central, 6)::DOUBLE AS centrality, round(base + 8 * central + 1, 6)::DOUBLE AS score FROM s WHERE base > 0 ORDER BY score DESC, qualified_name, id LIMIT {k}"""


def _hits(found):
    none = F.lit(0.0)
    return found.withColumn("token_match", F.round(F.coalesce(F.col("features")["token_match"], none), 6)).withColumn("centrality", F.round(F.coalesce(F.col("features")["graph_centrality"], none), 6)).drop("features", "matched_terms")


add("q_symbol_index", _symbols("nation_1", ["nation"], 300))(lambda s, d: _hits(symbol_index(s, d).search("nation_1", 300)))


@add("q_search_symbols", " UNION ALL ".join(f"SELECT '{q}' AS query, * FROM ({_symbols(q, w, 50)})" for q, w in (("order1", ["order1"]), ("building", ["building"]), ("supplier", ["supplier"]))))
def search_symbols(s, d):
    """Several queries against one index, side by side."""
    return _hits(symbol_index(s, d).search_many(["order1", "building", "supplier"], 50))
