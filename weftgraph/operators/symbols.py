"""A stored symbol index: fields, tokens and neighbours of entities, written once and searched often.

On the shared folder an index has
  entities             a row an entity: lowered fields, their tokens, degree, whether its file is indexed, its role
  edges                (head_id, relation, tail_id): each edge once, as it came

A neighbour's text isn't copied to the entities around it: what that takes is the text of
every entity times its degree. A search passes over the entities' columns, takes those whose
text holds the query or one of its tokens, and hands what they hold on over the edges, once
for all queries that are searched together; the tables behind the index aren't joined again.
What matches is gathered as points by id, and only that is ranked.

Ranks add up: exact name 140, qualified name 130 (or its last part 82), name prefix 52,
qualified prefix 38, path 36, metadata 28, namespace 22, neighbour text 18, share of the
query's tokens 42, subsequence 14; what matches at all also gets degree (8 at 12 edges), an
indexed file (1) and, if the query asks for tests, a test role (12).

Cases: an empty query or limit finds nothing; null fields count as empty; entities without
edges have no neighbours; an edge to an unknown entity counts in the degree only; a
neighbour's text is its edge's relation and its own fields, and is searched edge by edge, so
nothing is found across two neighbours; hubs aren't gathered, since tokens and neighbours are
rows; ties go by qualified name, then id; rows that repeat an id are ranked each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr
from ..sources.shared import shared_path

# fixed values: kinds that play a test role
TEST_KINDS = ("TestFile", "TestSuite", "TestCase", "Fixture", "Mock", "Stub", "Assertion")
ENTITY = "id string, kind string, name string, qualified_name string, path string, n string, q string, p string, namespace string, metadata string, text string, tokens array<string>, degree long, indexed boolean, test_role boolean"


def query_tokens(query: str) -> list[str]:
    """Runs of ASCII letters and digits, cut where a capital follows a small letter, of two characters or more."""
    return sorted({w for w in re.sub("[^A-Za-z0-9]+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", query)).lower().split() if len(w) >= 2})


def _tokens(lowered: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lowered, "[^a-z0-9]+"), lambda w: F.length(w) >= 2))


def metadata_text(entries: Column) -> Column:
    """Keys and values in order of key; null values are left out."""
    return F.array_join(F.transform(F.array_sort(F.filter(F.map_entries(entries), lambda e: e["value"].isNotNull())), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


def namespace(qualified: Column) -> Column:
    """What stands before the last '::', or else before the last '.'."""
    return F.when(qualified.contains("::"), F.regexp_extract(qualified, r"(?s)^(.*)::", 1)).otherwise(F.regexp_extract(qualified, r"(?s)^(.*)\.", 1))


@dataclass(frozen=True)
class SymbolIndex:
    spark: SparkSession
    root: str

    @staticmethod
    def create(entities: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> SymbolIndex:
        """Write the index of entities (id, kind, name, qualified_name, path, and metadata as a
        map of strings if there is one) with edges (head_id, relation, tail_id) and the indexed files (path)."""
        spark = entities.sparkSession
        root = shared_path(spark, "symbol-index")
        low = lambda c: expr.ascii_lower(F.coalesce(F.col(c), F.lit("")))
        meta = F.coalesce(metadata_text(F.col("metadata")), F.lit("")) if "metadata" in entities.columns else F.lit("")
        e = entities.select(
            "id", "kind", "name", "qualified_name", "path", low("name").alias("n"), low("qualified_name").alias("q"), low("path").alias("p"),
            expr.ascii_lower(meta).alias("metadata"), expr.ascii_lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("qualified_name", F.lit("")), F.coalesce("path", F.lit("")), meta)).alias("text"),
            (F.coalesce(F.col("kind").isin(*TEST_KINDS), F.lit(False)) | F.coalesce(F.col("path").contains("test"), F.lit(False))).alias("test_role"),
        ).withColumn("namespace", namespace(F.col("q"))).withColumn("tokens", _tokens(F.col("text")))
        self = SymbolIndex(spark, root)
        edges.select("head_id", "relation", "tail_id").write.parquet(f"{root}/edges")
        degree = self.edges().select(F.explode(F.array("head_id", "tail_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        e = e.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        if files is None:  # the entities' own files
            e = e.withColumn("indexed", F.col("path").isNotNull())
        else:
            known = files.select("path").where("path is not null").distinct().withColumn("indexed", F.lit(True))
            e = e.join(known, "path", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))
        e.select(*(f.split()[0] for f in ENTITY.split(", "))).write.parquet(f"{root}/entities")
        return self

    def entities(self) -> DataFrame:
        return self.spark.read.schema(ENTITY).parquet(f"{self.root}/entities")

    def edges(self) -> DataFrame:
        return self.spark.read.schema("head_id string, relation string, tail_id string").parquet(f"{self.root}/edges")

    def adjacent(self) -> DataFrame:
        """(from, to, relation): to has from as a neighbour; from may be unknown, and rows may repeat."""
        way = lambda a, b: F.struct(F.col(a).alias("from"), F.col(b).alias("to"))
        return self.edges().select("relation", F.explode(F.array(way("head_id", "tail_id"), way("tail_id", "head_id"))).alias("w")).select("w.from", "w.to", "relation")

    def _near(self, queries: list[str]) -> DataFrame:
        """(id, nth, fact): what neighbours' texts and the relations to them give, by place of the query."""
        text, relation = F.col("text"), expr.ascii_lower(F.col("relation"))
        facts, whole, halves, by_relation, tied = [], [], [], [], F.lit(False)
        for nth, query in enumerate(queries):
            q, wanted = query.translate(_LOWER), query_tokens(query)
            near = len(facts)
            facts += [F.struct(F.lit(nth).alias("nth"), fact.alias("fact")) for fact in (_fact("relation_neighbor_text", 1.0, 18, None), *(_fact("token_match", 1.0 / len(wanted), 42.0 / len(wanted), F.lit(w)) for w in wanted))]
            code = lambda cond, at: F.when(cond, F.lit(at))
            whole += [code(text.contains(q), near), *(code(F.array_contains("tokens", w), near + k) for k, w in enumerate(wanted, 1))]
            halves += [(near, q[:i], q[i + 1 :]) for i, ch in enumerate(q) if ch == " "]  # the relation may end in q's first words
            by_relation += [code(relation.contains(q), near), *(code(F.array_contains(_tokens(relation), w), near + k) for k, w in enumerate(wanted, 1))]
            tied = tied | relation.contains(q) | F.arrays_overlap(_tokens(relation), _strings(wanted))
        codes = lambda found: F.array_compact(F.array(*found)).cast("array<int>")
        told = self.entities().select(F.col("id").alias("from"), codes(whole).alias("found"), F.array(*(text.startswith(b) for _, _, b in halves)).cast("array<boolean>").alias("starts"))
        told = told.where((F.size("found") > 0) | F.exists("starts", lambda x: x))
        # what an edge gives is dealt by the entity that it goes to, and told apart there
        each = lambda df, found: df.select(F.col("to").alias("id"), found.alias("found")).where(F.size("found") > 0)
        met = codes([F.when(F.col("starts")[k] & relation.endswith(a), F.lit(near)) for k, (near, a, _) in enumerate(halves)])
        out = each(self.adjacent().join(told, "from"), F.concat("found", met) if halves else F.col("found"))
        by_name = self.adjacent().where(tied)
        if not by_name.isEmpty():  # few queries name a relation
            out = out.unionByName(each(by_name.join(self.entities().select(F.col("id").alias("from")), "from", "left_semi"), codes(by_relation)))
        out = out.repartition("id").select("id", F.explode("found").alias("code")).distinct()
        return out.select("id", F.array(*facts)[F.col("code")].alias("f")).select("id", "f.nth", "f.fact")

    def search(self, query: str, k: int) -> DataFrame:
        """id, qualified_name, score, features (name to value), matched_terms of the k best."""
        return self.search_many([query], k).drop("query")

    def search_many(self, queries: list[str], k: int) -> DataFrame:
        """``search`` for several different queries side by side: query as well, the k best of each."""
        asked = [(query, query.strip()) for query in queries if query.strip()]
        if not asked or k < 1:
            return self.spark.createDataFrame([], "query string, id string, qualified_name string, score double, features map<string, double>, matched_terms array<string>")
        rows = self._own([q for _, q in asked]).unionByName(self._near([q for _, q in asked])).select("id", "nth", "fact.*").distinct()
        by_feature = rows.groupBy("id", "nth", "feature").agg(F.when(F.col("feature") == "token_match", F.sum("value")).otherwise(F.max("value")).alias("value"), F.sum("points").alias("points"), F.collect_set("term").alias("terms"))
        found = by_feature.groupBy("id", "nth").agg(F.sum("points").alias("points"), F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("matched_terms"))
        centrality = F.least(F.col("degree") / 12.0, F.lit(1.0))
        e = self.entities().select("id", "qualified_name", centrality.alias("centrality"), "indexed", "test_role")
        of_query = lambda values: F.array(*map(F.lit, values))[F.col("nth")]
        asks_tests = of_query([12.0 if "test" in q.translate(_LOWER) or "spec" in q.translate(_LOWER) else 0.0 for _, q in asked])
        score = F.col("points") + 8 * F.col("centrality") + F.when(F.col("indexed"), 1.0).otherwise(0.0) + F.when(F.col("test_role"), asks_tests).otherwise(0.0)
        extra = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("key"), value.alias("value")))
        bonus = F.array_compact(F.array(
            extra(F.col("centrality") > 0, "graph_centrality", F.col("centrality")), extra(F.col("indexed"), "recent_edit_signal", F.lit(0.2)), extra(F.col("test_role"), "source_test_role", F.lit(1.0)),
        ))
        out = found.join(e, "id").select("nth", "id", "qualified_name", F.round(score, 6).alias("score"), F.map_concat("features", F.map_from_entries(bonus)).alias("features"), "matched_terms")
        order = (F.desc("score"), "qualified_name", "id")
        if len(asked) > 1:
            out = out.withColumn("place", F.row_number().over(W.partitionBy("nth").orderBy(*order))).where(F.col("place") <= k).drop("place")
        best = out.orderBy("nth", *order).limit(k * len(asked))
        return best.select(of_query([query for query, _ in asked]).alias("query"), "id", "qualified_name", "score", "features", "matched_terms")

    def _own(self, queries: list[str]) -> DataFrame:
        """(id, nth, fact): what an entity's own fields and tokens give, by place of the query."""
        n, full, path = F.col("n"), F.col("q"), F.col("p")
        found = []
        for nth, query in enumerate(queries):
            q, wanted = query.translate(_LOWER), query_tokens(query)
            tail = (full != q) & (full.endswith("." + q) | full.endswith("::" + q))
            # (feature, its value, points, the term that matched)
            rules = [
                ("exact_symbol_match", 1.0, 140, n == q, F.col("name")),
                ("qualified_name_match", 1.0, 130, full == q, F.col("qualified_name")), ("qualified_name_match", 0.75, 82, tail, F.col("qualified_name")),
                ("prefix_match", 0.8, 52, n.startswith(q) & (n != q), F.col("name")), ("prefix_match", 0.55, 38, full.startswith(q) & (full != q), F.col("qualified_name")),
                ("file_path_proximity", 1.0, 36, path.contains(q), F.col("path")), ("same_package_or_module", 1.0, 22, F.col("namespace").contains(q), None), ("metadata_match", 1.0, 28, F.col("metadata").contains(q), None),
            ]
            if len(q) >= 3:
                rules.append(("fuzzy_match", 0.65, 14, n.rlike("(?s)" + ".*".join(re.escape(ch) for ch in q)) & (n != q), None))
            rules += [("token_match", 1.0 / len(wanted), 42.0 / len(wanted), F.array_contains("tokens", w), F.lit(w)) for w in wanted]
            found += [F.when(cond, F.struct(F.lit(nth).alias("nth"), _fact(name, value, points, term).alias("fact"))) for name, value, points, cond, term in rules]
        return self.entities().select("id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("id", "f.nth", "f.fact")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _fact(name: str, value: float, points: float, term: Column | None) -> Column:
    return F.struct(F.lit(name).alias("feature"), F.lit(value).cast("double").alias("value"), F.lit(points).cast("double").alias("points"), (F.lit(None) if term is None else term).cast("string").alias("term"))


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
