"""The driver's star schema as a typed program graph: entities and edges.

Node ids and kinds keep every relation's endpoint types valid; edge ids are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_path(priority) -> object:
    return F.when(priority == "5-LOW", F.lit("src/tests/low.ts")).otherwise(F.concat(F.lit("src/orders/"), F.lower(priority), F.lit(".ts")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, qualified_name, path, line."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, tag, key, kind, name, path: df.select(F.concat(F.lit(f"{tag}:"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), (1 + F.col(key) % 200).cast("int").alias("line"))
    c = F.col
    parts = [
        row(t("region"), "r", "r_regionkey", "Repository", c("r_name"), F.concat(F.lit("src/"), c("r_name"))),
        row(t("nation"), "n", "n_nationkey", "Package", c("n_name"), F.concat(F.lit("src/"), c("n_name"))),
        row(t("customer"), "c", "c_custkey", "Function", c("c_name"), F.concat(F.lit("src/customer/"), c("c_mktsegment"), F.lit(".ts"))),
        row(t("orders"), "o", "o_orderkey", "Method", F.concat(F.lit("order"), c("o_orderkey")), order_path(c("o_orderpriority"))),
        row(t("supplier"), "s", "s_suppkey", "Method", c("s_name"), F.lit("src/supplier.ts")),
        row(t("part"), "p", "p_partkey", "Table", c("p_name"), F.lit("src/part.ts")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("qualified_name", F.concat(F.replace("path", F.lit("/"), F.lit("::")), F.lit("."), "name"))


def edges(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """id, head_id, relation, tail_id, path, line, exactness, confidence, derived.

    whole: the lines are joined once for both of their edges, which is less for who takes
    all relations; otherwise a relation that isn't asked for isn't made.
    """
    t, c = lambda n: table(spark, sf_dir, n), F.col

    def rows(df, id_, head, relation, tail, path, line, exactness, confidence):
        return df.select(
            id_.alias("id"), head.alias("head_id"), relation.alias("relation"), tail.alias("tail_id"), path.alias("path"), (1 + line % 200).cast("int").alias("line"),
            exactness.alias("exactness"), F.round(confidence, 6).alias("confidence"), F.lit(False).alias("derived"),
        )

    node = lambda tag, key: F.concat(F.lit(f"{tag}:"), c(key))
    exact, one = F.lit("exact"), F.lit(1.0)
    status = F.when(c("o_orderstatus") == "F", "exact").when(c("o_orderstatus") == "O", "parser_verified").otherwise("static_heuristic")
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"))
    key = F.concat_ws(":", c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    flag = F.when(c("l_returnflag") == "A", "READS").when(c("l_returnflag") == "R", "WRITES").otherwise("FLOWS_TO")
    parts = [
        rows(t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")), F.concat(F.lit("e:rn:"), c("n_nationkey")), node("r", "n_regionkey"), F.lit("CONTAINS"), node("n", "n_nationkey"), F.concat(F.lit("src/"), c("r_name")), c("n_nationkey"), exact, one),
        rows(t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")), F.concat(F.lit("e:nc:"), c("c_custkey")), node("n", "c_nationkey"), F.lit("CONTAINS"), node("c", "c_custkey"), F.concat(F.lit("src/"), c("n_name")), c("c_custkey"), exact, one),
        rows(t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")), F.concat(F.lit("e:co:"), c("o_orderkey")), node("c", "o_custkey"), F.lit("CALLS"), node("o", "o_orderkey"), F.concat(F.lit("src/customer/"), c("c_mktsegment"), F.lit(".ts")), c("o_orderkey"), status, one),
        rows(lines, F.concat(F.lit("e:os:"), key), node("o", "l_orderkey"), F.lit("CALLS"), node("s", "l_suppkey"), order_path(c("o_orderpriority")), c("l_orderkey"), status, 1 - c("l_discount")),
        rows(lines, F.concat(F.lit("e:op:"), key), node("o", "l_orderkey"), flag, node("p", "l_partkey"), order_path(c("o_orderpriority")), c("l_orderkey"), status, 1 - c("l_tax")),
    ]
    if whole:
        both = lambda name, a, b: F.struct(F.lit(name).alias("tag"), a.alias("relation"), b.alias("tail_id"), (1 - c({"os": "l_discount", "op": "l_tax"}[name])).alias("sure"))
        told = lines.select("*", F.explode(F.array(both("os", F.lit("CALLS"), node("s", "l_suppkey")), both("op", flag, node("p", "l_partkey")))).alias("e"))
        parts[3:] = [rows(told, F.concat_ws(":", F.lit("e"), c("e.tag"), key), node("o", "l_orderkey"), c("e.relation"), c("e.tail_id"), order_path(c("o_orderpriority")), c("l_orderkey"), status, c("e.sure"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled(e: DataFrame) -> DataFrame:
    """edges with context, class, resolution and flags."""
    c = F.col
    e = e.withColumn("context", expr.edge_context(c("relation"), c("path"), c("head_id"), c("tail_id")))
    e = e.withColumn("edge_class", expr.edge_class(c("context"), c("relation"), c("exactness"), c("derived")))
    e = e.withColumn("resolution", expr.resolution_kind(c("exactness"), c("derived")))
    return e.withColumn("flags", expr.flags(c("exactness"), c("resolution")))


#: DuckDB: the same entities and edges as common table expressions
ENTITIES_SQL = r"""
ent0 AS (
  SELECT 'r:' || r_regionkey AS id, 'Repository' AS kind, r_name AS name, 'src/' || r_name AS path, (1 + r_regionkey % 200)::INT AS line FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'Package', n_name, 'src/' || n_name, (1 + n_nationkey % 200)::INT FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'Function', c_name, 'src/customer/' || c_mktsegment || '.ts', (1 + c_custkey % 200)::INT FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'Method', 'order' || o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'src/tests/low.ts' ELSE 'src/orders/' || lower(o_orderpriority) || '.ts' END, (1 + o_orderkey % 200)::INT FROM orders
  UNION ALL SELECT 's:' || s_suppkey, 'Method', s_name, 'src/supplier.ts', (1 + s_suppkey % 200)::INT FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'Table', p_name, 'src/part.ts', (1 + p_partkey % 200)::INT FROM part
), entities AS (SELECT *, replace(path, '/', '::') || '.' || name AS qualified_name FROM ent0)"""
EDGES_SQL = r"""
lines AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'parser_verified' ELSE 'static_heuristic' END AS ex,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'src/tests/low.ts' ELSE 'src/orders/' || lower(o_orderpriority) || '.ts' END AS opath,
    concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS lk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), edges AS (
  SELECT 'e:rn:' || n_nationkey AS id, 'r:' || n_regionkey AS head_id, 'CONTAINS' AS relation, 'n:' || n_nationkey AS tail_id, 'src/' || r_name AS path, (1 + n_nationkey % 200)::INT AS line, 'exact' AS exactness, 1.0::DOUBLE AS confidence, false AS derived FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'e:nc:' || c_custkey, 'n:' || c_nationkey, 'CONTAINS', 'c:' || c_custkey, 'src/' || n_name, (1 + c_custkey % 200)::INT, 'exact', 1.0, false FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'e:co:' || o_orderkey, 'c:' || o_custkey, 'CALLS', 'o:' || o_orderkey, 'src/customer/' || c_mktsegment || '.ts', (1 + o_orderkey % 200)::INT, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'parser_verified' ELSE 'static_heuristic' END, 1.0, false FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'e:os:' || lk, 'o:' || l_orderkey, 'CALLS', 's:' || l_suppkey, opath, (1 + l_orderkey % 200)::INT, ex, round(1 - l_discount, 6), false FROM lines
  UNION ALL SELECT 'e:op:' || lk, 'o:' || l_orderkey, CASE l_returnflag WHEN 'A' THEN 'READS' WHEN 'R' THEN 'WRITES' ELSE 'FLOWS_TO' END, 'p:' || l_partkey, opath, (1 + l_orderkey % 200)::INT, ex, round(1 - l_tax, 6), false FROM lines
)"""
