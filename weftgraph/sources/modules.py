"""The driver's tables as source modules: what a parser would leave of files that import one another.

Customers are files, their orders functions in them and the orders' lines calls; parts are
library modules that declare names or pass them on, renamed or as a whole, in chains and
cycles. Spans nest, cross and repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .projection import table

NAMES = 4


def line_key(tag: str) -> Column:
    """An id of a line, by what tells lines apart."""
    return F.concat_ws(":", F.lit(tag), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, path, start, end."""
    orders, customer, part, lines = (table(spark, sf_dir, n) for n in ("orders", "customer", "part", "lineitem"))
    c = F.col
    rows = lambda df, id_, kind, name, path, start, end: df.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), path.alias("path"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    file = lambda key: F.concat(F.lit("src/c"), key, F.lit(".ts"))
    k, o, p = c("c_custkey"), c("o_orderkey"), c("p_partkey")
    top = (o % 50) * 20 + 10
    name = F.when(o % 11 == 0, "requireAdmin").when(o % 13 == 0, "sanitizeHtml").otherwise(F.concat(F.lit("fn"), o % 6))
    test = F.when(o % 9 == 4, "TestCase").when(o % 4 == 1, "Method").otherwise("Function")
    out = rows(customer, F.concat(F.lit("file:"), k), F.lit("File"), F.concat(F.lit("c"), k), file(k), F.lit(1), F.lit(2000))
    out = out.unionByName(rows(orders, F.concat(F.lit("fn:"), o), test, name, file(c("o_custkey")), top, top + 3 + (o % 7) * 11))
    # every third line of an order is a local variable that may take over an imported name
    at = (c("l_orderkey") % 50) * 20 + 11 + c("l_linenumber")
    own = lines.where("l_linenumber % 3 = 0").join(orders, c("l_orderkey") == o)
    out = out.unionByName(rows(own, line_key("var"), F.lit("LocalVariable"), F.concat(F.lit("imp"), c("l_suppkey") % 5), file(c("o_custkey")), at, at))
    library = lambda key: F.concat(F.lit("lib/p"), key, F.lit(".ts"))
    declared = part.where("p_partkey % 3 = 0").withColumn("n", F.explode(F.array(p % NAMES, (p + 1) % NAMES)))
    return out.unionByName(rows(declared, F.concat_ws(":", F.lit("decl"), p, "n"), F.lit("Function"), F.concat(F.lit("x"), "n"), library(p), F.lit(5), F.lit(9)))


def reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module, exported (null: all), target, imported, seq."""
    p = F.col("p_partkey")
    one = lambda seq, exported, target, imported: F.struct(F.lit(seq).alias("seq"), exported.alias("exported"), target.cast("long").alias("target"), imported.alias("imported"))
    x = lambda n: F.concat(F.lit("x"), n % NAMES)
    none = F.lit(None).cast("string")
    offered = F.when(p % 3 == 1, F.array(one(1, x(p), F.floor(p / 2), x(p + 1)), one(2, x(p), p + 1, x(p)), one(3, x(p + 2), p + 2, x(p + 2)))).when(p % 3 == 2, F.array(one(1, none, p - 1, none), one(2, none, p + 4, none)))
    rows = table(spark, sf_dir, "part").select(p, F.explode(offered).alias("r"))
    path = lambda k: F.concat(F.lit("lib/p"), k, F.lit(".ts"))
    return rows.select(path(p).alias("module"), "r.exported", path(F.col("r.target")).alias("target"), "r.imported", "r.seq")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """import_id, file, local, module, name, start, end."""
    k, j = F.col("c_custkey"), F.col("j")
    rows = table(spark, sf_dir, "customer").select(k, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    line = (1 + j + (k % 3) * j * 150).cast("long")
    return rows.select(
        F.concat_ws(":", F.lit("import"), k, j).alias("import_id"), F.concat(F.lit("src/c"), k, F.lit(".ts")).alias("file"), F.concat(F.lit("imp"), j).alias("local"),
        F.concat(F.lit("lib/p"), 1 + (k * 5 + j) % 180, F.lit(".ts")).alias("module"), F.concat(F.lit("x"), (k + j) % NAMES).alias("name"), line.alias("start"), line.alias("end"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, file, name, literal, argument, start, end."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    n, s = c("l_linenumber"), c("l_suppkey")
    line = (c("l_orderkey") % 50 * 20 + 12 + n * 3).cast("long")
    name = F.when(s % 7 == 6, F.when(n % 2 == 0, "requireRole").otherwise("checkRole")).when(s % 7 == 5, F.concat(F.lit("fn"), c("l_partkey") % 6)).otherwise(F.concat(F.lit("imp"), c("l_partkey") % 5))
    argument = F.when(n % 4 == 0, F.concat(F.lit("req.body.f"), c("l_partkey") % 3)).when(n % 4 < 3, F.concat(F.lit("v"), c("l_partkey") % 9))
    return rows.select(
        line_key("call").alias("call_id"), F.concat(F.lit("src/c"), "o_custkey", F.lit(".ts")).alias("file"), name.alias("name"),
        F.when(n % 5 != 4, F.concat(F.lit("r"), c("l_partkey") % 4)).alias("literal"), argument.alias("argument"), line.alias("start"), (line + F.when(n == 7, 2).otherwise(0)).alias("end"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name, line, source: chains, cycles, and sources that are never assigned."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src/c"), "o_custkey", F.lit(".ts")).alias("file"), F.concat(F.lit("v"), o % 9).alias("name"), (o % 1000).cast("long").alias("line"),
        F.when(o % 5 > 0, F.concat(F.lit("v"), (o * 7 + 3) % 11)).alias("source"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, file, method, path, guard, line."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.concat(F.lit("route:"), k).alias("route_id"), F.concat(F.lit("src/c"), k, F.lit(".ts")).alias("file"), F.when(k % 4 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/c/"), k).alias("path"),
        F.when(k % 3 == 0, "requireAdmin").when(k % 3 == 1, F.concat(F.lit("imp"), k % 5)).alias("guard"), (k % 400).cast("long").alias("line"),
    )


def mocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, module, name, line."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where("c_custkey % 3 = 1").select(F.concat(F.lit("src/c"), k, F.lit(".ts")).alias("file"), F.concat(F.lit("lib/p"), 3 + (k % 40) * 3, F.lit(".ts")).alias("module"), F.concat(F.lit("x"), k % NAMES).alias("name"), (k % 90).cast("long").alias("line"))


#: DuckDB: the same records as common table expressions
SQL = """
ent AS (
  SELECT 'file:' || c_custkey AS id, 'File' AS kind, 'c' || c_custkey AS name, 'src/c' || c_custkey || '.ts' AS path, 1::BIGINT AS b, 2000::BIGINT AS e FROM customer
  UNION ALL SELECT 'fn:' || o_orderkey, CASE WHEN o_orderkey % 9 = 4 THEN 'TestCase' WHEN o_orderkey % 4 = 1 THEN 'Method' ELSE 'Function' END,
    CASE WHEN o_orderkey % 11 = 0 THEN 'requireAdmin' WHEN o_orderkey % 13 = 0 THEN 'sanitizeHtml' ELSE 'fn' || o_orderkey % 6 END, 'src/c' || o_custkey || '.ts', o_orderkey % 50 * 20 + 10, o_orderkey % 50 * 20 + 13 + o_orderkey % 7 * 11 FROM orders
  UNION ALL SELECT concat_ws(':', 'var', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')), 'LocalVariable', 'imp' || l_suppkey % 5, 'src/c' || o_custkey || '.ts', l_orderkey % 50 * 20 + 11 + l_linenumber, l_orderkey % 50 * 20 + 11 + l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 3 = 0
  UNION ALL SELECT 'decl:' || p_partkey || ':' || n, 'Function', 'x' || n, 'lib/p' || p_partkey || '.ts', 5, 9 FROM (SELECT p_partkey, unnest([p_partkey % 4, (p_partkey + 1) % 4]) AS n FROM part WHERE p_partkey % 3 = 0)
), re AS (
  SELECT 'lib/p' || p || '.ts' AS module, exported, 'lib/p' || target || '.ts' AS target, imported, star, seq FROM (
    SELECT p_partkey AS p, 'x' || p_partkey % 4 AS exported, p_partkey // 2 AS target, 'x' || (p_partkey + 1) % 4 AS imported, 0 AS star, 1 AS seq FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, 'x' || p_partkey % 4, p_partkey + 1, 'x' || p_partkey % 4, 0, 2 FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, 'x' || (p_partkey + 2) % 4, p_partkey + 2, 'x' || (p_partkey + 2) % 4, 0, 3 FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, NULL, p_partkey - 1, NULL, 1, 1 FROM part WHERE p_partkey % 3 = 2
    UNION ALL SELECT p_partkey, NULL, p_partkey + 4, NULL, 1, 2 FROM part WHERE p_partkey % 3 = 2)
), imp AS (
  SELECT 'import:' || c_custkey || ':' || j AS import_id, 'src/c' || c_custkey || '.ts' AS file, 'imp' || j AS local, 'lib/p' || (1 + (c_custkey * 5 + j) % 180) || '.ts' AS module, 'x' || (c_custkey + j) % 4 AS name,
    (1 + j + c_custkey % 3 * j * 150)::BIGINT AS line FROM customer, range(5) r(j)
), cal AS (
  SELECT concat_ws(':', 'call', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS call_id, 'src/c' || o_custkey || '.ts' AS file,
    CASE WHEN l_suppkey % 7 = 6 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'requireRole' ELSE 'checkRole' END WHEN l_suppkey % 7 = 5 THEN 'fn' || l_partkey % 6 ELSE 'imp' || l_partkey % 5 END AS name,
    CASE WHEN l_linenumber % 5 <> 4 THEN 'r' || l_partkey % 4 END AS literal, CASE WHEN l_linenumber % 4 = 0 THEN 'req.body.f' || l_partkey % 3 WHEN l_linenumber % 4 < 3 THEN 'v' || l_partkey % 9 END AS argument,
    l_orderkey % 50 * 20 + 12 + l_linenumber * 3 AS b, l_orderkey % 50 * 20 + 12 + l_linenumber * 3 + CASE WHEN l_linenumber = 7 THEN 2 ELSE 0 END AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), asg AS (
  SELECT 'src/c' || o_custkey || '.ts' AS file, 'v' || o_orderkey % 9 AS name, CASE WHEN o_orderkey % 5 > 0 THEN 'v' || (o_orderkey * 7 + 3) % 11 END AS source FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 9 ORDER BY o_orderkey % 1000 DESC, coalesce(source, '') DESC) = 1
), rou AS (
  SELECT 'route:' || c_custkey AS route_id, 'src/c' || c_custkey || '.ts' AS file, CASE WHEN c_custkey % 4 = 0 THEN 'GET' ELSE 'POST' END AS method, '/c/' || c_custkey AS path,
    CASE c_custkey % 3 WHEN 0 THEN 'requireAdmin' WHEN 1 THEN 'imp' || c_custkey % 5 END AS guard, c_custkey % 400 AS line FROM customer WHERE c_custkey % 2 = 0
), moc AS (
  SELECT 'src/c' || c_custkey || '.ts' AS file, 'lib/p' || (3 + c_custkey % 40 * 3) || '.ts' AS module, 'x' || c_custkey % 4 AS name, c_custkey % 90 AS line FROM customer WHERE c_custkey % 3 = 1
)"""
