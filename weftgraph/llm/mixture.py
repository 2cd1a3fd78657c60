"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

The budget is handed down level by level. Among siblings it is shared by weight, capped
by what each subtree can supply (its tokens times max_epochs); what a short sibling can't
take goes to the other siblings in proportion to their weights, and only what a whole
subtree can't take is left to its ancestors' other children. Because each cap is that of
a whole subtree, one capped share per level, top down, does exactly this.

A leaf given t tokens reads its documents in seeded order, whole epochs first, then the
longest prefix of the next epoch's order whose tokens stay within the rest.

A leaf may hold a third of all rows: the order is cut into hash ranges, ranges are summed
first (partial sums, then a window over a leaf's few ranges), and only the range in which
the prefix ends is ordered row by row. Rows that are equal in all their columns are one
entry with a count from the start (partially aggregated), so a row repeated very often is
one entry too.

Cases: null level values count as ''; null or empty text has 0 tokens (such documents
come with whole epochs, and with a prefix as their place in the order says); very long
texts that don't fit the rest end the prefix; the order key is a hash of the whole row, in
which nulls count as '', so rows without an id, or of one id, are spread like others; equal
keys are taken in doc_id, then token, then row hash order; rows of one doc_id with different
texts are chosen one by one; siblings whose weights are all 0 get nothing; repeated rows
count as so many documents; other columns are kept by ``mix``, whatever their names.
Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import materialize, read

#: documents in one hash range of a leaf's order, about
RANGE_ROWS = 20_000


@dataclass(frozen=True)
class Mixture:
    """weights[level][value] is a node's weight among its siblings; others have default."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    default: float = 1.0
    budget_share: float = 0.5  # of all tokens
    max_epochs: int = 4
    seed: str = "mix"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(m: Mixture, level: str) -> Column:
    known = m.weights.get(level, {})
    if not known:
        return F.lit(m.default)
    pairs = [x for k, v in known.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(m.default))


def budgets(leaves: DataFrame, m: Mixture) -> DataFrame:
    """leaves (levels..., tokens) with the tokens granted to each as a whole number."""
    levels = list(m.levels)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = F.lit(float(min(int(total * m.budget_share), total * m.max_epochs)))
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * m.max_epochs).cast("double").alias("cap")).withColumn("w", _weight(m, level))
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("given", given)
        live = F.col("w") > 0
        ratio = F.when(live, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
        order = W.partitionBy(*parent).orderBy("ratio", *path)
        before = order.rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*parent)
        nodes = nodes.withColumn("ratio", ratio)
        nodes = nodes.withColumn("cap_before", F.coalesce(F.sum(F.when(live, F.col("cap"))).over(before), F.lit(0.0))).withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        full = live & (F.col("cap_before") + F.col("ratio") * F.col("w_left") <= F.col("given"))
        nodes = nodes.withColumn("full", full)
        rest = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
        open_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(whole)
        share = F.when(F.col("full"), F.col("cap")).when(live & (open_w > 0), F.least(F.col("cap"), (F.col("given") - rest) * F.col("w") / open_w)).otherwise(0.0)
        given = nodes.select(*path, share.alias("given"))
    out = leaves.join(given.withColumnRenamed("given", "granted"), levels)
    return out.withColumn("granted", F.floor(F.col("granted") + 1e-6).cast("long"))


def select(docs: DataFrame, m: Mixture) -> DataFrame:
    """(doc_id, levels, tokens, row, rows, copies, more) of the entries that are chosen.

    docs: doc_id, levels, tokens, row, a hash that rows share if they are equal, and digest,
    another one (a string) that the seeded order is taken from. An entry stands for so many equal rows; each is read `copies` times, and `more` of them once more.
    """
    levels = list(m.levels)
    docs = docs.select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels), "tokens", "row", "digest")
    docs = materialize(docs.groupBy("doc_id", *levels, "tokens", "row", "digest").agg(F.count("*").alias("rows")).withColumn("weight", F.col("tokens") * F.col("rows")), "mixture")
    leaves = docs.groupBy(*levels).agg(F.sum("weight").alias("tokens"), F.count("*").alias("entries"))
    plan = budgets(leaves, m)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("granted") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("granted") - F.col("epochs") * F.col("tokens")).withColumn("ranges", F.ceil(F.col("entries") / RANGE_ROWS))
    plan = materialize(plan.select(*levels, "epochs", "rest", "ranges"), "budgets")

    # the key of the epoch that ends in a prefix; whole epochs need no order
    keyed = docs.join(plan, levels)
    key = F.md5(F.concat_ws("|", F.lit(m.seed), F.col("epochs").cast("string"), "digest").cast("binary"))
    keyed = keyed.withColumn("key", key).withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) * F.col("ranges")))
    keyed = keyed.where("epochs > 0 or rest > 0")
    sums = keyed.groupBy(*levels, "range").agg(F.sum("weight").alias("t"))
    upto = W.partitionBy(*levels).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).select(*levels, "range", "before", "t")
    placed = keyed.join(sums, [*levels, "range"])
    inside = placed.where("before + t <= rest").withColumn("more", F.col("rows"))
    beyond = placed.where("before > rest").withColumn("more", F.lit(0).cast("long"))
    along = W.partitionBy(*levels, "range").orderBy("key", "doc_id", "tokens", "row").rowsBetween(W.unboundedPreceding, 0)
    edge = placed.where("before <= rest and before + t > rest").withColumn("left", F.col("rest") - F.col("before") - F.sum("weight").over(along) + F.col("weight"))
    fit = F.when(F.col("left") < 0, 0).when(F.col("tokens") == 0, F.col("rows")).otherwise(F.least("rows", F.floor(F.col("left") / F.col("tokens"))))
    edge = edge.withColumn("more", fit.cast("long")).drop("left")
    out = inside.unionByName(beyond).unionByName(edge)
    out = out.withColumn("more", F.when(F.col("rest") > 0, F.col("more")).otherwise(0)).where("epochs > 0 or more > 0")
    return out.select("doc_id", *levels, "tokens", "row", "rows", F.col("epochs").alias("copies"), "more")


def domain_of(source: Column) -> Column:
    """Sources by number: five to a domain; a source without a number is of the domain misc."""
    number = F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1), F.lit("")).cast("long")
    names = F.array(*map(F.lit, ("web", "books", "forum", "news")))
    return F.when(number < 20, F.get(names, F.floor(number / 5).cast("int"))).otherwise("misc")


PRODUCTION = Mixture(weights={"domain": {"web": 0.2, "books": 0.4, "forum": 0.15, "news": 0.25}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}})


def rows_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that can't be hashed count as their text."""
    cols = ((F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in docs.schema.fields)
    return F.xxhash64(*(c.cast("string") if "map<" in kind or "variant" in kind else c for c, kind in cols))


def digest(docs: DataFrame) -> Column:
    """md5 of id, language, source and text, and of the row's hash if there are other columns."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "lang", "source", "text")]
    more = [rows_hash(docs).cast("string")] if set(docs.columns) - {"doc_id", "lang", "source", "text"} else []
    return F.md5(F.concat_ws("|", *parts, *more).cast("binary"))


def _leaves(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", n_tokens(F.col("text")).alias("tokens"), rows_hash(docs).alias("row"), digest(docs).alias("digest"))


def _times(n: Column) -> Column:
    """One row for each of 1..n, by two steps, so that no array is long."""
    step = 1 << 12
    outer = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step))
    return F.transform(outer, lambda k: F.least(n - k * step, F.lit(step)).cast("int"))


def _repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column times (over 0) says; the column goes."""
    out = df.withColumn("__some", F.explode(_times(F.col(times))))
    return out.withColumn("__one", F.explode(F.sequence(F.lit(1), F.col("__some")))).drop("__some", "__one", times)


def mix(docs: DataFrame, m: Mixture = PRODUCTION) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) as mixed: each chosen row as often as it is read.

    An entry's rows are read alike but for the one entry of a leaf in which the prefix ends
    among equal rows: one of those rows is then written as often as all of them are read.
    """
    chosen = select(_leaves(docs), m)
    once = (F.col("copies") + F.when(F.col("more") == F.col("rows"), 1).otherwise(0)).cast("long")
    chosen = materialize(chosen.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), once.alias("__times"), (F.col("copies") * F.col("rows") + F.col("more")).alias("__all"), F.expr("more > 0 and more < rows").alias("__split")), "chosen")
    hashed = docs.withColumn("__own", rows_hash(docs))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__row"))
    # what is chosen grows with the documents: always a merge of two shuffles, at every size
    out = _repeat(hashed.join(chosen.where("not __split and __times > 0").drop("__split", "__all").hint("merge"), same).drop("__id", "__row", "__own"), "__times")
    split = chosen.where("__split").drop("__split", "__times")
    if split.take(1):  # an entry of a leaf at most
        one = hashed.join(split, same).drop("__id", "__row").dropDuplicates(["doc_id", "__own"]).drop("__own").withColumnRenamed("__all", "__times")
        out = out.unionByName(_repeat(one, "__times"))
    return out


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies of every chosen document."""
    found = select(_leaves(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), PRODUCTION).withColumnRenamed("tokens", "n_tokens")
    parts = F.array(F.struct(F.col("more").alias("n"), (F.col("copies") + 1).alias("c")), F.struct((F.col("rows") - F.col("more")).alias("n"), F.col("copies").alias("c")))
    found = found.withColumn("part", F.explode(F.filter(parts, lambda p: (p["n"] > 0) & (p["c"] > 0)))).withColumn("n", F.col("part.n"))
    return _repeat(found, "n").select("doc_id", *PRODUCTION.levels, "n_tokens", F.col("part.c").cast("long").alias("copies"))


def _oracle() -> str:
    """The same result by plain windows, with no ranges."""
    steps, parent = [], "SELECT least(floor(sum(tokens) * 0.5), sum(tokens) * 4)::DOUBLE AS given FROM leaves"
    levels = PRODUCTION.levels
    for d, level in enumerate(levels):
        path, up = ", ".join(levels[: d + 1]), ", ".join(levels[:d])
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRODUCTION.weights.get(level, {}).items())
        weight = f"(CASE {level} {cases} ELSE 1.0 END)::DOUBLE" if cases else "1.0::DOUBLE"
        part = f"PARTITION BY {up}" if up else ""
        join = f"JOIN g{d} USING ({up})" if up else "CROSS JOIN g0"
        steps.append(f"g{d} AS ({parent}), n{d} AS (SELECT a.*, given, cap / w AS ratio FROM (SELECT {path}, (sum(tokens) * 4)::DOUBLE AS cap, {weight} AS w FROM leaves GROUP BY ALL) a {join}), "
            f"c{d} AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER ({part}) - coalesce(sum(w) OVER b, 0) AS w_left FROM n{d} WINDOW b AS ({part} ORDER BY ratio, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
            f"f{d} AS (SELECT *, cap_before + ratio * w_left <= given AS is_full FROM c{d}), "
            f"r{d} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS rest, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS open_w FROM f{d})")
        parent = f"SELECT {path}, CASE WHEN is_full THEN cap WHEN open_w > 0 THEN least(cap, (given - rest) * w / open_w) ELSE 0 END AS given FROM r{d}"
    number = r"try_cast(nullif(regexp_extract(coalesce(source, ''), '(\d+)$', 1), '') AS BIGINT)"
    keys = ", ".join(levels)
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN {number} < 20 THEN (['web', 'books', 'forum', 'news'])[1 + ({number} // 5)::INT] ELSE 'misc' END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS digest FROM documents
), leaves AS (SELECT {keys}, sum(tokens) AS tokens FROM docs GROUP BY ALL),
{", ".join(steps)}, g3 AS ({parent}),
plan AS (SELECT {keys}, tokens AS all_tokens, floor(given + 1e-6)::BIGINT AS granted, CASE WHEN tokens > 0 THEN floor(floor(given + 1e-6) / tokens) ELSE 0 END::BIGINT AS epochs FROM leaves JOIN g3 USING ({keys})),
placed AS (SELECT *, granted - epochs * all_tokens AS rest, md5('mix|' || epochs || '|' || digest) AS key FROM docs JOIN plan USING ({keys})),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY {keys} ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed),
counted AS (SELECT *, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run)
SELECT doc_id, {keys}, tokens::BIGINT AS n_tokens, copies FROM counted WHERE copies > 0
"""


ORACLE = _oracle()
