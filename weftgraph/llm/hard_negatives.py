"""Hard negatives of anchors: rows of other labels that score somewhat below a positive.

Vectors become whole numbers, floor(SCALE * x), so that scores (inner products) are exact.
For each anchor the scores of all rows are sorted by score and id; each positive's upper
limit is found in that order by binary search, and the first k rows of other labels above
its lower limit are read from there. At scale this is done block by block: rows are dealt
into blocks and anchors into groups, a unit is one group against one block, and units are
sorted and searched apart. A unit gives for each anchor the best positives, in a second
round the first k negatives of each positive, and the best of all blocks are the answer. So
no task holds all rows, every anchor meets every row, and what a unit gives is bounded by
its anchors, whatever the data.

There are about two blocks for each core, of FEWEST to MOST components (2 to 34 MB); rows are
dealt by a row number, so repeated ids, labels or vectors can't fill one block.

Cases: rows with a null label, a null or empty vector, a null or non-finite component, or a
null id take no part; vectors of different lengths have no score with each other; repeated
rows are rows of their own (an anchor's copy is among its positives, and a repeated anchor
gives its answer as often as it is there); ties are broken by smaller id, then by row; scores
are exact while their partial sums fit in a long; other columns are dropped; an anchor
without positives, or a positive without negatives, gives no rows; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import arrowtext as at
from .tables import materialize, read

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: limits of a negative's score, in hundredths of the positive's
LOWER, UPPER = 30, 90
#: components of all vectors of a block or a group: fewest and most
FEWEST, MOST = 1 << 18, 1 << 22
#: tasks that units are dealt to, at most
MOST_TASKS = 20_000
#: scores handled at once within a unit
TILE = 2_000_000


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(row, id, label, dim, v): the rows that take part, v as whole numbers, numbered."""
    x = F.col(vector)
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.size(x).alias("dim"),
        F.transform(x, lambda e: F.floor(e.cast("double") * SCALE)).alias("v"),
    )
    return rows.where("label is not null").withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floats where they can't round, else in longs."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _sides(table: pa.Table):
    """(anchors, rows) of a unit as dicts of arrays; rows ordered by id and row."""
    dim = int(table["dim"][0].as_py())
    anchor = table["anchor"].to_numpy()
    both = []
    for part in (table.filter(pa.array(anchor)), table.filter(pa.array(~anchor))):
        side = {c: part[c].to_numpy() for c in ("row", "id", "label")} | {"v": _matrix(part["v"], dim) if part.num_rows else np.zeros((0, dim), np.int64)}
        if "limits" in part.column_names:
            side["limits"] = part["limits"].to_pylist()
        order = np.lexsort((side["row"], side["id"]))
        both.append({c: [x[i] for i in order] if isinstance(x, list) else x[order] for c, x in side.items()})
    return both


def _sorted_scores(anchors: dict, rows: dict):
    """(place of anchor, its rows' order by score and id, their scores falling) one by one."""
    step = max(1, TILE // max(1, len(rows["id"])))
    for lo in range(0, len(anchors["id"]), step):
        scores = _scores(anchors["v"][lo : lo + step], rows["v"])
        # rows are in order of id already, so a stable sort by score leaves ties so
        order = np.argsort(-scores, axis=1, kind="stable")
        for k in range(len(scores)):
            yield lo + k, order[k], scores[k][order[k]]


def _best_positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        out = {c: [] for c in ("anchor_row", "row", "id", "score")}
        for a, order, score in _sorted_scores(anchors, rows):
            own = rows["label"][order] == anchors["label"][a]
            own &= rows["row"][order] != anchors["row"][a]
            first = np.flatnonzero(own)[:k]
            out["anchor_row"].append(np.full(len(first), anchors["row"][a]))
            out["row"].append(rows["row"][order[first]])
            out["id"].append(rows["id"][order[first]])
            out["score"].append(score[first])
        made = pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in out.items()})
        at.release()
        return made

    return run


def _first_negatives(k: int, lower: int, upper: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        out = {c: [] for c in ("anchor_row", "place", "row", "id", "score")}
        for a, order, score in _sorted_scores(anchors, rows):
            other = np.flatnonzero(rows["label"][order] != anchors["label"][a])
            falling = -score[other]  # rising
            for limit in anchors["limits"][a]:
                # 100 * score <= upper * positive and 100 * score >= lower * positive, in whole numbers
                most, least = upper * limit["score"] // 100, -(-lower * limit["score"] // 100)
                start = int(np.searchsorted(falling, -most, "left"))
                stop = min(start + k, int(np.searchsorted(falling, -least, "right")))
                if start < stop:
                    got = order[other[start:stop]]
                    out["anchor_row"].append(np.full(len(got), anchors["row"][a]))
                    out["place"].append(np.full(len(got), limit["place"]))
                    out["row"].append(rows["row"][got])
                    out["id"].append(rows["id"][got])
                    out["score"].append(score[other[start:stop]])
        made = pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in out.items()})
        at.release()
        return made

    return run


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows come from ``prepared``; is_anchor says which of them are anchors (a condition on id,
    label, dim). An anchor's positives are its first rows of the same label by score and id;
    a positive's negatives the first rows of other labels with lower * positive_score <=
    100 * negative_score <= upper * positive_score.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "vectors")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).where("a > 0").withColumnRenamed("dim", "of_dim")
    most, fewest = (F.greatest(F.lit(1.0), F.floor(F.lit(n) / F.col("of_dim"))) for n in (MOST, FEWEST))
    share = F.ceil(F.col("n") / (2 * spark.sparkContext.defaultParallelism))
    sizes = sizes.select("of_dim", F.ceil(F.col("n") / F.greatest(fewest, F.least(most, share))).cast("int").alias("blocks"), F.ceil(F.col("a") / most).cast("int").alias("groups"))
    dealt = rows.join(sizes, F.col("dim") == F.col("of_dim"))  # sizes has a row for each length of vectors
    mixed = F.xxhash64("row")
    anchors = dealt.where(is_anchor).withColumn("group", F.pmod(F.shiftrightunsigned(mixed, 32), F.col("groups")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = dealt.withColumn("block", F.pmod(mixed, F.col("blocks")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    common = ["dim", "group", "block", "row", "id", "label", "v"]
    unit = ["dim", "group", "block"]

    # units are few bytes and much work: a task for each, which their size alone wouldn't give
    units = max(1, min(MOST_TASKS, int(sizes.agg(F.sum(F.col("blocks") * F.col("groups"))).first()[0] or 1)))
    with_rows = lambda a: others.select(*common, F.lit(False).alias("anchor"), *([F.lit(None).cast(LIMITS).alias("limits")] if "limits" in a.columns else [])).unionByName(a.withColumn("anchor", F.lit(True))).repartition(units, *unit)
    by_score = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")

    found = with_rows(anchors.select(*common)).groupBy(*unit).applyInArrow(_best_positives(positives), "anchor_row long, row long, id long, score long")
    found = found.withColumn("place", F.row_number().over(by_score("anchor_row"))).where(F.col("place") <= positives)
    found = materialize(found.select("anchor_row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    limits = found.groupBy("anchor_row").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), F.col("positive_score").alias("score"))).alias("limits"))
    limited = anchors.select(*common).join(limits, F.col("row") == F.col("anchor_row")).select(*common, F.col("limits").cast(LIMITS).alias("limits"))
    near = with_rows(limited).groupBy(*unit).applyInArrow(_first_negatives(negatives, lower, upper), "anchor_row long, place long, row long, id long, score long")
    near = near.withColumn("rank", F.row_number().over(by_score("anchor_row", "place"))).where(F.col("rank") <= negatives)
    ids = rows.where(is_anchor).select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return near.select("anchor_row", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["anchor_row", "place"]).join(ids, "anchor_row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


LIMITS = "array<struct<place: bigint, score: bigint>>"


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100, against all rows."""
    moved = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return mine(prepared(read(spark, sf_dir, "embeddings"), label=moved), F.expr("id % 100 = 0"))


ORACLE = """
WITH e AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
