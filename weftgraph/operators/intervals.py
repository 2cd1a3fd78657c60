"""Containment of line spans: the innermost outer span around each inner one.

Spans of a file are sorted by start (outer ones first, longer before shorter) and merged in
one pass with a stack of open spans: the innermost is at the top, so the work and the output
are linear where spans nest. Where spans cross, the open ones are all looked at. A file of
many spans is cut by line into sections of about SECTION spans; an outer span goes to each
section that it reaches into, so files are scanned side by side and no task holds one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import materialized

#: different spans of one section, about
SECTION = 200_000
#: lines of a cell
CELL = 128
#: what a scan says of an inner span
FOUND = {"file": "string", "start": "long", "end": "long", "first": "string", "first_start": "long", "first_end": "long", "second": "string", "second_start": "long", "second_end": "long"}


def _scan(batches):
    """Rows (file, section, start, end, outer, id) in order: each inner span with the two
    smallest spans around it that have different ids, with their starts and ends."""
    at, stack, crossing = None, [], False
    for batch in batches:
        out = []
        for file, section, start, end, outer, name in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, section) != at:
                at, stack, crossing = (file, section), [], False
            while stack and stack[-1][1] < start:
                stack.pop()
            if not stack:
                crossing = False
            if outer:
                crossing = crossing or bool(stack) and stack[-1][1] < end
                stack.append((start, end, name))
                continue
            around: list[tuple[int, str, int, int]] = []
            for a, b, other in reversed(stack):
                if b >= end:
                    around.append((b - a, other, a, b))
                    if not crossing and other != around[0][1]:
                        break  # what is further down is larger
            around.sort()
            second = next((x[1:] for x in around if x[1] != around[0][1]), (None, None, None))
            out.append((file, start, end, *(around[0][1:] if around else (None, None, None)), *second))
            if crossing and len(stack) > 64:
                stack = [s for s in stack if s[1] >= start]
        cols = list(zip(*out)) or [[]] * len(FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(cols, FOUND.values())], names=list(FOUND))


def innermost(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(file, inner_id, outer_id): the smallest outer (file, id, start, end) that covers each
    inner (file, id, start, end), ties by id; a span isn't around itself (equal ids).

    Cases: spans with a null file, start or end take no part; a span that ends before it
    starts covers nothing and nothing covers it; repeated spans are scanned once; files without
    one of the sides give nothing; extra columns are dropped.
    """
    rows = inner.select("file", F.col("id").cast("string").alias("inner_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    found = rows.join(around(inner, outer), ["file", "start", "end"])
    return found.select("file", "inner_id", outermost("inner_id")["id"].alias("outer_id")).where("outer_id is not null").distinct()


def outermost(own: str):
    """Of a row of ``around`` the smallest span (id, start, end) that isn't the row's own id."""
    span = lambda nth: F.struct(F.col(nth).alias("id"), F.col(f"{nth}_start").alias("start"), F.col(f"{nth}_end").alias("end"))
    return F.when(F.col("first") == F.col(own), span("second")).otherwise(span("first"))


def around(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(file, start, end, first, second, with the starts and ends of both): of each different
    span of inner that is covered, the two smallest outer ones of different ids."""
    real = F.expr("file is not null and start is not null and end is not null and start <= end")
    inner, outer = (df.where(real).select("file", F.col("id").cast("string").alias("id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")) for df in (inner, outer))
    # of equal spans the two smallest ids can be innermost, as one may be the inner span itself
    alike = F.dense_rank().over(W.partitionBy("file", "start", "end").orderBy("id"))
    outer = outer.withColumn("nth", alike).where("nth <= 2").drop("nth").distinct()
    spans = inner.select("file", "start", "end").distinct().withColumn("id", F.lit(None).cast("string"))
    spans = materialized(spans.withColumn("outer", F.lit(False)).unionByName(outer.withColumn("outer", F.lit(True))), "spans")
    files = spans.groupBy("file").agg(F.count("*").alias("n"), F.min(F.when(~F.col("outer"), F.col("start"))).alias("low"), F.max(F.when(~F.col("outer"), F.col("start"))).alias("high"))
    # a file of more than one section has over SECTION spans, so these files are few
    files = materialized(files.where(f"low is not null and n > {SECTION}").select("file", "low", F.ceil(F.col("n") / SECTION).alias("sections"), (F.col("high") - F.col("low") + 1).alias("width")), "long")
    cut = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col("low")) * F.col("sections") / F.col("width")), F.lit(0)), F.col("sections") - 1).cast("int")
    of = F.when(F.col("sections").isNull(), F.array(F.lit(0))).when(F.col("outer"), F.sequence(cut("start"), cut("end"))).otherwise(F.array(cut("start")))
    dealt = spans.join(F.broadcast(files), "file", "left").withColumn("section", F.explode(of))
    ordered = dealt.select("file", "section", "start", "end", "outer", "id").repartition("file", "section").sortWithinPartitions("file", "section", "start", F.desc("outer"), F.desc("end"), F.desc("id"))
    return ordered.mapInArrow(_scan, ", ".join(f"`{c}` {t}" for c, t in FOUND.items())).where("first is not null")


def covering(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(file, inner_id, outer_id): every outer span that covers each inner one, of other ids.

    Files are cut into cells of CELL lines; an outer span is looked for in the cell in which an
    inner one starts, so what meets is what covers and what begins or ends near by. The output
    has a row for each level of nesting.
    """
    real = F.expr("file is not null and start is not null and end is not null and start <= end")
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long")
    inner = inner.where(real).select("file", F.col("id").alias("inner_id"), F.col("start").alias("s"), F.col("end").alias("e"), cell("start").alias("cell"))
    outer = outer.where(real).select("file", F.col("id").alias("outer_id"), "start", "end", F.explode(F.sequence(cell("start"), cell("end"))).alias("cell"))
    return inner.join(outer, ["file", "cell"]).where("start <= s and end >= e and inner_id <> outer_id").select("file", "inner_id", "outer_id").distinct()
