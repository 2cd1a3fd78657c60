"""License scans: Dice coefficient over word bigrams against licence templates.

Native: only DataFrame functions. A text is scanned as a whole, by blocks (between blank
lines), by lines and by runs of lines. A unit is lowercased, runs of other characters than a-z and 0-9
become one blank, and its word bigrams are a multiset A; a template's are B. Dice is
2 |A & B| / (|A| + |B|), and Dice >= t needs t / (2 - t) |B| <= |A| <= (2 - t) / t |B|. So
the size of a unit, counted without splitting it, admits few templates or none: an
equi-join on the size with the table of admissible (size, template) rows, whose length
depends on the templates alone. Only units that pass are split and compared.

Reported is the best template of each unit that reaches the threshold (ties: the smaller
template id). A unit equal to a larger one of the same document (one block, one line) is
scanned once.

A run is two or more consecutive lines, blank ones aside, but not all of them: a licence of
several paragraphs, or one that is wrapped, inside a longer text. A bigram lies in the line
of its first word; a run's first line holds a bigram of the template, and its last one holds
one or the second word of one (runs without are no better than shorter ones). Runs aren't
built to be counted: a text must hold enough different bigrams of a template, and a run
t / 2 (|A| + |B|) words at which one starts, before it is compared. The best run of each
first line (dice, fewer words, template) is reported unless that of the run before or after
it overlaps it and is better, so that the shifted forms of one licence count once. pos is
the run's first line.

Cases: null or empty texts, and units of fewer than two words, match nothing; rows
repeated in documents are reported once, and of rows of one doc_id with different texts the
better of equal (kind, pos); "\\r" counts as blank space; other columns aren't read. Empty
tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import read

THRESHOLD = 0.8

#: fixed values: licence notices and texts by template id (SPDX id before the colon)
TEMPLATES = {
    "MIT:notice": "Released under the MIT License.",
    "MIT:licensed": "Licensed under the MIT License.",
    "Apache-2.0:notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0:notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0:notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0:notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0:notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0:notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0:long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT:text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC:text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause:text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0:header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Zlib:text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense:text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def with_bigrams(df: DataFrame, out: str) -> DataFrame:
    """df (norm, ...) with its word bigrams in place of norm, each with its number among
    equal ones, so that multisets become sets."""
    df = df.withColumn("__w", F.split("norm", " ", -1)).drop("norm")
    pair = F.zip_with(F.slice("__w", F.lit(1), F.size("__w") - 1), F.slice("__w", F.lit(2), F.size("__w") - 1), lambda x, y: F.concat(x, F.lit(" "), y))
    df = df.withColumn("__p", F.array_sort(pair)).drop("__w")
    # in a sorted list equal pairs stand together, so a pair's number is its distance from the first
    number = F.transform("__p", lambda p, i: F.concat(p, F.lit("#"), (i + 1 - F.array_position(F.col("__p"), p)).cast("string")))
    alone = F.transform("__p", lambda p: F.concat(p, F.lit("#0")))
    return df.withColumn(out, F.when(F.size(F.array_distinct("__p")) == F.size("__p"), alone).otherwise(number)).drop("__p")


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit that can match has one.

    Dice >= t needs |A & B| >= t / (2 - t) |B|: at most (2 - 2 t) / (2 - t) |B| bigrams of a
    template may be missing, so words that lie in more of its bigrams than that can't all be
    missing. Words are chosen greedily for all templates; very common ones last.
    """
    common = set("a an any and as at be by for from in is it no not of on or such that the this to you with mit der die und".split())
    pairs = {}
    for k, v in templates.items():
        words = re.sub("[^a-z0-9]+", " ", v.lower()).split()
        pairs[k] = list(zip(words, words[1:]))
    open_ = {k: v for k, v in pairs.items() if v}
    chosen: list[str] = []
    while open_:
        gain = Counter(w for v in open_.values() for p in v if not set(p) & set(chosen) for w in set(p))
        chosen.append(min(gain, key=lambda w: (w in common or w.isdigit(), len(w) < 4 and w != "cc", -gain[w], w)))
        open_ = {k: v for k, v in open_.items() if sum(bool(set(p) & set(chosen)) for p in v) <= (2 - 2 * threshold) / (2 - threshold) * len(v) + 1e-9}
    return chosen


def template_table(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    """(template, license, size, b, n): one row for every unit size at which a template may match."""
    base = spark.createDataFrame([(k, k.split(":")[0], v) for k, v in sorted(templates.items())], "template string, license string, text string")
    t = base.select("template", "license", normalise(F.col("text")).alias("norm"))
    t = with_bigrams(t, "b").withColumn("size", F.size("b"))
    low, high = F.ceil(F.col("size") * threshold / (2 - threshold) - 1e-9), F.floor(F.col("size") * (2 - threshold) / threshold + 1e-9)
    return t.withColumn("n", F.explode(F.sequence(low, high))).withColumn("n", F.col("n").cast("int"))


def _words(unit: Column) -> Column:
    """Number of words of a string in which every run of separators is one blank."""
    x = F.trim(unit)
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + F.when(x == "", 0).otherwise(1)


def units(docs: DataFrame, sizes: list[int], needed: list[str]) -> DataFrame:
    """(doc_id, kind, pos, norm, n): whole texts, blocks and lines (0-based; equal units
    once) whose number of bigrams n is one of sizes, and that hold one of the needed words.

    Letters are folded and separators collapsed once for a text, line breaks kept; a text's
    words are those of its lines, so sizes are sums and only admitted units are built.
    """
    mask = F.array(*(F.lit(n in set(sizes)) for n in range(max(sizes, default=0) + 1)))
    fits = lambda n: F.when((n >= 0) & (n < F.size(mask)), F.element_at(mask, F.greatest(n, F.lit(0)) + 1)).otherwise(False)
    d = docs.where("text is not null").select("doc_id", "text", F.lower("text").alias("low"))
    d = d.where(reduce(or_, (F.col("low").contains(w) for w in needed), F.lit(False)))
    d = d.withColumn("flat", F.regexp_replace("low", "[^a-z0-9\\n]+", " ")).withColumn("lines", F.split("flat", "\n", -1))
    d = d.withColumn("counts", F.transform("lines", _words))
    total = F.aggregate("counts", F.lit(0), lambda s, n: s + n)
    unit = lambda kind, pos, n, text: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), n.alias("n"), text.alias("unit"))
    none = F.expr("cast(array() as array<struct<kind:string,pos:int,n:int,unit:string>>)")
    whole = F.when(fits(total - 1), F.array(unit("text", F.lit(0), total - 1, F.col("flat")))).otherwise(none)
    fitting = F.filter(F.zip_with("counts", F.sequence(F.lit(0), F.size("counts") - 1), lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda c: fits(c["n"] - 1) & F.exists(F.array(*map(F.lit, needed)), lambda w: F.contains(F.get("lines", c["i"]), w)))
    lines = F.when(F.size("lines") > 1, F.transform(fitting, lambda c: unit("line", c["i"], c["n"] - 1, F.get("lines", c["i"])))).otherwise(none)
    d = d.withColumn("blocks", F.when(F.col("text").rlike(r"\n[ \t\r]*\n"), F.split("low", r"\n[ \t\r]*\n", -1)))
    several = F.transform(F.col("blocks"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, "[^a-z0-9]+", " ").alias("u")))
    several = F.filter(several, lambda x: fits(_words(x["u"]) - 1))
    blocks = F.when((F.size("blocks") > 1) & (F.size("lines") != F.size("blocks") * 2 - 1), F.transform(several, lambda x: unit("block", x["i"], _words(x["u"]) - 1, x["u"]))).otherwise(none)
    rows = d.select("doc_id", F.explode(F.concat(whole, blocks, lines)).alias("u"))
    return rows.select("doc_id", "u.kind", "u.pos", "u.n", F.trim(F.regexp_replace("u.unit", "[ \n]+", " ")).alias("norm"))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda x, y: F.concat(x, F.lit(" "), y))


def template_rows(templates: dict[str, str], threshold: float) -> list[dict]:
    """For each template its size, admissible sizes, different bigrams, and how many of these
    a text that holds a match must have."""
    out = []
    for k, v in sorted(templates.items()):
        words = re.sub("[^a-z0-9]+", " ", v.lower()).split()
        size, b = len(words) - 1, sorted({f"{x} {y}" for x, y in zip(words, words[1:])})
        least = math.ceil(threshold / (2 - threshold) * size - 1e-9)
        out.append({"template": k, "license": k.split(":")[0], "size": size, "low": least, "high": math.floor((2 - threshold) / threshold * size + 1e-9), "need": max(1, len(b) - size + least), "b": b})
    return out


def runs(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(doc_id, template, license, size, pos, last, norm, n): runs of lines that may match."""
    rows = template_rows(templates, threshold)
    listed = lambda b: F.split(F.lit("|".join(b)), r"\|", -1)
    known = listed(sorted({p for r in rows for p in r["b"]}))
    as_struct = lambda r: F.struct(*(F.lit(r[k]).alias(k) for k in ("template", "license", "size", "low", "high", "need")), listed(r["b"]).alias("b"))
    needed = anchors(templates, threshold)
    d = docs.where(F.contains("text", F.lit("\n"))).select("doc_id", F.lower("text").alias("low"))
    d = d.where(reduce(or_, (F.contains("low", F.lit(w)) for w in needed), F.lit(False)))
    lines = F.transform(F.split("low", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")).alias("s")))
    d = d.select("doc_id", F.filter(lines, lambda x: x["s"] != "").alias("lines"))
    d = d.withColumn("seen", F.array_intersect(_pairs(F.split(F.array_join("lines.s", " "), " ", -1)), known))
    d = d.where(F.size("seen") >= min((r["need"] for r in rows), default=1))
    fits = F.filter(F.array(*map(as_struct, rows)), lambda t: F.size(F.array_intersect("seen", t["b"])) >= t["need"])
    d = d.select("doc_id", "lines", F.explode(fits).alias("t"))
    # k: place among the lines that aren't blank; n words; h bigrams of the template that start in it; x: its last one ends in the next
    one = lambda x, k: F.struct(x["i"].alias("i"), x["s"].alias("s"), F.split(F.trim(F.concat(x["s"], F.lit(" "), F.coalesce(F.substring_index(F.get("lines.s", k + 1), " ", 1), F.lit("")))), " ", -1).alias("w"), _words(x["s"]).alias("n"))
    hit = lambda x: F.transform(_pairs(x["w"]), lambda p: F.array_contains("t.b", p))
    d = d.withColumn("lines", F.transform("lines", one))
    d = d.withColumn("lines", F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["n"].alias("n"), hit(x).alias("f"))))
    d = d.withColumn("lines", F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["n"].alias("n"), F.size(F.filter(x["f"], lambda f: f)).alias("h"), ((F.size(x["f"]) == x["n"]) & F.coalesce(F.get(x["f"], x["n"] - 1), F.lit(False))).alias("x"))))
    # from each first line onwards: words, bigrams that start before the line, whether one ends in it, and the ends found
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("h"), F.lit(False).alias("x"), F.lit(0).alias("k"), F.expr("cast(array() as array<int>)").alias("ends"))
    least = lambda n: F.lit(threshold / 2) * (n - 1 + F.col("t.size")) - 1e-9
    ends = lambda s, x: F.when((s["k"] > 0) & ((x["h"] > 0) | s["x"]) & (s["n"] + x["n"] - 1).between(F.col("t.low"), F.col("t.high")) & (s["h"] + x["h"] >= least(s["n"] + x["n"])), F.concat(s["ends"], F.array(s["k"]))).otherwise(s["ends"])
    step = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["h"] + x["h"]).alias("h"), x["x"].alias("x"), (s["k"] + 1).alias("k"), ends(s, x).alias("ends"))
    stop = lambda s, x: F.when(s["n"] > F.col("t.high") + 1, s).otherwise(step(s, x))
    found = F.transform("lines", lambda x, k: F.when(x["h"] > 0, F.aggregate(F.slice("lines", k + 1, F.col("t.high") + 1), start, stop, lambda s: F.transform(s["ends"], lambda e: F.struct(k.alias("k"), (k + e).alias("e"))))))
    d = d.withColumn("r", F.explode(F.flatten(F.filter(found, lambda x: x.isNotNull())))).where(~((F.col("r.k") == 0) & (F.col("r.e") == F.size("lines") - 1)))
    norm = F.array_join(F.transform(F.slice("lines", F.col("r.k") + 1, F.col("r.e") - F.col("r.k") + 1), lambda x: x["s"]), " ")
    end = lambda at: F.get("lines.i", F.col(f"r.{at}"))
    return d.select("doc_id", "t.template", "t.license", "t.size", end("k").alias("pos"), end("e").alias("last"), norm.alias("norm"), (_words(norm) - 1).alias("n"))


def scan_runs(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The runs that reach the threshold, as rows of scan."""
    table = template_table(docs.sparkSession, templates, threshold).dropDuplicates(["template"]).select("template", "b")
    near = with_bigrams(runs(docs, templates, threshold), "a").join(F.broadcast(table), "template")
    dice = F.lit(2.0) * F.size(F.array_intersect("a", "b")) / (F.col("n") + F.col("size"))
    scored = near.withColumn("dice", dice).where(F.col("dice") >= threshold - 1e-12)
    best = scored.groupBy("doc_id", "pos").agg(F.min(F.struct((-F.col("dice")).alias("d"), "n", "template", "license", "last")).alias("best"))
    by = W.partitionBy("doc_id").orderBy("pos")
    rank = F.struct("best.d", "best.n")
    best = best.withColumn("before", F.lag(F.struct(rank.alias("r"), F.col("best.last").alias("last"))).over(by)).withColumn("after", F.lead(F.struct(rank.alias("r"), F.col("pos").alias("pos"))).over(by))
    kept = best.where(~F.coalesce((F.col("before.last") >= F.col("pos")) & (F.col("before.r") <= rank), F.lit(False)) & ~F.coalesce((F.col("after.pos") <= F.col("best.last")) & (F.col("after.r") < rank), F.lit(False)))
    return kept.select("doc_id", F.lit("run").alias("kind"), "pos", "best.license", "best.template", F.round(-F.col("best.d"), 6).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind, pos, license, template, dice for every unit that reaches the threshold."""
    table = template_table(docs.sparkSession, templates, threshold)  # its size is the templates', whatever docs has
    sizes = [r[0] for r in table.select("n").distinct().collect()]
    near = with_bigrams(units(docs, sizes, anchors(templates, threshold)), "a")
    pairs = near.join(F.broadcast(table), "n")
    dice = F.lit(2.0) * F.size(F.array_intersect("a", "b")) / (F.col("n") + F.col("size"))
    scored = pairs.select("doc_id", "kind", "pos", "license", "template", dice.alias("dice")).where(F.col("dice") >= threshold - 1e-12)
    best = F.min(F.struct((-F.col("dice")).alias("d"), "template", "license")).alias("best")
    best = scored.groupBy("doc_id", "kind", "pos").agg(best)
    best = best.select("doc_id", "kind", "pos", "best.license", "best.template", F.round(-F.col("best.d"), 6).alias("dice"))
    return best.unionByName(scan_runs(docs, templates, threshold))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of every document that matches a licence template."""
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = ", ".join("('{}', '{}', '{}')".format(k, k.split(":")[0], v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    pairs = "list_sort(list_transform(list_zip({0}[:-2], {0}[2:]), lambda z: z[1] || ' ' || z[2]))"
    number = "list_transform(range(1, len({0}) + 1), lambda i: {0}[i] || '#' || (i - list_position({0}, {0}[i])))"
    return rf"""
WITH t0 AS (SELECT * FROM (VALUES {rows}) v(template, license, body)),
t1 AS (SELECT template, license, {norm.format("body")} AS norm FROM t0),
tw AS (SELECT template, license, string_split(norm, ' ') AS w FROM t1),
t2 AS (SELECT template, license, {pairs.format("w")} AS p FROM tw),
t AS (SELECT template, license, {number.format("p")} AS b, len(p) AS size FROM t2),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\n[ \t\r]*\n') AS blocks FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, 'text' AS kind, 0 AS pos, text AS unit FROM d
  UNION ALL SELECT doc_id, 'block', (i - 1)::INT, blocks[i] FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM d WHERE len(blocks) > 1 AND len(lines) <> len(blocks) * 2 - 1)
  UNION ALL SELECT doc_id, 'line', (i - 1)::INT, lines[i] FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE len(lines) > 1)
),
n AS (SELECT doc_id, kind, pos, {norm.format("unit")} AS norm FROM u),
s AS (SELECT *, length(norm) - length(replace(norm, ' ', '')) AS n FROM n),
k AS (SELECT * FROM s WHERE n > 0 AND EXISTS (SELECT 1 FROM t WHERE n BETWEEN size * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND size * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)),
w AS (SELECT doc_id, kind, pos, n, string_split(norm, ' ') AS w FROM k),
p AS (SELECT doc_id, kind, pos, n, {pairs.format("w")} AS p FROM w),
a AS (SELECT doc_id, kind, pos, n, {number.format("p")} AS a FROM p),
r0 AS (SELECT doc_id, (i - 1)::INT AS pos, {norm.format("lines[i]")} AS s FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE len(lines) > 1)),
r1 AS (SELECT doc_id, pos, string_split(s, ' ') AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS of_ FROM r0 WHERE s <> ''),
r2 AS (SELECT *, lead(w[1]) OVER (PARTITION BY doc_id ORDER BY k) AS nxt, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM r1),
r3 AS (SELECT *, list_transform(list_zip(w, w[2:] || [nxt]), lambda z: z[1] || ' ' || z[2]) AS pw FROM r2),
hl AS (SELECT doc_id, k, template, count(*) AS h, bool_or(j = len(pw)) AS x FROM (SELECT doc_id, k, pw, unnest(pw) AS q, unnest(range(1, len(pw) + 1)) AS j FROM r3) JOIN (SELECT template, unnest(list_distinct(p)) AS q FROM t2) USING (q) GROUP BY ALL),
rr AS (SELECT f.doc_id, f.k, l.k AS e, f.pos, l.pos AS last, t.template, (l.upto - f.upto + len(f.w) - 1)::INT AS n, t.size, t.license, t.b
  FROM hl JOIN r3 f ON f.doc_id = hl.doc_id AND f.k = hl.k JOIN t ON t.template = hl.template
  JOIN r3 l ON l.doc_id = f.doc_id AND l.k > f.k AND l.upto - f.upto + len(f.w) - 1 BETWEEN size * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND size * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9
  LEFT JOIN hl a ON a.doc_id = l.doc_id AND a.k = l.k AND a.template = hl.template LEFT JOIN hl c ON c.doc_id = l.doc_id AND c.k = l.k - 1 AND c.template = hl.template
  WHERE (a.h IS NOT NULL OR c.x) AND NOT (f.k = 1 AND l.k = l.of_)
    AND (SELECT sum(h) FROM hl y WHERE y.doc_id = f.doc_id AND y.template = hl.template AND y.k BETWEEN f.k AND l.k) >= {THRESHOLD} / 2 * (l.upto - f.upto + len(f.w) - 1 + t.size) - 1e-9),
rw AS (SELECT rr.doc_id, rr.k, e, template, any_value(rr.pos) AS pos, any_value(last) AS last, any_value(n) AS n, any_value(size) AS size, any_value(license) AS license, any_value(b) AS b, flatten(list(r3.w ORDER BY r3.k)) AS w FROM rr JOIN r3 ON r3.doc_id = rr.doc_id AND r3.k BETWEEN rr.k AND rr.e GROUP BY rr.doc_id, rr.k, e, template),
rp AS (SELECT * EXCLUDE w, {pairs.format("w")} AS p FROM rw),
ra AS (SELECT * EXCLUDE p, {number.format("p")} AS a FROM rp),
rd AS (SELECT *, 2.0::DOUBLE * len(list_intersect(a, b)) / (n + size) AS dice FROM ra),
rb AS (SELECT * FROM rd WHERE dice >= {THRESHOLD} - 1e-12 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY dice DESC, n, template) = 1),
rl AS (SELECT *, lag(last) OVER v AS last0, lag(dice) OVER v AS dice0, lag(n) OVER v AS n0, lead(pos) OVER v AS pos1, lead(dice) OVER v AS dice1, lead(n) OVER v AS n1 FROM rb WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
kept AS (SELECT * FROM rl WHERE NOT coalesce(last0 >= pos AND (dice0 > dice OR dice0 = dice AND n0 <= n), false) AND NOT coalesce(pos1 <= last AND (dice1 > dice OR dice1 = dice AND n1 < n), false)),
x AS (SELECT doc_id, kind, pos, license, template, 2.0::DOUBLE * len(list_intersect(a, b)) / (n + size) AS dice FROM a JOIN t ON n BETWEEN size * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND size * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)
SELECT * FROM (SELECT doc_id, kind, pos, license, template, round(dice, 6) AS dice FROM x WHERE dice >= {THRESHOLD} - 1e-12
QUALIFY row_number() OVER (PARTITION BY doc_id, kind, pos ORDER BY dice DESC, template) = 1)
UNION ALL SELECT doc_id, 'run', pos, license, template, round(dice, 6) FROM kept
"""


ORACLE = _oracle()
