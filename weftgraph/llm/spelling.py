"""Spelling variants of a corpus's words: pairs one edit apart, grouped under frequent forms.

Words are counted over all texts. One edit (a code point inserted, deleted or replaced)
touches two bigrams at most, so of the three rarest bigrams of each of two near words, in one
global order, one is common to both and survives the edit. ``near_pairs`` therefore joins
words by their three rarest bigrams only. Position and length limits are part of the join
keys: a bigram that survives a replacement keeps its place, one that survives an insertion
keeps it or moves by one, and the side of the word away from the edit is the same in both.
The key is thus (length, the word up to the end of the bigram) or (length, the word from the
bigram on). What meets is verified by its edit distance within the join.

The global order is that of rising counts over the words' bigrams (there are at most 90
squared, whatever the corpus, so they are broadcast). A key that more than BLOCK words share
is dealt into salted blocks, and what probes it goes to each block.

Cases: null, empty and wordless texts have no words; very long texts are cut between words
into pieces of PIECE code points before they are searched; rows are counted each by itself,
so repeated rows count again; a null doc_id counts as an empty string where runs are changed
by its hash; ties of bigram counts are broken by the bigram, ties of word counts by the
smaller word; other columns are dropped; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialize, read

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 6, 5
#: a form is at least so many times as frequent as its variant
TIMES = 5
#: one of so many runs of a document is misspelt by ``misspell``
EVERY = 199
PREFIX = 3
PIECE = 1 << 16
BLOCK = 2048


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of every maximal run of letters in the texts, A-Z lowered."""
    # a piece ends before a letter only if it is one long run itself
    pieces = F.regexp_extract_all("text", F.lit(rf"[\s\S]{{0,{PIECE - 1}}}(?:[^{LETTERS}]|\z)|[{LETTERS}]+"), F.lit(0))
    cut = docs.where("text <> ''").select("doc_id", F.explode(F.when(F.char_length("text") < PIECE, F.array("text")).otherwise(pieces)).alias("piece"))
    found = cut.select("doc_id", F.explode(F.regexp_extract_all("piece", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    return found.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def misspell(found: DataFrame) -> DataFrame:
    """(word) of every run: where EVERY divides the hash of document and run, the run lacks one code point."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = found.select("run", F.crc32(key.cast("binary")).alias("h"), F.char_length("run").alias("size")).where(F.col("size") >= 1)
    at = (F.col("h") % F.col("size")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    return hashed.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words of at least min_length code points that occur min_count times."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rarest(words: DataFrame) -> DataFrame:
    """(word, n, size, p): words, their lengths and the places of their three rarest bigrams.

    Words of fewer than four code points have fewer bigrams, and then all of them."""
    sized = words.withColumn("size", F.char_length("word")).where("size >= 2")
    grams = sized.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("size") - 2))).withColumn("gram", F.substring(F.col("word"), F.col("p") + 1, F.lit(2)))
    order = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = grams.join(F.broadcast(order), "gram")  # 90 * 90 bigrams at most
    first = ranked.groupBy("word", "n", "size").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "p"))), 1, PREFIX).alias("first"))
    return first.select("word", "n", "size", F.explode("first.p").alias("p"))


def _keys(word: Column, size: Column, p: Column) -> list[Column]:
    """Keys of a word's bigram at p: what comes up to its end, and what comes from it on.

    size is the length of the word that is looked for."""
    return [F.xxhash64(F.lit(0), size, F.substring(word, F.lit(1), p + 2)), F.xxhash64(F.lit(1), size, F.substring(word, p + 1, F.length(word)))]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), each pair once: words of words (word, n), all different, that differ by exactly one edit.

    Complete for words of at least four code points, which have three bigrams."""
    first = materialize(rarest(words), "bigrams")
    word, size, p = F.col("word"), F.col("size"), F.col("p")
    held = first.select("word", "n", "size", F.explode(F.array(*_keys(word, size, p))).alias("key"))
    asks = first.select("word", "n", "size", F.explode(F.array(*_keys(word, size, p), *_keys(word, size + 1, p))).alias("key"))

    large = materialize(held.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "large")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    held = held.join(large, "key", "left").select("key", F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"))
    asks = asks.join(large, "key", "left").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"))

    longer = F.col("size_b") == F.col("size_a") + 1
    alike = (F.col("size_b") == F.col("size_a")) & (F.col("a") < F.col("b"))
    met = asks.join(held.hint("merge"), (asks["key"] == held["key"]) & (asks["block"] == held["block"]) & (longer | alike) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) that starts with word ends.

    Every form must be more frequent than its word by TIMES, so chains are short (the
    logarithm of the largest count) and have no cycles; each round doubles their steps."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(reached.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not further.where("moved").take(1):
            return further.select("word", "root")
        reached = further.select("word", "root")


def group(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n), all different."""
    words = materialize(words, "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("other"), "n_b").unionAll(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "other", "other_n")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"), best.alias("best"))
    enough = -F.col("best.less") >= times * F.col("own")
    found = materialize(found.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null"))
    return words.join(found, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words' number, their form and its root."""
    return group(count_words(misspell(runs(read(spark, sf_dir, "documents")))))


ORACLE = """
WITH RECURSIVE tab AS (  -- crc32, a byte at a time
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))
), found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), runs AS (
  SELECT id, run, count(*) AS times FROM found WHERE length(run) >= 6 GROUP BY id, run
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_transform(string_split(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\\1 ', 'g').rtrim(), ' '), lambda x: ('0x' || x)::BIGINT),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS h
  FROM runs, tab
), spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cut AS (
  SELECT word, n, length(word) AS size, unnest(range(1, length(word) + 1)) AS p FROM words
), less AS (
  SELECT word, n, size, p, left(word, (p - 1)::INT) || substr(word, (p + 1)::INT) AS rest FROM cut
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word, n
), forms AS (
  SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM best
), chain AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root AND f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c LEFT JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN forms f ON f.word = w.word LEFT JOIN ends e ON e.word = w.word
"""
