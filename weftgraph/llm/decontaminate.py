"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document leaks an item of n words if some window of n of its words is within
floor(0.2 n) word edits of the item (words: lowercased runs of letters and digits; a
text shorter than the item is its only window).

* The CGK random walk turns edit distance into Hamming distance: each step emits the word
  under the pointer and moves on by a random bit of (step, word). The first 1.7 n steps are
  used, in which a text of n words isn't used up as a rule.
* Bit-sampling LSH finds the candidates: every item's embedding is entered in one table
  for each of WALKS x REPETITIONS repetitions, under a code of the words at SAMPLES random
  places; every window of an item's size looks up its own codes, and what it meets in any
  table is a candidate. Codes with a place beyond the end of the words are not used. The
  number of repetitions is set for a recall of TARGET_RECALL.
* Levenshtein distance decides every candidate.
* Windows that can't match are not embedded (a declared pre-filter that loses none): n words
  within k edits of an item keep an unbroken run of q = ceil((n - k) / (k + 1)) item words,
  so a window is embedded only if some item q-gram (q at most 4) of its size lies in it at
  most k words away from its place in the item.

An item of more than MAX_WORDS words leaks if some stretch of the text is within floor(0.2 n)
edits of the whole item. It is cut into even pieces of at most MAX_WORDS words, which are
looked for by the same tables: one of the pieces has at most its share of the edits (and one
more, for rounding), so the window that starts where it starts is within twice that of it.
Such windows say where the item may lie, and a distance with free ends, over all words of the
item, decides; it is never a piece that decides. Items are kept by size, without padding,
and taken in blocks of at most BLOCK_BYTES of text and about BLOCK_PIECES items and pieces, one
pass over the documents each, so what is broadcast (some 50 MB of tables) stays bounded
however large the benchmark is.

Cases: null or empty texts and items without words match nothing; different texts under
one item_id are all searched and the best match is reported, equal ones count once; rows
with null item_id are left out; equal distances are resolved to the first window; rows
repeated in documents give repeated rows; other columns are not read. Empty tables give
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import bounded_batches, read

EDIT_SHARE, SAMPLES, TARGET_RECALL = 0.2, 2, 0.999
#: measured (tests): over 0.999 of pairs within 20 % of edits meet, for items of 6 to MAX_WORDS words and longer ones
WALKS, REPETITIONS = 16, 8
REACH = 1.7
MAX_WORDS = 128
BLOCK_BYTES, BLOCK_PIECES = 8 << 20, 1 << 15
#: window words handled at once
PIECE = 1 << 20
_RNG = np.random.default_rng(1)
_STEP_SEED = _RNG.integers(0, 2**63, WALKS, dtype=np.uint64)
_PLACES = _RNG.random((WALKS, REPETITIONS, SAMPLES))
_PAD = np.uint64(0xD1B54A32D192ED03)


def edits(n: np.ndarray | int):
    return np.floor(np.asarray(n) * EDIT_SHARE + 1e-9).astype(np.int64)


def run_length(n: int, k: int | None = None) -> int:
    """Length of an item run that any match (within k edits) keeps, at most 4."""
    k = int(edits(n)) if k is None else k
    return min(4, -(-(n - k) // (k + 1)))


class Size:
    """All items, or pieces of longer ones, that have n words: their words and LSH tables.

    A window may be k edits away from what it is looked for; offset is a piece's place in its item."""

    def __init__(self, n: int, words: np.ndarray, item: np.ndarray, offset: np.ndarray, pieces: bool):
        self.n, self.k, self.words, self.item, self.offset, self.pieces = n, int(edits(n)) + pieces, words, item, offset, pieces
        code, ok = codes(words)
        row = np.repeat(np.arange(len(words)), ok.shape[1])[ok.ravel()]
        code = code.ravel()[ok.ravel()]
        order = np.argsort(code, kind="stable")
        self.code, self.row = code[order], row[order].astype(np.int32)

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, piece) pairs that meet in some table."""
        code, ok = codes(windows)
        who = np.repeat(np.arange(len(windows)), ok.shape[1])[ok.ravel()]
        code = code.ravel()[ok.ravel()]
        lo, hi = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        hit = np.flatnonzero(hi > lo)
        count = hi[hit] - lo[hit]
        at_ = np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pair = np.unique(np.repeat(who[hit], count) * len(self.words) + self.row[at_])
        return pair // len(self.words), pair % len(self.words)


class Items:
    """Pieces of one block of items by size, and the q-grams of each size."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = at.text_bytes(pa.array([t.lower() for t in texts], pa.string()))
        starts, ends, bounds = at.split_words(data, offsets, at.NON_ALNUM)
        h = at.hash_spans(data, starts, ends)
        pieces: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            cuts = np.linspace(0, b - a, max(1, -(-(b - a) // MAX_WORDS)) + 1).astype(int).tolist()
            for p, q in zip(cuts, cuts[1:]):
                if q > p:
                    pieces.setdefault((q - p, len(cuts) > 2), []).append((i, a + p, p))
        self.ids, self.h, self.bounds = np.asarray(ids, np.int64), h, bounds
        self.sizes = [Size(n, h[np.array([p for _, p, _ in of])[:, None] + np.arange(n)], *(np.array([x[c] for x in of]) for c in (0, 2)), long) for (n, long), of in sorted(pieces.items())]
        self.n, self.k = (np.array([getattr(s, c) for s in self.sizes], np.int64) for c in ("n", "k"))
        grams: dict[int, list[np.ndarray]] = {}
        for at_, s in enumerate(self.sizes):
            q = run_length(s.n, s.k)
            key = np.stack([at.rolling(w, q) for w in s.words])
            place = np.broadcast_to(np.arange(key.shape[1]), key.shape)
            grams.setdefault(q, []).append(np.stack([key.ravel(), np.full(key.size, at_, np.uint64), place.ravel().astype(np.uint64)]))
        self.grams = {}
        for q, found in grams.items():  # (gram, place in sizes, place in the item), each once, by gram
            key, which, place = np.unique(np.concatenate(found, axis=1), axis=1)
            filt = np.zeros(1 << 20, bool)
            filt[key >> np.uint64(44)] = True
            self.grams[q] = (filt, key, which.astype(np.int64), place.astype(np.int64))


def codes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, WALKS * REPETITIONS) LSH codes of rows of n words, and which of them may be used."""
    n = words.shape[1]
    rows, steps = np.arange(len(words)), max(SAMPLES, int(np.ceil(REACH * n)))
    padded = np.concatenate([words, np.full((len(words), 1), _PAD)], axis=1)
    out, ok = np.empty((len(words), WALKS, REPETITIONS), np.uint64), np.empty((len(words), WALKS, REPETITIONS), bool)
    for w in range(WALKS):
        walk = np.empty((len(words), steps), np.uint64)
        p = np.zeros(len(words), np.int64)
        salt = np.arange(1, 2 * steps, 2, dtype=np.uint64) * _STEP_SEED[w : w + 1]
        for j in range(steps):
            symbol = padded[rows, p]
            walk[:, j] = symbol
            p += (at.mix(symbol + salt[j]) >> np.uint64(63)).astype(np.int64)
            np.minimum(p, n, out=p)
        for r in range(REPETITIONS):
            code, used = np.full(len(words), w * REPETITIONS + r, np.uint64), np.ones(len(words), bool)
            for s in range(SAMPLES):
                symbol = walk[:, int(_PLACES[w, r, s] * steps)]
                used &= symbol != _PAD
                code = at.mix(code + symbol)
            out[:, w, r], ok[:, w, r] = code, used
    return out.reshape(len(words), -1), ok.reshape(len(words), -1)


def levenshtein(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distance of row r's first n[r] entries of a and first m[r] of b, all rows at once."""
    along = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(along, (len(a), len(along))).copy()
    out = np.where(n == 0, m, 0)
    rows = np.arange(len(a))
    for i in range(int(n.max()) if len(n) else 0):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(step - along, axis=1) + along
        done = n == i + 1
        out[done] = row[rows[done], m[done]]
    return out


def windows(items: Items, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, place in sizes, start) of the windows that pass the q-gram filter, each once."""
    found = []
    for q, (filt, keys, which, place) in items.grams.items():
        first, owner = at.window_starts(bounds, q)
        g = at.rolling(h, q)[first] if len(first) else np.zeros(0, np.uint64)
        hit = np.flatnonzero(filt[g >> np.uint64(44)])
        lo, hi = np.searchsorted(keys, g[hit], "left"), np.searchsorted(keys, g[hit], "right")
        hit, lo, count = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if len(hit):
            at_ = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            text = np.repeat(owner[hit], count)
            found.append(np.unique(np.stack([text, which[at_], np.repeat(first[hit], count) - bounds[text] - place[at_]]), axis=1))
    if not found:
        return np.zeros((3, 0), np.int64)
    # all starts within k words of where a q-gram puts an item
    text, which, start = np.unique(np.concatenate(found, axis=1), axis=1)
    spread = 2 * items.k[which] + 1
    at_ = np.repeat(np.arange(len(text)), spread)
    start = start[at_] + np.arange(len(at_)) - np.repeat(np.cumsum(spread) - spread, spread) - items.k[which][at_]
    text, which = text[at_], which[at_]
    size = np.diff(bounds)[text]
    start = np.clip(start, 0, np.maximum(size - items.n[which], 0))
    ok = size >= items.n[which] - items.k[which]
    return np.unique(np.stack([text[ok], which[ok], start[ok]]), axis=1)


def stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, first word) of the stretch of text that is nearest to the item; ties: the first to end."""

    def last_row(a: np.ndarray, b: np.ndarray, row: np.ndarray) -> np.ndarray:
        along = np.arange(len(b) + 1, dtype=np.int32)
        for i, word in enumerate(a):
            step = np.empty_like(row)
            step[0] = i + 1
            step[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != word))
            row = np.minimum.accumulate(step - along) + along
        return row

    row = last_row(item, text, np.zeros(len(text) + 1, np.int32))
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], np.arange(end + 1, dtype=np.int32))
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[0])


def long_matches(items: Items, found: list[np.ndarray], h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(text, item, distance, item words, first word) of whole long items where their pieces
    (text, item place, estimated start) were found. Near starts are looked at as one region."""
    out = [np.zeros((5, 0), np.int64)]
    text, item, start = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    n = np.diff(items.bounds)[item]
    new = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > n[1:])) if len(text) else np.zeros(0, bool)
    cut = np.append(np.flatnonzero(new), len(text))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        t, i, words = text[a], item[a], int(n[a])
        k = int(edits(words))
        low = max(0, int(start[a]) - 2 * k - MAX_WORDS)
        high = min(int(bounds[t + 1] - bounds[t]), int(start[b - 1]) + words + 2 * k + MAX_WORDS)
        d, first = stretch(h_of(items, i), h[bounds[t] + low : bounds[t] + high])
        if d <= k:
            out.append(np.array([[t], [items.ids[i]], [d], [words], [low + first]], np.int64))
    return np.concatenate(out, axis=1)


def h_of(items: Items, i: int) -> np.ndarray:
    """Hashes of all words of an item."""
    return items.h[items.bounds[i] : items.bounds[i + 1]]


def matches(items: Items, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item_id, distance, item words, first word) of the best window of every leaking pair."""
    starts, ends, bounds = at.split_words(data, offsets, at.NON_ALNUM)
    h = at.hash_spans(data, starts, ends)
    text, which, start = windows(items, h, bounds)
    best, parts = [np.zeros((5, 0), np.int64)], []
    for of in np.unique(which).tolist():
        s, own = items.sizes[of], np.flatnonzero(which == of)
        n, step = s.n, max(1, PIECE // s.n)
        for a in range(0, len(own), step):
            t, p = text[own[a : a + step]], start[own[a : a + step]]
            m = np.minimum(n, np.diff(bounds)[t])
            col = np.arange(n)
            window = np.where(col < m[:, None], h[np.minimum(bounds[t][:, None] + p[:, None] + col, len(h) - 1)], _PAD)
            w, piece = s.candidates(window)
            for c in range(0, len(w), step):
                v, i = w[c : c + step], piece[c : c + step]
                d = levenshtein(s.words[i], np.full(len(v), n), window[v], m[v])
                good = d <= (2 * s.k if s.pieces else s.k)
                if s.pieces:
                    parts.append(np.stack([t[v[good]], s.item[i[good]], p[v[good]] - s.offset[i[good]]]))
                else:
                    best.append(np.stack([t[v[good]], items.ids[s.item[i[good]]], d[good], np.full(int(good.sum()), n), p[v[good]]]))
    best.append(long_matches(items, parts, h, bounds))
    t, i, d, n, p = np.concatenate(best, axis=1)
    order = np.lexsort((p, d, d / np.maximum(n, 1), i, t))
    t, i, d, n, p = (x[order] for x in (t, i, d, n, p))
    lead = np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])) if len(t) else np.zeros(0, bool)
    return t[lead], i[lead], d[lead], n[lead], p[lead]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, similarity, start_word): leaked items, best window each."""
    bench = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    total, pieces = bench.agg(F.sum(F.octet_length("text")), F.sum(1 + F.regexp_count("text", F.lit("[^ ]+")) / (MAX_WORDS // 2))).first()
    blocks = max(1, -(-(total or 0) // BLOCK_BYTES), -(-int(pieces or 0) // BLOCK_PIECES))
    texts = bounded_batches(docs).select(F.col("doc_id"), F.lower(F.col("text")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, similarity double, start_word int"
    out = None
    for b in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about BLOCK_BYTES, BLOCK_PIECES
        sent = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in own], [r["text"] for r in own]))

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                for part in at.slices(batch):
                    t, i, d, n, p = matches(items, *at.text_bytes(part.column(1)))
                    if len(t):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array(i, pa.int64()), pa.array(d, pa.int32()), pa.array(1 - d / n), pa.array(p, pa.int32())], names=["doc_id", "item_id", "distance", "similarity", "start_word"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaking (document, benchmark item) pair with its edit distance."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
