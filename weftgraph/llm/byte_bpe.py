"""Byte-level BPE encoding and decoding by a vocabulary of ranks.

A text is cut into pre-tokens by the pattern of the rank files (contractions, letters,
digits and other characters with at most one space before them, white space). Each is
encoded in one of two tiers:

1. A minimal perfect hash over the vocabulary maps a pre-token to the one slot where it
   could be; if the bytes kept for that slot are the pre-token's, the slot's rank is its id.
2. What isn't in the vocabulary is merged from single bytes: neighbours in a linked list,
   a heap of (rank, place) that always gives the lowest rank, the leftmost first, and entries
   that a later merge has made stale are passed over. A pre-token of n bytes takes n log n
   steps, whatever it holds. Equal misses of a slice of text are merged once.

Splitting, hashing and looking up are array operations over slices of about SLICE_BYTES of
text; the table (16 bytes a token beside the token's bytes) is broadcast, and refused
above MAX_VOCABULARY_BYTES.

Cases: null and empty texts have no ids; very long texts are read whole; rows are encoded
each by itself, so repeated rows, ties and null ids of documents change nothing; special
tokens are ordinary text; other columns are kept, but for those named ``ids`` (encode) or
``decoded`` (decode), which are replaced. Ids outside the vocabulary can't be decoded and
raise. Empty tables give no rows.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import bounded_batches, extended, read

#: documented bound on what is broadcast: bytes of all tokens of the vocabulary
MAX_VOCABULARY_BYTES = 64 << 20
#: about so many bytes of misses and their ids are remembered by a task from slice to slice
REMEMBERED_BYTES = 48 << 20
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
# fixed values: the contractions of the pattern
CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


# ---- the minimal perfect hash


class Vocabulary:
    """Ranks of byte strings behind a minimal perfect hash, and the strings by rank.

    A key's hash names a bucket, and the bucket's displacement turns the hash into the key's
    own slot of exactly as many slots as there are keys. Buckets are placed from the largest
    to the smallest; a bucket of one key takes a free slot directly.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = sorted(ranks)
        if sum(map(len, keys)) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to broadcast")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        if min(ranks.values()) < 0 or len(set(ranks.values())) < len(ranks):
            raise ValueError("ranks must be different and not negative")
        ends = np.cumsum([len(k) for k in keys])
        data = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
        spans = np.concatenate([[0], ends[:-1]]), ends
        self.ranks, self.n = ranks, len(keys)
        hashes = at.hash_spans(data, *spans)
        slot = self._place(hashes)
        order = np.empty(self.n, np.int64)
        order[slot] = np.arange(self.n)
        self.data, self.start, self.end = data, spans[0][order], spans[1][order]
        self.rank = np.array([ranks[k] for k in keys], np.int32)[order]
        # for decoding: where the bytes of a rank are; -1 for ranks that don't exist
        self.by_rank = np.full(int(self.rank.max()) + 1, -1, np.int64)
        self.by_rank[self.rank] = np.arange(self.n)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        self.buckets = max(1, self.n // 3)
        bucket = (hashes >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        taken, slot = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        sizes = np.diff(cut)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[cut[b] : cut[b + 1]]
            if len(own) < 2:
                break
            tried = 0
            while True:  # 64 displacements at a time
                d = np.arange(tried, tried + 64)
                places = self._slots(hashes[own][None, :], d[:, None])
                ordered = np.sort(places, axis=1)
                good = np.flatnonzero(~taken[places].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(good):
                    self.shift[b] = d[good[0]]
                    slot[own] = places[good[0]]
                    taken[slot[own]] = True
                    break
                tried += 64
                if tried > 1 << 24:
                    raise RuntimeError("keys with equal hashes")
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self.shift[single] = -1 - free
        slot[order[cut[single]]] = free
        return slot

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = at.mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Rank of each span's bytes, -1 for those that aren't in the vocabulary."""
        slot = self._slots(hashes, self.shift[((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)])
        same = _equal(data, starts, ends, self.data, self.start[slot], self.end[slot])
        return np.where(same, self.rank[slot], np.int32(-1))


def _equal(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Which spans of a and b hold the same bytes, eight a step; both end in eight spare bytes."""
    left, right = (np.ndarray(shape=(len(x) - 7,), dtype="<u8", buffer=x, strides=(1,)) for x in (a, b))
    size = a1 - a0
    same = size == b1 - b0
    live, done = np.flatnonzero(same & (size > 0)), 0
    while len(live):
        keep = at._TAIL[np.minimum(size[live] - done, 8)]
        unlike = ((left[a0[live] + done] ^ right[b0[live] + done]) & keep) != 0
        same[live[unlike]] = False
        done += 8
        live = live[~unlike & (size[live] > done)]
    return same


# ---- pre-tokens


def kinds() -> np.ndarray:
    """Kind of every code point: letter, digit, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for start in (0, 0xE000):  # around the surrogates
            block = "".join(map(chr, range(start, 0xD800 if start == 0 else 0x110000)))
            for m in regex.finditer(pattern, block):
                out[start + m.start() : start + m.end()] = kind
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray, kind_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all pre-tokens and the end of the last, bounds by text).

    Characters of one kind form runs. A run of letters, digits or others takes a space right
    before it; of white space before other text the last character stands apart (and is
    taken by the run after it, if it is a space). An apostrophe that is a run by itself,
    has no space before it and is followed by a contraction's letters ends with those.
    """
    n = int(offsets[-1])
    at_char = np.flatnonzero((data[:n] & 0xC0) != 0x80)
    lead = data[at_char]
    code = lead.astype(np.int32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        b = [data[at_char[wide] + k].astype(np.int32) for k in range(4)]
        code[wide] = np.select(
            [b[0] < 0xE0, b[0] < 0xF0],
            [(b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0xF) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F],
            (b[0] & 7) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F,
        )
    chars = len(at_char)
    text_at = np.searchsorted(at_char, offsets)
    if not chars:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    kind = kind_of[np.minimum(code, 0x10FFFF)]
    first = np.zeros(chars + 1, bool)  # a text starts here
    first[text_at] = True
    run = first.copy()
    run[1:-1] |= kind[1:] != kind[:-1]
    run[0] = run[-1] = True

    space = kind == SPACE
    token = run.copy()
    # the last white space before other text of the same text stands apart
    last_space = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
    token[last_space] = True
    token[last_space[code[last_space] == 0x20] + 1] = False

    quote = np.flatnonzero((code == 0x27) & token[:-1] & run[1:])
    if len(quote):
        place = at_char[quote]
        left = offsets[np.searchsorted(offsets, place, "right")] - place
        for mark in CONTRACTIONS:
            same = left >= len(mark)
            for k in range(1, len(mark)):
                same &= data[place + k] == mark[k]
            hit = quote[same]
            token[hit + 1] = False
            token[hit + len(mark)] = True
    at_token = np.flatnonzero(token)
    return np.append(at_char, n)[at_token], np.searchsorted(at_token, text_at)


# ---- merging


class Remembered(dict):
    """Ids of misses merged before; emptied when it holds more than REMEMBERED_BYTES."""

    held = 0

    def ids(self, piece: bytes, ranks: dict[bytes, int]) -> list[int]:
        found = self.get(piece)
        if found is None:
            if self.held > REMEMBERED_BYTES:
                self.clear()
                self.held = 0
            found = self[piece] = merge(piece, ranks)
            self.held += 200 + len(piece) + 8 * len(found)
        return found


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token that isn't in the vocabulary."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts is no longer what it was
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def encode_slice(data: np.ndarray, offsets: np.ndarray, words: Vocabulary, kind_of: np.ndarray, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds by text); known holds misses that were merged before."""
    cut, bounds = pretokens(data, offsets, kind_of)
    starts, ends = cut[:-1], cut[1:]
    h = at.hash_spans(data, starts, ends)
    ids = words.find(data, starts, ends, h)
    missed = np.flatnonzero(ids < 0)
    if not len(missed):
        return ids, bounds
    _, one, which = np.unique(h[missed], return_index=True, return_inverse=True)
    one = missed[one]
    odd = ~_equal(data, starts[missed], ends[missed], data, starts[one[which]], ends[one[which]])  # equal hashes, other bytes
    which[odd] = len(one) + np.arange(odd.sum())
    one = np.concatenate([one, missed[odd]])
    raw = data.tobytes()
    merged = [known.ids(raw[a:b], words.ranks) for a, b in zip(starts[one].tolist(), ends[one].tolist())]
    size = np.array([len(m) for m in merged], np.int64)
    flat = np.fromiter((i for m in merged for i in m), np.int32, int(size.sum()))
    flat_at = np.cumsum(size) - size
    width = np.ones(len(ids), np.int64)
    width[missed] = size[which]
    place = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(width, out=place[1:])
    out = np.repeat(ids, width)
    many = size[which]
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(place[missed], many) + step] = flat[np.repeat(flat_at[which], many) + step]
    return out, place[bounds]


def decode_ids(ids: np.ndarray, bounds: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all lists of ids, bounds by list)."""
    slot = words.by_rank[np.where((ids >= 0) & (ids < len(words.by_rank)), ids, -1)] if len(ids) else ids.astype(np.int64)
    if len(ids) and (((ids < 0) | (ids >= len(words.by_rank))).any() or (slot < 0).any()):
        raise ValueError("an id is not in the vocabulary")
    size = words.end[slot] - words.start[slot]
    place = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=place[1:])
    step = np.arange(int(place[-1])) - np.repeat(place[:-1], size)
    return words.data[np.repeat(words.start[slot], size) + step], place[bounds]


# ---- DataFrames


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text as array<int>."""
    docs = bounded_batches(docs.drop(out) if out != text else docs)
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(ranks), kinds()))
    schema = extended(docs.schema, (out, "array<int>"))

    def run(batches):
        words, kind_of = shared.value
        known = Remembered()
        for batch in batches:
            for part in at.slices(batch, text):
                ids, bounds = encode_slice(*at.text_bytes(part.column(part.schema.get_field_index(text))), words, kind_of, known)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists if f.name == out else part.column(part.schema.get_field_index(f.name)) for f in schema], names=schema.names)

    return docs.mapInArrow(run, schema)


def _lists(batch: pa.RecordBatch, ids: str, most: int):
    """Cut a batch so that each piece holds about most ids (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(batch.schema.get_field_index(ids))), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the bytes of each list of ids as binary; a null list has no bytes."""
    encoded = bounded_batches(encoded.drop(out))
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    schema = extended(encoded.schema, (out, "binary"))

    def run(batches):
        words = shared.value
        for batch in batches:
            for part in _lists(batch, ids, at.SLICE_BYTES // 4):
                column = part.column(part.schema.get_field_index(ids))
                column = pa.compute.fill_null(column.cast(pa.large_list(pa.int32())), pa.scalar([], pa.large_list(pa.int32())))
                at_list = np.zeros(len(column) + 1, np.int64)
                np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), out=at_list[1:])
                raw, bounds = decode_ids(column.flatten().to_numpy(zero_copy_only=False), at_list, words)
                made = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([made if f.name == out else part.column(part.schema.get_field_index(f.name)) for f in schema], names=schema.names)
            at.release()

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    coded = decode(encode(docs.select("doc_id", "text"), ranks).select("doc_id", "ids"), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded bytes of every document."""
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
