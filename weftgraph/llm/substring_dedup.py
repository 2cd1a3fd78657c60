"""Substring deduplication by fixed-block anchors.

A passage of WINDOW = 13 words that also starts in a document with a smaller doc_id is
removed. Any 13 words hold a whole aligned block of ANCHOR = 7 words, so:

1. index: every document's non-overlapping 7-word blocks; probe: every rolling 7-word
   window. Both go as sorted, delta-coded fingerprints to the bucket of their hash, and a
   bit for each comes back: does some block of this hash lie in another document?
2. extend: 13-word windows around such anchors, and no others, send a 96-bit hash of all
   their words with the least doc_id that has them; the bit that comes back says whether
   a smaller doc_id has the same 13 words. Runs of such windows are the maximal exact
   repeats, and the words they cover are removed.

Work is done by chunk (about 2 MB of text as one compressed row, formed where the text
is read). A chunk sends each distinct fingerprint once, so a passage that a third of all
documents share costs its buckets one entry a chunk; text moves only to meet its answers.
The number of buckets follows the number of words. Step 1 may let too much through (short
fingerprints), never too little; step 2 decides.

Cases: null or empty text has no words; windows are judged on the input; a row with null
doc_id is neither a reference nor changed; rows repeated under one doc_id aren't smaller
than each other, so they keep their words; very long texts make a chunk of their own.
Columns named like an output are replaced, others are carried along. Empty tables give
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import bounded_batches, extended, materialize, read

WINDOW, ANCHOR = 13, 7
FINGERPRINT_BITS = 28
#: words whose fingerprints one bucket gets, about
BUCKET_WORDS = 1 << 20
_NO_DOC = np.iinfo(np.int64).max


def planes(x: np.ndarray) -> bytes:
    """Byte planes, so that the high bytes, mostly zero, compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def deltas(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def undeltas(b: bytes, kind) -> np.ndarray:
    return np.cumsum(unplanes(b, kind), dtype=kind)


CHUNK = "chunk long, words long, ids binary, known binary, sizes binary, nulls binary, blob binary, bytes long, rest binary"


def _chunks(names: list[str]):
    """Rows of documents to chunk rows; names: columns carried along."""

    def run(batches):
        ctx = TaskContext.get()
        base, count = (ctx.partitionId() if ctx else 0) << 32, 0
        for batch in batches:
            for part in at.slices(batch):
                ids, text = (part.column(part.schema.get_field_index(c)) for c in ("__id", "text"))
                data, offsets = at.text_bytes(text)
                size = np.diff(offsets)
                spaced = np.full(int(offsets[-1]) + len(size), 0x20, np.uint8)  # a blank after each text
                spaced[np.arange(int(offsets[-1])) + np.repeat(np.arange(len(size)), size)] = data[: int(offsets[-1])]
                bounds = at.split_words(np.append(spaced, np.zeros(8, np.uint8)), np.append(0, np.cumsum(size + 1)))[2]
                sink = pa.BufferOutputStream()
                rest = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names], names=names) if names else None
                if rest is not None:
                    with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(rest)
                known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
                null = np.asarray(text.is_null().to_numpy(zero_copy_only=False), bool)
                row = [base + count, int(bounds[-1]), ids.fill_null(_NO_DOC).to_numpy().astype(np.int64).tobytes(), np.packbits(known).tobytes(), size.astype(np.int64).tobytes(), np.packbits(null).tobytes(), pa.compress(spaced.tobytes(), codec="zstd", asbytes=True), len(spaced), sink.getvalue().to_pybytes()]
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["chunk", "words", "ids", "known", "sizes", "nulls", "blob", "bytes", "rest"])
                count += 1

    return run


class _Chunk:
    """A chunk row unpacked: words, their hashes, and its distinct anchors in hash order."""

    def __init__(self, row: dict, anchor_bits: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=n).astype(bool)
        self.null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=n).astype(bool)
        body = np.frombuffer(pa.decompress(row["blob"], decompressed_size=row["bytes"], codec="zstd", asbytes=True), np.uint8)
        self.data = np.append(body, np.zeros(8, np.uint8))
        self.offsets = np.append(0, np.cumsum(np.frombuffer(row["sizes"], np.int64) + 1))
        self.starts, self.ends, self.bounds = at.split_words(self.data, self.offsets)
        self.hash = at.hash_spans(self.data, self.starts, self.ends)
        self.first, self.owner = at.window_starts(self.bounds, ANCHOR)
        r = at.rolling(self.hash, ANCHOR)
        key = (r[self.first] if len(r) else r) >> np.uint64(64 - anchor_bits)
        self.keys, lead, self.inverse = np.unique(key, return_index=True, return_inverse=True)
        self.lead_owner = self.owner[lead]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(is a block, lies in several texts here) of each distinct anchor."""
        block, several = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        block[self.inverse[(self.first - self.bounds[self.owner]) % ANCHOR == 0]] = True
        several[self.inverse[self.owner != self.lead_owner[self.inverse]]] = True
        return block, several

    def candidates(self, shared: np.ndarray):
        """Windows near a shared anchor: (first word, text, distinct place), and the distinct hashes."""
        hit = np.zeros(len(self.hash) + 1, np.int64)
        hit[self.first[shared[self.inverse]] + 1] = 1
        hit = np.cumsum(hit)
        first, owner = at.window_starts(self.bounds, WINDOW)
        near = np.minimum(first + WINDOW - ANCHOR + 1, len(self.hash))
        pick = (hit[near] > hit[first]) & self.known[owner] if len(first) else np.zeros(0, bool)
        first, owner = first[pick], owner[pick]
        a = at.rolling(self.hash, WINDOW)[first] if len(first) else np.zeros(0, np.uint64)
        b = (at.rolling(at.mix(self.hash + np.uint64(0x5851F42D4C957F2D)), WINDOW)[first] if len(first) else np.zeros(0, np.uint64)) >> np.uint64(32)
        order = np.lexsort((b, a))
        a_, b_ = a[order], b[order]
        new = np.append(True, (a_[1:] != a_[:-1]) | (b_[1:] != b_[:-1])) if len(a_) else np.zeros(0, bool)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        at_ = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[owner[order]], at_) if len(at_) else np.zeros(0, np.int64)
        return first, owner, place, a_[at_], b_[at_].astype(np.uint32), least


def _cut(keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys of so many bits, by their top bits."""
    if not len(keys):
        return []
    b = (keys >> np.uint64(bits - buckets)).astype(np.int64) if buckets else np.zeros(len(keys), np.int64)
    new = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return list(zip(b[new].tolist(), new.tolist(), np.append(new[1:], len(keys)).tolist()))


def _answers(row: dict, step: int) -> np.ndarray:
    """The bits that came back for a chunk, in the order of its distinct keys."""
    got = sorted((a["bucket"], a["bits"], a["n"]) for a in (row["answers"] or []) if a["step"] == step)
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, b, n in got]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


ASK_1, ASK_2 = "bucket long, chunk long, n int, keys binary, block binary, several binary", "bucket long, chunk long, n int, a binary, b binary, least binary"
ANSWER = "chunk long, step int, bucket long, n int, bits binary"


def _batch(rows: list[list], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _ask_1(buckets: int):
    bits = buckets + FINGERPRINT_BITS

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = _Chunk(row, bits)
                block, several = c.anchors()
                out = [[k, row["chunk"], b - a, deltas((c.keys[a:b] & np.uint64((1 << FINGERPRINT_BITS) - 1)).astype(np.uint32)), np.packbits(block[a:b]).tobytes(), np.packbits(several[a:b]).tobytes()] for k, a, b in _cut(c.keys, bits, buckets)]
                yield _batch(out, ["bucket", "chunk", "n", "keys", "block", "several"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])
                del c, block, several, out
            at.release()

    return run


def _answer_rows(t: pa.Table, step: int, bits: np.ndarray) -> pa.Table:
    n = t["n"].to_numpy()
    cut = np.append(0, np.cumsum(n))
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
    at.release()
    return pa.table({"chunk": t["chunk"], "step": pa.array([step] * len(n), pa.int32()), "bucket": t["bucket"], "n": t["n"], "bits": pa.array(packed, pa.binary())})


def _answer_1(t: pa.Table) -> pa.Table:
    """Of one bucket: is the fingerprint a block's, and in two documents or more?"""
    t = t.combine_chunks()
    n = t["n"].to_numpy()
    key = np.concatenate([undeltas(b, np.uint32) for b in t["keys"].to_pylist()] or [np.zeros(0, np.uint32)])
    flag = [np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(t[c].to_pylist(), n)] or [np.zeros(0, np.uint8)]).astype(bool) for c in ("block", "several")]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    block, several = np.zeros(len(count), bool), count > 1
    block[inverse[flag[0]]] = True
    several[inverse[flag[1]]] = True
    return _answer_rows(t, 1, (block & several)[inverse])


def _ask_2(buckets: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = _Chunk(row, buckets + FINGERPRINT_BITS)
                _, _, _, a, b, least = c.candidates(_answers(row, 1))
                out = [[k, row["chunk"], y - x, deltas(a[x:y]), b[x:y].tobytes(), planes(least[x:y])] for k, x, y in _cut(a, 64, buckets)]
                yield _batch(out, ["bucket", "chunk", "n", "a", "b", "least"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])
                del c, a, b, least, out
            at.release()

    return run


def _answer_2(t: pa.Table) -> pa.Table:
    """Of one bucket: does a smaller doc_id than the chunk's least have these words?"""
    t = t.combine_chunks()
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    a = cat([undeltas(x, np.uint64) for x in t["a"].to_pylist()], np.uint64)
    b = cat([np.frombuffer(x, np.uint32) for x in t["b"].to_pylist()], np.uint32)
    own = cat([unplanes(x, np.int64) for x in t["least"].to_pylist()], np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    least = np.minimum.reduceat(own[order], np.flatnonzero(new)) if len(a) else own
    bits = np.empty(len(a), bool)
    bits[order] = least[np.cumsum(new) - 1] < own[order] if len(a) else np.zeros(0, bool)
    return _answer_rows(t, 2, bits)


def _remove(buckets: int, schema: pa.Schema, with_text: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = _Chunk(row, buckets + FINGERPRINT_BITS)
                first, owner, place, _, _, least = c.candidates(_answers(row, 1))
                gone = _answers(row, 2)[place] | (c.ids[owner] > least[place]) if len(first) else np.zeros(0, bool)
                cover = np.zeros(len(c.hash) + 1, np.int64)
                np.add.at(cover, first[gone], 1)
                np.add.at(cover, first[gone] + WINDOW, -1)
                kept = np.cumsum(cover)[:-1] == 0
                n = np.diff(c.bounds)
                lost = n - at.sums(kept, c.bounds).astype(np.int64)
                # kept words, each followed by one blank; texts end in a blank of their own
                edge = np.zeros(len(c.data) + 1, np.int8)
                edge[c.starts[kept]] += 1
                edge[c.ends[kept]] -= 1
                mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
                mask[c.ends[kept]] = True
                body = c.data.copy()
                body[c.ends] = 0x20
                length = np.append(0, np.cumsum(mask[: int(c.offsets[-1])]))[c.offsets]
                body = body[: int(c.offsets[-1])][mask[: int(c.offsets[-1])]].tobytes()
                texts = [body[a : max(a, b - 1)] for a, b in zip(length, length[1:])]
                names, cols = [], []
                if row["rest"]:
                    with pa.ipc.open_stream(row["rest"]) as r:
                        rest = r.read_next_batch()
                    names, cols = list(rest.schema.names), list(rest.columns)
                if with_text:
                    raw = c.data.tobytes()
                    whole = [None if z else (raw[a : b - 1] if not k else t).decode("utf-8", "replace") for z, a, b, k, t in zip(c.null, c.offsets, c.offsets[1:], lost, texts)]
                    cols, names = [*cols, pa.array(whole, pa.string())], [*names, "text"]
                cols += [pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                got = dict(zip([*names, "n_words", "n_removed", "kept_sha256"], cols))
                yield pa.RecordBatch.from_arrays([got[k] for k in schema], names=schema)
                del c, mask, body, texts, cols, got
            at.release()

    return run


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with repeated passages removed from text, and n_words, n_removed, kept_sha256 added.

    A text that loses nothing stays as it is; one that loses words becomes its kept words
    joined by one blank each. kept_sha256 is of the kept words so joined in either case.
    Without with_text the text column is left out.
    """
    docs = bounded_batches(docs).drop("n_words", "n_removed", "kept_sha256")
    names = [c for c in docs.columns if c != "text"]
    chunks = materialize(docs.withColumn("__id", F.col("doc_id").cast("long")).mapInArrow(_chunks(names), CHUNK), "chunks")
    words = chunks.agg(F.sum("words")).first()[0] or 0
    buckets = max(0, int(np.ceil(np.log2(max(words, 1) / BUCKET_WORDS))))

    def answered(*answers: DataFrame) -> DataFrame:
        rows = answers[0]
        for a in answers[1:]:
            rows = rows.unionAll(a)
        rows = rows.groupBy("chunk").agg(F.collect_list(F.struct("step", "bucket", "n", "bits")).alias("answers"))
        return chunks.join(rows, "chunk", "left")

    one = materialize(chunks.drop("rest").mapInArrow(_ask_1(buckets), ASK_1).groupBy("bucket").applyInArrow(_answer_1, ANSWER), "anchors")
    two = materialize(answered(one).drop("rest").mapInArrow(_ask_2(buckets), ASK_2).groupBy("bucket").applyInArrow(_answer_2, ANSWER), "repeats")
    base = docs if with_text else docs.drop("text")
    schema = extended(base.schema, ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"))
    return answered(one, two).mapInArrow(_remove(buckets, schema.names, with_text), schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
