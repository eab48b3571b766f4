"""Bring equal windows of different documents together without shuffling every window.

A *window* is ``window`` consecutive symbols (bytes or words) of one document. Each window belongs to its smallest
gram hash (its *anchor*), so equal windows share an anchor wherever they stand. Neighbouring windows with the same
anchor form one *segment*. The work runs in rounds over batches of documents (hash of the row, about 4 MB of text):

1. each batch sends its distinct anchors, five bytes each, to the bucket of the anchor;
2. a bucket answers, one bit each per anchor, which of them occur elsewhere too, and which are crowded (often in
   one batch already, as a common line is);
3. each batch sends its distinct segments of such anchors to a second bucket, with their first place in the batch;
4. there an *engine* finds the first place of every window among the segments, and answers in runs;
5. each batch applies the answers to all its occurrences.

Segments go where their anchor says; those of crowded anchors are cut into single windows, and each goes where its own
hash says, so that a common line with all its different neighbours is spread. A copy that occurs often is sent once by each batch, so no bucket gets more of a passage than there are batches.
Anchors are compared by 40 bits and their bucket; an accidental match only sends a segment that has no partner.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import LAST_ID, encoded, gram_hashes, ids, mixed, offsets, ranges, slices, span_hashes, text_size

BATCH_BYTES = 4 << 20
ANCHOR_BUCKET_BYTES = 16 << 20
SEGMENT_BUCKET_BYTES = 2 << 20
CHUNK_BYTES = 1 << 19
CROWD = 64

ANSWER = "batch long, kind int, bucket int, data binary, more binary"


@dataclass
class Chunk:
    """Texts laid end to end: gram hashes, symbol numbers where texts begin, and the bytes of a symbol range."""

    grams: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def piece(self, start: int, stop: int) -> bytes:
        if self.starts is None:
            return self.data[start:stop].tobytes()
        return self.data[self.starts[start] : self.ends[stop - 1]].tobytes()

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each symbol range."""
        if self.starts is None:
            return span_hashes(self.data, start, stop)
        return span_hashes(self.data, self.starts[start], self.ends[stop - 1])


@dataclass
class Runs:
    """Segments of one chunk: text in the chunk, first window (symbol number in the chunk), windows, anchor."""

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    again: np.ndarray


@dataclass
class Found:
    """Segments of a batch by bucket, hash, document and place: where they lie, and which begin a run of equal ones."""

    bucket: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    inside: np.ndarray
    chunk: np.ndarray
    first: np.ndarray
    last: np.ndarray
    count: np.ndarray
    new: np.ndarray


def smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    length = 1
    out = h
    while 2 * length <= w:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    if length < w:
        out = np.minimum(out[: len(out) - (w - length)], out[w - length :])
    return out


def runs_of(chunk: Chunk, window: int, gram: int, repeats: bool) -> Runs:
    """Segments of a chunk; ``again`` marks (if asked for) those whose anchor occurs twice inside them."""
    none = np.zeros(0, np.int64)
    w = window - gram + 1
    if len(chunk.grams) < w:
        return Runs(none, none, none, none.view(np.uint64), none.astype(bool))
    least = smallest(chunk.grams, w)
    change = np.empty(len(least), bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    # windows that would leave their text: from ``stop`` to the next text
    begin = chunk.bounds[:-1]
    stop = np.maximum(chunk.bounds[1:] - window + 1, begin)
    change[begin[begin < len(least)]] = True
    change[stop[stop < len(least)]] = True
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(least)))
    text = np.searchsorted(chunk.bounds, first, side="right") - 1
    keep = first < stop[text]
    first, count, text = first[keep], count[keep], text[keep]
    anchor = least[first]
    again = np.zeros(len(first), bool)
    if repeats and len(first):
        spread = count + w - 1
        same = chunk.grams[ranges(first, spread)] == np.repeat(anchor, spread)
        again = np.add.reduceat(same, np.cumsum(spread) - spread) > 1
    return Runs(text, first, count, anchor, again)


def five_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.append(first, len(keys)))


class Router:
    """The five rounds. ``cut`` lays texts out as a Chunk; ``engine`` and ``apply`` are the operator's own."""

    def __init__(
        self,
        cut: Callable[[list[bytes]], Chunk],
        engine: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple],
        apply: Callable[..., pa.Table],
        window: int,
        gram: int,
        within: bool,
    ):
        if not 1 <= gram <= window:
            raise ValueError("a gram has at least one symbol and at most the window's")
        self.cut, self.engine, self.apply = cut, engine, apply
        self.window, self.gram, self.within = window, gram, within

    # -- a batch of documents ------------------------------------------------------------------------------------
    def _load(self, docs: pa.Table):
        """Texts in a fixed order, so that every round numbers the segments alike."""
        docs = docs.select(["doc_id", "text"])
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        texts, doc = encoded(docs["text"]), ids(docs["doc_id"])
        chunks = [(a, b, self.cut(texts[a:b])) for a, b in slices(texts, CHUNK_BYTES)]
        return docs, texts, doc, chunks

    def _anchors(self, doc: np.ndarray, chunks) -> tuple[list[Runs], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs per chunk; sorted distinct anchors with their bucket, whether the batch alone makes them shared, crowded."""
        found = [runs_of(c, self.window, self.gram, self.within) for _, _, c in chunks]
        anchor = np.concatenate([np.zeros(0, np.uint64), *(r.anchor for r in found)])
        owner = np.concatenate([np.zeros(0, np.int64), *(doc[a:b][r.text] for (a, b, _), r in zip(chunks, found))])
        again = np.concatenate([np.zeros(0, bool), *(r.again for r in found)])
        bucket = (anchor % np.uint64(self.anchor_buckets)).astype(np.int64)
        order = np.lexsort((anchor, bucket))
        anchor, bucket, owner, again = anchor[order], bucket[order], owner[order], again[order]
        first, size = groups(anchor)
        if not len(first):
            return found, anchor, bucket, again, again
        crowded = size > CROWD
        if self.within:
            shared = (size > 1) | np.logical_or.reduceat(again, first)
        else:
            shared = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        return found, anchor[first], bucket[first], shared, crowded

    def send_anchors(self, docs: pa.Table) -> pa.Table:
        batch = docs["batch"][0].as_py()
        _, _, doc, chunks = self._load(docs)
        _, anchor, bucket, shared, crowded = self._anchors(doc, chunks)
        first, size = groups(bucket)
        value = anchor // np.uint64(self.anchor_buckets)
        return pa.table(
            {
                "bucket": pa.array(bucket[first], pa.int32()),
                "batch": pa.array(np.full(len(first), batch), pa.int64()),
                "data": pa.array([five_bytes(value[a : a + n]) for a, n in zip(first, size)], pa.binary()),
                "more": pa.array(
                    [np.packbits(np.concatenate([shared[a : a + n], crowded[a : a + n]])).tobytes() for a, n in zip(first, size)],
                    pa.binary(),
                ),
            }
        )

    def answer_anchors(self, sent: pa.Table) -> pa.Table:
        values = [from_five_bytes(x) for x in sent["data"].to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=2 * len(v)).reshape(2, -1) for x, v in zip(sent["more"].to_pylist(), values)]
        size = offsets(map(len, values))
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        first, count = groups(every[order])
        flag = np.maximum.reduceat(np.concatenate(flags, axis=1)[:, order], first, axis=1)
        bits = np.empty((2, len(every)), np.uint8)
        bits[0, order] = np.repeat((count > 1) | (flag[0] > 0), count)
        bits[1, order] = np.repeat(flag[1], count)
        parts = [bits[:, a:b] for a, b in zip(size, size[1:])]
        use = [i for i, x in enumerate(parts) if x[0].any()]
        return pa.table(
            {
                "batch": sent["batch"].combine_chunks().take(pa.array(use, pa.int64())),
                "kind": pa.array(np.zeros(len(use), np.int32)),
                "bucket": sent["bucket"].combine_chunks().take(pa.array(use, pa.int64())),
                "data": pa.array([np.packbits(parts[i][0]).tobytes() for i in use], pa.binary()),
                "more": pa.array([np.packbits(parts[i][1]).tobytes() for i in use], pa.binary()),
            }
        )

    def _segments(self, doc: np.ndarray, chunks, replies: pa.Table) -> Found:
        """All segments of shared anchors; equal ones of a bucket, by a 64-bit hash of their bytes, are numbered once."""
        found, anchor, bucket, _, _ = self._anchors(doc, chunks)
        first, size = groups(bucket)
        place = {int(bucket[a]): (a, n) for a, n in zip(first, size)}
        shared, crowded = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
        for kind, b, data, more in zip(*(replies[c].to_pylist() for c in ("kind", "bucket", "data", "more"))):
            if kind == 0:
                a, n = place[b]
                shared[a : a + n] = np.unpackbits(np.frombuffer(data, np.uint8), count=n)
                crowded[a : a + n] = np.unpackbits(np.frombuffer(more, np.uint8), count=n)
        order = np.argsort(anchor[shared])
        wanted, crowded = anchor[shared][order], crowded[shared][order]
        parts = []
        for k, ((a, _, chunk), r) in enumerate(zip(chunks, found)):
            if not len(wanted) or not len(r.anchor):
                continue
            at = np.minimum(np.searchsorted(wanted, r.anchor), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == r.anchor)
            if not len(hit):
                continue
            by, first, count, text = r.anchor[hit], r.first[hit], r.count[hit], r.text[hit]
            many = crowded[at[hit]]
            if many.any():  # single windows
                alone = ranges(first[many], count[many])
                by = np.concatenate([by[~many], self.window_hashes(chunk.grams, alone)])
                text = np.concatenate([text[~many], np.repeat(text[many], count[many])])
                first = np.concatenate([first[~many], alone])
                count = np.concatenate([count[~many], np.ones(len(alone), np.int64)])
            to = ((by >> np.uint64(20)) % np.uint64(self.segment_buckets)).astype(np.int64)
            last = first + count + self.window - 1
            inside = first - chunk.bounds[text]
            key = chunk.hashes(first, last).view(np.int64)
            parts.append(np.stack([to, key, doc[a + text], inside, np.full(len(to), k), first, last, count]))
        every = np.concatenate(parts, axis=1) if parts else np.zeros((8, 0), np.int64)
        every = every[:, np.lexsort((every[3], every[2], every[1], every[0]))]
        new = np.ones(every.shape[1], bool)
        new[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
        return Found(*every, new)

    def send_segments(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows = {"bucket": [], "batch": [], "sizes": [], "data": [], "doc": [], "start": [], "times": []}
        if docs.num_rows:
            batch = docs["batch"][0].as_py()
            _, _, doc, chunks = self._load(docs)
            f = self._segments(doc, chunks, replies)
            first = np.flatnonzero(f.new)
            times = np.diff(np.append(first, len(f.new)))
            pieces = [chunks[k][2].piece(s, e) for k, s, e in zip(*(x[first].tolist() for x in (f.chunk, f.first, f.last)))]
            for a, n in zip(*(x.tolist() for x in groups(f.bucket[first]))):
                own = first[a : a + n]
                rows["bucket"].append(int(f.bucket[own[0]]))
                rows["batch"].append(batch)
                rows["sizes"].append(np.fromiter(map(len, pieces[a : a + n]), np.uint32, n).tobytes())
                rows["data"].append(b"".join(pieces[a : a + n]))
                rows["doc"].append(f.doc[own].tobytes())
                rows["start"].append(f.inside[own].tobytes())
                rows["times"].append(np.packbits(times[a : a + n] > 1).tobytes())
        types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types)})

    def answer_segments(self, sent: pa.Table) -> pa.Table:
        """Runs the engine over the distinct segments of a bucket; each batch gets its own segments' answers back."""
        number: dict[bytes, int] = {}
        doc, start, again, owners = [], [], [], []
        for sizes, data, d, s, t in zip(*(sent[c].to_pylist() for c in ("sizes", "data", "doc", "start", "times"))):
            cut = offsets(np.frombuffer(sizes, np.uint32))
            d, s = np.frombuffer(d, np.int64).tolist(), np.frombuffer(s, np.int64).tolist()
            t = np.unpackbits(np.frombuffer(t, np.uint8), count=len(d)).tolist()
            mine = []
            for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
                x = self.canonical(data[a:b])
                n = number.setdefault(x, len(number))
                mine.append(n)
                if n == len(doc):
                    doc.append(d[i])
                    start.append(s[i])
                    again.append(t[i])
                else:
                    again[n] = 1
                    if (d[i], s[i]) < (doc[n], start[n]):
                        doc[n], start[n] = d[i], s[i]
            owners.append(mine)
        values, cut = self.engine(list(number), np.array(doc), np.array(start), np.array(again, bool))
        rows = []
        for mine in owners:
            mine = np.array(mine, np.int64)
            got = values[ranges(cut[mine], cut[mine + 1] - cut[mine])]
            first, size = groups_of_rows(got)
            rows.append((size.astype(np.uint32).tobytes(), got[first].tobytes()))
        return pa.table(
            {
                "batch": sent["batch"],
                "kind": pa.array(np.ones(len(rows), np.int32)),
                "bucket": sent["bucket"],
                "data": pa.array([x for x, _ in rows], pa.binary()),
                "more": pa.array([x for _, x in rows], pa.binary()),
            }
        )

    def finish(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return self.apply(docs.select(["doc_id", "text"]), [], np.zeros(0, np.int64), [], [])
        docs, texts, doc, chunks = self._load(docs)
        f = self._segments(doc, chunks, replies)
        answers = {}
        for kind, b, data, more in zip(*(replies[c].to_pylist() for c in ("kind", "bucket", "data", "more"))):
            if kind == 1:
                size = np.frombuffer(data, np.uint32)
                answers[b] = np.repeat(np.frombuffer(more, np.int64).reshape(len(size), -1), size, axis=0)
        marks = [np.zeros(0, np.int64) for _ in chunks]
        if answers:  # one row per window of each distinct segment, in the order of sending
            values = np.concatenate([answers[b] for b in sorted(answers)])
            cut = offsets(f.count[f.new])[np.cumsum(f.new) - 1]
            for k, (a, _, chunk) in enumerate(chunks):
                own = np.flatnonzero(f.chunk == k)
                at = ranges(f.first[own], f.count[own])
                best = values[ranges(cut[own], f.count[own])]
                text = np.searchsorted(chunk.bounds, at, side="right") - 1
                mine = doc[a + text]
                late = best[:, 0] < mine
                if self.within:
                    late |= (best[:, 0] == mine) & (best[:, 1] < at - chunk.bounds[text])
                marks[k] = np.sort(at[late])
        return self.apply(docs, texts, doc, chunks, marks)

    def window_hashes(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the window at each symbol, from grams that cover it."""
        out = np.zeros(len(at), np.uint64)
        for i in [*range(0, self.window - self.gram, self.gram), self.window - self.gram]:
            out = mixed(out * np.uint64(0xFF51AFD7ED558CCD) + grams[at + i])
        return out

    # -- symbols: bytes unless an operator says otherwise ---------------------------------------------------------
    def canonical(self, piece: bytes) -> bytes:
        return piece

    # -- the job --------------------------------------------------------------------------------------------------
    def run(self, df: DataFrame, key: str, text: str, schema: str) -> DataFrame:
        docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        size = text_size(docs)
        batches = max(1, math.ceil(size / BATCH_BYTES))
        self.anchor_buckets = max(1, math.ceil(size / ANCHOR_BUCKET_BYTES))
        self.segment_buckets = max(1, math.ceil(size / SEGMENT_BUCKET_BYTES))
        batched = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))).repartition(
            max(2, math.ceil(batches / 2)), "batch"
        )
        sent = batched.groupBy("batch").applyInArrow(
            lambda t: self.send_anchors(t), "bucket int, batch long, data binary, more binary"
        )
        shared = sent.groupBy("bucket").applyInArrow(lambda t: self.answer_anchors(t), ANSWER)
        segments = (
            batched.groupBy("batch")
            .cogroup(shared.groupBy("batch"))
            .applyInArrow(
                lambda a, b: self.send_segments(a, b),
                "bucket int, batch long, sizes binary, data binary, doc binary, start binary, times binary",
            )
        )
        answers = segments.groupBy("bucket").applyInArrow(lambda t: self.answer_segments(t), ANSWER)
        return (
            batched.groupBy("batch")
            .cogroup(shared.unionByName(answers).groupBy("batch"))
            .applyInArrow(lambda a, b: self.finish(a, b), schema)
        )


def groups_of_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run of equal neighbouring rows."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    first = np.flatnonzero(change)
    return first, np.diff(np.append(first, len(rows)))


def covered(starts: np.ndarray, window: int, total: int) -> np.ndarray:
    """Symbols that lie in one of the windows."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def byte_chunk(texts: list[bytes], gram: int) -> Chunk:
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = offsets(map(len, texts))
    return Chunk(byte_grams(data, gram), bounds, data)


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` bytes, eight at a time."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if gram % 8:
        return gram_hashes(data.astype(np.uint64) + np.uint64(1), gram)
    eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    out = np.zeros(n, np.uint64)
    for i in range(0, gram, 8):
        part = eight[i : i + n] * np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(32)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += part
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


__all__ = ["LAST_ID", "Chunk", "Router", "byte_chunk", "covered"]
