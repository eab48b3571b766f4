"""Benchmark decontamination by winnowing.

Of every ``WINNOW`` consecutive k-gram hashes the smallest is a fingerprint, on the test side and on the training
side alike, so any shared span of k + WINNOW - 1 = 13 words has a common fingerprint. Common fingerprints are
joined and extended word by word to the maximal shared span; spans of a whole window are hits. Items of fewer
words are one window: their whole sequence is the only fingerprint (a window of one gram).

The test side is cut into blocks of a fixed size; each block is one broadcast and one pass over all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import (
    LOWER, encoded, gram_hashes, offsets, ranges, slices, span_hashes, stage, text_size, word_spans,
)

WINDOW_WORDS = 13
GRAM = 5
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20

WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[0x80:] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and the number of words before each text."""
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, bounds = word_spans(data, offsets(map(len, texts)), WORD)
    return span_hashes(data, starts, ends), bounds


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest gram of every w consecutive ones (the rightmost of equal ones)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(n)
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, w):
        less = grams[i : i + n] <= best
        best[less] = grams[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


class Index:
    """Fingerprints of some items, by the length of the window they belong to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = [name for name, _ in items]
        self.words, self.bounds = words_of([text for _, text in items])
        self.window = window
        size = np.diff(self.bounds)
        owner = np.repeat(np.arange(len(size)), size)
        self.owner = owner
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({min(int(n), window) for n in size if n}):
            gram, w = self.scale(length)
            at = winnowed(gram_hashes(self.words, gram), w)
            long_enough = size >= window if length == window else size == length
            at = at[long_enough[owner[at]] & (owner[np.minimum(at + gram, len(owner)) - 1] == owner[at])]
            key = gram_hashes(self.words, gram)[at]
            order = np.argsort(key, kind="stable")
            self.tables[length] = key[order], at[order]

    def scale(self, length: int) -> tuple[int, int]:
        gram = min(GRAM, self.window) if length == self.window else length
        return gram, length - gram + 1

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal shared spans of at least a window: first word, end, item."""
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found = []
        for length, (keys, places) in self.tables.items():
            gram, w = self.scale(length)
            grams = gram_hashes(words, gram)
            at = winnowed(grams, w)
            left = np.searchsorted(keys, grams[at], "left")
            size = np.searchsorted(keys, grams[at], "right") - left
            mine, theirs = np.repeat(at, size), places[ranges(left, size)]
            if not len(mine):
                continue
            low, high = bounds[:-1][text[mine]], bounds[1:][text[mine]]
            first, last = self.bounds[:-1][self.owner[theirs]], self.bounds[1:][self.owner[theirs]]
            back = self._grow(words, mine - 1, theirs - 1, np.minimum(mine - low, theirs - first), -1)
            ahead = self._grow(words, mine, theirs, np.minimum(high - mine, last - theirs), 1)
            keep = back + ahead >= length
            found.append(np.stack([mine - back, mine + ahead, self.owner[theirs]])[:, keep])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def _grow(self, words, mine, theirs, limit, step) -> np.ndarray:
        """How many words from here on agree, within the limits."""
        length = np.zeros(len(mine), np.int64)
        live = np.flatnonzero(limit > 0)
        k = 0
        while len(live):
            same = words[mine[live] + step * k] == self.words[theirs[live] + step * k]
            live = live[same]
            k += 1
            length[live] = k
            live = live[limit[live] > k]
        return length


def _pass(block, carried: bool):
    """Arrow mapper: adds the block's hit spans and items to those that came in."""

    def run(batches):
        index = block.value
        for batch in batches:
            every = encoded(batch.column("text"))
            for a, b in slices(every, CHUNK_BYTES):
                words, bounds = words_of(every[a:b])
                start, end, item = index.hits(words, bounds)
                text = np.searchsorted(bounds, start, side="right") - 1
                spans: list[list] = [[] for _ in range(b - a)]
                items: list[set] = [set() for _ in range(b - a)]
                if carried:
                    spans = [[(s["first"], s["end"]) for s in x] for x in batch.column("spans")[a:b].to_pylist()]
                    items = [set(x) for x in batch.column("items")[a:b].to_pylist()]
                base = bounds[text]
                for t, s, e, i in zip(text.tolist(), (start - base).tolist(), (end - base).tolist(), item.tolist()):
                    spans[t].append((s, e))
                    items[t].add(index.names[i])
                spans = [merged(x) for x in spans]
                part = batch.slice(a, b - a)
                columns = {c: part.column(c) for c in part.schema.names if c not in ("spans", "items", "n_words")}
                columns["n_words"] = pa.array(np.diff(bounds))
                columns["spans"] = pa.array(
                    [[{"first": s, "end": e} for s, e in x] for x in spans],
                    pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])),
                )
                columns["items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                yield pa.record_batch(columns)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``spans`` (shared word spans: first, end), ``items``, ``n_hit``, ``contaminated``.

    A word is hit if it lies in an occurrence of a window of some item: ``window`` consecutive words, or all words
    of a shorter item. Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words; items
    without words match nothing; a null item id is listed as "null"; repeated items count once. Words compare by
    64-bit hashes. Result columns replace columns of the same name in ``docs``. An empty ``items`` hits nothing.
    """
    spark = docs.sparkSession
    rows = items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(item_text).alias("body")
    ).filter("body IS NOT NULL")
    blocks = max(1, math.ceil(text_size(rows, "body") / block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)))
    names = ["n_words", "spans", "items", "n_hit", "contaminated"]
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    out = kept.withColumn("text", F.col(text)) if text != "text" else kept
    for k in range(blocks):
        block = rows.filter(F.col("block") == k).drop("block").collect()
        index = Index([(r.name, r.body.encode()) for r in block], window)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in names)
        out = out.mapInArrow(
            _pass(spark.sparkContext.broadcast(index), k > 0),
            schema + ", n_words long, spans array<struct<first:long,end:long>>, items array<string>",
        )
        if blocks > 1 and k + 1 < blocks:
            out = stage(out, "contamination")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    out = out.withColumn("n_hit", hit).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    return out if text == "text" or "text" in docs.columns else out.drop("text")

