"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character n-grams; a softmax layer
on that average gives the class. Vectors and layer are trained together by stochastic gradient descent in numpy on
a bounded sample of labelled rows. Executors turn sample documents into feature counts, so no text is collected.
For scoring, the layer is applied to every vector once; a whole text is then one table look-up per feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.common import (
    NOT_BLANK, encoded, fixed_sample, gram_hashes, offsets, slices, smallest_text, span_hashes, word_spans,
)

BUCKETS = 1 << 15
GRAMS = (3, 5)
DIM = 8
SAMPLE_PER_CLASS = 1500
EPOCHS = 6
RATE = 0.6
CHUNK_BYTES = 1 << 18


def features(
    texts: list[bytes], buckets: int, grams: tuple[int, ...]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature per occurrence, first and end of each text's): words, word pairs and byte n-grams in turn.

    Each kind has its own part of the table. A pair of equal words is the same feature whatever the word. Pairs and
    n-grams that reach from one text into the next belong to none.
    """
    bounds = offsets(map(len, texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    part = np.uint64(buckets // (2 + len(grams)))
    starts, ends, words = word_spans(data, bounds, NOT_BLANK)
    h = span_hashes(data, starts, ends)
    yield (h % part).astype(np.int32), words[:-1], words[1:]
    pair = gram_hashes(h, 2)
    if len(pair):
        pair[h[1:] == h[:-1]] = 0
    yield (pair % part + part).astype(np.int32), words[:-1], np.maximum(words[:-1], words[1:] - 1)
    for i, k in enumerate(grams):
        g = np.zeros(max(0, len(data) - k + 1), np.uint32)
        for j in range(k):
            g = g * np.uint32(0x01000193) + data[j : j + len(g)]
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x2C1B3C6D)
        g ^= g >> np.uint32(13)
        feature = (g % np.uint32(part) + np.uint32(int(part) * (2 + i))).astype(np.int32)
        yield feature, np.minimum(bounds[:-1], len(g)), np.minimum(np.maximum(bounds[:-1], bounds[1:] - k + 1), len(g))


def counts(text: bytes, buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and their shares; the shares of each kind add up to one."""
    ids, times = occurrences(text, buckets, grams)
    return ids, shares(ids, times, buckets, grams)


def occurrences(text: bytes, buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and how often each occurs."""
    ids, times = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for feature, first, end in features([text], buckets, grams):
        u, n = np.unique(feature[first[0] : max(first[0], end[0])], return_counts=True)
        ids.append(u)
        times.append(n)
    return np.concatenate(ids), np.concatenate(times)


def shares(ids: np.ndarray, times: np.ndarray, buckets: int, grams: tuple[int, ...]) -> np.ndarray:
    """What part of all features of its kind each feature makes up."""
    kind = ids // (buckets // (2 + len(grams)))
    return times / np.bincount(kind, times, 2 + len(grams))[kind]


class Samples(Sequence):
    """Feature, share and label of each sample document; ids and counts stay in the few bytes they were sent in."""

    def __init__(self, rows: list[tuple[bytes, bytes, int]], buckets: int, grams: tuple[int, ...]):
        self.rows, self.buckets, self.grams = rows, buckets, grams

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        ids, times, label = self.rows[i]
        feature = np.frombuffer(ids, np.min_scalar_type(self.buckets - 1)).astype(np.int32)
        n = np.frombuffer(times, f"<u{len(times) // len(feature)}") if len(feature) else np.zeros(0, np.uint8)
        return feature, shares(feature, n, self.buckets, self.grams).astype(np.float32), label


@dataclass
class Model:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    grams: tuple[int, ...]

    def table(self) -> np.ndarray:
        """Log-odds of class 1 that each feature adds."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)

    def score(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        total = np.full(len(texts), float(self.bias[1] - self.bias[0]))
        kinds = 2 + len(self.grams)
        for feature, first, end in features(texts, len(self.vectors), self.grams):
            value, n = table[feature], end - first
            full = np.flatnonzero(n > 0)
            # every other sum is one of what lies between two texts
            edges = np.stack([first[full], end[full]], axis=1).ravel()
            sums = np.add.reduceat(np.append(value, 0.0), edges)[::2] if len(full) else np.zeros(0)
            total[full] += sums / n[full] / kinds
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def fit(
    samples: Sequence[tuple[np.ndarray, np.ndarray, int]],
    priors: tuple[float, float],
    buckets: int = BUCKETS,
    grams: tuple[int, ...] = GRAMS,
    dim: int = DIM,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = 7,
) -> Model:
    """Stochastic gradient descent over single documents; each document weighs as its class does in the whole table.

    The step of the vectors is divided by the squared length of the document's shares, so that a text of few
    features does not move the average further than others do.
    """
    r = np.random.default_rng(seed)
    scale = 1.0 / dim
    vectors = r.uniform(-scale, scale, (buckets, dim)).astype(np.float32)
    layer = r.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.log(np.maximum(priors, 1e-6)).astype(np.float32)
    weight = _weights(samples, priors)
    kinds = 2 + len(grams)
    steps = max(1, epochs * len(samples))
    step = 0
    for _ in range(epochs):
        for i in r.permutation(len(samples)):
            feature, share, label = samples[i]
            lr = rate * (1 - step / steps)
            step += 1
            x = (share / kinds).astype(np.float32)
            hidden = x @ vectors[feature]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            p *= weight[label]
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            vectors[feature] -= lr * min(200.0, 0.15 / float(x @ x) if len(x) else 0.0) * np.outer(x, back)
    return Model(vectors, layer, bias, grams)


def _weights(samples, priors) -> np.ndarray:
    labels = [r[2] for r in samples.rows] if isinstance(samples, Samples) else [label for _, _, label in samples]
    have = np.bincount(labels, minlength=2) / max(1, len(samples))
    return np.where(have > 0, np.sqrt(np.array(priors) / np.maximum(have, 1e-9)), 0.0)


def _counted(buckets: int, grams: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), encoded(batch.column("text"))):
                ids, times = occurrences(text, buckets, grams)
                least = np.min_scalar_type(times.max()) if len(times) else np.uint8
                yield pa.record_batch(
                    {
                        "label": pa.array([label], pa.int32()),
                        "ids": pa.array([ids.astype(np.min_scalar_type(buckets - 1)).tobytes()], pa.binary()),
                        "times": pa.array([times.astype(least).tobytes()], pa.binary()),
                    }
                )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
    per_class: int = SAMPLE_PER_CLASS,
    buckets: int = BUCKETS,
    grams: tuple[int, ...] = GRAMS,
    **fitting,
) -> Model:
    """Fit on at most ``per_class`` documents of each class, those with the smallest hash of their key.

    ``labels`` holds keys and labels 0 or 1 (others are left out); keys without a document do not count. A null text
    is empty; of several texts of one key the one with the smallest hash counts. The driver gets at most
    2 * per_class rows of at most ``buckets`` ids (16 bits each up to 65,536 buckets) and counts (8 bits each where
    none is above 255). Without any labelled document every score is one half.
    """
    own = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    own = own.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi")
    total = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(total.values())
    if not n:
        return Model(np.zeros((buckets, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2), grams)
    chosen = fixed_sample(own, "_key", "label", per_class)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    got = (
        smallest_text(rows, ["_key", "label"])
        .select("label", "text")
        .repartition(24)
        .mapInArrow(_counted(buckets, grams), "label int, ids binary, times binary")
        .toArrow()
    )
    found = list(zip(*(got[c].to_pylist() for c in ("ids", "times", "label"))))
    del got
    found.sort(key=lambda x: (x[2], len(x[0]), x[0], x[1]))
    samples = Samples(found, buckets, grams)
    return fit(samples, (total.get(0, 0) / n, total.get(1, 0) / n), buckets, grams, **fitting)


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` and ``out`` (0 to 1): how likely the whole text is of class 1. A null or empty text has only the bias.

    A column of ``df`` with that name, in any case, is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast((model, model.table()))

    def run(batches):
        model, table = shared.value
        for batch in batches:
            texts = encoded(batch.column(text))
            parts = [model.score(texts[a:b], table) for a, b in slices(texts, CHUNK_BYTES)]
            columns = {c: batch.column(c) for c in batch.schema.names if c.lower() != out.lower()}
            columns[out] = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.record_batch(columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name.lower() != out.lower())
    return df.mapInArrow(run, f"{schema}, `{out}` double")


def held_out(key: Column, parts: int, part: int) -> Column:
    """True for the share of keys kept away from training, by CRC-32 of the key as text; a null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
