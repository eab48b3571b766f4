"""Importance resampling towards a target distribution, with weights from bit-sliced sums.

Documents are bags of hashed word n-grams. A bucket's gain says how much likelier it is in the target than in the
corpus. The weight of a document is the mean gain of its features, and the sum behind it is bit-sliced: its bucket
counts become planes of bits (one per binary digit, one bit per bucket), the signed gains become planes in two's
complement, and the sum is made of popcounts of ANDed planes times powers of two, without rounding.

Both corpora are counted in one pass each; a task sends one number per bucket. Scores are drawn without replacement
by Gumbel noise from a hash of the key, and ranked in ranges of equal row counts, so no task sorts the whole table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.common import LOWER, encoded, offsets, ranges, slices, stage, word_spans

BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 25
CHUNK_BYTES = 1 << 19
RANGE_ROWS = 1 << 20
LONGEST = 64

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def _one_byte_more(state: np.ndarray) -> np.ndarray:
    """CRC-32 register after a zero byte."""
    return STEP[state & np.uint32(0xFF)] ^ (state >> np.uint32(8))


STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    STEP = np.where(STEP & np.uint32(1), (STEP >> np.uint32(1)) ^ np.uint32(0xEDB88320), STEP >> np.uint32(1))

# AFTER[n, i, v]: what the value v in byte i of the register becomes after n zero bytes; the register is their XOR
AFTER = np.empty((LONGEST + 1, 4, 256), np.uint32)
AFTER[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
for _n in range(LONGEST):
    AFTER[_n + 1] = _one_byte_more(AFTER[_n])


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, all ranges one byte further at a time; long ones by zlib."""
    order = np.argsort(starts - ends, kind="stable")
    at, size = starts[order], (ends - starts)[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(min(LONGEST, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -i))
        state[:n] = _one_byte_more(state[:n] ^ data[at[:n] + i])
    for j in range(int(np.searchsorted(-size, -LONGEST))):
        state[j] = zlib.crc32(data[at[j] : at[j] + size[j]]) ^ 0xFFFFFFFF
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out


def joined_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """CRC-32 of word ``left``, one space and the next word, from the two words' own values."""
    spaced = ~_one_byte_more(~crcs[left] ^ np.uint32(0x20))
    size = (ends - starts)[left + 1]
    out = crcs[left + 1].copy()
    n = np.minimum(size, LONGEST)
    for i in range(4):
        out ^= AFTER[n, i, (spaced >> np.uint32(8 * i)) & np.uint32(0xFF)]
    for j in np.flatnonzero(size > LONGEST).tolist():
        w = left[j] + 1
        out[j] = zlib.crc32(data[starts[w] : ends[w]], int(spaced[j]))
    return out


def bucketed(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every feature (words, then pairs), and the words of each text."""
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, bounds = word_spans(data, offsets(map(len, texts)), WORD_BYTES)
    words = np.diff(bounds)
    crcs = word_crcs(data, starts, ends)
    left = ranges(bounds[:-1], np.maximum(words - 1, 0))
    pairs = joined_crcs(data, starts, ends, left, crcs)
    owner = np.repeat(np.arange(len(texts)), words)
    return (
        np.concatenate([owner, owner[left]]),
        np.concatenate([crcs, pairs]).astype(np.int64) % buckets,
        words,
    )


class Planes:
    """Gains as planes of bits in two's complement; ``total`` gives exact sums of gains over bags of buckets."""

    def __init__(self, gains: np.ndarray):
        self.buckets = len(gains)
        self.words = -(-self.buckets // 64)
        digits = int(np.abs(gains).max(initial=0)).bit_length() + 1  # the last one is the sign
        self.weights = [1 << b for b in range(digits - 1)] + [-(1 << (digits - 1))]
        self.planes = []
        for b in range(digits):
            bits = np.zeros(self.words * 64, np.uint8)
            bits[: self.buckets] = (gains >> b) & 1
            self.planes.append(np.packbits(bits, bitorder="little").view("<u8"))

    def total(self, owner: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        """Sum of the gains of each text's features; words of 64 buckets without a bit are left out."""
        out = np.zeros(texts, np.int64)
        cells, count = np.unique(owner * self.buckets + bucket, return_counts=True)
        digit = 0
        while len(cells):
            set_ = cells[(count >> digit) & 1 > 0]
            own, at = set_ // self.buckets, set_ % self.buckets
            place = own * self.words + (at >> 6)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
            if len(first):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                word = at[first] >> 6
                sums = np.zeros(len(first), np.int64)
                for weight, plane in zip(self.weights, self.planes):
                    sums += np.bitwise_count(bits & plane[word]).astype(np.int64) * weight
                np.add.at(out, own[first], sums << digit)
            digit += 1
            more = count >> digit > 0
            cells, count = cells[more], count[more]
        return out


def _counted(buckets: int):
    """Arrow mapper: features per bucket of all texts of a task."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in slices(texts, CHUNK_BYTES):
                total += np.bincount(bucketed(texts[a:b], buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(used), "n": pa.array(total[used])})

    return run


def bucket_counts(df: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Features per bucket over the whole table: one number per bucket comes to the driver."""
    parts = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(_counted(buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus) per bucket."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum() + n), float(target.sum() + n)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def _weighed(gains: np.ndarray):
    """Arrow mapper: key, words, features and weight of each text."""

    def run(batches):
        planes = Planes(gains)
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in slices(texts, CHUNK_BYTES):
                owner, bucket, words = bucketed(texts[a:b], len(gains))
                features = words + np.maximum(words - 1, 0)
                weight = planes.total(owner, bucket, b - a) // np.maximum(features, 1)
                yield pa.record_batch(
                    {
                        "key": batch.column("key").slice(a, b - a), "n_words": pa.array(words),
                        "n_features": pa.array(features), "weight": pa.array(weight),
                    }
                )

    return run


def gumbel(key: Column, salt: str) -> Column:
    """floor of a thousand times Gumbel noise from the key's hash; a null key hashes the salt alone."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, draw: int, total: int) -> DataFrame:
    """``scored`` with ``rank`` by falling score and rising key, null beyond ``draw``.

    Rows are dealt into ranges of that order; equal rows are dealt apart by their row number. Counts per range (one
    row each) give every range its first rank, and only ranges that hold drawn rows are numbered.
    """
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("_row")]
    pieces = max(1, math.ceil(total / RANGE_ROWS), int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(scored.repartitionByRange(pieces, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")
    firsts = sizes.select("_range", before.alias("_first"))
    placed = dealt.join(firsts, "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    drawn = placed.filter(F.col("_first") < draw).withColumn("rank", F.col("_first") + inside)
    rest = placed.filter(F.col("_first") >= draw).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(rest)


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, salt: str = "7:",
) -> DataFrame:
    """Per document: ``key``, n_features, weight, score and rank (1, 2, ... of the drawn ones; else null), all long.

    Words are runs of letters of any script and digits, A-Z in lower case; features are words and pairs of
    neighbours. ``percent`` of the documents with at least ``least_words`` words are drawn, the highest scores
    first, ties to the smaller key. Null and empty texts have no features and weight 0; a null key ranks after its
    equals and stays null; repeated rows are drawn each on its own; an empty target gives gains from the corpus
    alone; an empty table gives an empty result. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(df, text, buckets), bucket_counts(target, target_text, buckets))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    weighed = rows.mapInArrow(_weighed(gains), f"key {kind}, n_words long, n_features long, weight long")
    scored = stage(
        weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), salt)).withColumn("_row", F.monotonically_increasing_id()),
        "scored",
    )
    able = scored.filter(F.col("n_words") >= least_words)
    total = able.count()
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return ranked(able, percent * total // 100, total).select(*columns).unionByName(short.select(*columns))
