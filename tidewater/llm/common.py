"""What several operators share: staged tables, Arrow columns and hashes over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.session import scratch_path

WORD_MIX = np.uint64(0x9E3779B97F4A7C15)
LAST_ID = np.int64(2**63 - 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_size(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one number, which sets how many groups a job is cut into."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Row ids as int64; null sorts after every number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(int(LAST_ID)).to_numpy(zero_copy_only=False)


def slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each, so that arrays per byte stay small; no text is cut."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x) + 64
    if start < len(texts):
        yield start, len(texts)


def offsets(lengths: Iterable[int]) -> np.ndarray:
    out = np.cumsum(np.fromiter(lengths, np.int64))
    return np.concatenate([np.zeros(1, np.int64), out])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of [start, start + size) ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place where possible)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        base = 0xD1342543DE82EF95
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.full(size, base, np.uint64)) * np.uint64(pow(base, -1, 2**64))
            _powers["down"] = np.cumprod(np.full(size, pow(base, -1, 2**64), np.uint64)) * np.uint64(base)
    return _powers["up"], _powers["down"]


_letters = mixed(np.arange(1, 257, dtype=np.uint64) * WORD_MIX)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of ``data``, from one running sum over all bytes."""
    up, down = _power_table(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters[data] * up[: len(data)])])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * WORD_MIX)


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes in texts laid end to end: starts, ends and the number of words before each text."""
    inside = is_word[data] if len(data) else np.zeros(0, bool)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive symbol hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += h[i : i + n]
    return mixed(out)


NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def fixed_sample(keyed: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """(key, label): for each label the ``per_class`` keys with the smallest hash; labels must be few (collected).

    Only these two columns are read. The sample does not depend on how the table is laid out.
    """
    rows = (
        keyed.select(F.col(key).alias(key), F.col(label).alias(label))
        .filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .withColumn("_h", F.xxhash64(F.col(key).cast("string")))
    )
    chosen = rows.limit(0)
    for (value,) in sorted(tuple(r) for r in rows.select(label).distinct().collect()):
        chosen = chosen.unionByName(rows.filter(F.col(label) == value).orderBy("_h", key).limit(per_class))
    return chosen.select(key, label)


def smallest_text(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per key: of several texts the one with the smallest hash, so that the layout of a table decides nothing.

    The number of rows must be bounded by the caller.
    """
    others = F.struct(*[c for c in rows.columns if c not in key])
    least = F.min_by(others, F.struct(F.xxhash64(text), F.coalesce(F.col(text), F.lit(""))))
    return rows.groupBy(*key).agg(least.alias("_row")).select(*key, "_row.*")


def classes_of_one_id(signed: DataFrame, classes: DataFrame, same: list[str], node: str) -> DataFrame:
    """(a, b): the first class of an id with its other classes, for ids that come with unequal sets.

    ``signed`` has a row per document with ``id`` and the columns ``same`` that tell its class, ``classes`` has those
    and ``node``. Most tables have no such id; only those found are joined.
    """
    own = F.struct(*same)
    several = signed.groupBy("id").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low <> high")
    rows = signed.join(several.select("id"), "id", "left_semi").select("id", *same).distinct()
    nodes = rows.join(classes.select(*same, F.col(node).alias("_node")), same).select("id", "_node")
    first = nodes.groupBy("id").agg(F.min("_node").alias("a"))
    return nodes.join(first, "id").select("a", F.col("_node").alias("b")).distinct()


def list_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of one array, without an object per value."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no rows
        return []
    values, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
