"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

``segments.Router`` brings the segments of equal windows into one bucket. There the distinct segments that have a
window with an equal hash elsewhere are laid end to end, suffix-sorted and transformed; intervals of the transform are extended backwards, breadth first, which
yields the boundaries between suffixes in order of their common prefix, 0, 1, 2, ... The expansion stops at the
minimum length: suffixes that no boundary separates then agree in that many bytes or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import offsets, ranges, span_hashes
from tidewater.llm.segments import Router, byte_chunk, covered

MIN_BYTES = 50
GRAM = 16


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Rotations sorted by at least their first ``depth`` symbols (prefix doubling).

    Up to 2^21 symbols a key and its place fit one 64-bit number, so that plain sorting does.
    """
    n = len(codes)
    place = np.arange(n, dtype=np.uint64)
    small = n <= 1 << 21
    symbol_bits = max(1, int(codes.max()).bit_length())
    length = max(1, 43 // symbol_bits)
    key = np.zeros(n, np.uint64)
    for i in range(length):
        key = (key << np.uint64(symbol_bits)) | np.roll(codes, -i).astype(np.uint64)
    while True:
        if small:
            packed = np.sort((key << np.uint64(21)) | place)
            order, key = (packed & np.uint64((1 << 21) - 1)).astype(np.int64), packed >> np.uint64(21)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        if length >= depth:
            return order
        step = np.concatenate([[False], key[1:] != key[:-1]])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step).astype(np.uint64)
        if int(rank.max()) == n - 1:
            return order
        key = (rank << np.uint64(21 if small else 32)) | np.roll(rank, -length)
        length *= 2


def common_prefix_edges(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at i where rotations order[i-1] and order[i] share fewer than ``depth`` symbols (and at both ends)."""
    n = len(codes)
    before = codes[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    sorted_symbols = before[by_symbol]
    back = np.empty(n, np.int32)
    back[by_symbol] = np.arange(n, dtype=np.int32)
    same = sorted_symbols[1:] == sorted_symbols[:-1]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    low, high = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(depth):
        size = high - low
        shift = np.cumsum(size, dtype=np.int64) - size
        at = np.repeat(low - shift, size) + np.arange(int(size.sum()))
        last = following[at] >= np.repeat(high, size)
        first = preceding[at] < np.repeat(low, size)
        ends, starts = np.sort(back[at[last]]) + 1, np.sort(back[at[first]])
        new = ~edge[ends]
        low, high = starts[new], ends[new]
        if not len(high):
            break
        edge[high] = True
    return edge


def first_owner(pieces: list[bytes], doc: np.ndarray, window: int) -> np.ndarray:
    """Smallest document of each window of each piece, pieces one after the other."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    starts = np.cumsum(size + 1) - size - 1
    present = np.zeros(256, bool)
    inside = np.ones(len(data), bool)
    inside[starts + size] = False
    present[data[inside]] = True
    code = np.cumsum(present)
    codes = np.where(inside, code[data], 0).astype(np.int16)
    order = suffix_order(codes, window)
    edge = common_prefix_edges(codes, order, window)
    owner = np.repeat(doc, size + 1)[order]
    first = np.flatnonzero(edge[:-1])
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(owner))))
    found = np.empty(len(owner), np.int64)
    found[order] = least
    count = size - window + 1
    before = np.cumsum(count) - count
    return found[np.repeat(starts - before, count) + np.arange(int(count.sum()))]


def repeated_windows(pieces: list[bytes], window: int) -> np.ndarray:
    """Pieces with a window whose hash occurs a second time among all pieces; the others share nothing."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    count = size - window + 1
    at = ranges(np.cumsum(size) - size, count)
    h = span_hashes(data, at, at + window)
    order = np.argsort(h)
    h = h[order]
    same = np.concatenate([[False], h[1:] == h[:-1], [False]])
    twice = np.empty(len(h), bool)
    twice[order] = same[1:] | same[:-1]
    return np.logical_or.reduceat(twice, np.cumsum(count) - count)


def owners(pieces: list[bytes], doc: np.ndarray, window: int) -> np.ndarray:
    """``first_owner`` of all pieces, which sorts only suffixes of those that share a window with another one."""
    count = np.fromiter(map(len, pieces), np.int64, len(pieces)) - window + 1
    out = np.repeat(doc, count)
    some = repeated_windows(pieces, window)
    if some.any():
        out[np.repeat(some, count)] = first_owner([pieces[i] for i in np.flatnonzero(some).tolist()], doc[some], window)
    return out


class _Bytes(Router):
    def __init__(self, window: int):
        gram = min(GRAM, window)

        def engine(pieces, doc, start, again):
            cut = offsets(len(x) - window + 1 for x in pieces)
            return owners(pieces, doc, window).reshape(-1, 1), cut

        super().__init__(lambda texts: byte_chunk(texts, gram), engine, _removed(window), window, gram, within=False)


def _removed(window: int):
    def apply(docs: pa.Table, texts, doc, chunks, marks) -> pa.Table:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for (a, b, chunk), starts in zip(chunks, marks):
            gone = covered(starts, window, len(chunk.data)) if len(starts) else None
            for i, (s, e) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist())):
                text = texts[a + i]
                n_bytes.append(e - s)
                cut = gone[s:e] if gone is not None else None
                if cut is None or not cut.any():
                    n_removed.append(0)
                    n_spans.append(0)
                else:
                    n_removed.append(int(cut.sum()))
                    n_spans.append(int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])))
                    text = chunk.data[s:e][~cut].tobytes()
                kept.append(text)
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return apply


def _digest(inner):
    def apply(*args) -> pa.Table:
        out = inner(*args)
        sha = [hashlib.sha256(x).hexdigest() for x in out["kept"].to_pylist()]
        return out.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sha, pa.string()))

    return apply


COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long"


def remove_repeated_bytes(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, digest: bool = False
) -> DataFrame:
    """Documents without each byte covered by a ``min_bytes`` string that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and ``kept`` (the remaining bytes, which may
    cut a character), or their SHA-256 with ``digest``. Strings are judged on the input. Null and empty texts have
    no bytes; a null id sorts after every number; rows with equal ids do not count as smaller than each other; a
    string that only repeats inside one document stays. Other columns of the input are not read.
    """
    router = _Bytes(min_bytes)
    if digest:
        router.apply = _digest(router.apply)
    return router.run(df, key, text, COLUMNS + (", kept_sha256 string" if digest else ", kept binary"))
