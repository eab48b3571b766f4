"""Substring dedup with repeated-phrase automata.

``segments.Router`` brings the segments of equal windows of words into one bucket. There the recurring windows are
confirmed, compiled into an Aho-Corasick automaton (one per bucket: the automata are sharded by anchor), and all
segments of the bucket stream through it, which locates every occurrence; the earliest one stays.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import NOT_BLANK, gram_hashes, offsets, ranges, span_hashes, word_spans
from tidewater.llm.segments import Chunk, Router, covered

MIN_WORDS = 20
GRAM = 4
LETTERS = 0x10FFFF - 0x800  # characters but for zero and the surrogates


def word_chunk(texts: list[bytes], gram: int) -> Chunk:
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, bounds = word_spans(data, offsets(map(len, texts)), NOT_BLANK)
    return Chunk(gram_hashes(span_hashes(data, starts, ends), gram), bounds, data, starts, ends)


def _letters(number: np.ndarray) -> str:
    """One character per number, leaving out zero and the surrogates."""
    return (number + 1 + 0x800 * (number + 1 >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


def _spelled(word: np.ndarray, distinct: int) -> tuple[str, int]:
    """Words (numbers below ``distinct``) as text of one character each, or of two from halves of the alphabet."""
    if distinct <= LETTERS:
        return _letters(word), 1
    half = LETTERS // 2
    return _letters(np.stack([word // half, half + word % half], axis=1).reshape(-1)), 2


def first_places(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, again: np.ndarray, window: int):
    """Earliest (document, word) of each window of each piece.

    Windows whose hash recurs (in the pieces, or because a piece does) are confirmed as phrases; a piece that recurs as
    a whole, and shares no window with another one, is one long phrase. The distinct words of phrases become letters,
    all other words share one that is in no phrase.
    """
    words = np.fromiter((x.count(b" ") for x in pieces), np.int64, len(pieces)) + 1
    begin = np.cumsum(words) - words
    cut = offsets(words - window + 1)
    data = np.frombuffer(b" ".join(pieces), np.uint8)
    blank = np.flatnonzero(data == 0x20)
    h = span_hashes(data, np.concatenate([[0], blank + 1]), np.append(blank, len(data)))
    own = np.repeat(np.arange(len(pieces)), np.diff(cut))
    at = ranges(begin, words - window + 1)
    place = np.stack([doc[own], start[own] + at - begin[own]], axis=1)
    _, example, kind = np.unique(gram_hashes(h, window)[at], return_index=True, return_inverse=True)
    pieces_with = np.bincount(kind)
    recurring = (np.bincount(kind, weights=1 + again[own]) > 1)[kind]
    if not recurring.any():
        return place, cut
    in_phrase = covered(at[recurring], window, len(h))
    whole = again & np.logical_and.reduceat(pieces_with[kind] == 1, cut[:-1])
    known, number = np.unique(h[in_phrase], return_inverse=True)
    letter = np.zeros(len(h), np.int64)
    letter[in_phrase] = number + 1
    line, width = _spelled(letter, len(known) + 1)
    automaton = ahocorasick.Automaton()
    single = example[np.unique(kind[recurring & ~whole[own]])]
    total = 0  # a phrase takes a number for each of its windows
    for a, n in [*((at[i], window) for i in single.tolist()), *((begin[i], words[i]) for i in np.flatnonzero(whole).tolist())]:
        automaton.add_word(line[a * width : (a + n) * width], (total, n))
        total += n - window + 1
    automaton.make_automaton()
    which = np.full(len(own), -1, np.int64)
    for a, n, base in zip((begin * width).tolist(), (words * width).tolist(), cut.tolist()):
        for end, (phrase, size) in automaton.iter(line[a : a + n]):
            windows = size - window + 1
            i = base + (end + 1) // width - size
            which[i : i + windows] = range(phrase, phrase + windows) if windows > 1 else phrase
    hit = np.flatnonzero(which >= 0)
    order = hit[np.lexsort((place[hit, 1], place[hit, 0], which[hit]))]
    first = np.concatenate([[True], which[order][1:] != which[order][:-1]])
    earliest = place[order[first]]
    place[hit] = earliest[which[hit]]
    return place, cut


class _Words(Router):
    def __init__(self, window: int):
        gram = min(GRAM, window)
        super().__init__(
            lambda texts: word_chunk(texts, gram),
            lambda pieces, doc, start, again: first_places(pieces, doc, start, again, window),
            _removed(window),
            window,
            gram,
            within=True,
        )

    def canonical(self, piece: bytes) -> bytes:
        return b" ".join(piece.split())


def _removed(window: int):
    def apply(docs: pa.Table, texts, doc, chunks, marks) -> pa.Table:
        n_words, n_removed, kept = [], [], []
        for (a, b, chunk), starts in zip(chunks, marks):
            gone = covered(starts, window, int(chunk.bounds[-1])) if len(starts) else None
            for i, (s, e) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist())):
                words = texts[a + i].split()
                n_words.append(e - s)
                cut = gone[s:e] if gone is not None else None
                if cut is None or not cut.any():
                    n_removed.append(0)
                else:
                    n_removed.append(int(cut.sum()))
                    words = [words[j] for j in np.flatnonzero(~cut).tolist()]
                kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
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


COLUMNS = "doc_id long, n_words long, n_removed long"


def remove_repeated_words(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, digest: bool = False
) -> DataFrame:
    """Documents without each word covered by a window of ``min_words`` words whose sequence also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start. Returns doc_id, n_words, n_removed and
    ``kept`` (remaining words joined by one space, UTF-8 bytes), or its SHA-256 with ``digest``. Windows are judged
    on the input. Null and empty texts have no words; a null id sorts after every number; rows with equal ids are
    not earlier than each other unless their start is. Other columns of the input are not read.
    """
    router = _Words(min_words)
    if digest:
        router.apply = _digest(router.apply)
    return router.run(df, key, text, COLUMNS + (", kept_sha256 string" if digest else ", kept binary"))
