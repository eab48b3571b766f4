"""Repeated byte strings and repeated word windows against brute force."""

import re
from collections import Counter

import pytest
from helpers import corpus, sha, table

from tidewater.llm import segments
from tidewater.llm.phrase_dedup import remove_repeated_words
from tidewater.llm.suffix_dedup import remove_repeated_bytes

LAST = 2**63 - 1


def spoiled_bytes(rows, window):
    rows = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in rows:
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if first[t[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((None if d == LAST else d, len(t), sum(gone), spans, sha(kept)))
    return Counter(out)


def spoiled_words(rows, window):
    rows = [(LAST if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, t in rows:
        for i in range(len(t) - window + 1):
            w = tuple(t[i : i + window])
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if first[tuple(t[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out.append((None if d == LAST else d, len(t), sum(gone), sha(b" ".join(w for w, g in zip(t, gone) if not g))))
    return Counter(out)


@pytest.fixture(params=["default", "many small groups"])
def sizes(request, monkeypatch):
    if request.param != "default":
        monkeypatch.setattr(segments, "BATCH_BYTES", 4000)
        monkeypatch.setattr(segments, "ANCHOR_BUCKET_BYTES", 9000)
        monkeypatch.setattr(segments, "SEGMENT_BUCKET_BYTES", 5000)
        monkeypatch.setattr(segments, "CHUNK_BYTES", 700)


@pytest.mark.parametrize("window", [50, 20, 3, 1])
def test_bytes_match_brute_force(spark, sizes, window):
    rows = corpus(2)
    got = remove_repeated_bytes(table(spark, rows), min_bytes=window, digest=True).collect()
    assert Counter(tuple(r) for r in got) == spoiled_bytes(rows, window)


@pytest.mark.parametrize("window", [20, 6, 2, 1])
def test_words_match_brute_force(spark, sizes, window):
    rows = corpus(3)
    got = remove_repeated_words(table(spark, rows), min_words=window, digest=True).collect()
    assert Counter(tuple(r) for r in got) == spoiled_words(rows, window)


def test_kept_text_and_empty_table(spark):
    text = "one two three four five six " * 3
    got = {r.doc_id: r for r in remove_repeated_words(table(spark, [(1, text), (2, "zero " + text)]), min_words=6).collect()}
    assert bytes(got[1].kept) == b"one two three four five six" and bytes(got[2].kept) == b"zero"
    assert remove_repeated_words(table(spark, [])).count() == 0
    assert remove_repeated_bytes(table(spark, [])).count() == 0
