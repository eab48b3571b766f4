"""The router of windows: a common line with different neighbours is spread, and nothing is lost."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import table
from test_repeats import spoiled_bytes, spoiled_words

from tidewater.llm import phrase_dedup, segments, suffix_dedup


def rounds(router, rows, batches):
    """Bytes of segments that each bucket gets."""
    router.anchor_buckets, router.segment_buckets = 3, 24
    sent = []
    for b in range(batches):
        own = rows[b::batches]
        sent.append(
            pa.table({"doc_id": pa.array([d for d, _ in own], pa.int64()), "text": [t for _, t in own], "batch": pa.array([b] * len(own), pa.int64())})
        )
    anchors = pa.concat_tables([router.send_anchors(t) for t in sent])
    answers = [
        router.answer_anchors(anchors.filter(pa.array(anchors["bucket"].to_numpy() == b))) for b in range(3)
    ]
    replies = pa.concat_tables(answers)
    out = Counter({b: 0 for b in range(24)})
    for t in sent:
        mine = replies.filter(pa.array(replies["batch"].to_numpy() == t["batch"][0].as_py()))
        for b, data in zip(*(router.send_segments(t, mine)[c].to_pylist() for c in ("bucket", "data"))):
            out[b] += len(data)
    return out


def random_texts(n, line, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    return [(i, " ".join([*(word() for _ in range(21)), line, *(word() for _ in range(21))])) for i in range(n)]


@pytest.mark.parametrize("router, line", [
    (suffix_dedup._Bytes(50), "the same thirty-two letters here"),
    (phrase_dedup._Words(20), "one line of all these texts that is shorter than any of the windows here"),
])
def test_a_common_line_is_spread(router, line):
    size = rounds(router, random_texts(2000, line), 4)
    assert max(size.values()) <= 3 * np.median(list(size.values()))


def test_crowded_anchors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(segments, "CROWD", 3)
    r = random.Random(2)
    rows = random_texts(60, "a common line that all of these texts have in the middle of them", 3)
    rows = [(d, t if r.random() < 0.7 else r.choice(rows)[1].replace("common", r.choice(["common", "rare"]))) for d, t in rows]
    rows += [(100 + i, "one text  that\tis here " + "again and again " * 9) for i in range(4)]
    got = suffix_dedup.remove_repeated_bytes(table(spark, rows), digest=True).collect()
    assert Counter(tuple(x) for x in got) == spoiled_bytes(rows, 50)
    got = phrase_dedup.remove_repeated_words(table(spark, rows), digest=True).collect()
    assert Counter(tuple(x) for x in got) == spoiled_words(rows, 20)


def test_more_words_than_characters(monkeypatch):
    """A bucket with more distinct words than letters spells each with two."""
    r = random.Random(4)
    pieces = [" ".join(f"w{r.randrange(90)}" for _ in range(9)).encode() for _ in range(60)]
    pieces += [p + b" tail" for p in pieces[:20]]
    doc, start, again = np.arange(len(pieces))[::-1].copy(), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool)
    again[5] = True
    want = phrase_dedup.first_places(pieces, doc, start, again, 4)
    monkeypatch.setattr(phrase_dedup, "LETTERS", 40)
    got = phrase_dedup.first_places(pieces, doc, start, again, 4)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_a_million_words_in_a_bucket():
    words = [b"%x" % i for i in range(1_200_000)]
    pieces = [b" ".join(words[i : i + 30_000]) for i in range(0, len(words), 30_000)]
    pieces += [pieces[7][: len(pieces[7]) // 2].rsplit(b" ", 1)[0]]
    again = np.ones(len(pieces), bool)
    place, cut = phrase_dedup.first_places(pieces, np.arange(len(pieces)), np.zeros(len(pieces), np.int64), again, 20)
    last = place[cut[-2] :]
    assert (last[:, 0] == 7).all() and (last[:, 1] == np.arange(len(last))).all()
