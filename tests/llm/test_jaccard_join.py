"""The n-gram Jaccard join against brute force over all pairs, and the promise of its prefixes."""

import random
from collections import Counter

import numpy as np
from helpers import corpus, table
from test_near_dedup import brute, families

from tidewater.llm import jaccard_join
from tidewater.llm.jaccard_join import jaccard_components, prefixes


def expected(rows, percent=90, k=3):
    return Counter({r[:3]: n for r, n in brute(rows, percent, k).items()})


def mosaics(seed, n=90):
    """Texts put together from few passages: many share a lot, few are alike; one line is in all of them."""
    r = random.Random(seed)
    parts = [" ".join(f"p{i}w{j}" for j in range(r.choice([12, 25]))) for i in range(9)]
    rows = []
    for i in range(n):
        own = [r.choice(parts) for _ in range(6)]
        rows.append((i, " ".join(["the common line of all", *own, *([f"own{r.randrange(9)}"] if r.random() < 0.5 else [])])))
    return rows


def test_components_match_brute_force(spark):
    for rows in (corpus(7), families(5) + [(5000 + i, t) for i, t in mosaics(1, 40)]):
        got = jaccard_components(table(spark, rows).withColumnRenamed("lang", "Node")).collect()
        assert Counter(tuple(r) for r in got) == expected(rows)


def test_split_groups_lose_no_link(spark, monkeypatch):
    """Groups of more than two members are split by the second and third order; no star settles anything first."""
    monkeypatch.setattr(jaccard_join, "SPLIT_ABOVE", 2)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    rows = mosaics(2) + [(500 + i, t) for i, t in families(6, 6)]
    got = jaccard_components(table(spark, rows), percent=70).collect()
    assert Counter(tuple(r) for r in got) == expected(rows, 70)


def test_an_id_with_several_texts_is_one_document(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "v w x y z"), (9, "v w x y z"), (7, "q r s")]
    got = jaccard_components(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]


def test_empty_table(spark):
    assert jaccard_components(table(spark, [])).count() == 0
    got = jaccard_components(table(spark, [(2, None), (1, ""), (None, "a"), (3, "A"), (4, "a")])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(2, 0, 2), (1, 0, 1), (None, 1, 3), (3, 1, 3), (4, 1, 3)], key=repr)


def test_similar_sets_share_a_prefix_token_under_every_order():
    r = np.random.default_rng(8)
    for _ in range(400):
        n = int(r.integers(1, 60))
        u = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, len(u) // 8) + 1))
        v = np.unique(np.concatenate([u[drop:], r.integers(0, 2**63, int(r.integers(0, 4))).astype(np.uint64)]))
        shared = len(np.intersect1d(u, v))
        if shared and 100 * shared >= 80 * (len(u) + len(v) - shared):
            digit = {int(t): int(r.integers(1, 9)) for t in np.intersect1d(u, v)}
            digits = lambda s: np.array([digit.get(int(t), 0) for t in s], np.uint8)
            for a, b in zip(prefixes(u, digits(u), 80, 4), prefixes(v, digits(v), 80, 4)):
                assert len(np.intersect1d(a, b))


def test_one_repeated_row_is_dealt_over_batches(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BATCH_BYTES", 2_000)
    rows = [(7, "one row again and again")] * 150 + families(4, 5)
    got = jaccard_components(table(spark, [(d + 100 if d != 7 else 7, t) for d, t in rows])).collect()
    assert Counter(tuple(r) for r in got) == expected([(d + 100 if d != 7 else 7, t) for d, t in rows])
