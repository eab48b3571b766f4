"""Near-duplicate components against brute force, and the parts they are made of."""

import random
from collections import Counter

import numpy as np
from helpers import corpus, table

from tidewater.llm.near_dedup import components, near_duplicates, shingle_sets, signatures

LAST = 2**63 - 1


def brute(rows, percent=85, k=5):
    sets = []
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = [LAST if d is None else d for d, _ in rows]
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((root(ids[i]), root(ids[j])))
                parent[y] = x
    out = []
    for d, s in zip(ids, sets):
        c = root(d)
        out.append((None if d == LAST else d, len(s), None if c == LAST else c, c == d))
    return Counter(out)


def families(seed, n=14):
    """Chains and stars of edited copies around the limit, besides unrelated texts."""
    r = random.Random(seed)
    rows, doc = [], 0
    for _ in range(n):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([8, 30, 120, 400]))]
        for _ in range(r.choice([1, 3, 12])):
            text = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.5:
                base = text
            rows.append((doc, " ".join(text)))
            doc += 1
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_components_match_brute_force(spark):
    for rows in (corpus(5), families(1), families(2)):
        got = near_duplicates(table(spark, rows)).collect()
        assert Counter(tuple(r) for r in got) == brute(rows)


def test_a_chain_in_one_bucket_loses_no_link(spark):
    """Few rows per band put unlike texts into the same buckets, so that most centres fail."""
    rows = families(3)
    got = near_duplicates(table(spark, rows), bands=40, rows=2).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (7, c)]
    got = near_duplicates(table(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    assert near_duplicates(table(spark, [(1, None), (2, "")])).filter("kept").count() == 2


def test_components_of_a_path(spark):
    r = random.Random(4)
    names = r.sample(range(10**6), 300)
    pairs = list(zip(names, names[1:]))
    r.shuffle(pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == 300 and {x.component for x in got} == {min(names)}


def test_signature_collisions_estimate_similarity():
    r = random.Random(6)
    for shared in (4, 40, 400):
        words = [f"w{r.randrange(10**9)}" for _ in range(shared * 10)]
        other = words[: shared * 9] + [f"v{i}" for i in range(shared)]
        a, b = shingle_sets([" ".join(words).encode(), " ".join(other).encode()], 1)
        sig = signatures([a, b], 2048)
        assert abs(np.mean(sig[0] == sig[1]) - 9 / 11) < 0.12
    single = signatures([a[:1]], 64)
    assert (single == a[0]).all()
