"""Importance resampling against a plain loop with zlib, and its parts against random input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import corpus, table

from tidewater.llm.importance import LONGEST, Planes, bucketed, ranked, resample


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, target, percent=25, least=20, buckets=10_000):
    spot = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(spot, features(text)[1]))
    for text in target:
        t.update(map(spot, features(text)[1]))
    every, wanted = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * every / ((s[b] + 1) * wanted))) for b in range(buckets)]
    out = []
    for key, text in rows:
        words, found = features(text)
        weight = sum(gain[spot(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


TARGET = ["ab ac Ad edited bd", "null id null id null", "", None, "x y z " * 30]


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_matches_brute_force(spark):
    # equal rows share a rank at random, so ranks are compared apart from n_features where ids repeat
    rows = corpus(11, 150)
    docs = table(spark, rows).withColumnRenamed("source", "score").withColumnRenamed("lang", "_row")
    got = [tuple(r) for r in resample(docs, target(spark, TARGET)).collect()]
    assert Counter(got) == Counter(brute(rows, TARGET))
    drawn = sorted(r[4] for r in got if r[4])
    assert drawn == list(range(1, len(drawn) + 1))


def test_empty_tables(spark):
    assert resample(table(spark, []), target(spark, TARGET)).count() == 0
    rows = [(1, None), (2, ""), (3, "a b c " * 10), (4, "A b. C " * 9)]
    got = resample(table(spark, rows), target(spark, []), percent=50).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(rows, [], percent=50))


def test_buckets_are_crc32_of_the_bytes():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("aéß9Z") for _ in range(r.choice([1, 2, 9, LONGEST, 200]))) for _ in range(r.choice([0, 1, 2, 30]))) for _ in range(40)]
    owner, bucket, words = bucketed([t.encode() for t in texts], 10_000)
    for i, text in enumerate(texts):
        found = features(text)
        assert words[i] == len(found[0])
        assert Counter(bucket[owner == i].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in found[1])


def test_planes_give_exact_sums():
    r = np.random.default_rng(4)
    for buckets, bound in ((1, 1), (64, 3), (65, 100_000), (1000, 12_000)):
        gains = r.integers(-bound, bound + 1, buckets)
        owner = r.integers(0, 7, 5000)
        bucket = np.minimum(r.geometric(0.05, 5000) - 1, buckets - 1)
        want = np.zeros(9, np.int64)
        np.add.at(want, owner, gains[bucket])
        assert (Planes(gains).total(owner, bucket, 9) == want).all()
    assert Planes(np.zeros(10, np.int64)).total(np.array([0, 1]), np.array([3, 9]), 2).tolist() == [0, 0]


def test_one_repeated_row_is_dealt_apart(spark):
    """A third of all rows has one score and one key: ranges are still about equal, and ranks gapless."""
    rows = spark.range(900).selectExpr("IF(id < 300, 7, id) AS key", "IF(id < 300, 5, id % 50) AS score", "id AS _row")
    got = ranked(rows, 450, 900)
    assert sorted(r.rank for r in got.filter("rank IS NOT NULL").collect()) == list(range(1, 451))
    assert got.groupBy("_range").count().agg({"count": "max"}).first()[0] < 500
