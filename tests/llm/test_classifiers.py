"""Quality and language classifiers: held-out accuracy, edges and what they must not look at."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import saved, table
from pyspark.sql import functions as F

from tidewater.llm import language, quality
from tidewater.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def remainder(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def test_quality_of_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (remainder(d, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    good = [got[r.doc_id].score for r in labels if r.quality]
    bad = [got[r.doc_id].score for r in labels if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_quality_edges(spark, tmp_path):
    rows = [(i, "good words here and there " * 3 if i % 2 else "JUNK!! JUNK!! JUNK!!") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "good words"), rows[0], rows[0], (103, "long " * 50_000), (104, "é\U0001f600\0")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (7777, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = QUERIES["op2_quality_classifier"](spark, saved(spark, tmp_path, rows, labels=labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = quality.train(docs, none, label="quality")
    assert {r.score for r in quality.scored(docs.withColumn("score", F.lit("old")), model).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_scores_are_sums_over_the_whole_text():
    """Scoring many texts at once equals scoring the averaged vectors of each."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["aa", "bé", "c!", "dd dd"]) for _ in range(r.randint(0, 40))).encode() for _ in range(30)]
    samples = [(*quality.counts(t, 1 << 10, (3, 4)), i % 2) for i, t in enumerate(texts)]
    model = quality.fit(samples, (0.5, 0.5), 1 << 10, (3, 4), epochs=2)
    scores = model.score(texts, model.table())
    for t, s in zip(texts, scores):
        assert model.score([t], model.table())[0] == pytest.approx(s, abs=1e-12)
        ids, share = quality.counts(t, 1 << 10, (3, 4))
        logits = (share / 4) @ model.vectors[ids] @ model.layer + model.bias
        assert s == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), abs=1e-5)


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (remainder(d, 4) == 2) and 0 <= r.score <= 1 for d, r in got.items())
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in docs if got[r.doc_id].held_out]) > 0.95


def test_language_edges(spark):
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (4, "the and of the"), (None, "der die und"), (5, "\U0001f600"), (6, "x" * 200_000), (7, "日本語")]
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the and of it is", "en"), ("der die und ist das", "de"), ("le la et les des", "fr"), (None, "es"), ("zz qq", "tlh")] * 5)]
    train += [(99, "no lang", None)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.families == ["germanic", "only tlh", "romance"] and model.members == [["de", "en"], ["tlh"], ["fr"]]
    docs = table(spark, rows).withColumn("lang_pred", F.lit("old"))
    got = {r.doc_id: r for r in language.predicted(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1, 2, 3, 5)] == ["und"] * 4 and got[1].score == 0
    assert got[4].lang_pred == "en" and got[None].lang_pred == "de" and got[7].lang_pred != "und"
    empty = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.predicted(docs, empty).collect()} == {"und"}
    assert language.predicted(docs.limit(0), model).count() == 0


def test_one_versus_one_with_three_related_languages():
    r = random.Random(5)
    words = {"sv": ["och", "att", "det"], "da": ["og", "af", "hvad"], "nl": ["het", "een", "niet"], "fr": ["les", "des", "une"]}
    texts = [(" ".join(r.choice(words[k]) for _ in range(6)), k) for k in words for _ in range(30)]
    model = language.fit([language.counts(t, 1 << 12) for t, _ in texts], [k for _, k in texts], 1 << 12)
    assert len(model.pairs) == 3 and model.families == ["germanic", "romance"]
    got, score = model.predict([t for t, _ in texts])
    assert [model.predict([t])[1][0] for t, _ in texts] == pytest.approx(score, abs=1e-12)
    assert np.mean([a == k for a, (_, k) in zip(got, texts)]) > 0.98 and score.min() >= 0


def test_sample_rows_keep_all_counts():
    """What the driver holds of a sample gives the ids and shares of the text, also beyond 255 and 65,535 times."""
    assert quality.SAMPLE_PER_CLASS == 1500
    texts = ["", "one", "a b " * 200, "x " * 70_000, "some words and more"]
    for buckets in (1 << 7, 1 << 10, 1 << 18):
        batch = pa.record_batch({"label": pa.array([0, 1, 0, 1, 1], pa.int32()), "text": pa.array(texts)})
        sent = pa.Table.from_batches(quality._counted(buckets, (3, 4))([batch]))
        samples = quality.Samples(list(zip(*(sent[c].to_pylist() for c in ("ids", "times", "label")))), buckets, (3, 4))
        for t, (ids, share, label), want in zip(texts, samples, [0, 1, 0, 1, 1]):
            expected = [np.unique(f[a[0] : e[0]], return_counts=True) for f, a, e in quality.features([t.encode()], buckets, (3, 4)) if e[0] > a[0]]
            assert label == want and ids.tolist() == [i for u, _ in expected for i in u.tolist()]
            assert share.tolist() == [x for _, n in expected for x in (n / n.sum()).astype(np.float32).tolist()]
