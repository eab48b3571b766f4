"""The pipeline against its stages in plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from helpers import corpus, saved, table
from pyspark.sql import functions as F
from test_near_dedup import brute
from test_text_operators import base_spans, contaminated

import __spark_entry__
from tidewater.llm.common import stage


def inputs(spark, tmp_path):
    rows = [(d, t) for d, t in dict((r[0], r) for r in corpus(21) if r[0] is not None).values()]
    rows += [(3000 + i, "BUY!! NOW!! CHEAP!! " * (5 + i)) for i in range(40)]
    rows += [(4000, "call +1 (504) 555-1234 or a.b@c.org now " + " ".join(f"u{i}" for i in range(30)))]
    bench = "the quick brown fox jumps over the lazy dog and then runs away again"
    rows += [(4001, bench + " indeed"), (4002, "some own words " + bench)]
    labels = [(d, 0 if d is not None and 3000 <= d < 4000 else 1, 0) for d, _ in rows]
    folder = saved(
        spark, tmp_path, rows,
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string"),
    )
    return rows, folder, bench


def test_stages_match_brute_force(spark, tmp_path):
    rows, folder, bench = inputs(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("found", F.col("doc_id") * 2).withColumn("score", F.lit("x"))
    names = docs.columns
    kept = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, folder), "test")
        assert docs.columns == names
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    first = dict(kept[0])
    assert not any(3000 <= d < 4000 for d in first) and len(first) > 0.9 * sum(not 3000 <= d < 4000 for d, _ in rows)
    want = {d for d, _, c, _ in brute(kept[0], 80) if d == c}
    assert Counter(kept[1]) == Counter({(d, t): 1 for d, t in kept[0] if d in want})
    bad = {d for d, *_, wrong in contaminated(kept[1], [(1, bench)]) if wrong}
    assert bad >= {4001, 4002} and Counter(kept[2]) == Counter((d, t) for d, t in kept[1] if d not in bad)
    masked = dict(kept[3])
    assert set(masked) == {d for d, _ in kept[2]} and masked[4000].startswith("call <phone> or <email> now")
    for d, t in kept[2]:
        if not base_spans(t) and "=" not in (t or ""):
            assert masked[d] == t
    assert {r.n_chars for r in docs.filter("doc_id = 4000").collect()} == {len(masked[4000])}
    packed = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        packed[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in row) <= 2048 and sorted(row)[0][0] == 0 for row in packed.values())


def test_near_duplicates_from_four_fifths_on(spark, tmp_path):
    """One changed word of 48 leaves 39 of 49 five-word shingles (0.796), one of 50 leaves 41 of 51 (0.804)."""
    rows = []
    for i, n in enumerate([48, 49, 50, 52, 56, 60, 64, 70] * 3):
        words = [f"w{i}x{k}" for k in range(n)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[: n // 2] + ["edited"] + words[n // 2 + 1 :])))
    got = corpus_pipeline.keep_one_of_each_group(spark, table(spark, rows), str(tmp_path)).collect()
    want = {d for d, _, c, _ in brute(rows, 80) if d == c}
    assert want < {d for d, _, c, _ in brute(rows) if d == c}
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_no_text_of_a_repeated_id_is_lost(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, c), (9, c), (9, b), (None, a)]
    got = corpus_pipeline.keep_one_of_each_group(spark, table(spark, rows), str(tmp_path)).collect()
    kept = Counter(r.text for r in got if r.doc_id is not None)
    assert kept == {a: 1, b: 1, c: 1} and {r.doc_id for r in got if r.text == a} == {1, None}


def test_run_and_registration(spark, tmp_path):
    _, folder, _ = inputs(spark, tmp_path)
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_nulls_and_repeated_rows(spark, tmp_path, name, step):
    _, folder, _ = inputs(spark, tmp_path)
    empty = table(spark, [])
    assert step(spark, empty, folder).count() == 0
    odd = table(spark, [(None, None), (None, "a word"), (1, None), (2, ""), (3, "same row"), (3, "same row"), (4, "word " * 30_000)])
    out = step(spark, odd.withColumn("_rest", F.lit(1)).withColumn("text_key", F.lit(None).cast("int")), folder)
    ids = Counter(r.doc_id for r in out.select("doc_id").distinct().collect())
    if name != "quality classifier":
        assert set(ids) == {None, 1, 2, 3, 4}
