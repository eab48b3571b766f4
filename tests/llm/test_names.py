"""Columns whose names clash but for their case, and one key with several texts."""

import pytest
from helpers import table
from pyspark.sql import functions as F

from tidewater.llm import language, quality
from tidewater.llm.common import smallest_text
from tidewater.llm.personal_data import find_personal_data
from tidewater.llm.sharding import shard


def test_result_columns_replace_those_of_any_case(spark):
    docs = table(spark, [(1, "some words a.b@c.org"), (2, None)]).drop("lang", "source")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    got = quality.scored(docs.withColumn("Score", F.lit("old")), model)
    assert got.columns == ["doc_id", "text", "n_chars", "score"] and {r.score for r in got.collect()} == {0.5}
    model = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    got = language.predicted(docs.withColumns({"SCORE": F.lit("old"), "Lang_Pred": F.lit("old")}), model)
    assert got.columns == ["doc_id", "text", "n_chars", "lang_pred", "score"] and got.count() == 2
    got = find_personal_data(docs.withColumn("Found", F.lit("old")))
    assert got.columns == ["doc_id", "n_chars", "found"] and [len(r.found) for r in got.orderBy("doc_id").collect()] == [1, 0]


@pytest.mark.parametrize("name", ["shard", "Slot", "_row", "_block"])
def test_names_that_sharding_gives_are_refused(spark, name):
    df = spark.range(3)
    with pytest.raises(ValueError, match="another name"):
        shard(df.withColumnRenamed("id", name), name, 3, [])
    with pytest.raises(ValueError, match="another name"):
        shard(df, "id", 3, [F.lit(1).alias(name)])


def test_the_layout_decides_nothing_where_a_key_has_several_texts(spark):
    rows = [(1, "a"), (1, "b"), (1, None), (2, "c"), (2, "c"), (None, "d"), (None, "e")]
    df = spark.createDataFrame(rows, "k long, text string")
    want = {(r.k, r.text) for r in smallest_text(df, ["k"]).collect()}
    assert len(want) == 3
    for parts in (1, 2, 5):
        assert {(r.k, r.text) for r in smallest_text(df.repartition(parts, "text"), ["k"]).collect()} == want
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    twice = [(i, f"good words {i}" if i % 2 else f"JUNK!! {i}") for i in range(40)] + [(i, f"other text {i}") for i in range(40)]
    docs = spark.createDataFrame(twice, "doc_id long, text string")
    ask = spark.createDataFrame([(1, "good words"), (2, "other text"), (3, "JUNK!!")], "doc_id long, text string")
    scores = [
        [r.score for r in quality.scored(ask, quality.train(docs.repartition(n, "text"), labels)).orderBy("doc_id").collect()] for n in (1, 3)
    ]
    assert scores[0] == scores[1]
