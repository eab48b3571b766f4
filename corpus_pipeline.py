"""Documents to packed training sequences: five stages, each one of the dealt operators on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``docs``. Columns
of ``docs`` beyond doc_id and text only pass through, whatever their names. Null and empty texts are documents
without words; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import quality
from tidewater.llm.common import documents, stage
from tidewater.llm.decontaminate import find_contamination
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.packing import pack_documents
from tidewater.llm.personal_data import find_personal_data, masked
from tidewater.session import use_utc


# Pairs of this similarity or more are near-duplicates; one shares no band with probability (1 - 0.8^6)^41, 4e-6.
NEAR = {"percent": 80, "bands": 41, "rows": 6}


def carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one struct, so that operators cannot meet clashing names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns]
    )


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least one half).

    It learns from the labels of documents outside the held-out third.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.filter(~quality.held_out(F.col("doc_id"), 3, 1)), labels)
    return restored(quality.scored(carried(docs), model).filter("score >= 0.5"), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates (0.80 or more); of identical rows, one.

    Documents without words are in no group; a document without an id is kept. Where an id comes with several texts,
    each of them is a document: the one with the smallest hash goes by the id, the others come after all ids.
    """
    keyed = carried(docs).withColumn("_text_key", F.xxhash64("text")).withColumn("_key", F.col("doc_id"))
    names = keyed.filter("doc_id IS NOT NULL").select("doc_id", "_text_key").distinct()
    several = names.groupBy("doc_id").agg(F.min("_text_key").alias("_low"), F.max("_text_key").alias("_high"))
    others = names.join(several.filter("_low < _high"), "doc_id").filter("_text_key > _low")
    others = stage(others.select("doc_id", "_text_key", F.monotonically_increasing_id().alias("_n")), "several-texts")
    if not others.isEmpty():
        last = docs.agg(F.max("doc_id")).first()[0]
        later = others.select("doc_id", "_text_key", (F.col("_n") + last + 1).alias("_later"))
        keyed = keyed.join(later, ["doc_id", "_text_key"], "left").withColumn("_key", F.coalesce("_later", "_key")).drop("_later")
        keyed = stage(keyed, "named")
    copies = near_duplicates(keyed, key="_key", **NEAR).filter("NOT kept").select(F.col("doc_id").alias("_key")).distinct()
    once = keyed.join(copies, "_key", "left_anti").dropDuplicates(["_key", "_text_key"])
    return restored(once, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = find_contamination(carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restored(found.filter("NOT contaminated"), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every personal span replaced by its kind; n_chars (if there is one) follows the text."""
    found = find_personal_data(carried(docs), keep=["doc_id", "text", "_rest"])
    out = restored(found.withColumn("text", F.expr(masked("text", "found"))), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

# A trained classifier and a tokenizer decide on the rows: SQL cannot express that. tests/llm compares with a
# stage-by-stage brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(use_utc(spark), sf_dir)
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
