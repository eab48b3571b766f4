"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are the lower-cased words of a text, weights their counts. For sample k and a term of weight w, hashes of
(term, k) give r and c from Gamma(2, 1) and b from [0, 1); then

    t = floor(ln w / r + b)      y = exp(r (t - b))      a = c / (y exp(r))

and the sample is the pair (term, t) with the smallest a. Two texts agree in a sample with a probability equal to
their generalised Jaccard similarity, the sum of the smaller over the sum of the larger weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.common import LAST_ID, stage, text_size

SAMPLES = 32
PART_BYTES = 6 << 20
_BITS = 12
_SCALE = 1 << 24


def _uniform(hash_: str, i: int) -> str:
    return f"(((shiftright({hash_}, {_BITS * i}) & {(1 << _BITS) - 1}) + 0.5D) / {1 << _BITS}D)"


def _sample(k: int) -> Column:
    """One sample of all terms of a text: the smallest (ln a, hash of term and t), as one long."""
    h = f"xxhash64(term, {k})"
    r = f"(-ln({_uniform(h, 0)} * {_uniform(h, 1)}))"
    c = f"(-ln({_uniform(h, 2)} * {_uniform(h, 3)}))"
    b = _uniform(h, 4)
    t = f"floor(ln_weight / {r} + {b})"
    log_a = f"(ln({c}) - {r} * ({t} - {b}) - {r})"
    pair = f"CAST({log_a} * {_SCALE} AS bigint) * 4294967296 + (xxhash64(term, {t}) & 4294967295)"
    return F.expr(f"min(CASE WHEN term IS NOT NULL THEN {pair} END)")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` (array<long>, one number per sample) per distinct key.

    Rows should already be partitioned by some of the keys: then nothing but the result is moved. A text without
    words gets the sample -1 throughout, so empty texts are alike and nothing else is like them.
    """
    words = texts.select(*keys, F.explode_outer(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")).alias("word"))
    weighted = (
        words.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.ln(F.count("*").cast("double")).alias("ln_weight"))
    )
    names = [f"_s{k}" for k in range(samples)]
    smallest = weighted.groupBy(*keys).agg(*[_sample(k).alias(n) for k, n in enumerate(names)])
    one = [F.coalesce(F.col(n).bitwiseAND(F.lit(4294967295)), F.lit(-1)) for n in names]
    return smallest.select(*keys, F.array(*one).alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples, 0 to 1: estimates the generalised Jaccard similarity."""
    same = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e))")
    return same / F.size(a)


def written(fingerprint: str) -> Column:
    return F.expr(f"array_join(transform({fingerprint}, x -> CASE WHEN x < 0 THEN '-' ELSE lower(hex(x)) END), ' ')")


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _text_key, _n, _next_id, _next_key): every document's successor in descending order of its key.

    The last one's successor is the first. Documents are dealt by range; each range finds successors on its own and
    the first document of the following range closes it, so no task sees the whole order. A null key comes first;
    rows with equal keys follow the hash of their text; identical rows count as one.
    """
    rows = (
        df.select(
            F.coalesce(F.col(key).cast("long"), F.lit(int(LAST_ID))).alias("_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_key"),
            F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_n"),
        )
        .distinct()
        .repartitionByRange(F.desc("_id"), F.desc("_text_key"))
    )
    ranged = stage(rows.withColumn("_range", F.spark_partition_id()), "order")
    here = F.struct("_id", "_text_key")
    inside = Window.partitionBy("_range").orderBy(F.desc("_id"), F.desc("_text_key"))
    firsts = ranged.groupBy("_range").agg(F.max(here).alias("first"))
    # one row per range: their order is short
    around = firsts.select(
        "_range",
        F.coalesce(
            F.lead("first").over(Window.orderBy("_range")),
            F.first("first").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("after"),
    )
    following = F.coalesce(F.lead(here).over(inside), F.col("after"))
    return ranged.join(around, "_range").select(
        "_id", "_text_key", "_n", following.getField("_id").alias("_next_id"), following.getField("_text_key").alias("_next_key")
    )


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document
    in descending order of the key (see ``with_next``). Null texts are empty. Columns: the key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (arrays), near_edited, near_next. Identical rows each give a row;
    other columns are not read; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own_key = ["_id", "_text_key"]
    order = stage(with_next(df, key, text), "successors")
    parts = max(2, math.ceil(text_size(df, text) / PART_BYTES))
    # texts move once, to the partition of their key; heads of texts move to the document that asks for them
    dealt = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(int(LAST_ID))).alias("_id"),
        F.xxhash64(body).alias("_text_key"),
        body.alias("text"),
    ).repartition(parts, *own_key)
    own = dealt.groupBy(*own_key).agg(F.any_value("text").alias("text"), F.count("*").alias("_rows"))
    asked = order.select(
        F.col("_next_id").alias("_id"), F.col("_next_key").alias("_text_key"), F.col("_id").alias("_to_id"),
        F.col("_text_key").alias("_to_key"), F.expr("_n div 2").cast("int").alias("_want"),
    )
    heads = (
        own.join(asked.repartition(parts, *own_key), own_key)
        .select(F.col("_to_id").alias("_id"), F.col("_to_key").alias("_text_key"), F.expr("left(text, _want)").alias("head"))
        .repartition(parts, *own_key)
    )
    edited = own.join(heads, own_key).withColumn("_n", F.length("text"))
    edited = edited.withColumn("edited", F.expr("concat(left(text, _n - _n div 2), head)"))
    facts = edited.select(
        *own_key, "_rows", F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    versions = edited.select(*own_key, F.expr("stack(2, 0, text, 1, edited) AS (_version, _body)"))
    printed = fingerprints(versions, [*own_key, "_version"], "_body", samples)
    both = stage(
        printed.groupBy(*own_key)
        .agg(
            F.max(F.when(F.col("_version") == 0, F.col("fingerprint"))).alias("fingerprint"),
            F.max(F.when(F.col("_version") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
        )
        .join(facts, own_key),
        "fingerprints",
    )
    after = both.select(F.col("_id").alias("_next_id"), F.col("_text_key").alias("_next_key"), F.col("fingerprint").alias("next_fingerprint"))
    return (
        both.join(order.select(*own_key, "_next_id", "_next_key"), own_key)
        .join(after, ["_next_id", "_next_key"])
        .withColumn("near_edited", likeness("fingerprint", "edited_fingerprint"))
        .withColumn("near_next", likeness("fingerprint", "next_fingerprint"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
        .select(
            F.when(F.col("_id") != F.lit(int(LAST_ID)), F.col("_id")).alias(key),
            "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        )
    )
