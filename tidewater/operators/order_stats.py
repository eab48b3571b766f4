"""Exact order statistics per group without bringing a group, or a bracket of it, into one task.

``sketched_summary`` is for few groups, and for groups that are made of others: one pass makes a mergeable sketch per
finest group, the sketches put a narrow bracket around every wanted rank, and a second pass counts exactly: values
inside a bracket one by one, all others as one number per gap between brackets.

``exact_summary`` is for any number of groups of any size. Groups of up to ``CROWDED_ROWS`` are shuffled into partitions
whose number follows the rows, and each is sorted there.

Values of larger groups are never moved. They are counted per cell: 64 cells an octave, then 256 equal steps of a cell
that is still too full. Sizes of cells, in order, give the cell and the place of every wanted rank; only values of such
cells are looked at again, at last counted one by one. So what is shuffled are counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.numeric import round_half_even
from tidewater.session import RANGE_ROWS, ranges_for, written

SKETCH_K = 8192  # a rank is right to about 0.06 per cent
SLACK = 0.002
LOOKED_AT_WHOLE = 2_000
RANKS = ("lower", "upper", "p95")
CROWDED_ROWS = RANGE_ROWS // 4
CELLS_AN_OCTAVE = 64
STEPS = 256
LARGEST = 1.7976931348623157e308
DIRECT_PARTITIONS = 200  # spark.shuffle.sort.bypassMergeThreshold


def nearest_rank_index(n: Column, p: float) -> Column:
    """Zero-based index of the nearest-rank percentile: round-half-even of p * (n - 1)."""
    return round_half_even(F.lit(p) * (n - 1))


def exact_summary(df: DataFrame, group: list[str], value: str, p95: float = 0.95) -> DataFrame:
    """n, mean, sample deviation (0 below two values), median, min, max and nearest-rank p95 per group.

    Null values are left out. Only the group columns are keys; sums of floats never are.
    """
    values = df.select(*group, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = values.count()
    crowded, held = None, 0
    if n > CROWDED_ROWS:
        sizes = values.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
        crowded = written(sizes.filter(F.col("size") > CROWDED_ROWS), "crowded")
        held = crowded.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not held:
        return _sorted_summary(values, group, n, p95)
    among = _same("x", "c", group)
    large = _counted_summary(values.alias("x").join(crowded.alias("c"), among, "left_semi"), group, held, p95)
    if held == n:
        return large
    others = values.alias("x").join(crowded.alias("c"), among, "left_anti")
    return large.unionByName(_sorted_summary(others, group, n - held, p95))


def _wanted_ranks(n: Column, p95: float) -> dict[str, Column]:
    ranks = (F.floor((n - 1) / 2), F.ceil((n - 1) / 2), nearest_rank_index(n, p95))
    return {name: rank.cast("bigint") for name, rank in zip(RANKS, ranks)}


def _dealt(values: DataFrame, group: list[str], n: int) -> DataFrame:
    """``n`` values in partitions of about ``RANGE_ROWS``, each group in one.

    To up to ``DIRECT_PARTITIONS`` a task writes rows as they come; for more it holds and sorts all rows of its input,
    whose number no one bounds. Beyond that values are therefore shuffled twice, the first time to that many.
    """
    parts = max(min(ranges_for(values.sparkSession, n), DIRECT_PARTITIONS), math.ceil(n / RANGE_ROWS))
    if parts > DIRECT_PARTITIONS:  # the filter, always true, is there as Spark drops a repartition right below another
        values = values.repartition(DIRECT_PARTITIONS, *group).filter(F.spark_partition_id() >= 0)
    return values.repartition(parts, *group)


def _sorted_summary(values: DataFrame, group: list[str], n: int, p95: float) -> DataFrame:
    """``exact_summary`` of groups that one task can sort; ``n`` values in all."""
    by_value = W.partitionBy(*group).orderBy("v")
    placed = _dealt(values, group, n).select(
        *group, "v", (F.row_number().over(by_value) - 1).alias("at"),
        F.count(F.lit(1)).over(by_value.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("size"),
    )
    at_rank = {
        name: F.max(F.when(F.col("at") == rank, F.col("v"))) for name, rank in _wanted_ranks(F.col("size"), p95).items()
    }
    size = F.count(F.lit(1))
    return placed.groupBy(*group).agg(
        size.alias("n"),
        (F.sum("v") / size).alias("mean"),
        F.when(size > 1, F.stddev_samp("v")).otherwise(0.0).alias("std"),
        ((at_rank["lower"] + at_rank["upper"]) / 2).alias("median"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        at_rank["p95"].alias("p95"),
    )


def _finite(v: Column) -> Column:
    """Infinities and NaN, which is above all numbers, as the largest numbers of their sign."""
    return F.greatest(F.lit(-LARGEST), F.least(v, F.lit(LARGEST)))


def _cell(v: Column) -> Column:
    """A number that never falls while v rises: 64 of them for every doubling."""
    octave = F.floor(F.log2(F.abs(_finite(v))) * CELLS_AN_OCTAVE) + 1100 * CELLS_AN_OCTAVE
    return F.when(v == 0, F.lit(0)).when(v > 0, octave).otherwise(-octave)


def _counted_summary(values: DataFrame, group: list[str], n: int, p95: float) -> DataFrame:
    """``exact_summary`` of a few large groups, ``n`` values in all, without moving values."""
    v = F.col("v")
    parts = values.groupBy(*group, _cell(v).alias("cell")).agg(
        F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.sum("v").alias("total"), F.avg("v").alias("part_mean"), F.var_pop("v").alias("part_variance"),
    )
    parts = written(parts, "cells")
    whole = parts.groupBy(*group).agg(
        F.sum("size").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("total").alias("total")
    )
    mean = F.col("w.total") / F.col("w.n")
    spread = parts.alias("p").join(whole.alias("w"), _same("p", "w", group))
    moments = spread.groupBy(*[F.col(f"p.{g}").alias(g) for g in group]).agg(
        F.sum(F.col("p.size") * (F.col("p.part_variance") + (F.col("p.part_mean") - mean) ** 2)).alias("squares")
    )
    ranks = _ranks(values, parts, whole, group, n, p95)
    joined = whole.alias("w").join(moments.alias("m"), _same("w", "m", group)).join(ranks.alias("r"), _same("w", "r", group))
    n_ = F.col("w.n")
    return joined.select(
        *[F.col(f"w.{g}").alias(g) for g in group],
        n_.alias("n"),
        mean.alias("mean"),
        F.when(n_ > 1, F.sqrt(F.col("m.squares") / (n_ - 1))).otherwise(0.0).alias("std"),
        ((F.col("r.lower") + F.col("r.upper")) / 2).alias("median"),
        F.col("w.min").alias("min"),
        F.col("w.max").alias("max"),
        F.col("r.p95").alias("p95"),
    )


def _ranks(values: DataFrame, parts: DataFrame, whole: DataFrame, group: list[str], n: int, p95: float) -> DataFrame:
    """Per group the values at its wanted ranks: cells that hold one are divided until each holds a single value."""
    asked = whole.select(
        *group, F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), rank.alias("place")) for name, rank in _wanted_ranks(F.col("n"), p95).items()
        ])).alias("r"),
    ).select(*group, "r.name", "r.place")
    wanted = written(_placed(asked, parts, group, []), "wanted")
    before = None
    while True:
        open_ = wanted.filter(F.col("low") < F.col("high"))
        cells = open_.select(*group, F.col("low").alias("from"), F.col("high").alias("to"), "size").distinct()
        rows, fullest = cells.agg(F.sum("size"), F.max("size")).first()
        if not rows:
            return wanted.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in RANKS])
        divide = (rows > max(RANGE_ROWS, n // 16) or fullest > RANGE_ROWS) and (before is None or rows < before)
        before = rows
        v, low, high = F.col("x.v"), F.col("c.from"), F.col("c.to")
        step = F.floor((_finite(v) - _finite(low)) / F.nullif(_finite(high) - _finite(low), F.lit(0.0)) * STEPS)
        inside = values.alias("x").join(cells.alias("c"), [*_same("x", "c", group), v.between(low, high)])
        counted = inside.groupBy(
            *[F.col(f"x.{g}").alias(g) for g in group], low.alias("from"), (step if divide else v).alias("cell")
        ).agg(F.count(F.lit(1)).alias("size"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
        asked = open_.select(*group, F.col("low").alias("from"), "name", "place")
        found = wanted.filter(~(F.col("low") < F.col("high")))
        wanted = written(found.unionByName(_placed(asked, counted, group, ["from"])), "wanted")


def _placed(asked: DataFrame, cells: DataFrame, group: list[str], within: list[str]) -> DataFrame:
    """The cell that each asked place lies in, and the place inside it; places count per group (and ``within``)."""
    keys = [*group, *within]
    upto = cells.withColumn("upto", F.sum("size").over(W.partitionBy(*keys).orderBy("cell")))
    start = F.col("c.upto") - F.col("c.size")
    held = [(F.col("a.place") >= start), (F.col("a.place") < F.col("c.upto"))]
    return asked.alias("a").join(upto.alias("c"), [*_same("a", "c", keys), *held]).select(
        *[F.col(f"a.{g}").alias(g) for g in group], "a.name", (F.col("a.place") - start).alias("place"), "c.low", "c.high", "c.size"
    )


def _same(left: str, right: str, names: list[str]) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names]


def _brackets(whole: DataFrame, p95: float) -> DataFrame:
    """``ranks``: per wanted rank its name, place, and the two values that the sketch puts around it.

    Small groups, where a place is not near enough to its share of all, are looked at whole.
    """
    n = F.col("n")
    places = (
        ("lower", 0.5, F.floor((n - 1) / 2)), ("upper", 0.5, F.ceil((n - 1) / 2)), ("p95", p95, nearest_rank_index(n, p95))
    )
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, share))))
    rows = [
        F.struct(
            F.lit(name).alias("name"), place.cast("bigint").alias("place"),
            F.when(n <= LOOKED_AT_WHOLE, F.col("min")).otherwise(at(share - SLACK)).alias("lo"),
            F.when(n <= LOOKED_AT_WHOLE, F.col("max")).otherwise(at(share + SLACK)).alias("hi"),
        )
        for name, share, place in places
    ]
    return whole.withColumn("ranks", F.array(*rows)).drop("sketch")


def sketched_summary(
    df: DataFrame, keys: list[str], value: str, finest: list[str] | None = None, scope: Column | None = None, p95: float = 0.95
) -> DataFrame:
    """The columns of ``exact_summary`` per ``keys`` (and ``scope``), for few groups; two passes over the values.

    With ``scope``, an array over the columns ``finest``, a finest group counts in each scope that it lists, without
    being read twice. Null and NaN values are left out. Should a sketch have missed a rank, which the exact counts
    show, ``exact_summary`` gives the result.
    """
    fine = [*keys, *(finest or [])]
    out = [*keys, "scope"] if scope is not None else list(keys)
    v = F.col("v")
    values = df.select(*fine, F.col(value).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    base = values.groupBy(*fine).agg(
        F.count(F.lit(1)).alias("size"), F.sum("v").alias("part_total"), F.avg("v").alias("part_mean"),
        F.var_pop("v").alias("part_variance"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.kll_sketch_agg_double("v", F.lit(SKETCH_K)).alias("part"),
    )
    base = written(base, "sketches")
    parts = base.withColumn("scope", F.explode(scope)) if scope is not None else base
    whole = parts.groupBy(*out).agg(
        F.sum("size").alias("n"), F.sum("part_total").alias("total"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.kll_merge_agg_double("part", F.lit(SKETCH_K)).alias("sketch"),
    )
    whole = written(_brackets(whole, p95), "brackets")

    # all brackets that a value of a finest group can lie in: three for each scope
    members = parts.select(*{c: None for c in [*fine, *out]}, "size", "part_mean", "part_variance").alias("p")
    together = members.join(whole.alias("w"), _same("p", "w", out))
    asked = together.groupBy(*[F.col(f"p.{c}").alias(c) for c in fine]).agg(F.flatten(F.collect_list("w.ranks")).alias("asked"))
    inside = F.exists("asked", lambda r: (v >= r["lo"]) & (v <= r["hi"]))
    below = F.size(F.filter("asked", lambda r: r["hi"] < v))
    placed = values.alias("x").join(asked.alias("a"), _same("x", "a", fine)).select(
        *[F.col(f"x.{c}").alias(c) for c in fine], "v",
        F.when(inside, v).alias("cell"), F.when(~inside, below).alias("gap"),
    )
    cells = placed.groupBy(*fine, "cell", "gap").agg(F.count(F.lit(1)).alias("times"), F.min("v").alias("at"))
    cells = written(cells, "cells")

    scoped = (cells.withColumn("scope", F.explode(scope)) if scope is not None else cells).alias("c")
    ranked = scoped.join(whole.alias("w"), _same("c", "w", out)).select(
        *[F.col(f"w.{c}").alias(c) for c in out], "at", "times", "cell", F.explode("ranks").alias("r")
    )
    upto = F.sum("times").over(W.partitionBy(*out, "r.name").orderBy("at"))
    held = ranked.filter(F.col("at") <= F.col("r.hi")).withColumn("upto", upto)
    place = F.col("r.place")
    hits = held.filter(
        (place < F.col("upto")) & (place >= F.col("upto") - F.col("times")) & F.col("cell").between(F.col("r.lo"), F.col("r.hi"))
    )
    found = hits.groupBy(*out).agg(*[F.max(F.when(F.col("r.name") == name, F.col("at"))).alias(name) for name in RANKS])
    found = written(found, "ranks")
    hit_all = F.col("lower").isNotNull() & F.col("upper").isNotNull() & F.col("p95").isNotNull()
    if found.filter(hit_all).count() < whole.count():
        again = values.withColumn("scope", F.explode(scope)) if scope is not None else values
        return exact_summary(again, out, "v", p95)

    mean = F.col("w.total") / F.col("w.n")
    squares = together.groupBy(*[F.col(f"w.{c}").alias(c) for c in out]).agg(
        F.sum(F.col("p.size") * (F.col("p.part_variance") + (F.col("p.part_mean") - mean) ** 2)).alias("squares")
    )
    joined = whole.alias("w").join(squares.alias("s"), _same("w", "s", out)).join(found.alias("f"), _same("w", "f", out))
    n = F.col("w.n")
    return joined.select(
        *[F.col(f"w.{c}").alias(c) for c in out],
        n.alias("n"),
        mean.alias("mean"),
        F.when(n > 1, F.sqrt(F.col("s.squares") / (n - 1))).otherwise(0.0).alias("std"),
        ((F.col("f.lower") + F.col("f.upper")) / 2).alias("median"),
        F.col("w.min").alias("min"),
        F.col("w.max").alias("max"),
        F.col("f.p95").alias("p95"),
    )


def exact_median_and_p95(df: DataFrame, group: list[str], value: str, p95: float = 0.95) -> DataFrame:
    """Columns ``n``, ``median`` and ``p95`` per group; null values are left out."""
    return exact_summary(df, group, value, p95).select(*group, "n", "median", "p95")
