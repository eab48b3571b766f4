"""Cooldown: per key, an event fires only if enough time passed since the last one that fired.

Whether an event fires depends on earlier decisions, so it is no plain ``lag``. The events are dealt into blocks:
ranges of (key, time) with about equal row counts, however they lie in time. Most keys lie inside one block and are
settled there. A key that spans blocks (a block has two such keys at most) is settled in three steps:

1. what a block does to the last fired time before it is a step function. Its first event to fire lies within one
   cooldown of the block's first row, so the function has a step at most for each of those rows, and chains of
   events that meet share one;
2. neighbouring functions are composed in groups, the results in groups again, until one group is left; from there
   the last fired time before each group, then before each of its members, follows by one look-up each;
3. every block replays its own events from there.

A task holds one block, or the functions of one group. No step loops over rows: chains are followed by doubling, and
functions are composed for all their steps at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import range_count, written


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrow batches of rows sorted by (block, g), re-cut so that no (block, g) spans two of them.

    ``g`` is the key as text, never null. A block has a bounded number of rows, so what is held back is bounded, too.
    """
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = ((pdf["g"] == pdf["g"].iloc[-1]) & (pdf["block"] == pdf["block"].iloc[-1])).to_numpy()
        if held and last.all() and held[0]["g"].iloc[0] == pdf["g"].iloc[0] and held[0]["block"].iloc[0] == pdf["block"].iloc[0]:
            held.append(pdf)
            continue
        if held or not last.all():
            done = pd.concat([*held, pdf[~last]], ignore_index=True)
            if len(done):
                yield done
        held = [pdf[last]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _layout(pdf: pd.DataFrame, cooldown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row, first row of each group, the row that may fire next or the number of rows) for sorted rows."""
    first = ((pdf["g"] != pdf["g"].shift()) | (pdf["block"] != pdf["block"].shift())).to_numpy()
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(pdf))
    t = pdf["t"].to_numpy()
    following = np.empty(len(t), np.int64)
    span = int((t - t[starts][group]).max()) + cooldown + 1
    if span < 2**62 // max(1, len(starts)):  # all groups on one line, too far apart to meet
        line = group * span + (t - t[starts][group])
        following = np.searchsorted(line, line + cooldown, side="left")
    else:
        for a, b in zip(starts.tolist(), ends.tolist()):
            following[a:b] = a + np.searchsorted(t[a:b], t[a:b] + cooldown, side="left")
    following = np.where(following < ends[group], following, len(t))
    # with no cooldown the next event is the next row
    return group, starts, np.maximum(following, np.minimum(np.arange(len(t)) + 1, len(t)))


def _doublings(following: np.ndarray) -> list[np.ndarray]:
    """Jumps of 1, 2, 4, ... steps; the number of rows stands for the end."""
    n = len(following)
    jumps = [np.append(following, n)]
    while (jumps[-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    return jumps


GROUP_BLOCKS = 32
FUNCTION = "g string, block bigint, opens bigint, upto array<bigint>, leaves array<bigint>"


def _merged(upto: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps that leave the same last event are one, named by the last of them."""
    ends = np.append(leaves[1:] != leaves[:-1], True)
    return upto[ends], leaves[ends]


def _functions(cooldown: int):
    """Step functions of (block, g): where the first event that may fire is at most ``upto``, the last one is ``leaves``."""

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_blocks(batches):
            _, starts, following = _layout(pdf, cooldown)
            n, t = len(pdf), pdf["t"].to_numpy()
            last = np.arange(n)
            for jump in reversed(_doublings(following)):  # as far as the chain goes
                further = jump[:-1][last]
                last = np.where(further < n, further, last)
            rows = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist()):
                stop = min(int(following[a]) + 1, b)  # beyond, an earlier event has fired in any case
                upto, leaves = _merged(t[a:stop], t[last[a:stop]])
                rows.append((pdf["g"].iloc[a], pdf["block"].iloc[a], t[a], upto, leaves))
            yield pd.DataFrame(rows, columns=["g", "block", "opens", "upto", "leaves"])

    return per_partition


def _composed(cooldown: int):
    """One function for a group of neighbouring blocks of a key."""

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        opens = int(pdf["opens"].iloc[0])
        upto, leaves = np.asarray(pdf["upto"].iloc[0]), np.asarray(pdf["leaves"].iloc[0])
        for more_upto, more_leaves in zip(pdf["upto"].iloc[1:], pdf["leaves"].iloc[1:]):
            more_upto, more_leaves = np.asarray(more_upto), np.asarray(more_leaves)
            at = np.searchsorted(more_upto, leaves + cooldown)
            further = np.where(at < len(more_upto), more_leaves[np.minimum(at, len(more_upto) - 1)], leaves)
            if upto[-1] < opens + cooldown:  # nothing before may have fired
                reach = np.searchsorted(more_upto, opens + cooldown) + 1
                upto, further = np.append(upto, more_upto[:reach]), np.append(further, more_leaves[:reach])
            upto, leaves = _merged(upto, further)
        return pd.DataFrame({"g": pdf["g"].iloc[:1].to_numpy(), "block": pdf["parent"].iloc[:1].to_numpy(), "opens": [opens], "upto": [upto], "leaves": [leaves]})

    return per_group


def _looked_up(cooldown: int):
    """The last fired time before each member of a group, from the one before the group (null: none)."""

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        start = pdf["start"].iloc[0]
        last = None if pd.isna(start) else int(start)
        before = []
        for upto, leaves in zip(pdf["upto"], pdf["leaves"]):
            before.append(last)
            at = 0 if last is None else int(np.searchsorted(np.asarray(upto), last + cooldown))
            if at < len(leaves):
                last = int(leaves[at])
        return pd.DataFrame({"g": pdf["g"].to_numpy(), "block": pdf["block"].to_numpy(), "before": pd.array(before, "Int64")})

    return per_group


def _before_blocks(functions: DataFrame, blocks: int, cooldown: int) -> DataFrame:
    """(g, block, before) for every function: composed upwards in groups, looked up downwards."""
    parent = F.floor(F.col("block") / GROUP_BLOCKS)
    levels = [functions]
    while blocks > GROUP_BLOCKS:
        up = levels[-1].withColumn("parent", parent).groupBy("g", "parent").applyInPandas(_composed(cooldown), FUNCTION)
        levels.append(written(up, "composed"))
        blocks = -(-blocks // GROUP_BLOCKS)
    columns = "g string, block bigint, before bigint"
    top = levels[-1].withColumn("start", F.lit(None).cast("bigint"))
    before = top.groupBy("g").applyInPandas(_looked_up(cooldown), columns)
    for functions in reversed(levels[:-1]):
        above = before.select("g", F.col("block").alias("parent"), F.col("before").alias("start"))
        members = functions.withColumn("parent", parent).join(above, ["g", "parent"])
        before = members.groupBy("g", "parent").applyInPandas(_looked_up(cooldown), columns)
    return before


def _replay(cooldown: int):
    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_blocks(batches):
            group, starts, following = _layout(pdf, cooldown)
            n = len(pdf)
            free = pdf["before"].isna().to_numpy() | (pdf["t"] >= pdf["before"].fillna(0) + cooldown).to_numpy()
            first = np.full(len(starts), n)
            np.minimum.at(first, group[free], np.flatnonzero(free))
            fires = np.zeros(n + 1, bool)
            fires[first] = True
            for jump in reversed(_doublings(following)):  # all chains, all their events
                fires[jump[np.flatnonzero(fires)]] = True
            yield pdf.loc[fires[:-1], ["k", "t"]]

    return per_partition


def fired_times(
    candidates: DataFrame, key: str, ts_ms: str, cooldown_ms: int = 120_000, blocks: int | None = None
) -> DataFrame:
    """Distinct (``key``, ``ts_ms``) pairs at which the key fires.

    ``blocks`` is the number of ranges that events are dealt into (by default it follows the number of rows).
    """
    key_type = candidates.schema[key].dataType.simpleString()
    as_text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    # at one instant a key fires at most once
    moments = candidates.select(F.col(key).alias("k"), as_text.alias("g"), F.col(ts_ms).cast("bigint").alias("t")).distinct()
    blocks = blocks or range_count(candidates)
    dealt = moments.repartitionByRange(blocks, "g", "t").withColumn("block", F.spark_partition_id().cast("bigint"))
    moments = written(dealt, "moments")

    # a block's first and last key may go on in another block
    ends = moments.groupBy("block").agg(F.array_distinct(F.array(F.min("g"), F.max("g"))).alias("g"))
    ends = ends.select(F.explode("g").alias("g"), "block")
    spanning = ends.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    # one block a task, so that all tasks have as many rows
    in_blocks = lambda df: df.repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "g", "t")
    split = moments.join(ends.join(spanning, "g"), ["g", "block"], "left_semi")
    functions = written(in_blocks(split).mapInPandas(_functions(cooldown_ms), FUNCTION), "functions")
    before = _before_blocks(functions, blocks, cooldown_ms)
    joined = moments.join(before, ["g", "block"], "left")
    fired = in_blocks(joined).mapInPandas(_replay(cooldown_ms), f"k {key_type}, t bigint")
    return fired.select(F.col("k").alias(key), F.col("t").alias(ts_ms))


def mark_fired(
    candidates: DataFrame,
    key: str,
    ts_ms: str,
    tie: str,
    cooldown_ms: int = 120_000,
    exempt=None,
    blocks: int | None = None,
) -> DataFrame:
    """Candidates with a boolean ``fired``; rows matching ``exempt`` always fire and never block others."""
    exempt = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    tagged = candidates.withColumn("exempt", exempt)
    limited = tagged.filter(~F.col("exempt"))
    same_moment = F.col(key).eqNullSafe(F.col("_key")) & (F.col(ts_ms) == F.col("_ts"))
    winners = (
        limited.groupBy(key, ts_ms)
        .agg(F.min(tie).alias(tie))
        .join(fired_times(limited, key, ts_ms, cooldown_ms, blocks).select(F.col(key).alias("_key"), F.col(ts_ms).alias("_ts")), same_moment)
        .select("_key", "_ts", F.col(tie).alias("_tie"), F.lit(True).alias("won"))
    )
    return (
        tagged.join(winners, same_moment & F.col(tie).eqNullSafe(F.col("_tie")), "left")
        .withColumn("fired", F.col("exempt") | F.coalesce("won", F.lit(False)))
        .drop("exempt", "won", "_key", "_ts", "_tie")
    )
