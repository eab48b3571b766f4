"""Centroid clustering with Orchard's search for the nearest centroid.

Every centroid has a list of the others, nearest first. A vector starts at some centroid and walks its list; as soon
as a closer centroid is found, it jumps to that one's list. Centroids it has met are marked and not measured again,
and the walk ends strictly beyond twice the current distance: by the triangle inequality nothing there is as close.
Components are integers, so distances, ties and means are exact.

Each round is one pass over the vectors: tasks search and add up their own vectors, Spark adds the tasks' sums per
centroid and component, and only those sums (centroids x components) come to the driver. No shuffle ever holds a
vector, so a centroid that gets a third of all rows is no hot spot.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import stage

SCALE = 1024
ROUNDS = 10
BATCH_ROWS = 4096


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each the numbers of all, nearest first (itself among them)."""
    between = np.stack([squared(centroids, c) for c in centroids])
    return between, np.argsort(between, axis=1, kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, start: int, lists: tuple[np.ndarray, np.ndarray]):
    """Number and squared distance of the nearest centroid (ties: the smaller number) of each row of ``x``."""
    between, order = lists
    at = np.full(len(x), start)
    best = squared(x, centroids[start])
    met = np.zeros((len(x), len(centroids)), bool)
    met[:, start] = True
    place = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        candidate = order[at[live], place[live]]
        within = between[at[live], candidate] <= 4 * best[live]
        live, candidate = live[within], candidate[within]
        place[live] += 1
        new = ~met[live, candidate]
        asked, candidate = live[new], candidate[new]
        met[asked, candidate] = True
        distance = squared(x[asked], centroids[candidate])
        closer = (distance < best[asked]) | ((distance == best[asked]) & (candidate < at[asked]))
        jump = asked[closer]
        at[jump], best[jump], place[jump] = candidate[closer], distance[closer], 0
        live = live[place[live] < len(centroids)]
    return at, best


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _limit(size: int) -> int:
    """Components below this keep four times a squared distance inside 63 bits."""
    return math.isqrt(2**61 // max(1, size)) // 2


def _sums(centroids: np.ndarray, start: int):
    """Arrow mapper: per centroid and component the sum of a task's vectors; component -1 holds their number."""

    def run(batches):
        k, size = centroids.shape
        lists = neighbour_lists(centroids)
        total = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                x = _vectors(batch.column("vector").slice(a, BATCH_ROWS), size)
                at, _ = nearest(x, centroids, start, lists)
                np.add.at(total[:, 1:], at, x)
                total[:, 0] += np.bincount(at, minlength=k)
        used = np.flatnonzero(total[:, 0])
        yield pa.record_batch(
            {
                "cluster": pa.array(np.repeat(used, size + 1).astype(np.int32)),
                "component": pa.array(np.tile(np.arange(-1, size, dtype=np.int32), len(used))),
                "total": pa.array(total[used].reshape(-1)),
            }
        )

    return run


def _assigned(centroids: np.ndarray, start: int):
    """Arrow mapper: key, nearest centroid and squared distance of each vector."""

    def run(batches):
        lists = neighbour_lists(centroids)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                at, best = nearest(_vectors(part.column("vector"), centroids.shape[1]), centroids, start, lists)
                yield pa.record_batch(
                    {"key": part.column("key"), "cluster": pa.array(at.astype(np.int32)), "distance": pa.array(best)}
                )

    return run


def whole_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, vector) of the rows with exactly ``size`` finite components, each floor(1024 * x) as an integer."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = _limit(size)
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x))
    kept = df.filter((F.size(v) == size) & finite).select(F.col(f"`{key}`").alias("key"), scaled.alias("vector"))
    too_large = F.exists("vector", lambda x: F.abs(x) >= limit)
    return kept.withColumn(
        "vector", F.when(too_large, F.raise_error(F.lit(f"a component is beyond {limit}"))).otherwise(F.col("vector"))
    )


def first_centroids(kept: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``salt`` and key; equal keys by their components, null keys last."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")).cast("binary"), 256)
    rows = kept.withColumn("digest", digest).orderBy(F.col("digest").asc_nulls_last(), "vector").limit(count)
    return np.array([r.vector for r in rows.select("vector").collect()], np.int64)


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, clusters: int = 8,
    rounds: int = ROUNDS, salt: str = "3:",
) -> DataFrame:
    """Per vector: ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Rows whose vector is null, has another number of components, or a component that is null or not finite are left
    out. Components become floor(1024 * x). The first centroids are the vectors with the smallest SHA-256 of ``salt``
    and key; each of ``rounds`` rounds assigns all vectors and replaces every non-empty centroid by the floor of its
    vectors' mean. It ends early where a round changes nothing. Fewer vectors than ``clusters`` give as many
    centroids as vectors; repeated rows count each; a null key comes last among the first centroids and stays null;
    an empty table gives an empty result. A component whose squared distances would leave 63 bits (2^26 and more at
    64 components) raises an error. Other columns are not read.
    """
    spark = df.sparkSession
    kept = stage(whole_vectors(df, key, vector, size), "vectors")
    centroids = first_centroids(kept, clusters, salt).reshape(-1, size)
    start = 0
    for _ in range(rounds if len(centroids) else 0):
        sums = kept.mapInArrow(_sums(centroids, start), "cluster int, component int, total long")
        total = np.zeros((len(centroids), size + 1), np.int64)
        for r in sums.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect():
            total[r.cluster, r.component + 1] = r.total
        count = total[:, :1]
        moved = np.where(count > 0, total[:, 1:] // np.maximum(count, 1), centroids)
        start = int(count.argmax())
        if (moved == centroids).all():
            break
        centroids = moved
    if not len(centroids):
        centroids = np.zeros((1, size), np.int64)
    kind = kept.schema["key"].dataType.simpleString()
    found = stage(
        kept.mapInArrow(_assigned(centroids, start), f"key {kind}, cluster int, distance long"), "assigned"
    )
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(
        [(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(  # a row per centroid
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
