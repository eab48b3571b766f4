"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

Each distinct shingle set is hashed once per shingle; the smallest hash of every bin is the signature, and an empty
bin borrows from a bin that its own hash sequence picks (the same one for all documents). Sets that agree in a band
share a bucket. A bucket compares its members with one of them, the *centre* (the one that collides most), not with
each other; all candidates are confirmed on full shingle sets.

A star alone can miss a link between two members that are unlike the centre. So the members of buckets that still
hold several components are joined exactly, with a prefix filter: in an order from rare to frequent shingles, two
sets that are similar enough share an early one, at places that leave room for the overlap they need. Variants of
one text, which share all but their own edits, then meet only if the edits agree. No link is lost to the star.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.llm.common import (
    LAST_ID, LOWER, NOT_BLANK, classes_of_one_id, encoded, gram_hashes, ids, mixed, offsets, slices, span_hashes, stage, word_spans,
)

SHINGLE_WORDS = 5
BANDS = 32
ROWS = 7
CHUNK_BYTES = 1 << 19
EMPTY = np.uint64(2**64 - 1)
GROUP_MEMBERS = 64


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of all k-word shingles; a shorter text is one shingle, a text without words has none."""
    out: list[np.ndarray] = []
    for a, b in slices(texts, CHUNK_BYTES):
        data = LOWER[np.frombuffer(b"".join(texts[a:b]), np.uint8)]
        starts, ends, bounds = word_spans(data, offsets(map(len, texts[a:b])), NOT_BLANK)
        words = span_hashes(data, starts, ends)
        grams = gram_hashes(words, k)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if e - s >= k:
                out.append(np.unique(grams[s : e - k + 1]))
            elif e > s:
                out.append(gram_hashes(words[s:e], e - s) ^ np.uint64(e - s))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures of non-empty sets, densified: every empty bin tries bins in its own random order."""
    out = np.full((len(sets), bins), EMPTY)
    for i, u in enumerate(sets):
        spot = ((u >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        out[i, spot[first].astype(np.int64)] = u[first]
    full = out != EMPTY
    single = full.sum(axis=1) == 1
    if single.any():
        out[single] = out[single].min(axis=1, keepdims=True)
    row, spot = np.nonzero(~full & ~single[:, None])
    attempt = 1
    while len(row):
        pick = (mixed(spot.astype(np.uint64) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)
        got = full[row, pick]
        out[row[got], spot[got]] = out[row[got], pick[got]]
        row, spot = row[~got], spot[~got]
        attempt += 1
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64)
    cut = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        key = mixed(key * np.uint64(0xFF51AFD7ED558CCD) + cut[:, :, r])
    return mixed(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(shingle: int, bands: int, rows: int):
    """Arrow mapper: id, hash of the text, set size, two hashes of the set, band keys (null for an empty set)."""

    def run(batches):
        for batch in batches:
            texts, doc = encoded(batch.column("text")), ids(batch.column("doc_id"))
            for a, b in slices(texts, 4 * CHUNK_BYTES):
                sets = shingle_sets(texts[a:b], shingle)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                filled = np.flatnonzero(size)
                one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                for i in filled.tolist():
                    one[i] = np.add.reduce(sets[i])
                    two[i] = np.bitwise_xor.reduce(mixed(sets[i]))
                keys: list = [None] * len(sets)
                if len(filled):
                    own = band_keys(signatures([sets[i] for i in filled.tolist()], bands * rows), bands, rows)
                    for i, x in zip(filled.tolist(), own):
                        keys[i] = x
                yield pa.record_batch(
                    {
                        "id": pa.array(doc[a:b]),
                        "text_key": batch.column("text_key").slice(a, b - a),
                        "n_shingles": pa.array(size),
                        "set_a": pa.array(one.view(np.int64)),
                        "set_b": pa.array(two.view(np.int64)),
                        "bands": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each connected part, for every node that has an edge (a, b).

    Every node hooks to its smallest neighbour, edges are contracted along the hooks, until none is left. Each
    round is written to the shared folder, so a lost executor repeats one round at most.
    """
    edges = stage(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = ends.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(
            both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node"), "hooks"
        )
        found = stage(
            found.join(hooks.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "components",
        )
        for end in ("a", "b"):
            edges = edges.join(hooks.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        edges = stage(
            edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "edges",
        )
    return found


def common(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(u) or not len(v):
        return 0
    return int(np.count_nonzero(v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u))


def _confirm(shingle: int, percent: int):
    """Arrow group: one centre and some members with their texts; rows (a, b) that reach the similarity."""

    def run(group: pa.Table) -> pa.Table:
        centre = group["centre"][0].as_py()
        known: dict[int, list[np.ndarray]] = {}
        for node, u in zip(group["node"].to_pylist(), shingle_sets(encoded(group["text"]), shingle)):
            known.setdefault(node, []).append(u)
        linked = []
        for node, sets in known.items():
            if node == centre:
                continue
            for u in sets:
                for c in known[centre]:
                    shared = common(u, c)
                    if shared and 100 * shared >= percent * (len(u) + len(c) - shared):
                        linked.append(node)
        linked = sorted(set(linked))
        return pa.table({"a": pa.array([centre] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


def _shingled(shingle: int):
    """Arrow mapper: the distinct shingles of each text."""

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in slices(texts, 4 * CHUNK_BYTES):
                sets = shingle_sets(texts[a:b], shingle)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                yield pa.record_batch(
                    {
                        "node": batch.column("node").slice(a, b - a),
                        "component": batch.column("component").slice(a, b - a),
                        "n": pa.array(size),
                        "tokens": pa.ListArray.from_arrays(offsets(size).astype(np.int32), pa.array(flat.view(np.int64))),
                    }
                )

    return run


def _salted(members: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(members), F.ceil(count / GROUP_MEMBERS)).cast("int")


class NearDuplicates:
    """Links of 100 * intersection >= ``percent`` * union between documents, and the components they form."""

    def __init__(self, docs: DataFrame, key: str, text: str, percent: int, shingle: int, bands: int, rows: int):
        self.docs = docs.select(
            F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")
        )
        self.percent, self.shingle = percent, shingle
        self.signed = stage(
            self.docs.mapInArrow(
                _signed(shingle, bands, rows),
                "id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>",
            ),
            "signatures",
        )

    def classes(self) -> DataFrame:
        """One row per distinct shingle set: its smallest document."""
        return stage(
            self.signed.filter("n_shingles > 0")
            .groupBy("n_shingles", "set_a", "set_b")
            .agg(F.min(F.struct("id", "text_key")).alias("least"), F.any_value("bands").alias("bands"))
            .select("n_shingles", "set_a", "set_b", "least.id", "least.text_key", "bands"),
            "classes",
        )

    def buckets(self, classes: DataFrame) -> DataFrame:
        """(bucket, node, weight): members of buckets with two or more; weight: how often a node collides."""
        rows = classes.select(F.col("id").alias("node"), F.explode("bands").alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        shared = stage(rows.join(sizes, "bucket"), "buckets")
        weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
        return stage(shared.join(weights, "node").select("bucket", "node", "weight").distinct(), "members")

    def texts(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, text) of every class that shares a bucket."""
        where = classes.select(F.col("id").alias("node"), "text_key").join(members.select("node").distinct(), "node")
        every = self.docs.select(F.coalesce("doc_id", F.lit(int(LAST_ID))).alias("node"), "text_key", "text")
        return stage(every.join(where, ["node", "text_key"], "left_semi").select("node", "text"), "candidates")

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs (a: centre, b: member) whose full shingle sets are similar enough."""
        many = pairs.groupBy("a").agg(F.count("*").alias("many"))
        asked = pairs.join(many, "a").select("a", "b", _salted(F.col("b"), F.col("many")).alias("salt"))
        members = asked.select(F.col("a").alias("centre"), "salt", F.col("b").alias("node"))
        centres = members.select("centre", "salt", F.col("centre").alias("node")).distinct()
        return (
            members.unionByName(centres)
            .join(texts, "node")
            .groupBy("centre", "salt")
            .applyInArrow(_confirm(self.shingle, self.percent), "a long, b long")
        )

    def star(self, members: DataFrame) -> DataFrame:
        """(a, b): the centre of each bucket with every other member."""
        first = members.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("first"))
        centres = first.select("bucket", F.col("first.node").alias("a"))
        return members.join(centres, "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()

    def unsettled(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """(node, component) of the members of buckets with several components."""
        state = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed_ = (
            state.groupBy("bucket")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .filter("low < high")
        )
        return state.join(mixed_, "bucket", "left_semi").select("node", "component").distinct()

    def prefix_pairs(self, nodes: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b) of different components that can be similar enough: all such pairs of ``nodes`` are among them.

        x is the larger set, y the other; p is the wanted percentage. They need an overlap of o with
        o * (100 + p) >= p * (|x| + |y|), and |y| * 100 >= p * |x|. Their first common shingle, at places i of x
        and j of y (rare ones first), leaves |x| - i and |y| - j shingles, and neither may be less than o. Sizes
        are joined by classes of two per cent, so that a place meets only sizes it can go with.
        """
        p = self.percent
        tokens = stage(
            nodes.join(texts, "node")
            .mapInArrow(_shingled(self.shingle), "node long, component long, n long, tokens array<long>")
            .select("node", "component", "n", F.xxhash64("tokens").alias("set"), F.explode("tokens").alias("token")),
            "shingles",
        )
        frequency = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
        shared = tokens.join(frequency, "token")
        of_node = Window.partitionBy("node", "set")
        placed = shared.select(
            "node", "component", "n", "token",
            (F.col("n") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("df", "token")) - 1).alias("place"),
        )
        size_class = lambda n: f"CAST(floor(ln({n}) / ln(1.02D)) AS int)"
        placed = placed.filter(F.expr(f"(n - place) * {100 + p} >= {p} * (n + ceil(n * {p} / 100D))"))
        placed = stage(placed, "prefixes")
        larger = placed.select(
            F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("i"), "token",
            F.explode(F.expr(
                f"sequence({size_class(f'ceil(n * {p} / 100D)')}, {size_class(f'least(n, floor((n - place) * {100 + p} / {p}D) - n)')})"
            )).alias("class"),
        )
        smaller = placed.filter(F.expr(f"(n - place) * {100 + p} >= {2 * p} * n")).select(
            F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("j"), "token",
            F.expr(size_class("n")).alias("class"),
        )
        # groups of one component need no look; in the others, members of the most frequent one skip each other
        sides = larger.select("token", "class", F.col("cx").alias("c"), F.lit(0).alias("side")).unionByName(
            smaller.select("token", "class", F.col("cy").alias("c"), F.lit(1).alias("side"))
        )
        parts = sides.groupBy("token", "class", "c").agg(F.count("*").alias("size"), F.max("side").alias("side"))
        groups_ = (
            parts.groupBy("token", "class")
            .agg(F.max_by("c", "size").alias("most"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("side").alias("side"))
            .filter("low < high AND side = 1")
            .select("token", "class", "most")
        )
        larger, smaller = larger.join(groups_, ["token", "class"]), smaller.join(groups_, ["token", "class"])
        larger, smaller = stage(larger, "larger"), stage(smaller, "smaller")
        fits = F.expr(
            f"cx <> cy AND ny <= nx AND ny * 100 >= {p} * nx AND (nx - i) * {100 + p} >= {p} * (nx + ny) "
            f"AND (ny - j) * {100 + p} >= {p} * (nx + ny)"
        )
        one = larger.filter("cx <> most").join(smaller.drop("most"), ["token", "class"]).filter(fits)
        two = larger.filter("cx = most").drop("most").join(smaller.filter("cy <> most"), ["token", "class"]).filter(fits)
        return one.select("x", "y").unionByName(two.select("x", "y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Classes and (node, component) for the nodes that have a link."""
        classes = self.classes()
        members = self.buckets(classes)
        texts = self.texts(members, classes)
        links = stage(self.confirmed(stage(self.star(members), "star"), texts), "links")
        same = ["n_shingles", "set_a", "set_b"]
        links = links.unionByName(stage(classes_of_one_id(self.signed.filter("n_shingles > 0"), classes, same, "id"), "links"))
        found = components(links)
        nodes = stage(self.unsettled(members, found), "unsettled")
        rest = stage(self.confirmed(stage(self.prefix_pairs(nodes, texts), "pairs"), texts), "rest")
        if rest.isEmpty():
            return classes, found
        return classes, components(links.unionByName(rest))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    shingle: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row; documents link at 100 * intersection >= percent * union.

    Shingles are ``shingle`` words of the text with A-Z in lower case; a text with fewer words is one shingle, a text
    without words has none and is linked with nothing. component_id is the smallest id that can be reached over
    links, kept marks the rows with that id. At similarity s a pair shares no band with probability
    (1 - s^rows)^bands: 4e-6 at 0.85. Null ids sort after every number and stay null; rows with equal ids are one
    document with several texts, all in one component. Other columns are not read; an empty table gives an empty result.
    """
    job = NearDuplicates(df, key, text, percent, shingle, bands, rows)
    classes, found = job.links()
    least = classes.select("n_shingles", "set_a", "set_b", F.col("id").alias("node"))
    own = (
        job.signed.select("id", "n_shingles", "set_a", "set_b")
        .join(least, ["n_shingles", "set_a", "set_b"], "left")
        .withColumn("node", F.coalesce("node", "id"))
        .join(found, "node", "left")
        .withColumn("component_id", F.least(F.coalesce("component", "node"), "id"))
    )
    real = lambda c: F.when(F.col(c) != F.lit(int(LAST_ID)), F.col(c))
    return own.select(
        real("id").alias("doc_id"),
        F.col("n_shingles").cast("long").alias("n_shingles"),
        real("component_id").alias("component_id"),
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


__all__ = ["components", "near_duplicates"]
