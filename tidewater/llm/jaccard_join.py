"""N-gram Jaccard join with prefix filters under several global token orders.

Two sets that are similar enough share a token among the first few of each, whatever the order of all tokens is. So
a candidate must share a prefix token under *every* order, and the filters are intersected before full sets are
compared. All orders put shingles that few documents have first and mix equally frequent ones by a hash of their
own: the prefix of a text without near copies holds shingles of its own only, and a common line is in no prefix.

How many have a shingle is asked in rounds over batches of documents (about 4 MB of text): a batch sends its distinct
shingles, five bytes each, to their buckets, and a bucket answers with a digit each, 0 for those that nobody else has.

Equal sets are one class, and a link matters only where it joins two components. First each prefix token compares
its members with one centre (then with a second one, for members outside the largest component). What is left is
joined exactly: all pairs of different components that share a prefix token, where large groups are split by the
prefix tokens of the second and third order, which similar sets share as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import LAST_ID, classes_of_one_id, encoded, ids, mixed, offsets, slices, stage, text_size
from tidewater.llm.near_dedup import components, shingle_sets
from tidewater.llm.segments import five_bytes, from_five_bytes, groups

SHINGLE_WORDS = 3
PERCENT = 90
ORDERS = 3
STAR_ROUNDS = 2
SPLIT_ABOVE = 128
BROADCAST_ROWS = 1 << 20  # of two numbers each; more are joined by a shuffle
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SALTS = 64
NONE = np.zeros(0, np.uint64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n of which, under any order, one is shared with every set that is similar enough."""
    return n - -(-n * percent // 100) + 1


def prefixes(u: np.ndarray, digits: np.ndarray, percent: int, orders: int) -> list[np.ndarray]:
    """Shared shingles in the prefix of a set under each order, in that order, behind those that nobody shares.

    ``digits`` tell how many documents have each shingle.
    """
    size = int(prefix_length(np.int64(len(u)), percent))
    if np.count_nonzero(digits == 0) >= size:  # nothing in any prefix is shared
        return [NONE] * orders
    rank = digits.astype(np.uint64) << np.uint64(56)
    out = []
    for r in range(orders):
        key = rank | (mixed(u + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8))
        first = np.argpartition(key, size - 1)[:size] if size < len(u) else np.arange(len(u))
        first = first[digits[first] > 0]
        out.append(u[first[np.argsort(key[first])]])
    return out


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else NONE
    return pa.ListArray.from_arrays(offsets(map(len, parts)).astype(np.int32), pa.array(flat.view(np.int64).astype(kind)))


class Signing:
    """Set sizes, set hashes and prefixes of all documents, in three rounds over batches."""

    def __init__(self, shingle: int, percent: int, orders: int, buckets: int):
        self.shingle, self.percent, self.orders, self.buckets = shingle, percent, orders, buckets

    def _load(self, docs: pa.Table):
        """Sets in a fixed order; distinct shingles by bucket, with the sets of the batch that have each one."""
        docs = docs.select(["doc_id", "text", "text_key"])
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text_key", "ascending")]))
        sets = shingle_sets(encoded(docs["text"]), self.shingle)
        one = np.array([np.add.reduce(u) for u in sets], np.uint64)
        two = np.array([np.bitwise_xor.reduce(mixed(u)) for u in sets], np.uint64)
        once = np.unique(np.stack([one, two]), axis=1, return_index=True)[1]
        token, count = np.unique(np.concatenate([NONE, *(sets[i] for i in once.tolist())]), return_counts=True)
        bucket = (token % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return docs, sets, one, two, token, count, bucket[order], order

    def send(self, docs: pa.Table) -> pa.Table:
        batch = docs["batch"][0].as_py()
        *_, token, count, bucket, order = self._load(docs)
        first, size = groups(bucket)
        value, again = token[order] // np.uint64(self.buckets), count[order] > 1
        return pa.table(
            {
                "bucket": pa.array(bucket[first], pa.int32()),
                "batch": pa.array(np.full(len(first), batch), pa.int64()),
                "data": pa.array([five_bytes(value[a : a + n]) for a, n in zip(first, size)], pa.binary()),
                "more": pa.array([np.packbits(again[a : a + n]).tobytes() for a, n in zip(first, size)], pa.binary()),
            }
        )

    def answer(self, sent: pa.Table) -> pa.Table:
        """A digit per shingle: 0 where one set has it, else the binary digits of the number of batches (or so)."""
        values = [from_five_bytes(x) for x in sent["data"].to_pylist()]
        again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(sent["more"].to_pylist(), values)]
        every, extra = np.concatenate(values), np.concatenate(again)
        order = np.argsort(every, kind="stable")
        first, size = groups(every[order])
        count = size + np.maximum.reduceat(extra[order], first)
        digit = np.empty(len(every), np.uint8)
        digit[order] = np.repeat(np.ceil(np.log2(count)).astype(np.uint8), size)
        parts = np.split(digit, np.cumsum([len(v) for v in values])[:-1])
        return pa.table(
            {"batch": sent["batch"], "bucket": sent["bucket"], "digits": pa.array([p.tobytes() for p in parts], pa.binary())}
        )

    def finish(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, sets, one, two, token, _, bucket, order = self._load(docs)
        first, size = groups(bucket)
        place = dict(zip(bucket[first].tolist(), zip(first.tolist(), size.tolist())))
        digits = np.zeros(len(token), np.uint8)
        for b, data in zip(replies["bucket"].to_pylist(), replies["digits"].to_pylist()):
            a, n = place[b]
            digits[order[a : a + n]] = np.frombuffer(data, np.uint8)
        alone, cut = [], []
        for u in sets:
            own = digits[np.searchsorted(token, u)]
            alone.append(np.count_nonzero(own == 0))
            cut.append(prefixes(u, own, self.percent, self.orders) if len(u) else [NONE] * self.orders)
        columns = {
            "id": pa.array(ids(docs["doc_id"])),
            "text_key": docs["text_key"],
            "n": pa.array(np.fromiter(map(len, sets), np.int64, len(sets))),
            "set_a": pa.array(one.view(np.int64)),
            "set_b": pa.array(two.view(np.int64)),
            "alone": pa.array(np.array(alone, np.int64)),
        }
        for r in range(self.orders):
            columns[f"prefix_{r}"] = _lists([c[r] for c in cut], np.int64 if r == 0 else np.int32)
        return pa.table(columns)

    def run(self, docs: DataFrame, batches: int) -> DataFrame:
        kinds = "".join(f", prefix_{r} array<{'int' if r else 'long'}>" for r in range(self.orders))
        # repeated rows are dealt apart by their place
        row = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
        batch = F.pmod(F.xxhash64("doc_id", "text_key", row), F.lit(batches))
        batched = docs.withColumn("batch", batch).repartition(max(2, math.ceil(batches / 2)), "batch")
        sent = batched.groupBy("batch").applyInArrow(lambda t: self.send(t), "bucket int, batch long, data binary, more binary")
        replies = sent.groupBy("bucket").applyInArrow(lambda t: self.answer(t), "batch long, bucket int, digits binary")
        return (
            batched.groupBy("batch")
            .cogroup(replies.groupBy("batch"))
            .applyInArrow(
                lambda a, b: self.finish(a, b), f"id long, text_key long, n long, set_a long, set_b long, alone long{kinds}"
            )
        )


def _tokens(shingle: int):
    """Arrow mapper: all shingles of each text."""

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in slices(texts, BATCH_BYTES // 2):
                sets = shingle_sets(texts[a:b], shingle)
                yield pa.record_batch({"node": batch.column("node").slice(a, b - a), "tokens": _lists(sets, np.int64)})

    return run


class JaccardJoin:
    """Links between documents at 100 * intersection >= ``percent`` * union, as components of classes of equal sets."""

    def __init__(self, docs: DataFrame, key: str, text: str, percent: int, shingle: int, orders: int):
        self.docs = docs.select(
            F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("text_key")
        )
        self.percent, self.shingle, self.orders = percent, shingle, orders
        self.others = [f"prefix_{r}" for r in range(1, orders)]
        size = text_size(self.docs)
        signing = Signing(shingle, percent, orders, max(1, math.ceil(size / BUCKET_BYTES)))
        self.signed = stage(signing.run(self.docs, max(1, math.ceil(size / BATCH_BYTES))), "signed")
        self.classes = stage(
            self.signed.filter("n > 0").groupBy("n", "set_a", "set_b").agg(
                F.min(F.struct("id", "text_key")).alias("least"),
                F.max("alone").alias("alone"), *[F.any_value(f"prefix_{r}").alias(f"prefix_{r}") for r in range(orders)],
            ).select("n", "set_a", "set_b", "alone", F.col("least.id").alias("node"), "least.text_key", *[f"prefix_{r}" for r in range(orders)]),
            "classes",
        )
        rows = self.classes.select("node", "n", "alone", F.posexplode("prefix_0").alias("at", "token"))
        rows = rows.select("node", "n", (F.col("alone") + F.col("at")).alias("place"), "token")
        sizes = rows.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
        shared = stage(rows.join(sizes, "token"), "shared")
        weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
        self.members = stage(shared.join(weights, "node").select("token", "node", "n", "place", "weight"), "members")
        nodes = self.classes.join(self.members.select("node").distinct(), "node", "left_semi")
        self.orders_of = stage(nodes.select("node", "n", "alone", *self.others), "prefixes")

    def state(self, found: DataFrame | None) -> DataFrame:
        """Members with their component, of the tokens that hold several."""
        if found is None:
            rows = self.members.withColumn("component", F.col("node"))
        else:
            rows = self.members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return self._unsettled(rows, "token")

    @staticmethod
    def _unsettled(rows: DataFrame, key: str) -> DataFrame:
        """``rows`` of the keys with several components, with the size of the group and its largest component."""
        parts = rows.groupBy(key, "component").agg(F.count("*").alias("part"))
        groups = parts.groupBy(key).agg(
            F.count("*").alias("parts"), F.sum("part").alias("size"),
            F.max(F.struct("part", "component"))["component"].alias("most"),
        ).filter("parts > 1").drop("parts")
        return rows.drop("size", "most").join(groups, key)

    def star(self, state: DataFrame, first: bool) -> DataFrame:
        """(a, b): a centre of each token's members with all members of other components.

        The centre is the member that collides most; after the first round, of those outside the largest component.
        """
        able = state if first else state.filter("component <> most")
        centres = able.groupBy("token").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node", "n", "place", "component")).alias("c"))
        pairs = state.join(centres, "token").filter("component <> c.component")
        return pairs.filter(self.fits("n", "place", "c.n", "c.place")).select(F.col("c.node").alias("a"), F.col("node").alias("b"))

    def fits(self, nx: str, i: str, ny: str, j: str) -> str:
        """Whether sets of these sizes whose first shared token has these places can be similar enough."""
        p = self.percent
        return (
            f"100 * least({nx}, {ny}) >= {p} * greatest({nx}, {ny}) "
            f"AND least({nx} - {i}, {ny} - {j}) * {100 + p} >= {p} * ({nx} + {ny})"
        )

    def rest(self, state: DataFrame) -> DataFrame:
        """(a, b): all pairs of different components that share a prefix token at places that leave enough.

        In a large group a pair meets where the smaller set's size is: the larger one goes to the classes of sizes (two
        per cent wide) that its place allows. What is still large is split by the prefix tokens of the next order.
        """
        p = self.percent
        size_class = lambda n: f"CAST(floor(ln({n}) / ln(1.02D)) AS int)"
        pairs = [self._pairs_of_small(state.filter(F.col("size") <= SPLIT_ABOVE))]
        rows = state.filter(F.col("size") > SPLIT_ABOVE).select("token", "node", "n", "place", "component")
        reach = f"least(n, floor((n - place) * {100 + p} / {p}D) - n)"
        larger = rows.withColumn("low", F.expr(f"ceil(n * {p} / 100D)")).filter(f"low <= {reach}").select(
            "token", "node", "n", "place", "component", F.lit(0).alias("side"),
            F.explode(F.expr(f"sequence({size_class('low')}, {size_class(reach)})")).alias("class"),
        )
        smaller = rows.filter(self.leaves_enough).select(
            "token", "node", "n", "place", "component", F.lit(1).alias("side"), F.expr(size_class("n")).alias("class")
        )
        rows = larger.unionByName(smaller).withColumn("key", F.xxhash64("token", "class")).drop("token", "class")
        for name in [*self.others, None]:
            rows = stage(self._open(rows), "groups")
            pairs.append(self._pairs(rows.filter(F.col("size") <= SPLIT_ABOVE) if name else rows))
            if name:
                rows = self._split(rows.filter(F.col("size") > SPLIT_ABOVE), name)
        out = pairs[0]
        for more in pairs[1:]:
            out = out.unionByName(more)
        return out

    def _pairs_of_small(self, state: DataFrame) -> DataFrame:
        """Pairs of members of one group, of which not both are in its largest component."""
        own = ("node", "n", "place", "component")
        x = state.filter("component <> most").select("token", "most", *[F.col(c).alias(f"{c}_x") for c in own])
        y = state.select("token", *[F.col(c).alias(f"{c}_y") for c in own])
        fits = self.fits("n_x", "place_x", "n_y", "place_y")
        met = x.join(y, "token").filter(f"component_x <> component_y AND (component_y = most OR node_x < node_y) AND {fits}")
        return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))

    @property
    def leaves_enough(self) -> str:
        """What holds for the smaller set of a pair."""
        return f"(n - place) * {100 + self.percent} >= {2 * self.percent} * n"

    def _split(self, rows: DataFrame, name: str) -> DataFrame:
        """Members of a group once per prefix token of another order, with their places in that order."""
        orders = self.orders_of.select("node", "n", "alone", name).distinct()
        finer = rows.join(orders, ["node", "n"]).select(
            "key", "node", "n", "component", "side", "alone", F.posexplode(name).alias("at", "token")
        )
        finer = finer.withColumn("place", F.col("alone") + F.col("at")).filter(f"side = 0 OR {self.leaves_enough}")
        return finer.select(F.xxhash64("key", "token").alias("key"), "node", "n", "place", "component", "side")

    @staticmethod
    def _open(rows: DataFrame) -> DataFrame:
        """``rows`` of the keys with both sides and several components, with the group's size and largest component."""
        parts = rows.groupBy("key", "component").agg(
            F.count("*").alias("part"), F.min("side").alias("low"), F.max("side").alias("high")
        )
        groups_ = parts.groupBy("key").agg(
            F.count("*").alias("parts"), F.sum("part").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.max(F.struct("part", "component"))["component"].alias("most"),
        ).filter("parts > 1 AND low < high").select("key", "size", "most")
        return rows.drop("size", "most").join(groups_, "key")

    def _pairs(self, rows: DataFrame) -> DataFrame:
        """Members of the largest component of a group do not meet each other."""
        x = rows.filter("side = 0").select("key", "most", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "place", "component")])
        y = rows.filter("side = 1").select("key", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "place", "component")])
        fits = f"component_x <> component_y AND n_y <= n_x AND {self.fits('n_x', 'place_x', 'n_y', 'place_y')}"
        one = x.filter("component_x <> most").join(y, "key").filter(fits)
        others = rows.filter("side = 1 AND component <> most").select("key", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "place", "component")])
        two = x.filter("component_x = most").join(others, "key").filter(fits)
        return one.unionByName(two).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))

    def sets(self, candidates: DataFrame) -> DataFrame:
        """(node, tokens): full sets of the classes that a candidate names, from their first texts."""
        ends = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(self.classes.select("node", "text_key").join(ends, "node", "left_semi"), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        every = self.docs.select(F.coalesce("doc_id", F.lit(int(LAST_ID))).alias("node"), "text_key", "text")
        texts = every.join(wanted, ["node", "text_key"], "left_semi")
        once = texts.groupBy("node", "text_key").agg(F.any_value("text").alias("text"))
        return stage(once.mapInArrow(_tokens(self.shingle), "node long, tokens array<long>"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that share a prefix token under every order and whose full sets are similar enough."""
        p = self.percent
        pairs = pairs.filter("a <> b").distinct()
        side = lambda end: self.orders_of.select(
            F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in self.others]
        )
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        for c in self.others:
            met = met.filter(F.arrays_overlap(f"{c}_a", f"{c}_b"))
        candidates = stage(met.select("a", "b").distinct(), "candidates")
        sets = self.sets(candidates)
        full = lambda end: sets.select(F.col("node").alias(end), F.col("tokens").alias(f"tokens_{end}"))
        shared = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
        union = F.size("tokens_a") + F.size("tokens_b") - shared
        confirmed = candidates.join(full("a"), "a").join(full("b"), "b").filter((shared > 0) & (100 * shared >= p * union))
        return stage(confirmed.select("a", "b").distinct(), "links")

    def found(self) -> DataFrame:
        """(node, component) of the nodes that have a link."""
        links, found = stage(classes_of_one_id(self.signed.filter("n > 0"), self.classes, ["n", "set_a", "set_b"], "node"), "links"), None
        for i in range(STAR_ROUNDS):
            state = stage(self.state(found), "state")
            more = self.links(self.star(state, i == 0))
            if i and more.isEmpty():
                break
            links = links.unionByName(more)
            found = components(links)
        state = stage(self.state(found), "state")
        more = self.links(self.rest(state))
        return found if more.isEmpty() else components(links.unionByName(more))


def jaccard_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE_WORDS, orders: int = ORDERS
) -> DataFrame:
    """``key``, n_shingles and component_id per row; documents link at 100 * intersection >= ``percent`` * union.

    Shingles are ``shingle`` words of the text with A-Z in lower case; a text with fewer words is one shingle, a null
    text or one without words has none and is linked with nothing. component_id is the smallest id that can be
    reached over links, itself included. Null ids sort after every number and stay null; rows with equal ids are one
    document with several texts. No link is lost; shingles compare by 64-bit hashes. Other columns are not read; an
    empty table gives an empty result.
    """
    if orders < 1 or not 1 <= percent <= 100:
        raise ValueError("one order at least, and a percentage from 1 to 100")
    job = JaccardJoin(df, key, text, percent, shingle, orders)
    found = job.found()
    least = job.classes.select("n", "set_a", "set_b", "node")
    own = (
        job.signed.select("id", "n", "set_a", "set_b")
        .join(least, ["n", "set_a", "set_b"], "left")
        .withColumn("node", F.coalesce("node", "id"))
        .join(found, "node", "left")
        .withColumn("component_id", F.coalesce("component", "node"))
    )
    real = lambda c: F.when(F.col(c) != F.lit(int(LAST_ID)), F.col(c))
    return own.select(real("id").alias(key), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"))
