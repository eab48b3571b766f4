"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Longer documents are cut into full pieces; what is left of them and all other documents are items. Items above one
third of the capacity are *large*: at most two of them share a sequence, so they are matched greedily, the largest
first, each with the largest partner that still fits. Smaller items then go, the largest first, to the sequence whose
gap they fill best, or to a new one. Items are packed in groups of about ``GROUP_ITEMS`` (by hash of the row), each
group on its own, so a group costs the same on any amount of data and adds at most part of one sequence.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import encoded, ranges, stage

CAPACITY = 2048
GROUP_ITEMS = 25_000
MAX_CACHED_WORDS = 700_000
SLICE_BYTES = 1 << 21
RUNS_AT_ONCE = 64
CLOSING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation; an apostrophe can begin a token of letters
PLAIN = " ".join([*"abcdefghijklmnopqrstuvwxyz", *map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]), "straße", "niño"])
NOT_PLAIN = re.compile("[^ a-z\u00df-\u00f6\u00f8-\u00ff]")


def letters_only(stem: bytes) -> bytes | None:
    """The lower-cased stem if the tokenizer sees one run of letters in it, else None."""
    if stem.isalpha():
        return stem.lower()
    text = stem.decode()
    if not text.isalpha():
        return None
    if max(text) > "ÿ" and not unicodedata.normalize("NFC", text).lower().isalpha():
        return None
    return text.lower().encode() if max(text) <= "ÿ" else stem


class WordTokenizer:
    """Token ids of whole texts, with every distinct word encoded once.

    Blanks always separate tokens of the vocabulary this is meant for (its pre-tokenizer never joins over white
    space), so a text's ids are those of its blank-separated words in order. Words that are not known yet go to the
    tokenizer together, runs of letters without the punctuation that closes them: ``ends`` marks the ids that end such
    a run. Lower-case Latin letters are what the normalizer makes of them, so their runs skip it (``runs``).
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(file)
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        if any(not np.array_equal(*x) for x in zip(self._ids([PLAIN]), self._ids([PLAIN], runs=True))):
            self.runs = self.tokenizer  # this vocabulary splits or changes them in another way
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def _ids(self, texts: list[str], runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has; offsets, a third of the time, are left out."""
        by = self.runs if runs else self.tokenizer
        found = [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add words whose ids lie one after the other."""
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def learn(self, words: set[bytes]) -> None:
        """Add words that are not known yet."""
        stems: dict[bytes, int] = {}
        tails: dict[bytes, int] = {}
        plain, which, closed, other = [], [], [], []
        for w in words:
            run = w.rstrip(CLOSING)
            stem = run.lower() if run.isalpha() else letters_only(run)
            if stem is None:
                other.append(w)
            else:
                plain.append(w)
                which.append(stems.setdefault(stem, len(stems)))
                closed.append(tails.setdefault(w[len(run) :], len(tails)))
        if other:
            self._keep(other, *self._ids([w.decode() for w in other]))
        if not plain:
            return
        ids, sizes = self._stems(list(stems))
        tail_ids, tail_sizes = self._ids([w.decode() for w in tails])
        first, tail_first = np.cumsum(sizes) - sizes, np.cumsum(tail_sizes) - tail_sizes
        which, closed = np.array(which), np.array(closed)
        total = sizes[which] + tail_sizes[closed]
        out = np.empty(int(total.sum()), np.uint32)
        start = np.cumsum(total) - total
        out[ranges(start, sizes[which])] = ids[ranges(first[which], sizes[which])]
        out[ranges(start + sizes[which], tail_sizes[closed])] = tail_ids[ranges(tail_first[closed], tail_sizes[closed])]
        self._keep(plain, out, total)

    def _stems(self, stems: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters, one after the other, and how many each has."""
        ids, sizes = [], []
        for a in range(0, len(stems), RUNS_AT_ONCE):
            part = stems[a : a + RUNS_AT_ONCE]
            text = b" ".join(part).decode()
            own, _ = self._ids([text], runs=not NOT_PLAIN.search(text))
            cut = np.flatnonzero(self.ends[own]) + 1
            if len(cut) != len(part) or cut[-1] != len(own):  # one is not what the tokenizer takes for one run
                own, each = self._ids([w.decode() for w in part])
                cut = np.cumsum(each)
            ids.append(own)
            sizes.append(np.diff(cut, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts, which are split at ASCII white space only."""
        split = [x.split() for x in texts]
        words = list(chain.from_iterable(split))
        if len(self.known) > MAX_CACHED_WORDS:
            self.known.clear()
            self.ids, self.bounds = self.ids[:0], self.bounds[:1]
        which = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            unknown = [words[i] for i in missing.tolist()]
            self.learn(set(unknown))
            which[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        first, size = self.bounds[which], self.bounds[which + 1] - self.bounds[which]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - before[:-1], size) + np.arange(int(before[-1]))]
        cut = before[np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)]
        return [ids[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]


def worker_tokenizer(file: str) -> WordTokenizer:
    """The tokenizer of this Python worker with the words it has met; Spark keeps a worker for many tasks.

    Functions travel to workers by value, so their own globals do not outlive a task; the library's module does.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_word_tokenizers", {})
    if file not in kept:
        kept[file] = WordTokenizer(file)
    return kept[file]


def _pieces(file: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        tokenizer = worker_tokenizer(file)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = encoded(batch.column("text"))
            start = size = 0
            cuts = [0]
            for i, x in enumerate(texts):
                size += len(x)
                if size > SLICE_BYTES:
                    cuts.append(i + 1)
                    size = 0
            cuts.append(len(texts))
            keys = batch.column("key")
            for start, stop in zip(cuts, cuts[1:]):
                rows: dict[str, list] = {c: [] for c in ("at", "piece", "start", "length", "ids_crc32", "ids")}
                for i, ids in enumerate(tokenizer.encode(texts[start:stop]), start):
                    ids = np.concatenate([ids, end])
                    for p, a in enumerate(range(0, len(ids), capacity)):
                        own = ids[a : a + capacity].astype("<u4")
                        rows["at"].append(i)
                        rows["piece"].append(p)
                        rows["start"].append(a)
                        rows["length"].append(len(own))
                        rows["ids_crc32"].append(zlib.crc32(own.tobytes()))
                        rows["ids"].append(own if keep_ids else None)
                at = pa.array(rows["at"], pa.int64())
                columns = {
                    "key": keys.take(at),
                    "row_hash": batch.column("row_hash").take(at),
                    "piece": pa.array(rows["piece"], pa.int32()),
                    **{c: pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")},
                }
                if keep_ids:
                    columns["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
                yield pa.record_batch(columns)

    return run


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each item, and the number of sequences.

    Equal lengths are taken in the order given. ``gaps[g]`` stacks the sequences with a gap of exactly g, and a
    binary number with a bit per non-empty stack finds the smallest gap that is large enough.
    """
    lengths = np.asarray(lengths, np.int64)
    where = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable").tolist()
    size = lengths.tolist()
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    for i in order:  # the largest first lies at the end of each stack's turn
        if size[i] * 3 > capacity:
            stacks[size[i]].append(i)
            filled |= 1 << size[i]
    for s in stacks:
        s.reverse()
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    used = 0

    def take(n: int) -> int:
        nonlocal filled
        i = stacks[n].pop()
        if not stacks[n]:
            filled &= ~(1 << n)
        return i

    while filled:  # match the largest with the largest that still fits
        large = filled.bit_length() - 1
        i = take(large)
        where[i] = used
        room = capacity - large
        fits = filled & ((1 << (room + 1)) - 1)
        if fits:
            partner = fits.bit_length() - 1
            j = take(partner)
            where[j], offset[j] = used, large
            room -= partner
        if room:
            gaps[room].append(used)
            open_gaps |= 1 << room
        used += 1
    for i in order:
        n = size[i]
        if n * 3 > capacity:
            continue
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            bin_ = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, bin_ = capacity, used
            used += 1
        where[i], offset[i] = bin_, capacity - gap
        if gap > n:
            gaps[gap - n].append(bin_)
            open_gaps |= 1 << (gap - n)
    return where, offset, used


def _packed(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row_hash", "ascending"), ("key", "ascending"), ("piece", "ascending")])
        where, offset, _ = pack(group["length"].to_numpy(), capacity)
        base = group["pack_group"].to_numpy().astype(np.int64) << 32
        keep = group.select([c for c in group.schema.names if c not in ("pack_group", "row_hash")])
        return keep.append_column("sequence_id", pa.array(base + where)).append_column("offset", pa.array(offset))

    return run


def pack_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    keep_ids: bool = False,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` with ``keep_ids``).

    A document is its token ids and then ``end_id``; a null text is empty and is one piece of one id. Only documents
    above the capacity are cut. A sequence holds its pieces without gaps from offset 0. Repeated rows are packed each
    on its own; other columns are not read; an empty table gives an empty result.
    """
    file = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = df.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("row_hash")
    )
    kind = rows.schema["key"].dataType.simpleString()
    ids = ", ids array<int>" if keep_ids else ""
    columns = f"key {kind}, %spiece int, start long, length long, ids_crc32 long{ids}"
    pieces = stage(
        rows.mapInArrow(_pieces(file, capacity, end_id, keep_ids), columns % "row_hash long, "), "pieces"
    )
    full = pieces.filter(F.col("length") == capacity)
    groups = max(1, math.ceil(pieces.filter(F.col("length") < capacity).count() / group_items))
    packed = (
        pieces.filter(F.col("length") < capacity)
        .withColumn("pack_group", F.pmod(F.xxhash64("row_hash", "piece"), F.lit(groups)))
        .groupBy("pack_group")
        .applyInArrow(_packed(capacity), columns % "" + ", sequence_id long, offset long")
    )
    alone = full.drop("row_hash").withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(alone).withColumnRenamed("key", key)
