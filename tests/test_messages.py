"""Stored messages by offsets, and the cooldown over a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.sources import message_log
from tidewater.sources.message_log import MessageLogReader, OffsetRange, append_messages, drain_messages, message_stream, share
from tidewater.streaming import cooldown, windows

SCHEMA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"


def messages(spark, places):
    """Messages of {(topic, partition): (first offset, end)}."""
    rows = [
        (None if o % 3 else b"k", f"{t}-{p}-{o}".encode(), t, p, o, None, 0)
        for (t, p), (first, end) in places.items()
        for o in range(first, end)
    ]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_seconds(F.col("offset")))


def read(reader, start, end):
    return [
        (r["topic"], r["partition"], r["offset"], r["value"].decode())
        for part in reader.partitions(start, end)
        for batch in reader.read(part)
        for r in batch.to_pylist()
    ]


def test_a_batch_is_a_bounded_range_of_offsets(spark, tmp_path):
    path = str(tmp_path / "log")
    append_messages(messages(spark, {("a/b", 0): (5, 50), ("a/b", 1): (0, 10), ("c", 0): (0, 200)}), path, files=2)
    reader = MessageLogReader({"path": path, "maxOffsetsPerTrigger": "100"})
    position = reader.initialOffset()
    assert position == {"a/b": {"0": 5, "1": 0}, "c": {"0": 0}}
    seen, sizes = [], []
    while (end := reader.latestOffset()) != position:
        assert reader.latestOffset() == end  # asking twice plans no more
        got = read(reader, position, end)
        seen, position = seen + got, end
        sizes.append(len(got))
    assert sizes == [100, 100, 55]
    assert sorted(seen) == sorted(
        (t, p, o, f"{t}-{p}-{o}") for (t, p), (a, b) in {("a/b", 0): (5, 50), ("a/b", 1): (0, 10), ("c", 0): (0, 200)}.items() for o in range(a, b)
    )
    # what comes later goes on behind it, in a new place from its first message on
    append_messages(messages(spark, {("c", 0): (200, 203), ("d", 7): (4, 6)}), path)
    end = reader.latestOffset()
    assert [r[:3] for r in read(reader, position, end)] == [("c", 0, 200), ("c", 0, 201), ("c", 0, 202), ("d", 7, 4), ("d", 7, 5)]


def test_reset_rules(spark, tmp_path):
    path = str(tmp_path / "log")
    append_messages(messages(spark, {("a", 0): (3, 9), ("b", 0): (0, 4)}), path)
    start = lambda **o: MessageLogReader({"path": path, **o}).initialOffset()
    assert start() == start(startingOffsets="earliest") == {"a": {"0": 3}, "b": {"0": 0}}
    assert start(startingOffsets="latest", subscribe="a") == {"a": {"0": 9}}
    assert start(startingOffsets='{"a": {"0": 7}}') == {"a": {"0": 7}, "b": {"0": 0}}
    latest = MessageLogReader({"path": path, "startingOffsets": "latest"})
    assert latest.initialOffset() == latest.latestOffset()
    assert MessageLogReader({"path": str(tmp_path / "none")}).initialOffset() == {}
    for bad in ({"startingOffsets": "newest"}, {"maxOffsetsPerTrigger": "0"}):
        with pytest.raises(ValueError):
            MessageLogReader({"path": path, **bad})


def test_share_is_fair_and_whole():
    r = random.Random(4)
    for _ in range(200):
        waiting = {("t", i): r.choice([0, 1, 7, 1000]) for i in range(r.randint(0, 6))}
        cap = r.randint(1, 1500)
        got = share(waiting, cap)
        assert sum(got.values()) == min(cap, sum(waiting.values())) and all(0 <= got[p] <= waiting[p] for p in waiting)


def test_an_empty_range_reads_nothing(spark, tmp_path):
    assert list(MessageLogReader({"path": str(tmp_path)}).read(OffsetRange(("a", 0), 4, 4))) == []


def test_failed_batch_is_read_again_and_restart_goes_on(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / n) for n in ("log", "checkpoint", "out"))
    append_messages(messages(spark, {("a", 0): (0, 120), ("a", 1): (0, 130)}), path)
    tried = {}

    def fails_once(batch, batch_id):
        rows = sorted((r.partition, r.offset) for r in batch.collect())
        tried.setdefault(batch_id, []).append(rows)
        if batch_id == 1 and len(tried[1]) == 1:
            raise RuntimeError("lost")
        windows.batch_writer(out)(batch, batch_id)

    with pytest.raises(Exception, match="lost"):
        drain_messages(message_stream(spark, path, batch_size=100), checkpoint, fails_once)
    drain_messages(message_stream(spark, path, batch_size=100), checkpoint, fails_once)
    assert tried[1][0] == tried[1][1] and [len(tried[b][-1]) for b in (0, 1, 2)] == [100, 100, 50]
    append_messages(messages(spark, {("a", 0): (120, 190), ("z", 0): (0, 60)}), path)
    drain_messages(message_stream(spark, path, batch_size=100), checkpoint, windows.batch_writer(out))
    got = spark.read.parquet(out)
    assert got.count() == got.select("topic", "partition", "offset").distinct().count() == 380
    assert got.groupBy("batch_id").count().agg(F.max("count")).first()[0] == 100


def fold(rows, wait):
    last, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        out[i] = k not in last or t - last[k] >= wait
        if out[i]:
            last[k] = t
    return out


def test_streamed_cooldown_over_a_restart(spark, tmp_path):
    landing, checkpoint, out = (str(tmp_path / n) for n in ("landing", "checkpoint", "out"))
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "b", None]), 40_000 * i + r.randrange(90_000), i) for i in range(160)]
    rows.sort(key=lambda x: x[1])
    schema = "k string, t bigint, id bigint"
    stream = lambda: windows.landing_stream(spark, landing, "k string, t bigint, id bigint", files_per_trigger=1)
    events = lambda: stream().select("k", F.timestamp_millis("t").alias("ts"), "id")
    for half in (rows[:80], rows[80:]):
        for at in range(0, 80, 27):
            spark.createDataFrame(half[at : at + 27], schema).coalesce(1).write.mode("append").parquet(landing)
        with windows.rocksdb(spark):
            windows.drain(cooldown.stream_fired(events(), "k", "ts", "id", 120_000, "1 minute"), checkpoint, windows.batch_writer(out))
    got = {x.id: x.fired for x in spark.read.parquet(out).collect()}
    assert got == fold(rows, 120_000) and 20 < sum(got.values()) < 120


def test_streamed_cooldown_spares_exempt_rows(spark, tmp_path):
    landing, checkpoint, out = (str(tmp_path / n) for n in ("landing", "checkpoint", "out"))
    data = [("a", 0, 1, False), ("a", 0, 2, False), ("a", 10_000, 3, True), ("a", 120_000, 4, False), ("a", 120_001, 5, True)]
    spark.createDataFrame(data, "k string, t bigint, id bigint, free boolean").coalesce(1).write.parquet(landing)
    stream = windows.landing_stream(spark, landing, "k string, t bigint, id bigint, free boolean")
    events = stream.select("k", F.timestamp_millis(F.col("t") + 10**12).alias("ts"), "id", "free")
    with windows.rocksdb(spark):
        windows.drain(cooldown.stream_fired(events, "k", "ts", "id", 120_000, exempt=F.col("free")), checkpoint, windows.batch_writer(out))
    assert [x.fired for x in spark.read.parquet(out).orderBy("id").collect()] == [True, False, True, True, True]


def test_offsets_survive_json():
    position = {("a", 0): 5, ("a", 11): 7, ("b", 2): 0}
    assert message_log._from_json(json.loads(json.dumps(message_log._to_json(position)))) == position
