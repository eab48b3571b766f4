"""Stored messages read by offsets, as a Python Data Source for streams.

    spark.dataSource.register(MessageLog)
    spark.readStream.format("message_log").option("path", ...).option("maxOffsetsPerTrigger", 100).load()

The log is a table of envelope rows in folders of topic and partition, as ``append_messages`` writes it. A batch is a
range of offsets per topic and partition, at most ``maxOffsetsPerTrigger`` of them in all, dealt by what is waiting
where. Spark keeps the ranges in the checkpoint: a failed batch is read again with the same messages, and a restart
goes on behind the last one. Planning reads file footers only; tasks read the ranges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewater.sources.envelope import BATCH_SIZE, OFFSET_RESETS

ENVELOPE = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
FOLDER = re.compile(r"/topic=([^/]*)/partition=(\d+)/[^/._][^/]*$")

Place = tuple[str, int]


def append_messages(messages: DataFrame, path: str, files: int = 1) -> None:
    """Append envelope rows to the log, sorted by offset in each of at most ``files`` files per topic and partition."""
    salted = messages.withColumn("_file", F.pmod(F.xxhash64("offset"), F.lit(files)))
    dealt = salted.repartition("topic", "partition", "_file").sortWithinPartitions("topic", "partition", "offset")
    dealt.drop("_file").write.mode("append").partitionBy("topic", "partition").parquet(path)


@dataclass
class Stored:
    """One file of the log: its place and the offsets it holds."""

    path: str
    place: Place
    first: int
    last: int


@dataclass
class OffsetRange(InputPartition):
    place: Place
    start: int
    end: int
    files: list[str] = field(default_factory=list)


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return ENVELOPE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return MessageLogReader(dict(self.options))


class MessageLogReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.topics = {t.strip() for t in options.get("subscribe", "").split(",") if t.strip()}
        self.cap = int(options.get("maxoffsetspertrigger", BATCH_SIZE))
        if self.cap < 1:
            raise ValueError("maxOffsetsPerTrigger must be at least 1")
        self.starting = options.get("startingoffsets", "earliest")
        if self.starting not in OFFSET_RESETS:
            try:
                self.starting = _from_json(json.loads(self.starting))
            except (ValueError, AttributeError):
                raise ValueError(f"startingOffsets must be one of {OFFSET_RESETS} or offsets by topic and partition") from None
        self.known: dict[str, Stored] = {}
        self.position: dict[Place, int] | None = None

    def stored(self) -> list[Stored]:
        """All files of the wanted topics; the footer of a file is read once."""
        system, root = _system(self.path)
        infos = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in infos:
            place = FOLDER.search(info.path)
            if info.type != pyarrow.fs.FileType.File or not place or info.path in self.known:
                continue
            topic = _plain(place[1])
            if self.topics and topic not in self.topics:
                continue
            with system.open_input_file(info.path) as file:
                footer = pq.ParquetFile(file).metadata
            at = footer.schema.names.index("offset")
            parts = [footer.row_group(i).column(at).statistics for i in range(footer.num_row_groups)]
            if footer.num_rows:
                self.known[info.path] = Stored(
                    info.path, (topic, int(place[2])), min(p.min for p in parts), max(p.max for p in parts)
                )
        return list(self.known.values())

    def _bounds(self) -> dict[Place, tuple[int, int]]:
        """First offset and the one behind the last, by place."""
        out: dict[Place, tuple[int, int]] = {}
        for s in self.stored():
            first, end = out.get(s.place, (s.first, s.last + 1))
            out[s.place] = min(first, s.first), max(end, s.last + 1)
        return out

    # -- called by Spark ------------------------------------------------------------------------------------------
    def initialOffset(self) -> dict:
        bounds = self._bounds()
        if self.starting == "earliest":
            self.position = {p: first for p, (first, _) in bounds.items()}
        elif self.starting == "latest":
            self.position = {p: end for p, (_, end) in bounds.items()}
        else:
            self.position = {p: self.starting.get(p, first) for p, (first, _) in bounds.items()}
        return _to_json(self.position)

    def latestOffset(self) -> dict:
        """Where the next batch ends: at most ``maxOffsetsPerTrigger`` behind the last planned one."""
        if self.position is None:
            self.initialOffset()
        ends = {p: end for p, (_, end) in self._bounds().items()}
        starts = {p: self.position.get(p, first) for p, (first, _) in self._bounds().items()}
        waiting = {p: max(0, ends[p] - starts[p]) for p in ends}
        taken = share(waiting, self.cap)
        return _to_json(self.position | {p: starts[p] + taken[p] for p in ends if taken[p] or p in self.position})

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin, stop = _from_json(start), _from_json(end)
        self.position = stop  # after a restart, Spark names the last batch here first
        out = []
        for place, last in sorted(stop.items()):
            files = sorted((s for s in self.stored() if s.place == place), key=lambda s: s.first)
            first = begin.get(place, files[0].first if files else 0)
            if first < last:
                out.append(OffsetRange(place, first, last, [s.path for s in files if s.first < last and s.last >= first]))
        return out

    def read(self, partition: OffsetRange) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        topic, number = partition.place
        own = ["key", "value", "offset", "timestamp", "timestampType"]
        tables = []
        for path in partition.files:
            with system.open_input_file(path) as file:
                tables.append(pq.read_table(file, columns=own, filters=[("offset", ">=", partition.start), ("offset", "<", partition.end)]))
        if not tables:
            return
        rows = pa.concat_tables(tables)
        rows = rows.take(pc.sort_indices(rows["offset"]))
        rows = rows.set_column(3, "timestamp", rows["timestamp"].cast(pa.timestamp("us", "UTC")))
        rows = rows.add_column(2, "topic", pa.array([topic] * rows.num_rows, pa.string()))
        rows = rows.add_column(3, "partition", pa.array([number] * rows.num_rows, pa.int32()))
        yield from rows.combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def share(waiting: dict[Place, int], cap: int) -> dict[Place, int]:
    """``cap`` messages over places in proportion to what waits there; what rounding leaves goes to the first ones."""
    total = sum(waiting.values())
    if total <= cap:
        return dict(waiting)
    out = {p: n * cap // total for p, n in waiting.items()}
    left = cap - sum(out.values())
    for p in sorted(waiting):
        if left and out[p] < waiting[p]:
            out[p] += 1
            left -= 1
    return out


def _plain(folder: str) -> str:
    """A folder name as Spark writes it, back to the value."""
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), folder)


def _to_json(position: dict[Place, int]) -> dict:
    out: dict[str, dict[str, int]] = {}
    for (topic, number), offset in sorted(position.items()):
        out.setdefault(topic, {})[str(number)] = offset
    return out


def _from_json(offsets: dict) -> dict[Place, int]:
    return {(topic, int(number)): int(offset) for topic, places in offsets.items() for number, offset in places.items()}


def message_stream(
    spark: SparkSession, path: str, topics: tuple[str, ...] = (), starting: str = "earliest", batch_size: int = BATCH_SIZE
) -> DataFrame:
    """The log as a stream of envelope rows in batches of at most ``batch_size`` messages; no topics: all."""
    spark.dataSource.register(MessageLog)
    reader = spark.readStream.format("message_log").option("path", path).option("startingOffsets", starting)
    if topics:
        reader = reader.option("subscribe", ",".join(topics))
    return reader.option("maxOffsetsPerTrigger", batch_size).load()


def drain_messages(messages: DataFrame, checkpoint: str, each_batch) -> StreamingQuery:
    """Work off everything that is in the log, batch by batch, then stop."""
    writer = messages.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
