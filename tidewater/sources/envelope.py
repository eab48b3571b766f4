"""Message-broker source: reader options, envelope columns and payload decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

# Consumer defaults and the columns of one message.
BATCH_SIZE = 100
OFFSET_RESETS = ("earliest", "latest")
ENVELOPE_COLUMNS = ("key", "value", "topic", "partition", "offset", "timestamp")


@dataclass(frozen=True)
class MessageSource:
    """Topics of a broker, read by Spark's own connector (its jar must be on the class path)."""

    bootstrap_servers: str
    topics: tuple[str, ...]
    group_id: str = "default"
    auto_offset_reset: str = "earliest"
    batch_size: int = BATCH_SIZE
    consumer_config: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.topics:
            raise ValueError("at least one topic is required")
        if self.auto_offset_reset not in OFFSET_RESETS:
            raise ValueError(f"auto_offset_reset must be one of {OFFSET_RESETS}")

    def options(self) -> dict[str, str]:
        """Offsets are tracked by the query's checkpoint; the cap bounds one micro-batch."""
        return {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "subscribe": ",".join(self.topics),
            "startingOffsets": self.auto_offset_reset,
            "groupIdPrefix": self.group_id,
            "maxOffsetsPerTrigger": str(self.batch_size),
            **{f"kafka.{k}": str(v) for k, v in self.consumer_config.items()},
        }

    def stream(self, spark: SparkSession) -> DataStreamReader:
        return spark.readStream.format("kafka").options(**self.options())


def text_of(raw: Column) -> Column:
    """UTF-8 text of a binary column; bad bytes become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def decode(messages: DataFrame) -> DataFrame:
    """Envelope rows with text key, JSON value (null when the value is no JSON) and its text.

    ``timestampType`` -1 marks a message without a time stamp.
    """
    text = text_of(F.col("value"))
    kept = [c for c in ("topic", "partition", "offset") if c in messages.columns]
    return messages.select(
        F.when(F.length("key") > 0, text_of(F.col("key"))).alias("key"),
        F.try_parse_json(text).alias("value_json"),
        text.alias("value_text"),
        *kept,
        F.when(F.col("timestampType") != -1, F.col("timestamp")).alias("timestamp"),
    )


def decode_with(messages: DataFrame, decoder: Callable[[bytes], str]) -> DataFrame:
    """Decode values with a user function in Arrow batches.

    ``decoded`` is null and ``decode_error`` set where the function raises; the
    caller drops those rows or routes them to the dead-letter table.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            out, errors = [], []
            for value in values:
                try:
                    out.append(decoder(value))
                    errors.append(None)
                except Exception as exc:  # any decoder failure concerns one message only
                    out.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame({"decoded": out, "decode_error": errors})

    decode_udf = F.pandas_udf(run, "decoded string, decode_error string")
    return messages.withColumn("d", decode_udf("value")).select(
        *messages.columns, "d.decoded", "d.decode_error"
    )


def flatten(messages: DataFrame, payload_schema: str) -> DataFrame:
    """Object payloads as columns beside ``kafka_*`` columns; a payload column wins a name clash.

    Messages whose value is not a JSON object are left out.
    """
    text = text_of(F.col("value"))
    rows = messages.withColumn("v", F.from_json(text, payload_schema)).filter(
        F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT"))
    )
    payload = rows.schema["v"].dataType.names
    envelope = {
        "kafka_key": F.when(F.length("key") > 0, text_of(F.col("key"))),
        "kafka_topic": F.col("topic"),
        "kafka_partition": F.col("partition"),
        "kafka_offset": F.col("offset"),
        "kafka_timestamp": F.when(F.col("timestampType") != -1, F.col("timestamp")),
    }
    return rows.select(
        *[c.alias(n) for n, c in envelope.items() if n not in payload], *[F.col(f"v.{n}").alias(n) for n in payload]
    )
