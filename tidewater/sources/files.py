"""File sources: parquet, CSV, JSON and text with explicit schemas and path-derived columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File schemas and folder layouts of the market feeds.
OHLC_SCHEMA = "timestamp bigint, open double, high double, low double, close double, volume double"
NEWS_SCHEMA = (
    "category string, datetime bigint, headline string, id bigint, image string, "
    "related string, source string, summary string, url string"
)
FORMATS = ("parquet", "csv", "json", "text")
OHLC_PATH = r"/([^/]+)/[^/]+\.gz$"
NEWS_PATH = r"/([^/]+)/news\.json$"
FILING_PATH = r"/([^/]+)/10-Q/([^/]+)/full-submission\.txt$"


@dataclass(frozen=True)
class FileSource:
    paths: tuple[str, ...]
    format: str = "parquet"
    schema: str | None = None
    options: dict = field(default_factory=dict)
    include_paths: bool = False

    def read(self, spark: SparkSession) -> DataFrame:
        """Lazy scan; a pattern that matches nothing gives an empty table when the schema is known."""
        if self.format not in FORMATS:
            raise ValueError(f"unsupported file format: {self.format}")
        reader = spark.read.format(self.format)
        if self.format == "csv":
            reader = reader.option("header", True)
        for name, value in self.options.items():
            reader = reader.option(name, value)
        schema = "value string" if self.format == "text" else self.schema
        if schema:
            reader = reader.schema(schema)
        try:
            df = reader.load(list(self.paths))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND" or schema is None:
                raise
            empty = f"{schema}, path string" if self.include_paths else schema
            return spark.createDataFrame([], empty)
        return df.withColumn("path", F.col("_metadata.file_path")) if self.include_paths else df


def ohlc_files(*paths: str) -> FileSource:
    return FileSource(paths, "csv", OHLC_SCHEMA, {"mode": "PERMISSIVE"}, include_paths=True)


def news_files(*paths: str, multi_line: bool = False) -> FileSource:
    """Records one per line (splittable) or, with ``multi_line``, one array per file."""
    return FileSource(paths, "json", NEWS_SCHEMA, {"multiLine": multi_line}, include_paths=True)


def whole_documents(*paths: str) -> FileSource:
    """One row per file, for pages and filings."""
    return FileSource(paths, "text", options={"wholetext": True}, include_paths=True)


def text_lines(*paths: str) -> FileSource:
    return FileSource(paths, "text", include_paths=True)
