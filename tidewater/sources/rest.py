"""Paged REST source as a Python Data Source: pages are read by tasks, not by the driver.

    rest_records(spark, url=..., pagination="page", numPartitions=4)

A source ends at its first empty page, whatever comes behind it. Doubling and bisection find an empty page with a
few requests; the pages before it are dealt into even ranges, one a task. A task that meets an empty page on its way
ends there and leaves a row without a record, and ``rest_records`` cuts the landed rows at the first such page.
Each row is one record as JSON text.
"""

from __future__ import annotations

import base64
import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewater.session import scratch_path

# Retried statuses, list keys of a wrapped payload, defaults.
RETRY_STATUSES = (429, 500, 502, 503, 504)
RECORD_KEYS = ("results", "data", "items")
DEFAULT_RETRIES = 3
DEFAULT_TIMEOUT = 30.0
DEFAULT_TASKS = 4


def unwrap(payload) -> list:
    """Records of a payload: a list, the first list under a known key, or the single object."""
    if isinstance(payload, list):
        return payload
    if isinstance(payload, dict):
        return next((payload[k] for k in RECORD_KEYS if isinstance(payload.get(k), list)), [payload])
    return []


def auth_headers(options: dict) -> dict[str, str]:
    kind, token = options.get("auth_type", "none"), options.get("auth_token", "")
    if kind == "bearer":
        return {"Authorization": f"Bearer {token}"}
    if kind == "header":
        return {options.get("auth_key", "Authorization"): token}
    if kind == "basic":
        pair = f"{options.get('auth_username', '')}:{options.get('auth_password', '')}"
        return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}
    return {}


def http_fetch(options: dict, params: dict):
    """One request, repeated with growing pauses on throttling, server errors and lost or hung connections."""
    url = options["url"]
    if params:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
    headers = {"Content-Type": "application/json", **json.loads(options.get("headers", "{}")), **auth_headers(options)}
    request = urllib.request.Request(url, headers=headers, method=options.get("method", "GET"))
    retries = int(options.get("retries", DEFAULT_RETRIES))
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", DEFAULT_TIMEOUT))) as response:
                return json.load(response)
        except urllib.error.HTTPError as exc:
            if exc.code not in RETRY_STATUSES or attempt == retries:
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):  # lost, refused or hung
            if attempt == retries:
                raise
        time.sleep(2**attempt)


class PageRange(InputPartition):
    """Pages from ``first`` up to (not with) ``end``; without an end, up to the first empty page."""

    def __init__(self, first: int, end: int | None, paged: bool = True) -> None:
        super().__init__(first)
        self.first, self.end, self.paged = first, end, paged


class PagedRestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "page int, ordinal int, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedRestReader(dict(self.options))


class PagedRestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        parts = urllib.parse.urlparse(options.get("url", ""))
        if not parts.scheme or not parts.netloc:
            raise ValueError(f"url must have a scheme and a host: {options.get('url')!r}")
        self.options = options

    def partitions(self) -> list[InputPartition]:
        if self.options.get("pagination", "none") != "page":
            return [PageRange(1, 2, paged=False)]
        tasks = self._tasks()
        if tasks == 1:
            return [PageRange(1, None)]
        pages = self.an_empty_page() - 1
        cuts = [1 + pages * i // tasks for i in range(tasks + 1)]
        return [PageRange(a, b) for a, b in zip(cuts, cuts[1:]) if a < b] or [PageRange(1, 1)]

    def _tasks(self) -> int:
        return max(1, int(self.options.get("numpartitions", self.options.get("numPartitions", DEFAULT_TASKS))))

    def an_empty_page(self) -> int:
        """An empty page behind a page with records (or page 1), found by doubling and bisection."""
        fetch, delay = self._fetcher(), self._delay()

        def empty(page: int) -> bool:
            time.sleep(delay)
            return not unwrap(fetch(self.options, {self._page_param(): page}))

        low, high = 0, 1
        while not empty(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if empty(middle) else (middle, high)
        return high

    def _page_param(self) -> str:
        return self.options.get("page_param", "page")

    def _delay(self) -> float:
        return float(self.options.get("rate_limit_delay", 0.0))

    def _fetcher(self):
        """``fetcher`` = "module:function" replaces the HTTP call, for tests and custom transports."""
        target = self.options.get("fetcher")
        if not target:
            return http_fetch
        module, function = target.split(":")
        return getattr(importlib.import_module(module), function)

    def read(self, partition: PageRange) -> Iterator[tuple]:
        """Rows of a range; an empty page inside it is a row without a record, and ends the range."""
        fetch = self._fetcher()
        delay = self._delay() * (1 if partition.end is None else self._tasks())  # all tasks ask in turn
        page = partition.first
        while partition.end is None or page < partition.end:
            records = unwrap(fetch(self.options, {self._page_param(): page} if partition.paged else {}))
            for ordinal, record in enumerate(records):
                yield page, ordinal, json.dumps(record)
            if partition.paged and not records:
                if partition.end is not None:
                    yield page, None, None
                return
            page += 1
            if partition.paged:
                time.sleep(delay)


def rest_records(spark: SparkSession, **options) -> DataFrame:
    """page, ordinal and record (JSON text) of all pages before the first empty one, read once and landed.

    ``options`` are those of the source: url, pagination ("page" or "none"), numPartitions (tasks), page_param,
    rate_limit_delay (seconds between any two requests), headers, auth_*, retries, timeout.
    """
    spark.dataSource.register(PagedRestSource)
    path = scratch_path(spark, "pages")
    spark.read.format("paged_rest").options(**{k: str(v) for k, v in options.items()}).load().write.parquet(path)
    landed = spark.read.parquet(path)
    gap = landed.filter(F.col("record").isNull()).agg(F.min("page")).first()[0]
    kept = landed.filter(F.col("record").isNotNull())
    return kept if gap is None else kept.filter(F.col("page") < gap)
