"""Fetching pages: a Python data source with bounded retries and a delay.

``spark.read.format("http_pages").option("urls", json_list).load()`` gives one
row for each attempt of each URL.  The first attempt waits ``timeout`` seconds,
retries wait longer; an answer with an error status counts as a failed attempt.
The URLs are dealt to ``partitions`` tasks, each fetching one page at a time, so
the rate is bounded by partitions / delay; with ``stagger`` each task begins so
many seconds after the one before.  ``fetch_frame`` does the same for a table of
URLs, which never pass through the driver.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, is_external boolean, attempt int, status int, error string, body string"
#: Seconds: first attempt, retries, and the pause between fetches; retries after the first attempt.
TIMEOUT, RETRY_TIMEOUT, DELAY, RETRIES = 15.0, 20.0, 25.0, 3


def fetch(url: str, timeout: float) -> tuple[int | None, str | None, str | None]:
    """(status, error, body) of one attempt."""
    request = urllib.request.Request(url, headers={"User-Agent": "threadloom"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            charset = answer.headers.get_content_charset() or "utf-8"
            return answer.status, None, answer.read().decode(charset, "replace")
    except urllib.error.HTTPError as error:
        return error.code, None, None
    except (OSError, ValueError) as error:
        return None, f"{type(error).__name__}: {error}", None


class _Part(InputPartition):
    def __init__(self, number: int, urls: list[str]):
        super().__init__(None)
        self.number, self.urls = number, urls


class _Fetcher:
    """Attempts for URLs one after the other, by the options of the data source."""

    def __init__(self, options: dict):
        self.parts = max(1, int(options.get("partitions", 1)))
        self.delay, self.stagger = float(options.get("delay", DELAY)), float(options.get("stagger", 0))
        self.retries = int(options.get("retries", RETRIES))
        self.timeouts = float(options.get("timeout", TIMEOUT)), float(options.get("retrytimeout", RETRY_TIMEOUT))
        self.external = str(options.get("external", "false")).lower() == "true"

    def attempts(self, number: int, urls: Iterable[str]) -> Iterator[tuple]:
        time.sleep(number * self.stagger)
        for url in urls:
            for attempt in range(1, self.retries + 2):
                status, error, body = fetch(url, self.timeouts[attempt > 1])
                yield url, self.external, attempt, status, error, body
                time.sleep(self.delay)
                if error is None and status is not None and status < 400:
                    break


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls, self.fetcher = json.loads(options.get("urls", "[]")), _Fetcher(options)

    def partitions(self) -> list[InputPartition]:
        return [_Part(i, self.urls[i :: self.fetcher.parts]) for i in range(self.fetcher.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self.fetcher.attempts(partition.number, partition.urls)


class HttpPages(DataSource):
    """Options: urls (JSON list), partitions, delay, stagger, retries, timeout, retrytimeout, external."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch_pages(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """All attempts for a list of URLs (a frontier chunk; the list travels in the plan)."""
    spark.dataSource.register(HttpPages)
    reader = spark.read.format("http_pages").option("urls", json.dumps(urls))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def fetch_frame(urls: DataFrame, **options) -> DataFrame:
    """All attempts for the distinct ``url`` of a table; store the result, since reading it again would fetch again."""
    fetcher = _Fetcher({k.lower(): v for k, v in options.items()})
    kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = fetcher.attempts(TaskContext.get().partitionId(), (u for b in batches for u in b.column(0).to_pylist()))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return urls.select("url").where("url IS NOT NULL").distinct().repartition(fetcher.parts).mapInArrow(run, SCHEMA)


def landed(attempts: DataFrame) -> DataFrame:
    """(url, raw_content) of the attempts that were answered well."""
    return attempts.where(F.col("error").isNull() & (F.col("status") < 400)).select("url", F.col("body").alias("raw_content"))
