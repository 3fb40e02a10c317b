"""Pages of the web as a data source: `spark.read.format("web")` and `spark.readStream.format("web")`.

The pages asked for are numbered: `template` is a URL with `{}` for the number (a feed, an archive, a listing), or `urls` is a JSON list
that the number counts through. The number is the page_id and the stream's offset. A batch reads `first` to `last`; a stream asks the
URL `newest` for the newest page's number (or takes `last`) and reads what is new since its checkpoint, so the same offsets always
mean the same pages and a batch that is run again asks for the same ones. Partitions are ranges of numbers, `per_partition` each, fetched by
the executors under a `sources.fetch` policy; a page that fails has an empty html. Register with `register(spark)`.

Options: template or urls; first (0), last, newest; per_partition (100); policy (only_ok, no_errors, any_status); at_once (8).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siltstone.sources import fetch
from siltstone.sources.landed import RAW_PAGES

POLICIES = {"only_ok": fetch.ONLY_OK, "no_errors": fetch.NO_ERRORS, "any_status": fetch.ANY_STATUS}


@dataclass
class Range(InputPartition):
    """Pages first to end - 1."""

    first: int
    end: int


class _Pages:
    """What both readers share: the options, ranges, and reading one."""

    def __init__(self, options: dict[str, str]) -> None:
        self.urls = json.loads(options["urls"]) if "urls" in options else None
        self.template = options.get("template")
        if (self.urls is None) == (self.template is None):
            raise ValueError("either template or urls says which pages there are")
        self.first = int(options.get("first", 0))
        last = options.get("last", None if self.urls is None else len(self.urls) - 1)
        self.last = None if last is None else int(last) if self.urls is None else min(int(last), len(self.urls) - 1)
        self.newest = options.get("newest")
        self.size, self.at_once = int(options.get("per_partition", 100)), int(options.get("at_once", 8))
        self.policy = POLICIES[options.get("policy", "only_ok")]

    def url(self, number: int) -> str:
        return self.template.replace("{}", str(number)) if self.urls is None else self.urls[number]

    def ranges(self, first: int, end: int) -> list[Range]:
        return [Range(a, min(a + self.size, end)) for a in range(first, end, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(self.at_once) as pool:
            for a in range(partition.first, partition.end, self.at_once):
                numbers = range(a, min(a + self.at_once, partition.end))
                urls = [self.url(n) for n in numbers]
                html = list(pool.map(lambda url: fetch.body(url, self.policy), urls))
                yield pa.record_batch({"page_id": pa.array(numbers, pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(html, pa.string())})


class WebReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Range]:
        if self.last is None:
            raise ValueError("a batch needs the last page's number")
        return self.ranges(self.first, self.last + 1) or [Range(0, 0)]


class WebStreamReader(_Pages, DataSourceStreamReader):
    """Offsets are numbers of the next page."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self.last
        if self.newest:
            told = fetch.body(self.newest, fetch.ONLY_OK).strip()
            last = int(told) if told.isdigit() else self.first - 1
            last = last if self.last is None else min(last, self.last)
        if last is None:
            raise ValueError("a stream needs last or newest")
        return {"next": max(last + 1, self.first)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start["next"], end["next"])

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class Web(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return RAW_PAGES

    def reader(self, schema) -> WebReader:  # noqa: ANN001, ARG002
        return WebReader(self.options)

    def streamReader(self, schema) -> WebStreamReader:  # noqa: ANN001, ARG002, N802
        return WebStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Web)
