"""Rows of a paged HTTP endpoint as a Spark source, a partition for each run of pages."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Rows a page, seconds between pages, tries of a page, seconds that a wait grows by with each, seconds a request may take.
PAGE, PAUSE, TRIES, BACK_OFF, TIMEOUT = 100, 1.5, 8, 4.0, 120.0
PAGES_PER_TASK = 50


class Unreadable(RuntimeError):
    """A page that could not be read, with its offset."""


class Pages(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        number = lambda name, default: float(options.get(name, default))
        self.endpoint, self.query = options["endpoint"], {k: options[k] for k in ("dataset", "config", "split") if k in options}
        self.page, self.limit, self.per_task = int(number("page", PAGE)), int(number("limit", 0)), int(number("pagespertask", PAGES_PER_TASK))
        self.pause, self.tries, self.back_off, self.timeout = number("pause", PAUSE), int(number("tries", TRIES)), number("backoff", BACK_OFF), number("timeout", TIMEOUT)

    def fetch(self, offset: int, length: int) -> dict:
        """A page, tried again with a wait that grows by a fixed step after a throttle (429), a server's error, a lost connection or a torn
        body; other refusals are not asked again."""
        target = f"{self.endpoint}?{urllib.parse.urlencode({**self.query, 'offset': offset, 'length': length})}"
        last: Exception | None = None
        for attempt in range(self.tries):
            time.sleep(attempt * self.back_off)
            try:
                with urllib.request.urlopen(target, timeout=self.timeout) as answer:  # noqa: S310 - the caller names the endpoint
                    return json.load(answer)
            except urllib.error.HTTPError as error:
                last = error
                if error.code != 429 and error.code < 500:
                    break
            except (OSError, ValueError) as error:
                last = error
        raise Unreadable(f"offset {offset}: {last}")

    def partitions(self) -> list[InputPartition]:
        """The first page tells how many rows there are; each task then takes a run of offsets."""
        total = int(self.fetch(0, 1).get("num_rows_total") or 0)
        end = min(total, self.limit) if self.limit > 0 else total
        step = self.page * self.per_task
        return [Pages(a, min(end, a + step)) for a in range(0, end, step)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        for offset in range(partition.start, partition.end, self.page):
            length = min(self.page, partition.end - offset)
            rows = self.fetch(offset, length).get("rows") or []
            for i, row in enumerate(rows[:length]):
                yield offset + i, json.dumps(row["row"], ensure_ascii=False, separators=(",", ":"))
            if len(rows) < length:  # the split ended early
                return
            time.sleep(self.pause)


class PagedRows(DataSource):
    """SRC-13. Options: endpoint, dataset, config, split, page, limit (0: all), pause, tries, backoff, timeout, pagesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "offset long, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def paged_rows(spark: SparkSession, endpoint: str, **options: str | int | float) -> DataFrame:
    """SRC-13: offset and row (JSON) of a split. A task that is tried again reads its own run of pages anew."""
    spark.dataSource.register(PagedRows)
    return spark.read.format("paged_rows").options(endpoint=endpoint, **{k: str(v) for k, v in options.items()}).load()
