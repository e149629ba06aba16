"""A paged REST source as a Python data source: one partition a page, retries inside the reader."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, tries: int = 5, wait_429: float = 60.0) -> bytes:
    """The body of a page; waits a minute on 429 and doubling times on server errors."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=120) as r:  # noqa: S310
                return r.read()
        except urllib.error.HTTPError as e:
            if k == tries - 1 or (e.code != 429 and e.code < 500):
                raise
            time.sleep(wait_429 if e.code == 429 else 2.0**k)
    raise RuntimeError("no tries left")


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.total = options["url"], int(options["total"])
        self.size, self.field = int(options.get("page_size", 250)), options.get("field", "items")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(at) for at in range(0, self.total, self.size)]

    def read(self, partition: InputPartition):
        join = "&" if "?" in self.url else "?"
        page = json.loads(fetch(f"{self.url}{join}offset={partition.value}&limit={self.size}"))
        for item in page.get(self.field, []):
            yield (partition.value, json.dumps(item, ensure_ascii=False))


class PagedRest(DataSource):
    """``spark.read.format("paged_rest").option("url", ...).option("total", n).load()`` after ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "page_offset int, item string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)
