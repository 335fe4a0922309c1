"""A paged API as a Python data source: one partition for each date, pages are fetched until a short one, offline from stored responses or from an injected client."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(request: Callable[[str, int, int], list[dict]], day: str, page_size: int = 25_000, max_rows: int = 1_000_000) -> Iterator[dict]:
    """Rows of a day, page by page. The last row of a pull that reaches ``max_rows`` has ``truncated``."""
    start = 0
    while True:
        rows = request(day, start, page_size)
        for i, row in enumerate(rows):
            yield row | {"date": day, "truncated": start + i + 1 >= max_rows}
            if start + i + 1 >= max_rows:
                return
        if len(rows) < page_size:
            return
        start += page_size


class _Day(InputPartition):
    def __init__(self, day: str):
        self.day = day


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_Day(x.strip()) for x in self.options["dates"].split(",") if x.strip()]

    def read(self, partition):
        folder = Path(self.options["folder"])
        size = int(self.options.get("pageSize", "25000"))

        def stored(day: str, start: int, n: int) -> list[dict]:
            file = folder / f"{day}-{start // n}.json"
            return json.loads(file.read_text()).get("rows", []) if file.exists() else []

        for row in fetch(stored, partition.day, size, int(self.options.get("maxRows", "1000000"))):
            yield (row["date"], row["keys"], int(row["clicks"]), int(row["impressions"]), float(row["position"]), row["truncated"])


class StoredPages(DataSource):
    @classmethod
    def name(cls):
        return "stored_pages"

    def schema(self):
        return "date string, keys array<string>, clicks long, impressions long, position double, truncated boolean"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredPages)
