"""A paged listing as a Spark data source with one input partition a page.

``fetch`` is any callable (offset) -> list of JSON texts; the default reads a local directory of saved
pages, since network access is left to the caller."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 10


class Page(InputPartition):
    def __init__(self, number: int, offset: int):
        self.number, self.offset = number, offset


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.dir = options["path"]
        self.limit = int(options.get("limit", -1))

    def partitions(self):
        n = len([f for f in os.listdir(self.dir) if f.endswith(".page")])
        pages = [Page(i + 1, i * STEP) for i in range(n)]
        return pages if self.limit < 0 else [p for p in pages if p.offset < self.limit]

    def read(self, partition):
        with open(os.path.join(self.dir, f"{partition.number}.page"), encoding="utf-8") as f:
            rows = [line.rstrip("\n") for line in f if line.strip()]
        if self.limit >= 0:
            rows = rows[: max(0, self.limit - partition.offset)]
        for i, line in enumerate(rows):
            yield partition.number, partition.offset + i, line


class PagedListing(DataSource):
    """``spark.dataSource.register(PagedListing)``; ``spark.read.format("paged_listing").load(dir)``."""

    @classmethod
    def name(cls):
        return "paged_listing"

    def schema(self):
        return "page int, position int, line string"

    def reader(self, schema):
        return _Reader(self.options)
