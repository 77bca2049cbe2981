"""A paginated service as a Python data source: one partition a page range, retried pages.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("client", "package.module:factory").option("total", 5000).load()
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from folioforge.operators.external import retried

PAGE = 500


class Pages(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.client = options["client"]
        self.total = int(options["total"])
        self.page = int(options.get("page", PAGE))
        self.pages_a_task = int(options.get("pages_a_task", 4))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[InputPartition]:
        step = self.page * self.pages_a_task
        return [Pages(a, min(a + step, self.total)) for a in range(0, self.total, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        module, name = self.client.split(":")
        fetch = getattr(importlib.import_module(module), name)()
        for offset in range(partition.start, partition.end, self.page):
            limit = min(self.page, partition.end - offset)
            rows = retried(lambda o=offset, n=limit: fetch(o, n), self.attempts)
            for i, row in enumerate(rows):
                yield (offset + i, json.dumps(row, ensure_ascii=False))
            if len(rows) < limit:
                return  # the service has no more


class PagedSource(DataSource):
    """Rows (position long, record string as JSON) of ``client``: a factory of a function
    (offset, limit) -> list of records."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "position long, record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)


def sample_client():  # noqa: ANN201
    """A client over 1,234 made-up records, for tests."""

    def fetch(offset: int, limit: int) -> list[dict]:
        return [{"id": i, "title": f"Paper {i}"} for i in range(offset, min(offset + limit, 1234))]

    return fetch
