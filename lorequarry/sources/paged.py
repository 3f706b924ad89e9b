"""A paged service as a source of its own: ``spark.read.format(name)``.

A page is a partition.  A limit, an option of the reader, decides how many pages
are asked for; equalities and lower or upper bounds on stated columns become part
of the request.  Each task waits and tries again on its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.types import StructType

from lorequarry.sources.services import ATTEMPTS, PAUSE_SECONDS, WAIT_SECONDS, TooManyRequests

PAGE_SIZE = 100

#: From a request (the query and what was pushed), a page's number and size, to its rows.
FetchPage = Callable[[dict, int, int], Iterable[tuple]]


@dataclass
class Page(InputPartition):
    """A page, and how many of its rows are wanted."""

    number: int
    rows: int


class PagedReader(DataSourceReader):
    def __init__(self, fetch: FetchPage, options: Mapping[str, str], pushed: tuple[str, ...]) -> None:
        self.fetch, self.pushed = fetch, pushed
        self.size, self.limit = int(options.get("pageSize", PAGE_SIZE)), int(options["limit"])
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.wait, self.pause = float(options.get("wait", WAIT_SECONDS)), float(options.get("pause", PAUSE_SECONDS))
        self.request: dict = {"query": options.get("query", "")}

    def partitions(self) -> list[Page]:
        """The pages that the limit needs, the last for the rows that are left; for none
        one that nothing is asked for."""
        return [Page(n, min(self.size, self.limit - n * self.size)) for n in range(-(-self.limit // self.size))] or [Page(0, 0)]

    def read(self, page: Page) -> Iterator[tuple]:
        """The rows of a page.  An error is followed by a pause and another attempt, and a
        service that asks its callers to slow down is waited for; when every attempt has
        failed, so has the task.  A page that came is followed by a pause as well."""
        if not page.rows:
            return
        for left in range(self.attempts - 1, -1, -1):
            try:
                found = list(self.fetch(self.request, page.number, self.size))
                break
            except Exception as e:  # the service's own errors are not known here
                if not left:
                    raise
                time.sleep(self.wait if isinstance(e, TooManyRequests) else self.pause)
        time.sleep(self.pause)
        yield from found[: page.rows]


class PushingReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the service's own columns go into the request; others come back."""
        names = {EqualTo: "", GreaterThanOrEqual: "_min", LessThanOrEqual: "_max"}
        for f in filters:
            key = f"{f.attribute[0]}{names[type(f)]}" if type(f) in names and len(f.attribute) == 1 and f.attribute[0] in self.pushed else None
            if key is None or key in self.request:
                yield f
            else:
                self.request[key] = f.value


def register_paged(spark: SparkSession, name: str, fetch: FetchPage, schema: str, pushed: tuple[str, ...] = ()) -> None:
    """Make ``spark.read.format(name).option("limit", n).load()`` a table of the service's rows.

    ``fetch`` runs on the executors and gives tuples of ``schema``; a page beyond the last
    is empty.  ``pushed`` are the columns that a request may bound: ``year`` comes as
    ``year``, ``year_min`` or ``year_max``.  Rows are limited after those filters, and
    before any that Spark applies.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> PagedReader:
            return (PushingReader if pushed else PagedReader)(fetch, self.options, pushed)

    if pushed:  # off by default, and a reader that pushes fails where it is
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
