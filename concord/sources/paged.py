"""Paginated feeds as a Spark data source: one partition a feed, which follows the feed's cursors on its executor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concord.session import ship
from concord.sources.feeds import follow_pages

MOST_PAGES = 8


class Feed(InputPartition):
    def __init__(self, name: str, url: str):
        self.name, self.url = name, url


class PagedReader(DataSourceReader):
    def __init__(self, feeds: list[tuple[str, str]], most: int, fetch: Callable[[str], dict | None]):
        self.feeds, self.most, self.fetch = feeds, most, fetch

    def partitions(self) -> list[Feed]:
        return [Feed(name, url) for name, url in self.feeds]

    def read(self, feed: Feed) -> Iterator[tuple[str, int, str]]:
        for number, payload in enumerate(follow_pages(self.whole, feed.url, self.most)):
            yield feed.name, number, json.dumps(payload)

    def whole(self, url: str) -> dict | None:
        """A page, or None if it can't be had: what came before it still counts."""
        try:
            page = self.fetch(url)
        except Exception:  # the caller's own; a feed that breaks off ends there
            return None
        return page if isinstance(page, dict) else None


def paged(spark: SparkSession, feeds: dict[str, str], fetch: Callable[[str], dict | None], most: int = MOST_PAGES) -> DataFrame:
    """feed, page_no (from 0), payload: the pages of each feed (name: first address), until one fails, names no next page, or is the `most`-th.

    fetch gets an address and gives the parsed page; it runs on executors and is what the caller brings. A feed without
    any page has no row.
    """

    class PagedFeeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return "concord_paged"

        def schema(self) -> str:
            return "feed string, page_no int, payload string"

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(sorted(json.loads(self.options["feeds"]).items()), int(self.options["most"]), fetch)

    ship(spark).dataSource.register(PagedFeeds)
    return spark.read.format("concord_paged").option("feeds", json.dumps(feeds)).option("most", most).load()
