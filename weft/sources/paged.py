"""A data source of post pages: one partition for each channel, pages followed until one is short.

Pages lie as JSON files, `<channel>/<page>.json`, with `order` (ids) and `posts` (by id),
as an API gives them. A reader for the network would take the place of read_page().
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZE = 200
SCHEMA = "id string, root_id string, channel_id string, user_id string, message string, create_at bigint, update_at bigint, delete_at bigint"
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class InvalidPage(ValueError):
    pass


def page_window(since: int | None = None, before: str | None = None, after: str | None = None) -> tuple[str, object] | None:
    """The one option that bounds a scan; more than one is an error."""
    given = [(k, v) for k, v in (("since", since), ("before", before), ("after", after)) if v is not None]
    if len(given) > 1:
        raise ValueError("since, before and after exclude each other")
    return given[0] if given else None


def page_rows(page: dict) -> list[tuple]:
    """Posts in the page's order; ids without a post are left out, posts without an id are an error."""
    if not isinstance(page.get("order"), list) or not isinstance(page.get("posts"), dict):
        raise InvalidPage("a page needs order and posts")
    rows = []
    for i in page["order"]:
        post = page["posts"].get(i)
        if post is None:
            continue
        if post.get("id") != i or any(int(post.get(k, 0)) < 0 for k in ("create_at", "update_at", "delete_at")):
            raise InvalidPage(f"not a post: {i}")
        rows.append(tuple(int(post.get(f, 0)) if f.endswith("_at") else post.get(f, "") for f in _FIELDS))
    return rows


class Channel(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = min(int(options.get("page_size", PAGE_SIZE)), PAGE_SIZE)
        self.window = page_window(int(options["since"]) if "since" in options else None, options.get("before"), options.get("after"))

    def partitions(self) -> list[InputPartition]:
        return [Channel(c) for c in sorted(os.listdir(self.path))]

    def read_page(self, channel: str, page: int) -> dict | None:
        name = f"{self.path}/{channel}/{page}.json"
        if not os.path.exists(name):
            return None
        with open(name) as f:
            return json.load(f)

    def read(self, partition: Channel) -> Iterator[tuple]:
        page, on = 0, self.window is None or self.window[0] != "before"
        while (got := self.read_page(partition.name, page)) is not None:
            for row in page_rows(got):
                if self.window and self.window[0] == "since" and max(row[6], row[7]) < self.window[1]:
                    continue
                if self.window and self.window[0] == "after" and row[0] == self.window[1]:
                    return
                if on:
                    yield row
                on = on or row[0] == self.window[1]
            if len(got["order"]) < self.size:
                return
            page += 1


class PostPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "post_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)
