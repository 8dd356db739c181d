"""Paged answers as a stream that can resume: ``spark.readStream.format("paged_stream")``.

The folder is that of ``paged_replay``: one sub-folder per request, one JSON file per
page, each naming the token of the next. The stream's offset says of every request how
many of its pages have been read and which token asks for the next, so Spark's own
checkpoint holds the cursor: a run that stops in the middle goes on with the page that
follows, and a batch that is tried again reads the same pages. A page that is not there
yet is waited for; one that breaks the rules fails the query.

With ``follow`` a page's answer is a list of further documents (the second hop): once
new pages are known, their lists are cut into partitions of their own, so documents are
fetched side by side by many tasks, each once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "request string, hop int, page_number int, response_page_token string, document string, response_payload string, response_bytes bigint, response_sha256 string, records_received bigint"


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _next_token(page: dict, token: str | None, folder: str) -> str | None:
    following = page.get("next_page_token")
    if following is not None and (not isinstance(following, str) or not following.strip() or os.sep in following or following == token):
        raise ValueError(f"a page of {folder} names no new page")
    return following


def advance(folder: str, at: dict, most_pages: int) -> dict:
    """The cursor of a request after all pages that are there: number of pages, the token of the next, whether the last was the end."""
    page, token, ended = at["page"], at["token"], at["ended"]
    while not ended:
        path = os.path.join(folder, f"{token or 'first'}.json")
        if not os.path.exists(path):
            break
        if page >= most_pages:
            raise ValueError(f"{folder} has more than {most_pages} pages")
        token = _next_token(json.loads(_read(path)), token, folder)
        page, ended = page + 1, token is None
    return {"page": page, "token": token, "ended": ended}


def pages_between(folder: str, start: dict, end: dict) -> Iterator[tuple[int, str | None, bytes, dict]]:
    """Number, token, bytes and content of a request's pages after one cursor up to another."""
    token = start["token"]
    for number in range(start["page"] + 1, end["page"] + 1):
        raw = _read(os.path.join(folder, f"{token or 'first'}.json"))
        page = json.loads(raw)
        yield number, token, raw, page
        token = _next_token(page, token, folder)


class _Pages(InputPartition):
    def __init__(self, folder: str, start: dict, end: dict):
        super().__init__((folder, start["page"], end["page"]))
        self.folder, self.start, self.end = folder, start, end


class _Documents(InputPartition):
    def __init__(self, folder: str, listed: list[tuple[int, str]]):
        super().__init__((folder, listed))
        self.folder, self.listed = folder, listed


_BEGIN = {"page": 0, "token": None, "ended": False}


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self._root, self._records, self._follow = options["path"], options.get("records", "bars"), options.get("follow")
        self._most, self._together = int(options.get("mostPages", "10000")), int(options.get("documentsPerPartition", "16"))
        self._known: dict[str, dict] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        for entry in sorted(os.scandir(self._root), key=lambda e: e.name):
            if entry.is_dir():
                self._known[entry.name] = advance(entry.path, self._known.get(entry.name, _BEGIN), self._most)
        return dict(self._known)

    def partitions(self, start, end):
        found: list[InputPartition] = []
        for request, cursor in sorted(end.items()):
            before, folder = start.get(request, _BEGIN), os.path.join(self._root, request)
            if cursor["page"] <= before["page"]:
                continue
            found.append(_Pages(folder, before, cursor))
            if self._follow:
                listed = [(number, name) for number, _, _, page in pages_between(folder, before, cursor) for name in page.get(self._follow) or []]
                found += [_Documents(folder, listed[k : k + self._together]) for k in range(0, len(listed), self._together)]
        return found

    def read(self, partition):
        request = os.path.basename(partition.folder)
        if isinstance(partition, _Pages):
            for number, token, raw, page in pages_between(partition.folder, partition.start, partition.end):
                held = page.get(self._records)
                n = sum(map(len, held.values())) if isinstance(held, dict) else len(held or [])
                yield request, 1, number, token, None, raw.decode(), len(raw), hashlib.sha256(raw).hexdigest(), n
        else:
            for number, name in partition.listed:
                if os.sep in name or not name:
                    raise ValueError("a document name is no path")
                raw = _read(os.path.join(partition.folder, "documents", name))
                yield request, 2, number, None, name, raw.decode(), len(raw), hashlib.sha256(raw).hexdigest(), 1

    def commit(self, end):
        pass


class PagedStream(DataSource):
    """Options: path (a folder that all executors see), records, follow (the field that lists documents), mostPages, documentsPerPartition."""

    @classmethod
    def name(cls):
        return "paged_stream"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedStream)


def append_new_pages(spark: SparkSession, source: str, target: str, checkpoint: str, **options: str) -> None:
    """Appends to ``target`` (Parquet) what has come since the last run with this checkpoint, and returns."""
    register(spark)
    rows = spark.readStream.format("paged_stream").options(path=source, **options).load()
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
