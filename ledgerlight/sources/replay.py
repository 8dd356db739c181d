"""A batch source of paged answers kept as files: ``spark.read.format("paged_replay")``.

A folder holds one sub-folder per request, and in it one JSON file per page, named by
the token that asks for it (``first.json`` for none). A reader follows the tokens as a
client of the service would: every request is one partition, all its pages are read
or the read fails, so a run is appended whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "request string, page_number int, response_page_token string, next_page_token string, response_payload_json string, response_bytes bigint, response_sha256 string, records_received bigint"


def pages_of(folder: str, records: str, most_pages: int) -> Iterator[tuple]:
    """The pages of one request, in order; a ValueError where a token repeats, is blank or leads nowhere."""
    token, seen, number = None, set(), 0
    while True:
        number += 1
        path = os.path.join(folder, f"{token or 'first'}.json")
        if number > most_pages or not os.path.exists(path):
            raise ValueError(f"page {number} of {folder} is one too many or is not there")
        with open(path, "rb") as file:
            raw = file.read()
        page = json.loads(raw)
        following, held = page.get("next_page_token"), page.get(records)
        if following is not None and (not isinstance(following, str) or not following.strip() or os.sep in following or following in seen):
            raise ValueError(f"page {number} of {folder} names no new page")
        n = sum(map(len, held.values())) if isinstance(held, dict) else len(held or [])
        yield os.path.basename(folder), number, token, following, raw.decode(), len(raw), hashlib.sha256(raw).hexdigest(), n
        if following is None:
            return
        seen.add(following)
        token = following


class _Request(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class _Reader(DataSourceReader):
    def __init__(self, options):
        self._root, self._records, self._most = options["path"], options.get("records", "bars"), int(options.get("mostPages", "100"))

    def partitions(self):
        return [_Request(e.path) for e in sorted(os.scandir(self._root), key=lambda e: e.name) if e.is_dir()]

    def read(self, partition):
        return pages_of(partition.folder, self._records, self._most) if partition else iter(())


class PagedReplay(DataSource):
    """Options: path (a folder that all executors see), records (the field that holds them), mostPages."""

    @classmethod
    def name(cls):
        return "paged_replay"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedReplay)
