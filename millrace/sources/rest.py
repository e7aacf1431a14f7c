"""A paginated REST source: cursors followed, transient failures retried."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRANSIENT = (429, 500, 502, 503, 504)
Fetch = Callable[[str], tuple[int, dict[str, str], bytes]]


def fetch_url(url: str) -> tuple[int, dict[str, str], bytes]:
    try:
        with urlopen(url, timeout=30) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()


def waits(first: float = 1.0, times: int = 4) -> list[float]:
    """The pauses before each further attempt, every one twice as long."""
    return [first * 2**n for n in range(times)]


def _pause(headers: dict[str, str], planned: float) -> float:
    said = headers.get("Retry-After", "")
    return float(said) if said.replace(".", "", 1).isdigit() else planned


def with_retries(fetch: Fetch, url: str, schedule: list[float] | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body. Only transient failures are tried again, after the pauses of the schedule or what ``Retry-After`` says."""
    attempts = 0
    for planned in [*(waits() if schedule is None else schedule), None]:
        status, headers, body = fetch(url)
        attempts += 1
        if status < 400:
            return body
        if planned is None or status not in TRANSIENT:
            break
        sleep(_pause(headers, planned))
    raise OSError(f"{url}: status {status} after {attempts} attempts")


class Pages:
    """The rows of a paged resource: ``limit`` and ``since`` go with the first page only, then ``next`` is followed."""

    def __init__(self, base: str, since: str | None = None, page_size: int = 100, fetch: Fetch = fetch_url, sleep: Callable[[float], None] = time.sleep):
        asked = {"limit": page_size, "since": since}
        self.next: str | None = f"{base}?{urlencode({k: v for k, v in asked.items() if v})}"
        self.fetch, self.sleep = fetch, sleep

    def page(self) -> list[dict]:
        body = json.loads(with_retries(self.fetch, self.next, sleep=self.sleep))
        self.next = body.get("next")
        return body.get("results", body.get("data", []))

    def __iter__(self) -> Iterator[dict]:
        while self.next:
            yield from self.page()


pages = Pages


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in pages(partition.value, self.options.get("since"), int(self.options.get("page_size", "100"))):
            yield tuple(None if row.get(n) is None else str(row[n]) for n in self.names)


class RestSource(DataSource):
    """``spark.read.format("paged_rest").schema(...).load(url)``: text columns; several URLs, comma-separated, are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)
