"""Bars over HTTP: chunks from the newest back to the oldest, merged and checked.

``fetch(end, limit)`` returns up to limit bars that end at a date (None: the newest), oldest
first, and raises ``Busy`` when the server asks to wait. Chunks overlap by the bar at their
boundary, which has to agree.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..schema import OHLCV
from . import bars as B

CHUNK, ATTEMPTS = 5000, 5
Bar = tuple  #: (date, open, high, low, close, volume), all as text
Fetch = Callable[[str | None, int], list[Bar]]


class Busy(Exception):
    """The server wants fewer requests."""


def http_fetch(url: str, timeout: float = 30) -> Fetch:
    """A fetch that asks url (with {end} and {limit}) for a JSON list of objects with the bar's fields."""

    def fetch(end: str | None, limit: int) -> list[Bar]:
        try:
            with urllib.request.urlopen(url.format(end=end or "", limit=limit), timeout=timeout) as answer:
                rows = json.load(answer)
        except urllib.error.HTTPError as e:
            raise Busy(url) if e.code == 429 else e
        return [tuple(str(r[c]) for c in OHLCV) for r in rows]

    return fetch


def chunks(fetch: Fetch, limit: int = CHUNK, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Iterator[list[Bar]]:
    """Chunks from the newest back, until one isn't full or brings nothing older. Waits twice as long
    after each refusal."""
    end = None
    while True:
        for attempt in range(attempts):
            try:
                rows = fetch(end, limit)
                break
            except Busy:
                if attempt == attempts - 1:
                    raise
                wait(2.0**attempt)
        if rows:
            yield rows
        if len(rows) < limit or rows[0][0] == end:
            return
        end = rows[0][0]


def download(spark: SparkSession, fetch: Fetch, series_id: str = "all", limit: int = CHUNK, **options) -> DataFrame:
    """The bars of all chunks with days, or ContractError for a breach of the contract. A download
    comes through one connection, so its chunks are made DataFrames one by one."""
    frames = [spark.createDataFrame(rows, ", ".join(f"{c} string" for c in OHLCV)) for rows in chunks(fetch, limit, **options)]
    if not frames:
        raise B.ContractError("nothing was downloaded")
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    merged = B.merge_chunks(B.typed(every, series_id))
    first = B.violations(merged).head()
    if first:
        raise B.ContractError(f"{first['date']}: {first['rule']} ({first['value']})")
    return B.with_days(merged)
