"""Link probing: classification, retries, and the capture job.

The library opens no connection itself.  Responses come from a table captured
elsewhere or from a fetch function given by the caller.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import CAPTURE_MAX_BYTES, MAX_ATTEMPTS
from ..functions.responses import content_signature, success_rate, with_verdict
from ..functions.urls import is_probeable
from ..schema import RESPONSE
from ..workspace import materialize
from .lookup import lookup

# fetch(link, timeout_seconds) -> (status, icy_br, first bytes of the body)
Fetch = Callable[[str, float], tuple[int | None, str | None, bytes | None]]

# Answers that a task holds before it hands them on, some kilobytes each.
_ANSWERS = 256


def probe_results(classified: DataFrame) -> DataFrame:
    """One row per link: alive if one of the first attempts was; its info."""
    alive_attempt = F.when(F.col("is_alive"), F.col("attempt"))
    return (
        classified.where(F.col("attempt") < MAX_ATTEMPTS)
        .groupBy("link")
        .agg(
            F.bool_or("is_alive").alias("is_alive"),
            F.min_by("stream_info", alive_attempt).alias("stream_info"),
        )
    )


def _per_link(channels: DataFrame, table: DataFrame) -> DataFrame:
    """Join a one-row-per-link table to channels, however often a link occurs."""
    return lookup(channels, table, "link", F.col("id"))


def filter_working(channels: DataFrame, results: DataFrame) -> DataFrame:
    """Rows with a working link, in their order, with what the probe found."""
    found = results.where("is_alive").select(
        "link", F.lit(True).alias("_alive"), F.col("stream_info").alias("_info")
    )
    return (
        _per_link(channels, found)
        .where("_alive")
        .withColumn("stream_info", F.coalesce("_info", "stream_info"))
        .select(*channels.columns)
    )


def attach_content_hash(channels: DataFrame, responses: DataFrame) -> DataFrame:
    """Set ``content_hash`` from the first response of each link."""
    hashes = (
        responses.where("attempt = 0")
        .select("link", content_signature(F.col("status"), F.col("body")).alias("_hash"))
        .where("_hash is not null")
        .groupBy("link")
        .agg(F.min("_hash").alias("_hash"))
    )
    return (
        _per_link(channels, hashes)
        .withColumn("content_hash", F.col("_hash"))
        .select(*channels.columns)
    )


def link_counts(channels: DataFrame, results: DataFrame) -> DataFrame:
    """Working and failed rows and the success rate, as one row."""
    flags = results.select("link", F.col("is_alive").alias("_alive"))
    alive = F.coalesce("_alive", F.lit(False))
    return (
        _per_link(channels, flags)
        .agg(F.count_if(alive).alias("working"), F.count_if(~alive).alias("failed"))
        .withColumn("success_rate", success_rate(F.col("working"), F.col("working") + F.col("failed")))
    )


def capture(links: DataFrame, fetch: Fetch, attempt: int, concurrency: int, timeout: float) -> DataFrame:
    """Fetch every link once, ``concurrency`` at a time per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(link: str):
            try:
                status, icy_br, body = fetch(link, timeout)
            except Exception:  # a link that cannot be fetched is a dead link
                status, icy_br, body = None, None, None
            return link, attempt, status, icy_br, bytes((body or b"")[:CAPTURE_MAX_BYTES])

        rows: list[tuple] = []

        def held(row: tuple | None) -> Iterator[pd.DataFrame]:
            """Answers in frames of bounded size; None asks for the rest."""
            if row is not None:
                rows.append(row)
            if rows and (row is None or len(rows) >= _ANSWERS):
                out = pd.DataFrame(rows, columns=RESPONSE.names)
                rows.clear()
                yield out.astype({"status": "Int32", "attempt": "Int32"})

        with ThreadPoolExecutor(concurrency) as pool:
            # Links are handed out as answers come in; few answers are held at once.
            waiting: deque[Future] = deque()
            for batch in batches:
                for link in batch["link"]:
                    waiting.append(pool.submit(one, link))
                    if len(waiting) >= 2 * concurrency:
                        yield from held(waiting.popleft().result())
            while waiting:
                yield from held(waiting.popleft().result())
            yield from held(None)

    return links.select("link").mapInPandas(run, RESPONSE)


def capture_once(
    channels: DataFrame, fetch: Fetch, concurrency: int = 10, timeout: float = 10.0
) -> DataFrame:
    """One written response for each distinct link of the channels."""
    links = channels.where(is_probeable(F.col("link"))).select("link").distinct()
    tasks, each = _dealt(links, concurrency)
    return materialize(capture(links.repartition(tasks, "link"), fetch, 0, each, timeout), "captured")


def _dealt(links: DataFrame, concurrency: int, partitions: int | None = None) -> tuple[int, int]:
    """Tasks and requests of each at a time, so that the whole job never has more than ``concurrency`` in flight.

    The limit is from 1 to 50.  There are no more tasks than requests, so it holds
    however many of them run at once.
    """
    limit = max(1, min(50, concurrency))
    tasks = max(1, min(limit, partitions or links.sparkSession.sparkContext.defaultParallelism))
    return tasks, limit // tasks


def probe_links(
    channels: DataFrame,
    fetch: Fetch,
    concurrency: int = 10,
    timeout: float = 10.0,
    partitions: int | None = None,
) -> DataFrame:
    """Capture and classify the distinct links of the channels.

    Every attempt is one pass over the links not yet alive, written down before
    it is judged, so that a lost executor repeats requests but never mixes two
    answers.  The whole job has at most ``concurrency`` requests in flight.
    """
    tasks, each = _dealt(channels, concurrency, partitions)
    todo = materialize(channels.where(is_probeable(F.col("link"))).select("link").distinct(), "links")
    attempts = None
    for attempt in range(MAX_ATTEMPTS):
        spread = todo.repartition(tasks, "link")
        captured = materialize(capture(spread, fetch, attempt, each, timeout), "captured")
        classified = with_verdict(captured).select("link", "attempt", "is_alive", "stream_info")
        attempts = classified if attempts is None else attempts.unionByName(classified)
        todo = todo.join(classified.where("is_alive").select("link"), "link", "left_anti")
        todo = materialize(todo, "links")
        if todo.isEmpty():
            break
    return probe_results(attempts)
