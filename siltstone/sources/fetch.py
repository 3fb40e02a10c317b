"""Fetching pages: requests as a DataFrame, bodies read by the executors in Arrow batches.

The result has the columns of landed pages. It is to be written before anything reads it twice, as a lost executor's
requests are sent again. When a request may be sent is decided before: `operators.queue.schedule`, `streaming.jobs.polite`.
"""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.landed import RAW_PAGES

AGENT = "siltstone/1"


@dataclass(frozen=True)
class Policy:
    """How long one read may take, which statuses' bodies are kept (of redirects, that of where they end), and how long and large a body may be.

    A body is read in pieces; one that is larger than most_bytes or takes longer than whole_s is refused, so that no answer
    holds or fills a task.
    """

    timeout_s: float
    keeps: Callable[[int], bool]
    most_bytes: int = 32 << 20
    whole_s: float = 120


def _ok(status: int) -> bool:
    return status == 200


def _no_error(status: int) -> bool:
    return status < 400


def _any(status: int) -> bool:  # noqa: ARG001
    return True


ONLY_OK, NO_ERRORS, ANY_STATUS = Policy(30, _ok), Policy(10, _no_error), Policy(10, _any)
PIECE = 1 << 16
OUTCOMES = ["ok", "no url", "status", "too large", "too slow", "failed"]


def answered(url: str | None, policy: Policy) -> tuple[str, str]:
    """The body as text, by the charset that the answer names, else UTF-8, with U+FFFD for what is not, and one of OUTCOMES; '' unless ok.

    Only http and https are fetched: a URL never reads a file of the executor.
    """
    if not (url or "").startswith(("http://", "https://")):
        return "", "no url"
    until = time.monotonic() + policy.whole_s
    try:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        try:
            answer = urllib.request.urlopen(request, timeout=policy.timeout_s)
        except urllib.error.HTTPError as error:  # an answer too, with a status of 300 or more
            answer = error
        with answer:
            if not policy.keeps(answer.status):
                return "", "status"
            pieces, size = [], 0
            while piece := answer.read1(PIECE):
                pieces.append(piece)
                size += len(piece)
                if size > policy.most_bytes:
                    return "", "too large"
                if time.monotonic() > until:
                    return "", "too slow"
            if answer.length:  # fewer bytes than the answer said
                return "", "failed"
            return b"".join(pieces).decode(answer.headers.get_content_charset() or "utf-8", "replace"), "ok"
    except (OSError, http.client.HTTPException, ValueError, LookupError):
        return "", "failed"


def body(url: str | None, policy: Policy) -> str:
    """The body alone; '' on any failure."""
    return answered(url, policy)[0]


def fetched(requests: DataFrame, policy: Policy = ONLY_OK, at_once: int = 8, fetch: Callable[[str | None, Policy], str] = body) -> DataFrame:
    """page_id, url, html of requests (page_id, url), one row each, in any order; at_once requests of a task are open at a time.

    Null URLs and failures have an empty html, as extraction expects; further columns of requests are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, at_once):
                    part = batch.slice(at, at_once)
                    html = list(pool.map(lambda url: fetch(url, policy), part.column("url").to_pylist()))
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(html, pa.string())], ["page_id", "url", "html"])

    return requests.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, RAW_PAGES)


def fetched_with_outcome(requests: DataFrame, policy: Policy = ONLY_OK, at_once: int = 8) -> DataFrame:
    """As `fetched`, with `outcome`: why an html is empty, one of OUTCOMES."""
    told = fetched(requests, policy, at_once, lambda url, own: "\0".join(answered(url, own)[::-1]))
    return told.select("page_id", "url", F.expr("substring(html, instr(html, char(0)) + 1)").alias("html"), F.substring_index("html", "\0", 1).alias("outcome"))
