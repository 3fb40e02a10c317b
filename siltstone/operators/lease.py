"""Claims that expire: the crawl queue's states by URL, from a log of what was asked and when.

An event is (url, kind, worker, at): `add` queues an unknown URL, `claim` takes a queued one that is due, for a lease of lease_us,
`done` and `fail` by the worker that has it, within the lease, end a claim; everything else is refused. A failure, or a lease that
runs out, puts the URL back with a delay that doubles each time, and after `most` retries among the dead. Each change is a row
(url, at, status, retries, worker), so the last one of a URL is its state.

`replay` does this over stored events, `streaming.jobs.leases` over arriving ones, by the same steps. Events of a URL go by time, then
kind and worker; a log without events of a URL says nothing of it. Null urls, kinds or times are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
Change = tuple[int, str, int, str | None]


@dataclass(frozen=True)
class Rules:
    """Microseconds a claim holds and a first retry waits, and how many retries there are."""

    lease_us: int = 8 * HOUR
    backoff_us: int = 6 * HOUR
    most: int = 3


@dataclass
class Item:
    """One URL's state; lease_until counts while it is processing, due while it is queued."""

    status: str | None = None
    retries: int = 0
    due: int = 0
    lease_until: int = 0
    worker: str | None = None

    def _failed(self, at: int, rules: Rules) -> Change:
        worker = self.worker
        self.retries, self.worker = self.retries + 1, None
        self.status = "dead" if self.retries > rules.most else "queued"
        self.due = at + rules.backoff_us * (1 << (self.retries - 1))
        return at, self.status, self.retries, worker

    def expire(self, now: int, rules: Rules) -> list[Change]:
        return [self._failed(self.lease_until, rules)] if self.status == "processing" and self.lease_until <= now else []

    def take(self, kind: str, worker: str | None, at: int, rules: Rules) -> list[Change]:
        out = self.expire(at, rules)
        if kind == "add" and self.status is None:
            self.status, self.due = "queued", at
            out.append((at, "queued", 0, None))
        elif kind == "claim" and self.status == "queued" and self.due <= at:
            self.status, self.worker, self.lease_until = "processing", worker, at + rules.lease_us
            out.append((at, "processing", self.retries, worker))
        elif kind in ("done", "fail") and self.status == "processing" and self.worker == worker:
            if kind == "fail":
                out.append(self._failed(at, rules))
            else:
                self.status = "completed"
                out.append((at, "completed", self.retries, worker))
        return out


def readable(events: DataFrame) -> DataFrame:
    """Events without null urls, kinds or times."""
    return events.select("url", "kind", "worker", F.col("at").cast("timestamp").alias("at")).where("url is not null and kind is not null and at is not null")


def replay(events: DataFrame, rules: Rules = Rules(), until_us: int | None = None) -> DataFrame:
    """url, at, status, retries, worker of all changes; leases that are open at the end run out if that is by until_us (always without one).

    One shuffle by URL; a task walks its URLs' events in order and holds one URL's state.
    """
    end = until_us if until_us is not None else 2**62

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        url, item, rows = None, Item(), []
        for batch in batches:
            for own, kind, worker, at in zip(*(batch.column(c).to_pylist() for c in ("url", "kind", "worker", "us"))):
                if own != url:
                    rows += [(url, *x) for x in item.expire(end, rules)]
                    url, item = own, Item()
                rows += [(url, *x) for x in item.take(kind, worker, at, rules)]
            yield made(rows)
            rows = []
        yield made([(url, *x) for x in item.expire(end, rules)])

    def made(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["url", "us", "status", "retries", "worker"])

    order = readable(events).withColumn("us", F.unix_micros("at")).repartition("url").sortWithinPartitions("url", "us", "kind", "worker")
    found = order.select("url", "kind", "worker", "us").mapInArrow(walk, "url string, us long, status string, retries int, worker string")
    return found.select("url", F.timestamp_micros("us").alias("at"), "status", "retries", "worker")
