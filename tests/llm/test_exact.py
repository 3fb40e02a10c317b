"""Exact dedup: the perfect hash of a shard, lookups, and whole results against a plain version."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import exact
from siltstone.llm.common import Scratch

from . import cases


def keys(n, salt=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{salt}:{k}".encode()).digest() for k in range(n)), np.uint8).reshape(-1, 32)


def shard(own):
    n = len(own)
    columns = {"digest": pa.array([x.tobytes() for x in own], pa.binary()), "keep_id": pa.array(range(n), pa.int64()), "best_chars": pa.array([5] * n, pa.int64()), "size": pa.array([1] * n, pa.int64()), "shard": pa.array([3] * n, pa.int32())}
    return exact.build_shard(pa.table(columns))


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_hash_is_perfect_and_minimal(n):
    bits, widths = exact.perfect(exact.words_of(keys(n)))
    slot = exact.slots(bits, widths, exact.words_of(keys(n)))
    assert sorted(slot.tolist()) == list(range(n))
    assert sum(widths) < 6 * n + 64 * len(widths)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 200), st.integers(0, 5), st.integers(1, 200))
def test_members_are_found_and_others_are_not(n, salt, others):
    table = shard(keys(n, salt))
    slot = exact.find_in_shard(table, keys(n, salt))
    assert [table.column("keep_id")[0].as_py()[k] for k in slot] == list(range(n))
    assert (exact.find_in_shard(table, keys(others, salt + 10)) == -1).all()


def test_keys_that_no_level_takes(monkeypatch):
    monkeypatch.setattr(exact, "LEVELS", 1)
    table = shard(keys(300))
    slot = exact.find_in_shard(table, keys(300))
    assert [table.column("keep_id")[0].as_py()[k] for k in slot] == list(range(300))
    assert (exact.find_in_shard(table, keys(300, 1)) == -1).all()


def test_one_byte_is_enough_to_differ():
    own = keys(50).copy()
    other = own.copy()
    other[:, 31] ^= 1
    assert (exact.find_in_shard(shard(own), other) == -1).all()


def plain(rows):
    groups = defaultdict(list)
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        best = min(groups[bare(t)])
        out.append((i, best[3], len(groups[bare(t)]), i == best[3] and len(t or "") == -best[0], cases.sha(bare(t))))
    return sorted(out, key=repr)


def result(done):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in done.collect()), key=repr)


def odd_rows():
    own = [(r[0], r[1]) for r in cases.rows()]
    p = own[7][1]
    own += [(200 + k, p.replace(" ", " " * (1 + k % 3))) for k in range(20)] + [(150, "x y"), (149, "y\tx"), (148, " xy"), (147, "x\x0by"), (146, "x y"), (151, "é"), (152, "é")]
    own += [(300 + k, "😀 hot") for k in range(40)] + [(None, " "), (None, "x y"), (999, "long " * 400_000)]
    return own


@pytest.mark.parametrize(("split", "shard_keys"), [("doc_id % 2 = 0", 10), ("doc_id > 0", 200_000), ("false", 7), ("true", 7)])
def test_rows_equal_brute_force(spark, split, shard_keys, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 10)
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "k", 1, "s", True) for i, t in rows], "doc_id long, text string, keep_id string, size int, digest string, batch boolean").repartition(3)
    later = f"coalesce({split}, true)"
    with Scratch(spark) as scratch:
        got = result(exact.dedup(docs.where(later), docs.where(f"not {later}"), scratch, shard_keys))
    assert got == plain(rows)


def test_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    with Scratch(spark) as scratch:
        assert exact.dedup(empty, empty, scratch).collect() == []


def test_lookup_tells_members(spark):
    old = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + k, f"te xt{k}") for k in range(60, 140)], "doc_id long, text string")
    index = exact.build(exact.winners(exact.digests(old)), 4)
    assert index.count() == 4
    got = {r.keep_id: (r.size, r.seen) for r in exact.lookup(exact.winners(exact.digests(new)), index, 4, 3).collect()}
    assert got == {k: (2, True) for k in range(60, 100)} | {1000 + k: (1, False) for k in range(100, 140)}
