"""The page store: batches give what one pass gives, however they come; filters, and merges that are broken off."""

import random
import re

import numpy as np
import pytest

from siltstone.sources import store as stores
from siltstone.sources.store import PageStore, filter_of, filter_places, maybe_in, saving

SCHEMA = "id long, url string, content_hash string, title string, batch string"


def writes(n=240, seed=3):
    rng = random.Random(seed)
    rows = [(k, f"u{rng.randrange(n // 2)}", rng.choice([f"h{rng.randrange(n // 2)}", f"h{rng.randrange(9)}", f"u{k}", "", None]), "t", "mine") for k in range(1, n)]
    return rows + [(n, None, "h1", "t", None), (n + 1, "hot", "hot", "", "")] + [(n + 2 + k, f"v{k}", "hot", None, "") for k in range(30)]


def one_by_one(rows):
    urls, hashes, out = set(), {}, []
    for i, url, content_hash, *_ in rows:
        if content_hash and content_hash in hashes:
            out.append((i, False, hashes[content_hash]))
        elif url is None or url in urls or (content_hash == "" and "" in hashes):
            out.append((i, False, 0))
        else:
            urls.add(url)
            if content_hash is not None:
                hashes[content_hash] = i
            out.append((i, True, i))
    return out


def answers(df):
    return sorted((r.id, r.stored, r.page_id) for r in df.collect())


@pytest.mark.parametrize("edges", [(0, 1000), (0, 60, 70, 1000), (0, 120, 240, 1000)])
def test_batches_give_what_one_pass_gives(spark, tmp_path, edges):
    rows, got = writes(), []
    for batch, (a, b) in enumerate(zip(edges, edges[1:])):
        store = PageStore(spark, str(tmp_path), buckets=5, filter_bits=256)  # filters so small that many answers are false
        part = spark.createDataFrame([r for r in rows if a <= r[0] < b], SCHEMA)
        first = answers(store.merge(part, batch))
        assert answers(store.merge(part.limit(3), batch)) == first  # the same batch again is answered as before
        got += first
    assert sorted(got) == one_by_one(rows)
    stored = sorted((r.id, r.url, r.content_hash, r.title) for r in PageStore(spark, str(tmp_path)).pages().collect())
    assert stored == [r[:4] for r, x in zip(rows, one_by_one(rows)) if x[1]]


def test_a_merge_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    rows = writes()
    batches = [spark.createDataFrame([r for r in rows if (r[0] < 100) == x], SCHEMA) for x in (True, False)]
    store = PageStore(spark, str(tmp_path), buckets=4, filter_bits=1024)
    store.merge(batches[0], 0)
    before = sorted(map(tuple, store.pages().collect()), key=repr)
    for broken in ("_filters", "_decide"):
        with monkeypatch.context() as m:
            m.setattr(PageStore, broken, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.merge(batches[1], 1)
        assert store.committed() == [0] and sorted(map(tuple, store.pages().collect()), key=repr) == before
    got = answers(store.merge(batches[1], 1))
    assert got == [x for x in one_by_one(rows) if x[0] >= 100]


def test_stream(spark, tmp_path):
    rows = writes()
    for k, (a, b) in enumerate(((0, 90), (90, 200), (200, 1000))):
        spark.createDataFrame([r for r in rows if a <= r[0] < b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        store = PageStore(spark, f"{tmp_path}/store", buckets=3)
        pages = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        saving(pages, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert store.committed() == [0, 1, 2]
    got = [x for batch in range(3) for x in answers(store.decisions(batch))]
    assert sorted(got) == one_by_one(rows)


def test_only_buckets_in_question_are_read(spark, tmp_path):
    store = PageStore(spark, str(tmp_path), buckets=32)
    store.merge(spark.createDataFrame([(k, f"u{k}", f"h{k}") for k in range(500)], "id long, url string, content_hash string"), 0)
    keys = spark.createDataFrame([("url", "u77"), ("url", "none"), ("hash", "u77")], "kind string, key string")
    known = store.known(keys)
    assert [tuple(r) for r in known.collect()] == [("url", "u77", 77)]
    plan = known._jdf.queryExecution().executedPlan().toString()
    asked = re.search(r"PartitionFilters: \[[^\]]*?bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert asked and len((asked[1] or asked[2]).split(",")) <= 2, plan


def test_pieces_of_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PIECE_KEYS", 20)
    store = PageStore(spark, str(tmp_path), buckets=3)
    for batch in range(2):
        got = answers(store.merge(spark.createDataFrame([(k + 400 * batch, f"u{k}", f"h{k}") for k in range(1, 400)], "id long, url string, content_hash string"), batch))
        assert got == [(k + 400 * batch, not batch, k) for k in range(1, 400)]


def test_of_nothing(spark, tmp_path):
    store = PageStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="nothing"):
        store.pages()
    empty = spark.createDataFrame([], "id long, url string, content_hash string")
    assert store.merge(empty, 0).collect() == [] and store.merge(empty, 4).collect() == []
    assert store.pages().collect() == []
    with pytest.raises(ValueError, match="comes after"):
        store.merge(empty, 2)


def test_filters_merge():
    rng = np.random.default_rng(1)
    a, b, c, d = (rng.integers(-(2**63), 2**63, 300) for _ in range(4))
    one, two = filter_places(a, b, 8192), filter_places(c, d, 8192)
    both = filter_of(one, 8192) | filter_of(two, 8192)
    assert (both == filter_of(np.concatenate([one, two]), 8192)).all()
    assert maybe_in(both, one).all() and maybe_in(both, two).all()
    assert maybe_in(both, filter_places(rng.integers(-(2**63), 2**63, 3000), rng.integers(-(2**63), 2**63, 3000), 8192)).mean() < 0.05
