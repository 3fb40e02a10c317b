"""Substring, suffix-array and near-duplicate removal against plain versions."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import minhash, substrings, suffixes
from siltstone.llm.common import texts_of
from siltstone.llm.components import components

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.mark.parametrize("hot", [1000, 1])
def test_substrings_equal_brute_force(docs, hot):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs, hot=hot).collect()), key=repr)
    want = sorted(cases.repeated_words([(r[0], r[1]) for r in cases.rows()], 50), key=repr)
    assert got == want
    assert sum(x[2] for x in want) > 500


def test_substrings_of_nothing(empty):
    assert substrings.dedup(empty).collect() == []


@pytest.mark.parametrize(("hot", "batches"), [(20_000, 4), (20_000, 1), (1, 4)])
def test_suffixes_equal_brute_force(docs, hot, batches, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 4000)  # so that there are several parts
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(docs, hot=hot, batches=batches).collect()), key=repr)
    want = sorted(cases.repeated_bytes([(r[0], r[1]) for r in cases.rows()], 400), key=repr)
    assert got == want
    assert sum(x[2] for x in want) > 3000


def test_suffixes_of_near_copies(spark):
    rng, base = np.random.default_rng(6), cases.prose(400, 11).split()
    own = []
    for k in range(40):  # copies with few edits: trees of many depths on both sides of an anchor
        w = list(base)
        for at in rng.integers(0, len(w), 1 + k % 4):
            w[at] = f"e{rng.integers(3)}"
        own.append((k, " ".join(w[rng.integers(0, 60) : rng.integers(340, 400)])))
    own += [(100, "ab" * 700 + "x" * 500), (101, "x" * 450), (102, "q" + "ab" * 300), (103, "\0" * 401 + "é" * 300)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(spark.createDataFrame(own, "doc_id long, text string")).collect())
    assert got == sorted(cases.repeated_bytes(own, 400))


def test_suffixes_of_nothing(empty):
    assert suffixes.dedup(empty).collect() == []


def strings_of(texts, length, mer):
    """The texts' different packed strings, as columns for `arrays`, and the places of each."""
    all_ = texts_of(pa.array(texts, pa.binary()))
    columns, where = {}, {}
    for start, n, off, mini in zip(*(x.tolist() for x in suffixes.anchors(all_, length, mer))):
        text = bytes(all_.data[start : start + n + length - 1])
        columns[text] = (text, off, n, mini)
        where.setdefault(text, []).append(start)
    return list(columns.values()), list(where.values()), all_


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=60).map(str.encode), min_size=1, max_size=12), st.integers(1, 6))
def test_family_finds_every_repeat(texts, batch):
    length, mer = 9, 4
    columns, where, all_ = strings_of(texts, length, mer)
    family = suffixes.Family(length, mer)
    for k in range(0, len(columns), batch):
        own = columns[k : k + batch]
        family.add(suffixes.arrays(*map(list, zip(*own)), list(range(k, k + len(own)))))
    got = {start + s for i, a, b in family.found for s in range(a, b) for start in where[i]}
    got |= {start + s for i, own in enumerate(where) if len(own) > 1 for start in own for s in range(columns[i][2])}
    data, starts = all_.data.tobytes(), suffixes.run_starts(all_.bounds, length).tolist()
    have = Counter(data[s : s + length] for s in starts)
    assert got == {s for s in starts if have[data[s : s + length]] > 1}
    for level in family.levels:  # every level is in both orders
        rights, lefts = level.rights(), level.lefts()
        assert [rights[i] for i in level.right] == sorted(rights) and [lefts[i] for i in level.left] == sorted(lefts)


def test_levels_stay_geometric():
    family = suffixes.Family(20, 8)
    for k in range(40):
        columns, _, _ = strings_of([cases.prose(12, k + 1).encode()], 20, 8)
        family.add(suffixes.arrays(*map(list, zip(*columns)), list(range(len(columns)))))
    sizes = [len(x) for x in family.levels]
    assert len(sizes) < 8 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    own = cases.texts()
    base = own[7][1].split()
    for k in range(40):  # a group of near copies around the threshold
        w = list(base)
        for j in range(k):
            w[(j * 7 + k) % len(w)] = f"edit{k}x{j}"
        own.append((1000 + k, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in own], "doc_id long, text string, registers string, head string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle, 80).collect()}
    want = cases.near_components(own, shingle, 80)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_with_odd_rows(docs, empty):
    rows = minhash.near_duplicates(docs, 2, 80).collect()
    assert len(rows) == len(cases.rows())
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    twice = [r for r in rows if r.doc_id == cases.texts()[3][0]]
    assert len(twice) == 2 and {r.component_id for r in twice} == {twice[0].component_id}
    assert minhash.near_duplicates(empty).collect() == []


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    own = []
    for k in range(30):  # a chain: neighbours are similar, ends are not, and the smallest id is an end
        own.append((k, " ".join(f"w{j}" for j in range(k * 6, k * 6 + 100))))
    docs = spark.createDataFrame(own, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2, 80).collect()}
    assert got == {i: c for i, (_, c) in cases.near_components(own, 2, 80).items()}


def test_estimate_and_merge():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 900).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = int(share * 900)
        c = np.concatenate([a[:both], b[both:]])
        x, y = (minhash.registers_of(v, np.array([0, len(v)])) for v in (a, c))
        true = both / (1800 - both)
        assert abs(minhash.estimate(x, y, np.array([900.0]), np.array([900.0]))[0] - true) < 0.12
        union = np.unique(np.concatenate([a, c]))
        assert (minhash.merge_registers(x, y) == minhash.registers_of(union, np.array([0, len(union)]))).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (3, 30)] + [(100 + k, 101 + k) for k in range(20)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(2, 1), (3, 1), (30, 1), (5, 4), (7, 6), (8, 6)} | {(101 + k, 100) for k in range(20)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
