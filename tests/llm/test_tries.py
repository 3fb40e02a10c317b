"""Divergence of sources: the trie, and whole results against a plain version."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import tries
from siltstone.llm.common import Scratch

from . import cases

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def trie(items):
    """Of (term, source, count), each one document."""
    items = sorted((t.encode(), x, n) for t, x, n in items)
    one = lambda t, x, n: tries.Trie.of(pa.array([t], pa.large_binary()), np.ones(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64), np.array([n]), [x])
    return tries.merge([one(*x) for x in items]) if items else tries.Trie.of(pa.array([], pa.large_binary()), *(np.zeros(0, np.int64) for _ in range(4)), [])


def leaves(t):
    ends = np.concatenate([[0], np.cumsum(t.fan)])
    own = [{t.sources[s]: n for s, n in zip(t.source[a:b], t.count[a:b])} for a, b in zip(ends, ends[1:])]
    return list(zip(t.terms().to_pylist(), t.docs.tolist(), own))


TERMS = st.text("abé😀", min_size=1, max_size=6) | st.sampled_from(["a" * 60, "a" * 61, "a" * 60 + "b", "a" * 200, "a" * 60 + "bc"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TERMS, st.sampled_from("xyz"), st.integers(1, 4)), max_size=60), st.integers(0, 60), st.lists(TERMS, max_size=3), st.integers(1, 9))
def test_tries_count_merge_and_cut_in_order(items, cut, borders, chunk):
    want = defaultdict(Counter)
    for term, source, n in items:
        want[term.encode()][source] += n
    whole = tries.merge([trie(items[:cut]), trie(items[cut:])])
    got = leaves(whole)
    assert [t for t, _, _ in got] == sorted(want) and {t: c for t, _, c in got} == want
    assert sum(d for _, d, _ in got) == len(items)
    # an inner node has several edges: what a leaf shares with the one before is all that it could
    own = [t for t, _, _ in got]
    assert whole.depth.tolist() == [0] * bool(own) + [len(os.path.commonprefix([a, b])) for a, b in zip(own, own[1:])]
    borders = sorted({x.encode() for x in borders})
    rows = tries.pieces("en", whole, borders, 0, chunk)
    cut_up = [(n, leaves(t)) for _, n, t in tries.tries_of(iter([rows]))]
    assert [x for _, own in cut_up for x in own] == got and all(len(own) <= chunk for _, own in cut_up)
    assert all(n == sum(x <= t for x in borders) for n, own in cut_up for t, _, _ in own)


def plain(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    seen, counts, groups = defaultdict(set), Counter(), defaultdict(set)
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for term in TERM.findall((text or "").translate(cases.LOWER)):
            seen[lang, term].add(k)
            counts[lang, source, term] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for (x, t), d in seen.items() if x == lang and len(d) >= min_docs), key=str.encode)
        v = len(kept)
        own = {s: [counts[lang, s, t] for t in kept] for s in sources}
        own[None] = [sum(own[s][k] for s in sources) for k in range(v)]
        p = {s: [1 + 10**9 * (c + 1) // (sum(x) + v) for c in x] for s, x in own.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted(((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s))
            term = sorted(((-f(a, b), t.encode(), t) for t, c, a, b in zip(kept, own[s], p[s], p[None]) if c and a > b))[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def odd_rows():
    rows = [(r[1], ("en", "de", None, "")[k % 4], ("a", "b", None, "ç", "")[k % 5]) for k, r in enumerate(cases.rows())]
    rows += [(f"The the THE ÀB àb tie{k % 3} tier x-y_z " + "😀漢" * (k % 4), "en", "abc"[k % 3]) for k in range(30)]
    rows += [(None, "xx", "only"), ("alone", "xx", "other"), ("", "yy", None), ("y" * 2_000_000, "en", "a"), ("y" * 2_000_000, "en", "b"), ("y" * 2_000_000 + " z", "en", "b")]
    return rows + [(" ".join(f"{a}{b}" for a in "abcdefgh" for b in "äbcdefghijklmnopqrstuvwxyzßø") * (1 + k % 2), "fr", f"s{k % 4}") for k in range(8)]


@pytest.mark.parametrize(("most", "slice_bytes"), [(tries.RANGE, tries.SLICE), (300, 2000)])
def test_rows_equal_brute_force(spark, most, slice_bytes):
    rows = odd_rows()
    docs = spark.createDataFrame([(t, x, s, "k", 1) for t, x, s in rows], "text string, lang string, source string, term string, value int").repartition(3)
    with Scratch(spark) as scratch:
        got = sorted(tuple(r) for r in tries.audit(docs, scratch, top=50, leaves=most, slice_bytes=slice_bytes).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain(rows, top=50)
    assert Counter(r[2] for r in got)["term"] > 150


def test_of_nothing(spark):
    with Scratch(spark) as scratch:
        assert tries.audit(spark.createDataFrame([], "text string, lang string, source string"), scratch).collect() == []


def test_numbers_beyond_64_bits():
    counts = np.array([[9 * 10**15, 0]])
    assert tries.shares(counts, np.array([[9 * 10**15]], object), 2).tolist() == [[1 + 10**9 * (9 * 10**15 + 1) // (9 * 10**15 + 2), 1]]
