"""The trigram index: packed lists, and answers equal to a scan's."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.operators import search, trigram

SCHEMA = "id long, title string, content string, query string, extra int"


@given(st.lists(st.lists(st.integers(0, 2**62), min_size=1, max_size=50, unique=True).map(sorted), max_size=9), st.integers(0, 3))
def test_lists_come_back(lists, skip):
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    packed = trigram.pack(np.array([x for y in lists for x in y], np.int64), starts.astype(np.int64)).slice(skip)
    numbers, owner = trigram.unpack(packed)
    assert [numbers[owner == k].tolist() for k in range(len(packed))] == lists[skip:]


def test_lists_are_short():
    size = lambda x: len(trigram.pack(x, np.zeros(1, np.int64))[0].as_py())
    assert size(np.arange(16384)) == 16384 and size(np.array([300])) == 2


@given(st.text("abcÄ😀%_", max_size=12), st.text("abcÄ😀", max_size=40), st.booleans())
def test_no_match_lacks_a_trigram(query, content, literal):
    pattern = "".join(re.escape(c) if literal or c not in "%_" else ".*" if c == "%" else "." for c in query)
    if re.search(pattern, content, re.DOTALL):
        assert set(trigram.query_trigrams(query.upper() if query.isascii() else query, literal)) <= set(trigram.trigrams(content).tolist())


def test_lists_are_joined_in_pieces(monkeypatch):
    monkeypatch.setattr(trigram, "JOINED", 1000)
    lists = [[b"x" * (k * 37 % 400)] * (k % 4) for k in range(200)] + [[b"x" * 5000], [], [b"y"]]
    batch = pa.record_batch([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.binary()))], names=["k", "lists"]).slice(3)
    found = [p.to_pydict() for p in trigram.parts(batch)]
    assert sum((p["k"] for p in found), []) == list(range(3, len(lists)))
    assert all(len(p["k"]) == 1 or sum(len(b) for x in p["lists"] for b in x) <= 1000 for p in found) and len(found) < 80


def pages():
    words = "The quick brown Fox jumps over Lazy dogs ÄÖÜ straße 漢字かな 😀😀😀 100% a_b a%b back\\slash".split()
    rows = [(k * 7, " ".join(words[k % 5 : k % 5 + 2]), " ".join(words[(k * j) % len(words)] for j in range(k % 13)), "mine", 1) for k in range(300)]
    rows += [(7, "again", "The same id", "", None), (None, None, "no id fox", None, None), (-5, "fox", None, "", 1), (99999, None, None, None, None), (10**12, "far Fox", "x" * 300_000 + "needle", "", 2), (10**12 + 1, "", "", "", 3)]
    return rows


QUERIES = ["fox", "FOX", "the quick", "q%k_br", "a%b", "a_b", "100%", "", "%", "_", "ox", "needle", "xxxx", "ÄÖÜ", "äöü", "漢字か", "😀😀😀", "k\\sl", "foxdog", "fox%lazy%fox", "again", "no id"]


@pytest.mark.parametrize(("block", "slots"), [(64, 4), (1 << 14, 32)])
def test_answers_equal_a_scan(spark, tmp_path, block, slots):
    docs = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    trigram.build(docs.drop("query"), str(tmp_path), block, slots)
    asked = {f"{q} {literal}": (q, literal) for q in QUERIES for literal in (False, True)}
    got = sorted(((r.query, r.id, r.title) for r in trigram.search_many(spark, str(tmp_path), asked).collect()), key=repr)
    want = sorted(((name, r.id, r.title) for name, (q, literal) in asked.items() for r in search.matching(docs, q, literal).collect()), key=repr)
    assert got == want and len(want) > 1000


def test_few_files_are_read(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(pages(), SCHEMA).drop("query")
    trigram.build(docs, str(tmp_path), 64, 16)
    plan = trigram.search_index(spark, str(tmp_path), "needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"block#\d+L (= 15625000000|IN \(15625000000\))", plan), plan
    lists = trigram.candidates(spark, str(tmp_path), {"x": trigram.query_trigrams("needle")})
    slots = re.search(r"PartitionFilters: \[[^\]]*slot#\d+ IN \(([\d,]+)\)", lists._jdf.queryExecution().executedPlan().toString())
    assert len(slots[1].split(",")) <= 4  # of 16
    monkeypatch.setattr(trigram, "NAMED_BLOCKS", 2)  # beyond so many, pages are joined
    assert sorted(r.id for r in trigram.search_index(spark, str(tmp_path), "fox").collect() if r.id) == sorted(r.id for r in search.matching(docs, "fox").collect() if r.id)


def test_of_nothing(spark, tmp_path):
    trigram.build(spark.createDataFrame([], "id long, title string, content string"), str(tmp_path))
    assert trigram.search_index(spark, str(tmp_path), "fox").collect() == []
