import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing

from . import cases


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def own_ids(text, path=None):
    return np.frombuffer(packing.encoder(path or packing.default_tokenizer())(text), "<u4").tolist()


PARTS = ["<|endoftext|>", "<|endoftext|", "|>", " ", "\n", "  ", "a", "é", "12", "'s"]


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)))
def test_ids_equal_tokenizers(tokenizer, text):
    assert own_ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_texts_have_the_same_ids(tokenizer):
    assert own_ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    for x in ["<|endoftext|> a", " a  b\n c \nd   ", "don't 's 'll", "x" * 3000, "\x1c\x85 é z", *(t or "" for _, t in cases.texts())]:
        assert own_ids(x) == tokenizer.encode(x, add_special_tokens=False).ids


def test_other_kinds_of_vocabulary():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert own_ids("Some words, é", path) == Tokenizer.from_file(path).encode("Some words, é", add_special_tokens=False).ids


def test_pieces_have_the_tokenizers_ids(spark, tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", " x  <|endoftext|><|endoftext|>\n y", "<|endoftext|", cases.prose(100) + "<|endoftext|>" + cases.prose(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.pieces(docs, budget=64).collect()}
    want = {}
    for k, x in enumerate(texts):
        ids = ids_of(tokenizer, x)
        for s, n in packing.cut_points(len(ids), 64):
            want[k, s] = (n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))
    assert got == want


def least_sequences(lengths, budget):
    """No packing has fewer: pieces over half a sequence are one each, and what these can't take is at least so much volume."""
    large = [n for n in lengths if 2 * n > budget]
    bounds = [-(-sum(lengths) // budget), len(large)]
    for least in sorted({n for n in lengths if 2 * n <= budget}):  # pieces shorter than `least` left out, and large ones that take none of the rest
        alone = sum(n > budget - least for n in large)
        rest = [n for n in lengths if least <= n <= budget - least]
        bounds += [alone + max(-(-sum(rest) // budget), sum(2 * n > budget for n in rest))]
    return max(bounds)


def check(rows, expected, budget):
    """Every piece of every document once, sequences gapless."""
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert own[-1][0] + own[-1][1] <= budget
    return len(by)


@pytest.mark.parametrize("per_task", [200_000, 7])
def test_pieces_and_packing(spark, tokenizer, per_task):
    docs = spark.createDataFrame(cases.rows(), cases.SCHEMA).repartition(3)
    budget = 512
    expected = []
    for i, t, *_ in cases.rows():
        ids = ids_of(tokenizer, t)
        first = len(ids) if len(ids) <= budget else len(ids) % budget or budget
        starts = [0, *range(first, len(ids), budget)]
        for k, a in enumerate(starts):
            own = ids[a : (starts + [len(ids)])[k + 1]]
            expected.append((i if i is not None else -1, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = packing.pack(packing.pieces(docs, budget=budget), budget, per_task, fan_in=3).collect()
    used = check(rows, expected, budget)
    best = least_sequences([e[3] for e in expected], budget)
    assert best <= used <= best + 3


def test_lengths_that_never_fit_together(spark):
    """No task holds more than per_task rows, though every sequence stays open."""
    per_task, fan_in = 40, 4
    docs = spark.range(900).selectExpr("id as doc_id", "0 as piece", "0L as start", "1500L as length", "0L as ids_crc32")
    rows = packing.pack(docs, 2048, per_task, fan_in).collect()
    assert len({r.sequence_id for r in rows}) == 900 and sorted(r.doc_id for r in rows) == list(range(900))
    tasks = Counter(r.sequence_id >> 28 for r in rows)  # the step and the task that placed a row for good
    assert max(tasks.values()) <= per_task + 10  # a round-robin deals out about evenly


def test_the_emptiest_are_packed_again():
    own, gaps = np.array([0, 1, 1, 2, 3, 3, 3]), np.array([5, 0, 9, 7])
    assert packing.emptiest(own, gaps, 4).tolist() == [False, False, False, True, True, True, True]
    assert packing.emptiest(own, gaps, 7).tolist() == [True, False, False, True, True, True, True]
    assert not packing.emptiest(own, gaps, 0).any()


def test_nothing_to_pack(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], cases.SCHEMA))).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_place_follows_the_rule(lengths):
    budget = 50
    sequence, offset, gaps = packing.place(np.array(lengths), budget)
    open_ = []  # gaps of all sequences
    for s, own, at in zip(lengths, sequence.tolist(), offset.tolist()):
        count = [sum(g == v for g in open_) for v in range(budget + 1)]
        if own == len(open_):
            open_.append(budget)
        before = open_[own]
        assert at == budget - before and before >= s

        def cost(gap, s=s, count=count):
            after = count.copy()
            after[0] = 0
            if gap < budget:
                after[gap] -= 1
            if gap > s:
                after[gap - s] += 1
            return sum(x * x for x in after[1:budget])

        assert cost(before) == min(cost(g) for g in {*open_, budget} if g >= s)
        open_[own] -= s
    assert gaps.tolist() == open_


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, cases.prose(400))], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, budget=100), 100)
    built = {r.sequence_id: r.ids for r in packing.sequences(docs, packed, budget=100).collect()}
    texts = {1: "a b c", 2: "", 3: cases.prose(400)}
    for r in packed.collect():
        assert built[r.sequence_id][r.offset : r.offset + r.length] == ids_of(tokenizer, texts[r.doc_id])[r.start : r.start + r.length]
