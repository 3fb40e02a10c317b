"""Benchmark decontamination: an inverted index of test items, queried with every training passage by block-max WAND.

The index holds each item's words (ASCII lower case, ASCII punctuation as space) with BM25 weights, divided by the least
score that a passage can have which holds SHARE of the item's shingles. So the threshold is 1 for every item and retrieving
all above it loses nothing: at most (1 - SHARE) of the shingles, hence as many words, can be missing, and the bound takes
the heaviest. Postings are cut into blocks with their largest weight. Items are indexed by length class (the bits of the number
of words), and a class's passages are twice the power of two above all its lengths with half of that as step, so any place that
holds an item lies within a passage, and passages don't depend on the other items.

A passage's distinct words first meet the bounds, for a whole batch of passages at once: the sum of their lists' maxima, then
for each block of BLOCK neighbouring items the sum of the maxima there. What can still reach the threshold goes through the
WAND cursors with list and block bounds. What it retrieves is verified: SHARE of the item's shingles of SHINGLE
words, and SHARE of the distinct words of its question and of its answer, must be in the passage. An item's answer follows
its last "Answer:" or "A:" line mark; without one, it is the last third of its words.

The index is fitted on at most ITEMS items, as it goes to all executors; larger benchmarks are taken in shards of about
that many, one after the other: a shard's leaks are checkpointed before the next shard is collected, so one index at a time is
held, and the results are those of one shard. Documents are read once a shard and need no shuffle.

Defined results: null or empty text, and text without words, leaks nothing; items without words are leaked by nothing;
items with fewer words than a shingle are one shingle; rows without item_id count for `clean`,
not for `leaks`; repeated rows give repeated rows; an empty benchmark or table gives no leaks; columns other than doc_id
and text, item_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, WORD_BASE, Texts, U, Words, cut, prefix_sums, ranges, slices, spans_hash, texts_of, windows_hash, words_of

K1, B = 1.2, 0.75
SHINGLE, SHARE = 5, 0.8
ITEMS, BLOCK, SHORTEST_CLASS = 20_000, 8, 32
_FOLD = LOWER.copy()
_FOLD[[x for x in range(33, 127) if not chr(x).isalnum()]] = 0x20
ANSWER = re.compile(r"^[ \t]*(?:answer|a)[ \t]*:", re.IGNORECASE | re.MULTILINE)


def folded(texts: Texts) -> Texts:
    return Texts(_FOLD[texts.data], texts.bounds)


@dataclass
class Item:
    words: np.ndarray  # hashes, in order
    answer_from: int
    shingles: np.ndarray


def items_of(texts: list[str]) -> list[Item]:
    out = []
    for text in texts:
        words = words_of(folded(texts_of(pa.array([text], pa.string()))))
        hashes = words.hashes()
        marks = list(ANSWER.finditer(text or ""))
        at = len((text or "")[: marks[-1].start()].encode()) if marks else None
        first = int(np.searchsorted(words.starts, at)) if at is not None else -(-2 * len(hashes) // 3)
        if len(hashes):
            out.append(Item(hashes, first, np.unique(windows_hash(words, hashes, min(SHINGLE, len(hashes)))[1])))
        else:
            out.append(Item(hashes, 0, hashes))
    return out


class Index:
    """Items of one length class: BM25 postings in item order with block maxima."""

    def __init__(self, ids: list[int], items: list[Item]) -> None:
        self.ids, self.items = ids, items
        # of the length class, not of the items in it: what leaks doesn't depend on the other items
        self.step = 1 << max(SHORTEST_CLASS, max(len(x.words) for x in items)).bit_length()
        df = Counter(w for x in items for w in np.unique(x.words).tolist())
        mean = sum(len(x.words) for x in items) / len(items)
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, x in enumerate(items):
            weight = {}
            for w, tf in zip(*(v.tolist() for v in np.unique(x.words, return_counts=True))):
                idf = math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x.words) / mean))
            absent = int((1 - SHARE) * len(x.shingles) + 1e-9)  # words at most that a leak may lack
            whole = sum(weight.values())
            least = max(whole - sum(sorted(weight.values())[len(weight) - absent :]), 1e-6 * whole)
            for w, v in weight.items():
                postings[w].append((i, v / least))
        self.vocabulary = np.array(sorted(postings), U)
        self.lists = [postings[w] for w in self.vocabulary.tolist()]
        self.most = np.array([max(v for _, v in x) for x in self.lists])
        cells = [{} for _ in self.lists]  # blocks of BLOCK neighbouring items, for whole batches of passages
        for cell, x in zip(cells, self.lists):
            for i, v in x:
                cell[i // BLOCK] = max(cell.get(i // BLOCK, 0.0), v)
        self.blocks = -(-len(items) // BLOCK)
        self.row = np.cumsum([0, *map(len, cells)])
        self.block, self.value = (np.array([v for c in cells for v in part(c)]) for part in (dict.keys, dict.values))
        self.block_most = [[max(v for _, v in x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.lists]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, -1 if it isn't there."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def retrieve(self, terms: list[int], threshold: float = 1 - 1e-9) -> list[tuple[int, float]]:
        """All items whose score for the (distinct) terms reaches the threshold, by block-max WAND."""
        end = len(self.items)
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # item, place in the list, term
        lists, most, block_most, out = self.lists, self.most, self.block_most, []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += most[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            last = pivot
            while last + 1 < len(cursors) and cursors[last + 1][0] == item:
                last += 1
            here = cursors[: last + 1]
            for c in here:  # forward to the pivot; shallow: by block first
                if c[0] < item:
                    own, at = lists[c[2]], c[1]
                    while at < len(own) and own[min(at | (BLOCK - 1), len(own) - 1)][0] < item:
                        at = (at | (BLOCK - 1)) + 1
                    while at < len(own) and own[at][0] < item:
                        at += 1
                    c[0], c[1] = (own[at][0], at) if at < len(own) else (end, at)
            if sum(block_most[c[2]][c[1] // BLOCK] for c in here if c[0] < end) < threshold:
                # No item up to the end of the nearest block can get there.
                target = min([own[min(c[1] | (BLOCK - 1), len(own) - 1)][0] + 1 for c in here if c[0] < end for own in (lists[c[2]],)] + [c[0] for c in cursors[last + 1 : last + 2]] + [end])
                target = max(target, item + 1)
            else:
                score = sum(lists[c[2]][c[1]][1] for c in here if c[0] == item)
                if score >= threshold:
                    out.append((item, score))
                target = item + 1
            for c in here:
                own, at = lists[c[2]], c[1]
                while at < len(own) and own[at][0] < target:
                    at += 1
                c[0], c[1] = (own[at][0], at) if at < len(own) else (end, at)
            cursors = [c for c in cursors if c[0] < end]
        return out

    def candidates(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
        """Of many texts' passages those that the bounds leave: text, first and last word, distinct terms."""
        sizes = np.diff(words.first)
        counts = np.where(sizes > 0, np.maximum(-(-(sizes - self.step) // self.step), 1), 0)
        text = np.repeat(np.arange(len(sizes)), counts)
        starts = words.first[text] + self.step * ranges(np.zeros(len(sizes), np.int64), counts)
        ends = np.minimum(starts + 2 * self.step, words.first[text + 1])
        terms = self.terms(hashes)
        at = ranges(starts, ends - starts)
        passage = np.repeat(np.arange(len(starts)), ends - starts)[terms[at] >= 0]
        key = np.unique(passage * len(self.vocabulary) + terms[at][terms[at] >= 0])
        passage, term = np.divmod(key, len(self.vocabulary))
        high = np.bincount(passage, self.most[term], minlength=len(starts)) >= 1 - 1e-9
        passage, term = passage[high[passage]], term[high[passage]]
        edges = np.searchsorted(passage, np.arange(len(starts) + 1))
        live = np.flatnonzero(np.diff(edges))
        for group in np.array_split(live, max(1, len(live) // 2000)):  # each term's blocks of items, with their largest weights
            if not len(group):
                continue
            own = slice(edges[group[0]], edges[group[-1] + 1])
            count = self.row[term[own] + 1] - self.row[term[own]]
            at = ranges(self.row[term[own]], count)
            cell = np.repeat(passage[own] - group[0], count) * self.blocks + self.block[at]
            bound = np.bincount(cell, self.value[at], minlength=(group[-1] - group[0] + 1) * self.blocks).reshape(-1, self.blocks).max(1)
            for p in (np.flatnonzero(bound >= 1 - 1e-9) + group[0]).tolist():
                yield int(text[p]), int(starts[p]), int(ends[p]), term[edges[p] : edges[p + 1]].tolist()

    def leaks(self, words: Words, hashes: np.ndarray) -> dict[int, set[int]]:
        """For texts that leak items, the items' numbers."""
        found: dict[int, set[int]] = defaultdict(set)
        for text, a, b, terms in self.candidates(words, hashes):
            for item, _ in self.retrieve(terms):
                if item not in found[text] and self.verify(item, hashes[a:b]):
                    found[text].add(item)
        return found

    def verify(self, number: int, passage: np.ndarray) -> bool:
        item = self.items[number]
        n = min(SHINGLE, len(item.words))
        held = np.isin(item.shingles, shingles(passage, n)).sum()
        parts = [np.unique(x) for x in (item.words[: item.answer_from], item.words[item.answer_from :])]
        return held >= SHARE * len(item.shingles) - 1e-9 and all(np.isin(x, passage).sum() >= SHARE * len(x) - 1e-9 for x in parts)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    firsts = np.arange(max(len(hashes) - n + 1, 0))
    return spans_hash(prefix_sums(hashes, WORD_BASE), WORD_BASE, firsts, firsts + n)


def indexes(ids: list[int], texts: list[str]) -> list[Index]:
    classes: dict[int, list[int]] = defaultdict(list)
    items = items_of(texts)
    for k, x in enumerate(items):
        if len(x.words):
            classes[max(len(x.words), SHORTEST_CLASS).bit_length()].append(k)
    return [Index([ids[k] for k in own], [items[k] for k in own]) for _, own in sorted(classes.items())]


def leaks_column(docs: DataFrame, found: list[Index]) -> DataFrame:
    """docs with `_leaks`: ids of the items that each text leaks, ascending."""
    names = [x for x in docs.columns if x != "_leaks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words = words_of(folded(texts))
            hashes = words.hashes()
            out: list[list[int | None]] = [[] for _ in range(len(texts))]
            for x in found:
                for text, own in x.leaks(words, hashes).items():
                    out[text] += (x.ids[k] for k in own)
            out = [sorted(v, key=lambda i: (i is None, i)) for v in out]
            yield part.append_column("_leaks", pa.array(out, pa.list_(pa.int64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    return docs.select(names).mapInArrow(run, f"{schema}, _leaks array<bigint>")


def shards(benchmark: DataFrame, most: int = ITEMS) -> tuple[int, Iterator[list[Index]]]:
    """How many there are, and each one's indexes, collected when it is asked for."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-benchmark.count() // most))

    def each() -> Iterator[list[Index]]:
        for k in range(parts):
            rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
            rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
            yield indexes([r.item_id for r in rows], [r.text for r in rows])

    return parts, each()


def leaks(docs: DataFrame, benchmark: DataFrame, most: int = ITEMS) -> DataFrame:
    """(doc_id, item_id) for every leak."""
    docs, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    parts, each = shards(benchmark, most)
    for found in each:
        part = leaks_column(docs, found).select("doc_id", F.explode("_leaks").alias("item_id")).where("item_id is not null")
        part = cut(part) if parts > 1 else part
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, most: int = ITEMS) -> DataFrame:
    """The rows of docs that leak no item. With several shards, 128 bits of hash of the texts that leak are held against all texts."""
    parts, each = shards(benchmark, most)
    if parts == 1:
        return leaks_column(docs, next(each)).where(F.size("_leaks") == 0).drop("_leaks")
    name, out = [F.xxhash64("text").alias("_id_1"), F.xxhash64(F.lit(1), "text").alias("_id_2")], None
    for found in each:
        part = cut(leaks_column(docs.select("text"), found).where(F.size("_leaks") > 0).select(*name).distinct())
        out = part if out is None else out.unionAll(part)
    return docs.select("*", *name).join(out.distinct(), ["_id_1", "_id_2"], "left_anti").select(docs.columns)
