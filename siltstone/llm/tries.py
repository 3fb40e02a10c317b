"""Divergence of sources by the terms they use, counted in radix tries over bytes.

A trie is held flat, as its leaves in the order of their bytes: each has the depth at which it leaves the path of the leaf before,
the label of its edge from there, the number of documents with the term, and a counter for each source. Cutting a trie by a
range of terms is slicing it, and merging tries is one sort of their leaves. A task counts each slice of its texts in one
trie a language. Tries travel in pieces of CHUNK leaves, cut at the borders of ranges of (language, term) that a bounded sample of
pieces gives, so that a range holds whole subtrees of about RANGE leaves, and each range's tries are merged as they come. A second
walk in UTF-8 order, knowing each source's total, streams what every pair of sources differs by and each source's best terms;
these partial sums and candidates are few, whatever the number of terms.

The driver holds the totals of the (lang, source) groups, no more than the square root of the pairs that are returned, and BORDERS
borders of ranges at most.

Defined results: null text, lang and source count as ''; a repeated row is a document of its own; a language without kept
terms gives its pairs with value 0; a term has any length; numbers beyond 64 bits are reckoned in Python's integers; further
columns are left aside, whatever their names; an empty table gives no rows. Values must fit in a long.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, Scratch, Texts, ranges, slices, words_of

#: Bytes of text that one trie counts; leaves of a piece and of a range, and how many borders of ranges there are at most.
SLICE, CHUNK, RANGE, BORDERS = 6_000_000, 512, 400_000, 200_000
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Depths up to here are found for all leaves at once, deeper ones leaf by leaf.
NEAR = 48
#: Bytes of terms: letters and all that is not ASCII.
KEEP = np.zeros(256, bool)
KEEP[0x41:0x5B] = KEEP[0x61:0x7B] = KEEP[0x80:] = True
PIECE = "lang string, first binary, leaves long, depth binary, sizes binary, labels binary, docs binary, fan binary, source binary, count binary, sources array<string>"
ARRAYS = {"depth": np.int32, "sizes": np.int32, "labels": np.uint8, "docs": np.int64, "fan": np.int32, "source": np.int32, "count": np.int64}


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a large_binary array: all bytes, and where each term begins."""
    if not len(terms):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return np.frombuffer(terms.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def shared(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes each of the sorted terms shares with the one before."""
    out, size = np.zeros(len(bounds) - 1, np.int64), np.diff(bounds)
    left, least = np.arange(1, len(size)), np.minimum(size[1:], size[:-1])
    for k in range(NEAR):
        left = left[least[left - 1] > k]
        left = left[data[bounds[left - 1] + k] == data[bounds[left] + k]]
        out[left] = k + 1
    for i in left.tolist():
        n = int(least[i - 1])
        differ = data[bounds[i - 1] : bounds[i - 1] + n] != data[bounds[i] : bounds[i] + n]
        out[i] = int(differ.argmax()) if differ.any() else n
    return out


@dataclass
class Trie:
    """A radix trie over bytes by its leaves in order; leaf i has the next fan[i] of (source, count), source a place in `sources`."""

    depth: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    docs: np.ndarray
    fan: np.ndarray
    source: np.ndarray
    count: np.ndarray
    sources: list[str]

    def __len__(self) -> int:
        return len(self.docs)

    @classmethod
    def of(cls, terms: pa.Array, docs: np.ndarray, fan: np.ndarray, source: np.ndarray, count: np.ndarray, sources: list[str]) -> Trie:
        """terms: different ones, sorted."""
        data, bounds = bytes_of(terms)
        depth = shared(data, bounds)
        sizes = np.diff(bounds) - depth
        return cls(depth, sizes, data[ranges(bounds[:-1] + depth, sizes)], docs, fan, source, count, sources)

    def terms(self) -> pa.Array:
        """The leaves' whole terms: what a leaf shares is read off the last leaf that has the byte on its own label."""
        sizes, depth = self.sizes.astype(np.int64), self.depth.astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(depth + sizes)])
        data = np.empty(bounds[-1], np.uint8)
        data[ranges(bounds[:-1] + depth, sizes)] = self.labels
        place = np.arange(len(self))
        for k in range(min(int(depth.max(initial=0)), NEAR)):
            own = np.maximum.accumulate(np.where(depth <= k, place, 0))
            need = np.flatnonzero(depth > k)
            data[bounds[need] + k] = data[bounds[own[need]] + k]
        for i in np.flatnonzero(depth > NEAR).tolist():
            data[bounds[i] + NEAR : bounds[i] + depth[i]] = data[bounds[i - 1] + NEAR : bounds[i - 1] + depth[i]]
        return strings(data, bounds)

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each leaf's label and counters begin."""
        return tuple(np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (self.sizes, self.fan))

    def part(self, low: int, high: int, first: bytes) -> Trie:
        """Leaves low to high - 1, of which the first is the term given: its whole path is its label."""
        labels, counters = ([int(x[k]) for k in (low, low + 1, high)] for x in self.ends)
        depth, sizes, own = self.depth[low:high].copy(), self.sizes[low:high].copy(), slice(counters[0], counters[2])
        depth[0], sizes[0] = 0, len(first)
        used, source = np.unique(self.source[own], return_inverse=True)
        return Trie(depth, sizes, np.concatenate([np.frombuffer(first, np.uint8), self.labels[labels[1] : labels[2]]]), self.docs[low:high], self.fan[low:high], source, self.count[own], [self.sources[k] for k in used])

    def where(self, keep: np.ndarray) -> Trie:
        held = np.repeat(keep, self.fan)
        return Trie.of(self.terms().filter(pa.array(keep)), self.docs[keep], self.fan[keep], self.source[held], self.count[held], self.sources)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each different one begins, and how often it is there."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(keys)))


def merge(tries: list[Trie]) -> Trie:
    """One trie of all leaves, their documents and counters added up."""
    if len(tries) == 1:
        return tries[0]
    sources = sorted({s for t in tries for s in t.sources})
    place = {s: k for k, s in enumerate(sources)}
    terms = pa.concat_arrays([t.terms() for t in tries])
    order = np.asarray(pc.array_sort_indices(terms), np.int64)
    terms = terms.take(pa.array(order))
    data, bounds = bytes_of(terms)
    size = np.diff(bounds)
    new = np.ones(len(terms), bool)
    new[1:] = (size[1:] != size[:-1]) | (shared(data, bounds)[1:] != size[1:])
    leaf = np.empty(len(terms), np.int64)
    leaf[order] = np.cumsum(new) - 1
    docs = np.add.reduceat(np.concatenate([t.docs for t in tries])[order], np.flatnonzero(new)) if len(terms) else np.zeros(0, np.int64)
    source = np.concatenate([np.array([place[s] for s in t.sources], np.int64)[t.source] for t in tries])
    key = np.repeat(leaf, np.concatenate([t.fan for t in tries])) * max(len(sources), 1) + source
    own = np.argsort(key, kind="stable")
    at, _ = runs_of(key[own])
    key, count = key[own][at], np.add.reduceat(np.concatenate([t.count for t in tries])[own], at) if len(at) else np.zeros(0, np.int64)
    owner, source = np.divmod(key, max(len(sources), 1))
    return Trie.of(terms.filter(pa.array(new)), docs, np.bincount(owner, minlength=len(docs)), source, count, sources)


# ---- pieces as rows ----------------------------------------------------------------------------------------------------


def pieces(lang: str, trie: Trie, borders: list[bytes] | None = None, first_range: int = 0, chunk: int = CHUNK) -> pa.RecordBatch:
    """Rows of PIECE, of `chunk` leaves at most; with borders (ascending terms at which a range begins) cut there, and with the `range`."""
    terms = trie.terms()
    term = lambda k: terms[k].as_py()
    cuts = [0, *(bisect_left(range(len(trie)), x, key=term) for x in borders or []), len(trie)]
    rows: dict[str, list] = {n: [] for n in ["range", "first", "leaves", "sources", *ARRAYS]}
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for low in range(a, b, chunk):
            one = trie.part(low, min(low + chunk, b), term(low))
            rows["range"].append(first_range + k)
            rows["first"].append(term(low))
            rows["leaves"].append(len(one))
            rows["sources"].append(one.sources)
            for name, kind in ARRAYS.items():
                rows[name].append(getattr(one, name).astype(kind).tobytes())
    n = len(rows["first"])
    arrays = {"lang": pa.array([lang] * n, pa.string()), "first": pa.array(rows["first"], pa.binary()), "leaves": pa.array(rows["leaves"], pa.int64())}
    arrays |= {name: pa.array(rows[name], pa.binary()) for name in ARRAYS} | {"sources": pa.array(rows["sources"], pa.list_(pa.string()))}
    if borders is not None:
        arrays["range"] = pa.array(rows["range"], pa.int64())
    return pa.record_batch(arrays)


def tries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Trie]]:
    """Language, range (0 without one) and trie of PIECE rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            yield row["lang"], row.get("range", 0), Trie(*(np.frombuffer(row[n], kind) for n, kind in ARRAYS.items()), row["sources"])


# ---- counting ----------------------------------------------------------------------------------------------------------


def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each occurrence's text and term's number, and the different terms, sorted."""
    low = LOWER[texts.data]
    low[~KEEP[low]] = 0x20
    words = words_of(Texts(low, texts.bounds))
    coded = strings(low[low != 0x20], np.concatenate([[0], np.cumsum(words.ends - words.starts)])).dictionary_encode()
    order = np.asarray(pc.array_sort_indices(coded.dictionary), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return words.text(), rank[np.asarray(coded.indices, np.int64)], coded.dictionary.take(pa.array(order))


def counted_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[str, Trie]]:
    """(text, lang, source) to one trie a slice and language."""
    for batch, texts in slices(batches, most=most):
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        lang, source = np.asarray(langs.indices, np.int64), np.asarray(sources.indices, np.int64)
        sources = sources.dictionary.to_pylist()
        text, term, terms = terms_of(texts)
        leaf = lang[text] * len(terms) + term
        key = np.sort(leaf * len(texts) + text)
        owner = key[runs_of(key)[0]] // len(texts)  # a leaf and a text once
        at, docs = runs_of(owner)
        leaves = owner[at]
        key = np.sort(leaf * max(len(sources), 1) + source[text])
        at, count = runs_of(key)
        owner, which = np.divmod(key[at], max(len(sources), 1))
        fan = np.bincount(np.searchsorted(leaves, owner), minlength=len(leaves))
        edges, ends = np.searchsorted(leaves, np.arange(len(langs.dictionary) + 1) * len(terms)), np.concatenate([[0], np.cumsum(fan)])
        for k, name in enumerate(langs.dictionary.to_pylist()):
            a, b = edges[k], edges[k + 1]
            if a < b:
                own = slice(ends[a], ends[b])
                yield name, Trie.of(terms.take(pa.array(leaves[a:b] - k * len(terms))), docs[a:b], fan[a:b], which[own], count[own], sources)


def counted(docs: DataFrame, scratch: Scratch, min_docs: int, leaves: int = RANGE, slice_bytes: int = SLICE) -> DataFrame:
    """PIECE rows of the terms that at least min_docs documents of their language have, each once."""
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    walked = scratch.put(own.mapInArrow(lambda batches: (pieces(lang, trie) for lang, trie in counted_slices(batches, slice_bytes)), PIECE), "walked")
    rows, total = walked.agg(F.count("*"), F.sum("leaves")).first()
    n_ranges = min(-(-(total or 0) // leaves), BORDERS)
    sample = walked.select("lang", "first").sample(min(1.0, 20 * n_ranges / max(rows, 1)), seed=1).orderBy("lang", "first").limit(20 * BORDERS).collect() if n_ranges > 1 else []
    borders: dict[str, list[bytes]] = {}
    for k in range(1, n_ranges):
        if sample:
            lang, first = sample[k * len(sample) // n_ranges]
            borders.setdefault(lang, []).append(bytes(first))
    borders = {lang: sorted(set(x)) for lang, x in borders.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, trie in tries_of(batches):
            yield pieces(lang, trie, borders.get(lang, []))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base, at = [], 0, 0, None

        def done() -> pa.RecordBatch:
            whole = merge(held)
            return pieces(at[0], whole.where(whole.docs >= min_docs))

        for lang, number, trie in tries_of(batches):
            if at is not None and at != (lang, number):
                yield done()
                held, size, base = [], 0, 0
            at = lang, number
            held.append(trie)
            size += len(trie)
            if size > 2 * base + 200_000:  # repeated leaves become one
                held = [merge(held)]
                size = base = len(held[0])
        if at is not None:
            yield done()

    dealt = walked.mapInArrow(deal, f"{PIECE}, range long").repartition("lang", "range").sortWithinPartitions("lang", "range", "first")
    return dealt.mapInArrow(join, PIECE)


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    wide = len(counts) and (int(counts.max()) + 1 > (2**63 - 1) // SCALE)
    top = (counts.astype(object) if wide else counts) + 1
    return (1 + SCALE * top // (totals + terms)).astype(np.int64)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top: int = TOP, leaves: int = RANGE, slice_bytes: int = SLICE) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = scratch.put(counted(docs, scratch, min_docs, leaves, slice_bytes), "kept")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, trie in tries_of(batches):
            total = np.zeros(len(trie.sources), np.int64)
            np.add.at(total, trie.source, trie.count)
            yield pa.record_batch({"lang": pa.array([lang] * len(total), pa.string()), "source": pa.array(trie.sources, pa.string()), "total": pa.array(total)})

    own = kept.mapInArrow(add_up, "lang string, source string, total long").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    totals: dict[str, dict[str, int]] = {}
    for lang, source, n in groups.join(own, ["lang", "source"], "left").collect():
        totals.setdefault(lang, {})[source] = n or 0
    terms = {lang: n for lang, n in kept.groupBy("lang").agg(F.sum("leaves")).collect()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, str], tuple[np.ndarray, list[str]]] = {}
        for lang, _, trie in tries_of(batches):
            names = sorted(totals[lang])
            at = {s: k for k, s in enumerate(names)}
            total, n = np.array([totals[lang][s] for s in names], object), terms[lang]
            total = total if int(total.sum()) + n > 2**62 else total.astype(np.int64)
            item = [x.decode() for x in trie.terms().to_pylist()]
            table = np.zeros((len(names), len(item)), np.int64)
            table[np.array([at[s] for s in trie.sources], np.int64)[trie.source], np.repeat(np.arange(len(item)), trie.fan)] = trie.count
            p = shares(table, total[:, None], n)
            q = shares(table.sum(0), total.sum(), n)
            held = sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
            for k, s in enumerate(names):
                held[k] += difference(p[k], p).sum(1)
                own = np.flatnonzero((table[k] > 0) & (p[k] > q))
                value = difference(p[k][own], q[own])
                # terms come in order, so a stable sort keeps ties in order
                old = best.get((lang, s), (np.zeros(0, np.int64), []))
                value, name = np.concatenate([old[0], value]), [*old[1], *(item[i] for i in own)]
                order = np.argsort(-value, kind="stable")[:top]
                best[lang, s] = value[order], [name[i] for i in order]
        for lang, held in sums.items():
            names = sorted(totals[lang])
            for k, s in enumerate(names):
                other = [j for j in range(len(names)) if j != k]
                yield rows(lang, s, "pair", [names[j] for j in other], held[k][other])
        for (lang, s), (value, name) in best.items():
            yield rows(lang, s, "term", name, value)

    def rows(lang: str, source: str, part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
        n = len(item)
        return pa.record_batch([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    found = scratch.put(kept.sortWithinPartitions("lang", "first").mapInArrow(walk, "lang string, source string, part string, item string, value long"), "found")
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.withColumnRenamed("source", "item")
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
