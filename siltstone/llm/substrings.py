"""Substring dedup on words by super-k-mers: drop words in windows that a document with a smaller doc_id also has.

1. Every window of `width` words has a minimiser, the smallest hash of its MER-word runs, and equal windows have equal
   minimisers. Consecutive windows with one minimiser are a super-k-mer; first only its minimiser, document and place
   travel. Minimisers that just one document has are out: none of their windows is anywhere else.
2. The other super-k-mers go, each as one packed string, to the bucket of their minimiser. There the windows are sorted by
   fingerprint, documents ascending, so equal ones lie together, the first of them in the smallest document; the bytes of
   each stretch of matches are then compared, so the fingerprint decides nothing alone.
3. A minimiser with over HOT super-k-mers (a passage that many documents share) isn't gathered in a bucket: its windows meet
   by 128-bit fingerprint in parts of a fixed size (siltstone.llm.desks).

Defined results: null or empty text has no words; rows without doc_id lose nothing and take nothing from others; rows with
equal doc_id don't take from each other (neither doc_id is smaller); an empty table gives no rows; other columns than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import MIX_2, Scratch, U, Words, covered, cut, mix, prefix_sums, ranges, run_starts, slices, sliding_min, spans_hash, texts_of, whole_groups, windows_hash, words_of
from siltstone.llm.desks import IDS, gathered, with_ids

WIDTH, MER = 50, 16
HOT = 1000
SECOND_BASE = U(0xD6E8FEB86659FD93)


def super_kmers(words: Words, width: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, and minimiser of each super-k-mer."""
    hashes = words.hashes()
    starts = run_starts(words.first, width)
    if not len(starts):
        return starts, starts, np.zeros(0, U)
    firsts, values = windows_hash(words, hashes, mer)
    order = np.full(len(hashes), np.iinfo(U).max, U)
    order[firsts] = mix(values ^ MIX_2)
    least = sliding_min(order, width - mer + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), least[at]


def places(docs: DataFrame, width: int, mer: int) -> DataFrame:
    """Every super-k-mer's minimiser, document and place, without its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words = words_of(texts)
            starts, count, least = super_kmers(words, width, mer)
            text = np.searchsorted(words.first, starts, "right") - 1
            own = [part.column(c).take(pa.array(text)) for c in ("doc_id", "print")]
            yield pa.RecordBatch.from_arrays([*own, pa.array((starts - words.first[text]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(least.view(np.int64))], ["doc_id", "print", "start", "n", "mini"])

    return docs.mapInArrow(run, "doc_id long, print long, start int, n int, mini long")


def packed(found: DataFrame, width: int) -> DataFrame:
    """found: doc_id, print, text, at (array of start, n, mini, hot). A row per super-k-mer with its words as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words = words_of(texts)
            lists = part.column("at")
            counts = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            start, n, mini, hot = (flat.field(x) for x in ("start", "n", "mini", "hot"))
            text = np.repeat(np.arange(len(texts)), counts)
            first = words.first[text] + np.asarray(start)
            low, high = words.starts[first], words.ends[first + np.asarray(n) + width - 2]
            raw = texts.data.tobytes()
            strings = pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
            own = [part.column(c).take(pa.array(text)) for c in ("doc_id", "print")]
            yield pa.RecordBatch.from_arrays([*own, start, mini, hot, strings], ["doc_id", "print", "start", "mini", "hot", "words"])

    return found.mapInArrow(run, "doc_id long, print long, start int, mini long, hot boolean, words binary")


def strings_windows(column: pa.Array, width: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed strings: the words, each window's first word, and two fingerprints of each window."""
    words = words_of(texts_of(column))
    hashes = words.hashes()
    firsts, one = windows_hash(words, hashes, width)
    two = spans_hash(prefix_sums(mix(hashes ^ MIX_2), SECOND_BASE), SECOND_BASE, firsts, firsts + width)
    return words, firsts, one, two


def bucket_matches(group: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole buckets, documents ascending: spans of windows (string, first window, number) that a smaller document has."""
    words, firsts, one, two = strings_windows(group.column("words").combine_chunks(), width)
    string = np.searchsorted(words.first, firsts, "right") - 1
    doc = np.asarray(group.column("doc_id"))[string]
    order = np.argsort(one, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    source = np.empty(len(order), np.int64)
    source[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    hit = np.flatnonzero(doc[source] < doc)
    if not len(hit):
        return hit, hit, hit
    src = source[hit]
    new = np.ones(len(hit), bool)  # a stretch: windows and their sources both go on by one, in one string each
    new[1:] = (firsts[hit[1:]] != firsts[hit[:-1]] + 1) | (string[hit[1:]] != string[hit[:-1]]) | (firsts[src[1:]] != firsts[src[:-1]] + 1) | (string[src[1:]] != string[src[:-1]])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(hit)))
    raw, keep = words.data.tobytes(), np.ones(len(at), bool)
    tokens = lambda first, n: raw[words.starts[first] : words.ends[first + n + width - 2]].split()
    plain = lambda first, n: raw[words.starts[first] : words.ends[first + n + width - 2]]
    for k, (a, b, n) in enumerate(zip(firsts[hit[at]].tolist(), firsts[src[at]].tolist(), count.tolist())):
        if plain(a, n) != plain(b, n) and tokens(a, n) != tokens(b, n):  # white space between words may differ
            keep[k] = False  # two windows with one 128-bit fingerprint, not seen so far
    at, count = at[keep], count[keep]
    own = string[hit[at]]
    return own, firsts[hit[at]] - words.first[own], count


SPANS = "doc_id long, print long, first int, last int"


def cold_spans(strings: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["mini"]):
            string, first, n = bucket_matches(group, width)
            start = np.asarray(group.column("start"))[string] + first
            own = [group.column(c).combine_chunks().take(pa.array(string)) for c in ("doc_id", "print")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(start.astype(np.int32)), pa.array((start + n + width - 1).astype(np.int32))], ["doc_id", "print", "first", "last"])

    return strings.repartition("mini").sortWithinPartitions("mini", "doc_id").mapInArrow(run, SPANS)


def prints_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's string, its first word there, and its fingerprint."""
    words, firsts, one, two = strings_windows(column, width)
    string = np.searchsorted(words.first, firsts, "right") - 1
    return string, firsts - words.first[string], np.stack([one, two], 1)


def hot_spans(strings: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """Of equal strings only one goes to the desks, with its smallest document."""
    strings = with_ids(strings, "words")
    once = strings.groupBy(*IDS).agg(F.min("words").alias("words"), F.min("doc_id").alias("value"))
    marked = gathered(once, "words", lambda c: prints_of(c, width), True, scratch)
    found = strings.select("doc_id", "print", "start", *IDS).join(marked, IDS).where("value < doc_id")
    return found.select("doc_id", "print", (F.col("start") + F.col("low")).cast("int").alias("first"), (F.col("start") + F.col("high") + (width - 1)).cast("int").alias("last"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, mer: int = MER, hot: int = HOT) -> DataFrame:
    """doc_id, print (hash of the text, for rows with equal doc_id), spans: word ranges first:last that smaller documents have."""
    docs = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("print"), "text")
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.put(places(docs, width, mer), "places")
        shared = found.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("many")).where("low < high").select("mini", (F.col("many") > hot).alias("hot"))
        at = found.join(shared, "mini").groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "n", "mini", "hot")).alias("at"))
        strings = scratch.put(packed(docs.join(at, ["doc_id", "print"]), width), "strings")
        spans = cold_spans(strings.where("not hot"), width).unionAll(hot_spans(strings.where("hot"), width, scratch))
        return cut(spans.groupBy("doc_id", "print").agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def dedup(docs: DataFrame, width: int = WIDTH, mer: int = MER, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, and kept: the words that stay, joined by one space, for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, width, mer, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words = words_of(texts)
            lists = part.column("spans")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            flat = lists.flatten()
            base = np.repeat(words.first[:-1], sizes)
            gone = covered(base + np.asarray(flat.field("first")), base + np.asarray(flat.field("last")), len(words.starts))
            kept = [x.tobytes() for x in joined(words, ~gone, len(texts.data))]
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.withColumn("print", F.xxhash64("text")).join(spans, ["doc_id", "print"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def joined(words: Words, keep: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the bytes of the words to keep, one space between them."""
    out, mask = words.data.copy(), np.zeros(size, bool)
    own = np.flatnonzero(keep)
    text = np.searchsorted(words.first, own, "right") - 1
    inner = own[:-1][text[1:] == text[:-1]] if len(own) else own  # kept words with another one after them in their text
    mask[ranges(words.starts[own], words.ends[own] - words.starts[own])] = True
    mask[words.ends[inner]] = True
    out[words.ends[inner]] = 0x20
    sizes = np.bincount(text, words.ends[own] - words.starts[own], minlength=len(words.first) - 1).astype(np.int64) + np.bincount(text[:-1][text[1:] == text[:-1]] if len(own) else own, minlength=len(words.first) - 1)
    return np.split(out[mask], np.cumsum(sizes)[:-1])

