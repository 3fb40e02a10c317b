"""Quality rules: fixed counts of each text, and a calibrated logistic regression over hashed n-grams for the verdict.

`base_counts` computes the rules' numbers of whole texts; lines and windows are held to be equal by their 64-bit hashes. The
model is linear in the shares of hashed words, pairs of words, and runs of 3 and of 5 characters (code points), DIMENSIONS
buckets each, so scoring a text is a gather and a sum over its n-grams; no vector is built. It is fitted on a bounded sample
of labelled rows (SAMPLE rows and SAMPLE_BYTES of hashed shares, chosen by a hash of doc_id), whose shares alone go to the
driver, by full-batch gradient steps with a scale per bucket, and calibrated by Platt's method on rows left out of the fit.
Texts are scored in Arrow batches against THRESHOLD.

Defined results: null and empty texts have zero counts, fail the base rules and aren't kept; without labelled rows of both
kinds the verdict is the smoothed rate of label 1 against THRESHOLD; rows with a null label teach nothing; repeated rows are
judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import BYTE_BASE, MIX_1, Texts, U, Words, covered, cut, inverse, lines_of, powers, run_starts, seen_before, slices, spans_hash, windows_hash, words_of
from siltstone.llm.quality import sample

SAMPLE = 4_000
#: Of the hashed shares (6 bytes a bucket) that the sample's rows have, in all.
SAMPLE_BYTES = 60_000_000
#: Buckets of each kind of n-gram.
DIMENSIONS = 1 << 13
WORDS, RUNS = (1, 2), (3, 5)
WIDTH = (len(WORDS) + len(RUNS)) * DIMENSIONS
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEATED_PERCENT, REPEAT_WIDTH = 20, 30, 8
#: [#*$%&|<>]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def ngram_buckets(texts: Texts, words: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind the text and the bucket of every n-gram."""
    out = []
    for n in WORDS:
        firsts, value = (np.arange(len(hashes)), hashes) if n == 1 else windows_hash(words, hashes, n)
        out.append((np.searchsorted(words.first, firsts, "right") - 1 if n > 1 else words.text(), value))
    characters = np.flatnonzero((texts.data & 0xC0) != 0x80)  # where code points begin
    ends = np.append(characters, len(texts.data))
    bounds = np.searchsorted(characters, texts.bounds)
    for n in RUNS:
        firsts = run_starts(bounds, n)
        low = characters[firsts]
        # A run's bytes, from the sums that its words' hashes have used, spread by one multiplication.
        value = (words.prefix[ends[firsts + n]] - words.prefix[low]) * powers(inverse(BYTE_BASE), len(words.prefix))[low] * MIX_1
        out.append((texts.of(low), value))
    return [(text, (value >> U(40)).astype(np.int64) % DIMENSIONS + k * DIMENSIONS) for k, (text, value) in enumerate(out)]


def base_counts(texts: Texts, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(texts)
    per = lambda x, bounds: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]).astype(np.int64)
    owner = words.text()
    starts, ends, first = lines_of(words, texts)
    line_owner = np.repeat(np.arange(n), np.diff(first))
    some_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    earlier, _ = seen_before(line_owner, spans_hash(words.prefix, BYTE_BASE, starts, ends))
    windows, found = windows_hash(words, hashes, REPEAT_WIDTH)
    before, after = seen_before(owner[windows], found)
    twice = windows[before | after]
    return {
        "n_words": np.diff(words.first).astype(np.int64),
        "word_chars": per(~np.isin(texts.data, _BETWEEN), texts.bounds),
        "n_symbols": per(SYMBOL[texts.data], texts.bounds),
        "n_dup_lines": np.bincount(line_owner, some_word & earlier, minlength=n).astype(np.int64),
        "n_repeat_words": per(covered(twice, twice + REPEAT_WIDTH, len(hashes)), words.first),
    }


#: Bytes that are no code point in a word of their own: white space and UTF-8's continuation bytes.
_BETWEEN = np.array([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)], np.uint8)


@dataclass
class Model:
    weights: np.ndarray  # of all buckets
    bias: float
    slope: float  # Platt's scaling of the margin
    shift: float

    def margin(self, n: int, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = np.full(n, self.bias)
        for text, bucket in grams:
            total += np.bincount(text, self.weights[bucket], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)
        return total

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Of the sample, every fourth row by hash calibrates and the others teach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words = words_of(texts)
            rows: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(texts))]
            for text, bucket in ngram_buckets(texts, words, words.hashes()):
                key, times = np.unique(text * WIDTH + bucket, return_counts=True)
                owner, whole = key // WIDTH, np.bincount(text, minlength=len(texts))
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    own = slice(edges[i], edges[i + 1])
                    rows[i].append(((key[own] % WIDTH).astype(np.uint16), (times[own] / max(whole[i], 1)).astype(np.float32)))
            for name in ("bucket", "share"):
                part = part.append_column(name, pa.array([np.concatenate([x[name == "share"] for x in r]).tobytes() for r in rows], pa.binary()))
            yield part.select(["doc_id", "label", "bucket", "share"])

    taught = sample(docs, labels, label, most).mapInArrow(run, "doc_id long, label int, bucket binary, share binary").withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0)
    taught = cut(taught)  # at most `most` rows
    size = F.octet_length("bucket") + F.octet_length("share")
    within = Window.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)
    rows = taught.withColumn("before", F.sum(size).over(within) - size).where(F.col("before") < most_bytes).drop("before").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    y, apart = np.array([r.label for r in rows], float), np.array([r.apart for r in rows], bool)
    width, rate = WIDTH, (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    if not all(0 < v.sum() < len(v) for v in (y[~apart], y[apart])):
        return Model(np.zeros(width), bias, 1.0, 0.0)
    blocks = []  # rows, few at a time: for each n-gram its row, bucket and share
    for at in range(0, len(rows), 200):
        own = rows[at : at + 200]
        row = np.repeat(np.arange(len(own), dtype=np.uint16), [len(r.bucket) // 2 for r in own])
        blocks.append((slice(at, at + len(own)), row, np.frombuffer(b"".join(bytes(r.bucket) for r in own), np.uint16), np.frombuffer(b"".join(bytes(r.share) for r in own), np.float32)))
    del rows
    use = (~apart).astype(float) / (~apart).sum()
    square = sum(np.bincount(j, x.astype(float) ** 2 * use[own][i], minlength=width) for own, i, j, x in blocks)
    scale = 1 / np.sqrt(square + 1e-8)
    w, b, fast, fast_b, strength = np.zeros(width), bias, np.zeros(width), 0.0, 1e-4
    for _ in range(120):  # gradient steps with momentum, in scaled weights
        grad, grad_b = strength * w, 0.0
        for own, i, j, x in blocks:
            z = np.bincount(i, x * (w * scale)[j], minlength=len(y[own])) + b
            g = (1 / (1 + np.exp(-z)) - y[own]) * use[own]
            grad += np.bincount(j, x * g[i], minlength=width) * scale
            grad_b += g.sum()
        fast, fast_b = 0.9 * fast - 0.05 * grad, 0.9 * fast_b - 0.05 * grad_b
        w, b = w + fast, b + fast_b
    model = Model(w * scale, b, 1.0, 0.0)
    z = np.concatenate([np.bincount(i, x * model.weights[j], minlength=len(y[own])) + b for own, i, j, x in blocks])
    model.slope, model.shift = platt(z[apart], y[apart])
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), with Platt's smoothed targets, by Newton steps."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        h = p * (1 - p)
        grad = np.array([((p - t) * z).sum(), (p - t).sum()])
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, probability (of label 1) and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words = words_of(texts)
            hashes = words.hashes()
            found = base_counts(texts, words, hashes)
            failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED_PERCENT * found["n_words"])
            p = model.probability(model.margin(len(texts), ngram_buckets(texts, words, hashes)))
            columns = found | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= threshold)}
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns.values())], ["doc_id", *columns])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
