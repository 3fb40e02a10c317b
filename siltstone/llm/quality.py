"""Quality classifier: histogram gradient-boosted trees over document statistics.

`features` computes FEATURES of whole texts, an Arrow batch at a time, from byte histograms, word hashes and line hashes;
doc_id, source, lang and labels are not among them. `fit` grows trees level by level on a bounded sample of labelled rows
(SAMPLE, drawn by a hash of doc_id) whose features alone go to the driver; every tree is complete and kept as flat arrays
(feature, threshold, leaf value), so `Trees.score` walks a whole batch down with a few numpy gathers a level.

Defined results: null and empty texts get the statistics of an empty text (all zero) and the score the trees give these;
without labelled rows of both kinds the score is the smoothed rate of label 1 for every text; rows with a null label teach
nothing; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BYTE_BASE, U, Texts, lines_of, mix, run_starts, seen_before, slices, spans_hash, windows_hash, words_of

#: Labelled rows to fit on, at most.
SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE, L2, LEAST_ROWS = 150, 4, 64, 0.1, 1.0, 10

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "symbol": b"#*$%&<>@^~=+",
    "bar": b"|", "quote": b"\"'`()[]{}", "dash": b"-_/\\", "space": b" ", "newline": b"\n", "control": bytes(x for x in range(32) if x != 10) + b"\x7f", "high": bytes(range(128, 256)),
}
_LUT = np.zeros((256, len(_CLASSES)))
for _k, _own in enumerate(_CLASSES.values()):
    _LUT[list(_own), _k] = 1
FEATURES = [
    *(f"share_{k}" for k in _CLASSES), "entropy", "log_chars", "log_words", "mean_word", "sd_word", "longest_word", "shares_1", "shares_2", "distinct_words", "distinct_pairs", "distinct_triples", "repeated_next", "top_word",
    "lines", "mean_line", "dup_lines", "lines_with_end", "word_ends_stop", "word_ends_odd", "word_starts_upper",
]


def statistics(texts: Texts) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, data = len(texts), texts.data
    out = np.zeros((n, len(FEATURES)), np.float32)
    put = lambda name, x: out.__setitem__((slice(None), FEATURES.index(name)), x)
    size = np.diff(texts.bounds)
    text = np.repeat(np.arange(n), size)
    histogram = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = histogram / np.maximum(size, 1)[:, None]
    out[:, : len(_CLASSES)] = share @ _LUT
    put("entropy", -(share * np.log2(np.maximum(share, 1e-12))).sum(1))
    put("log_chars", np.log1p(histogram[:, :128].sum(1) + histogram[:, 192:].sum(1)))
    words = words_of(texts, lower=True)
    counts = np.diff(words.first)
    some = np.maximum(counts, 1)
    owner = words.text()
    by = lambda x: np.bincount(owner, x, minlength=n) / some
    put("log_words", np.log1p(counts))
    length = (words.ends - words.starts).astype(float)
    mean = by(length)
    put("mean_word", mean)
    put("sd_word", np.sqrt(np.maximum(by(length**2) - mean**2, 0)))
    if len(length):
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        put("longest_word", np.log1p(longest))
    put("shares_1", by(length <= 2))
    put("shares_2", by(length >= 12))
    hashes = words.hashes()
    for name, k in (("distinct_words", 1), ("distinct_pairs", 2), ("distinct_triples", 3)):
        first, found = (np.arange(len(hashes)), hashes) if k == 1 else windows_hash(words, hashes, k)
        own = owner[first]
        earlier, _ = seen_before(own, found)
        put(name, 1 - np.bincount(own, earlier, minlength=n) / np.maximum(np.bincount(own, minlength=n), 1))
    pairs = run_starts(words.first, 2)
    put("repeated_next", np.bincount(owner[pairs], hashes[pairs] == hashes[pairs + 1], minlength=n) / some)
    if len(hashes):
        key = mix(hashes + owner.astype(U))
        order = np.argsort(key)
        runs = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        top = np.zeros(n)
        np.maximum.at(top, owner[order[runs]], np.diff(np.append(runs, len(key))).astype(float))
        put("top_word", top / some)
        last = texts.data[words.ends - 1]
        put("word_ends_stop", by(np.isin(last, list(b".,;:?"))))
        put("word_ends_odd", by(np.isin(last, list(b"!#*$%&|<>@^~=+"))))
        put("word_starts_upper", by((texts.data[words.starts] >= 65) & (texts.data[words.starts] <= 90)))
    starts, ends, first = lines_of(words, texts)
    line_owner = np.repeat(np.arange(n), np.diff(first))
    lines = np.diff(first)
    earlier, _ = seen_before(line_owner, spans_hash(words.prefix, BYTE_BASE, starts, ends))
    put("lines", np.log1p(lines))
    put("mean_line", np.log1p(size / lines))
    put("dup_lines", np.bincount(line_owner, earlier & (ends > starts), minlength=n) / lines)
    put("lines_with_end", np.bincount(line_owner, (ends > starts) & np.isin(data[np.maximum(ends, 1) - 1], list(b".!?")) if len(data) else np.zeros(len(starts)), minlength=n) / lines)
    return out


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node i's children are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if above
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total, row = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Boosting of logistic loss; splits are sought over at most BINS quantile bins a feature."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    inner = 2**depth - 1
    if not 0 < y.sum() < len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin > k if x > edges[k]
    flat = binned + np.arange(x.shape[1]) * BINS
    width = x.shape[1] * BINS
    valid = np.concatenate([np.arange(BINS) < len(e) for e in edges])
    features, thresholds, values = [], [], []
    total = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            low, many = 2**level - 1, 2**level
            key = ((node - low)[:, None] * width + flat).ravel()
            sums = [np.bincount(key, np.repeat(w, x.shape[1]), minlength=many * width).reshape(many, x.shape[1], BINS) for w in (g, h, np.ones(len(y)))]
            left = [np.cumsum(s, 2) for s in sums]
            whole = [s[:, :1, -1:] for s in left]
            right = [w - s for w, s in zip(whole, left)]
            worth = lambda s: s[0] ** 2 / (s[1] + L2)
            gain = worth(left) + worth(right) - worth(whole)
            gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS) | ~valid.reshape(1, x.shape[1], BINS)] = -1
            best = gain.reshape(many, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                if gain[k].ravel()[b] > 1e-9:  # else all rows go left
                    feature[low + k], threshold[low + k] = b // BINS, edges[b // BINS][b % BINS]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + L2)
        total += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 on division by 4. A null id teaches nothing either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of at most that many labelled rows which may teach, drawn by a hash of doc_id."""
    drawn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out() & F.col("label").isin(0, 1))
    drawn = drawn.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "label").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # `most` bounds it


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and `x`: the statistics as bytes of float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = [r.tobytes() for r in statistics(texts)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, pa.binary())], [*keep, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, x binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Trees:
    rows = features(sample(docs, labels, label, most), ["doc_id", "label"]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.label for r in rows], float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with `score` (0 to 1; higher: label 1 likelier)."""
    names = [x for x in docs.columns if x != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield part.append_column("score", pa.array(trees.score(statistics(texts))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    return docs.select(names).mapInArrow(run, f"{schema}, score double")
