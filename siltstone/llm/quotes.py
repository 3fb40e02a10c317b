"""Chat formatting by quotation linking: messages without their quotes, each linked to the one that it replies to.

1. `parse` reads quote levels (`>`, nested as `>>` or `> >`), drops attribution lines before a quote, and keeps the body:
   the lines of level 0. Quoted passages and bodies are normalised (white space collapsed, ASCII lower case) and cut into
   sentences and lines, which are hashed; so a quote is found again when it was wrapped anew or takes only part of a message.
2. A quoted sentence leads to the latest earlier message of the conversation that has it in its body: as a whole sentence or
   line, else as a run of words anywhere. If no message has it so, it leads where most words of its own lines do, which are
   found in the same way. A message replies to the one that most of its level-1 sentences lead to (the latest of equals),
   else to the one that those of the next deeper level lead to, and so on, else to the turn before.
3. A message that replies to another than the turn before begins a thread. Ordered by (conv_id, thread, turn), each message
   comes after what it replies to, and threads stay together.

"Latest earlier" is an as-of join (`last_before`): both sides are range-partitioned and sorted together by key and turn, a
scan carries the last message on, and what crosses a partition's edge is one row a partition. So a conversation, or a
sentence, with a third of all rows is spread over partitions, and no pairs are made. Runs of words are hashed at the lengths
that the conversation's open quotes have, only in conversations with such quotes, and only what a bitmap of their hashes lets
through is joined; so that work is at most a body's words times those lengths.

Defined results: null or empty text has an empty body; text that is all quote has one too; rows that repeat (conv_id, turn)
share their place, and none of them replies to the other; rows without conv_id or turn are roots of their own; quotes that
nobody wrote, or that only later turns have, link nothing; a word is a run of letters, digits and _, so punctuation doesn't
count within a run of words, and a quote without words is found only as a whole sentence or line; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD_BASE, cut, prefix_sums, spans_hash

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"(?:\bwrote|\bschrieb[^:]*|\ba écrit|\bescribió)[  ]?:\s*$", re.IGNORECASE)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
BITS = 32768  # of Spark's bitmaps
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The body, and the quoted passages as (level, text without marks)."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    inside = 0
    for line in text.split("\n"):
        m = _MARK.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if not inside:
                while body and not body[-1].strip():
                    body.pop()
                if body and _ATTRIBUTION.search(body[-1]):
                    body.pop()
            if level != inside:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        else:
            body.append(line)
        inside = level
    return "\n".join(body).strip(), [(level, "\n".join(x)) for level, x in passages]


def normalised(text: str) -> str:
    return _SPACE.sub(" ", text).strip().translate(_LOWER)


def sentences(text: str) -> list[list[str]]:
    """A passage's normalised sentences, each as its parts on the passage's lines."""
    out: list[list[str]] = []
    now: list[str] = []
    for line in filter(None, map(normalised, text.split("\n"))):
        for part in _SENTENCE_END.split(line):
            now.append(part)
            if part[-1] in ".!?":
                out.append(now)
                now = []
    return [*out, now] if now else out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def own_hashes(body: str) -> list[int]:
    """64-bit hashes of a body's distinct normalised sentences and lines."""
    return [_hash(x) for x in sorted({" ".join(x) for x in sentences(body)} | {x for x in map(normalised, body.split("\n")) if x})]


def word_runs(text: str, lengths: list[int]) -> list[np.ndarray]:
    """For each length the 64-bit hashes of all runs of so many words of a normalised text."""
    words = np.array([_hash(x) for x in _WORD.findall(text)], np.int64).view(np.uint64)
    prefix = prefix_sums(words, WORD_BASE)
    starts = np.arange(len(words) + 1)
    return [spans_hash(prefix, WORD_BASE, starts[: max(len(words) + 1 - k, 0)], starts[k:]).view(np.int64) for k in lengths]


def asked(passages: list[tuple[int, str]]) -> list[dict[str, int]]:
    """What is looked for: each level's distinct sentences (line 0) and, of those on several lines, the parts on each (line 1 and on)."""
    out = []
    for k, ((level, text), parts) in enumerate(sorted({(level, " ".join(x)): x for level, p in passages for x in sentences(p)}.items())):
        for j, part in enumerate([text, *(parts if len(parts) > 1 else [])]):
            n = len(_WORD.findall(part))
            out.append({"level": level, "sentence": k, "line": j, "hash": _hash(part), "words": n, "run": int(word_runs(part, [n])[0][0])})
    return out


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, print (of the text), content, levels, own sentence and line hashes, and what is quoted."""
    one = pa.struct([("level", pa.int32()), ("sentence", pa.int32()), ("line", pa.int32()), ("hash", pa.int64()), ("words", pa.int32()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, levels, passages, own, quoted = [], [], [], [], []
            for x in batch.column("text"):
                body, found = parse(x.as_py() or "")
                bodies.append(body), levels.append(max((k for k, _ in found), default=0)), passages.append(len(found))
                own.append(own_hashes(body))
                quoted.append(asked(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "print")), pa.array(bodies, pa.string()), pa.array(levels, pa.int32()), pa.array(passages, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, pa.list_(one))], ["conv_id", "turn", "role", "print", "content", "levels", "passages", "own", "quoted"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.xxhash64("text").alias("print"), "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, print long, content string, levels int, passages int, own array<long>, quoted array<struct<level int, sentence int, line int, hash long, words int, run long>>")


def runs_of(bodies: DataFrame, open_: DataFrame) -> DataFrame:
    """conv_id, turn, run: the runs of words of bodies that may be among those of open_, by length and a bitmap for each conversation."""
    need = open_.groupBy("conv_id").agg(F.collect_set("words").alias("lengths"), F.bitmap_construct_agg(F.col("run").bitwiseAND(BITS - 1)).alias("bits"), F.max("turn").alias("until"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                conv, turn, content, lengths, bits = (batch.column(k)[row].as_py() for k in range(5))
                bit = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
                found = np.concatenate(word_runs(normalised(content), lengths))
                found = np.unique(found[bit[found & (BITS - 1)]])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), conv)), pa.array(np.full(len(found), turn)), pa.array(found)], ["conv_id", "turn", "run"])

    joined = bodies.where("content <> ''").join(need, "conv_id").where("turn < until")
    return joined.select("conv_id", "turn", "content", "lengths", "bits").mapInArrow(run, "conv_id long, turn long, run long")


def last_before(have: DataFrame, ask: DataFrame, keys: list[str], inclusive: bool = False) -> DataFrame:
    """ask with `found`: the largest `turn` below its own (or equal, if inclusive) that `have` has for the keys, else null.

    keys and turn are non-null longs.
    """
    names = ask.columns
    both = have.select(*keys, "turn").distinct().withColumn("_asks", F.lit(not inclusive)).withColumn("_has", F.lit(True))
    both = ask.withColumn("_asks", F.lit(inclusive)).withColumn("_has", F.lit(False)).unionByName(both, allowMissingColumns=True)
    order = [*keys, "turn", "_asks"]  # at one turn, what has it comes after what asks, unless inclusive
    rows = cut(both.repartitionByRange(*keys, "turn").sortWithinPartitions(*order))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Each batch with the turn found within the partition, whether there is one, and whether the key is the partition's first."""
        first = key = None
        turn, some = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.asarray(batch.column(k)) for k in keys]
            turns, has = np.asarray(batch.column("turn")), np.asarray(batch.column("_has").cast(pa.int8())).astype(bool)
            n = len(turns)
            new = np.zeros(n, bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in own])
            head = tuple(x[0] for x in own)
            first = head if first is None else first
            if key != head:
                key, some = head, False
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            last = np.maximum.accumulate(np.where(has, np.arange(n), -1))
            inner = last >= start
            found = np.where(inner, turns[np.maximum(last, 0)], turn)
            valid = inner | ((start == 0) & some)
            in_first = np.logical_and.reduce([x == f for x, f in zip(own, first)])
            yield batch, np.where(valid, found, 0), valid, in_first
            key, turn, some = tuple(x[-1] for x in own), int(found[-1]), bool(valid[-1])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch, found, valid, in_first in scan(batches):
            end = [TaskContext.get().partitionId(), [int(batch.column(k)[0].as_py()) for k in keys] if end is None else end[1], [int(batch.column(k)[batch.num_rows - 1].as_py()) for k in keys], int(found[-1]), bool(valid[-1])]
        if end:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "low", "high", "turn", "some"), end))], schema=pa.schema([("part", pa.int32()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("turn", pa.int64()), ("some", pa.bool_())]))

    carried: dict[int, int] = {}  # part: the turn that its first key has from the parts before
    key, turn, some = None, 0, False
    for e in sorted(rows.mapInArrow(edges, "part int, low array<long>, high array<long>, turn long, some boolean").collect()):  # one row a partition
        if some and e.low == key:
            carried[e.part] = turn
        if e.some or e.high != key:
            turn, some = e.turn, e.some
        key = e.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch, found, valid, in_first in scan(batches):
            if part in carried:
                found, valid = np.where(~valid & in_first, carried[part], found), valid | in_first
            asks = pc.invert(batch.column("_has"))
            yield batch.select(names).append_column("found", pa.array(found, pa.int64(), mask=~valid)).filter(asks)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema)
    return rows.mapInArrow(run, f"{schema}, found long")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, quote_levels, n_passages, n_linked (sentences of the level that decides), parent_turn, link (quote, previous or root), thread;
    in reply order."""
    rows = cut(parsed(messages))
    whole = rows.where("conv_id is not null and turn is not null")
    own = whole.select("conv_id", "turn", F.explode("own").alias("hash"))
    ask = whole.select("conv_id", "turn", "print", F.inline("quoted")).distinct()
    one = ["conv_id", "turn", "print", "level", "sentence"]
    asked_ = cut(last_before(own, ask, ["conv_id", "hash"]))
    found = asked_.where("found is not null")
    open_ = cut(asked_.where("found is null and words > 0").join(found.where("line = 0"), one, "left_anti").drop("found"))
    if not open_.isEmpty():
        found = found.unionByName(last_before(runs_of(whole, open_), open_, ["conv_id", "run"]).where("found is not null"))
    found = found.groupBy(*one, "found").agg(F.max(F.col("line") == 0).alias("entire"), F.sum("words").alias("words"))
    found = found.groupBy(one).agg(F.max_by("found", F.struct("entire", "words", "found")).alias("found"))
    votes = found.groupBy("conv_id", "turn", "print", "level", "found").agg(F.count("*").alias("votes"))
    best = votes.groupBy("conv_id", "turn", "print", "level").agg(F.max_by("found", F.struct("votes", "found")).alias("quoted_turn"), F.sum("votes").alias("n_linked"))
    best = best.groupBy("conv_id", "turn", "print").agg(F.min_by(F.struct("quoted_turn", "n_linked"), "level").alias("best")).select("conv_id", "turn", "print", "best.*")
    places = whole.select("conv_id", "turn").distinct()
    previous = last_before(places, places, ["conv_id"]).withColumnRenamed("found", "previous_turn")
    replies = whole.select("conv_id", "turn", "print").distinct().join(best, ["conv_id", "turn", "print"], "left").join(previous, ["conv_id", "turn"])
    replies = cut(replies.withColumn("parent_turn", F.coalesce("quoted_turn", "previous_turn")))
    jumps = replies.where("quoted_turn is not null and quoted_turn < previous_turn").select("conv_id", "turn")
    threads = last_before(jumps, places, ["conv_id"], inclusive=True).withColumnRenamed("found", "jump")
    begin = places.groupBy("conv_id").agg(F.min("turn").alias("begin"))
    replies = replies.join(threads, ["conv_id", "turn"]).join(begin, "conv_id").withColumn("thread", F.coalesce("jump", "begin"))
    out = rows.join(replies.select("conv_id", "turn", "print", "parent_turn", "quoted_turn", "n_linked", "thread"), ["conv_id", "turn", "print"], "left")
    return out.select(
        "conv_id", "turn", "role", "content", F.col("levels").alias("quote_levels"), F.col("passages").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn",
        F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("parent_turn").isNotNull(), "previous").otherwise("root").alias("link"), F.coalesce("thread", "turn").alias("thread"),
    ).orderBy("conv_id", "thread", "turn")
