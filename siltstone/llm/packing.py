"""Best-fit packing by sum of squares: documents into sequences of at most `budget` tokens.

Three steps, each on small rows:

1. `pieces` tokenises whole texts and cuts only what is longer than a sequence. Each row has a document's piece with its
   length and checksum; ids are kept on request.
2. `pack` places pieces. A task holds about `per_task` rows of a few bytes, whatever the corpus: the number of tasks grows
   instead. Within a task each piece goes where the sum over residual gaps g of N(g)^2, N(g) being the number of open
   sequences with gap g, becomes smallest. That rule leaves few sequences open; the pieces of the emptiest, per_task / fan_in
   at most, are packed again with the leftovers of `fan_in` tasks together, at least once and until one task is left; so no task of any step
   holds more than per_task rows, even where lengths never fill a sequence. No key decides where a piece goes, so no source
   or group of copies is hot.
3. `sequences` builds the token sequences themselves.

Defined results: null or empty text is one piece that holds the end token alone; rows with equal or null doc_id are
separate documents; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut

SEQUENCE_TOKENS = 2048
END_ID = 0
PIECES_PER_TASK = 200_000
FAN_IN = 16
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The pre-tokens of byte-level BPE: the published pattern, with possessive repeats, which match the same.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """Byte-level BPE's letters: a printable byte is its own letter, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_ranks(tokenizer: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as bytes and ranks, if it is plain byte-level BPE whose ids ascend as its merges do."""
    model, cut_ = tokenizer["model"], tokenizer["pre_tokenizer"] or {}
    plain = tokenizer["normalizer"] is None and cut_.get("type") == "ByteLevel" and cut_.get("use_regex") and not cut_.get("add_prefix_space")
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or odd or any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in tokenizer["added_tokens"]):
        return None
    letters, vocabulary = byte_letters(), model["vocab"]
    merged = [vocabulary.get("".join(x if isinstance(x, list) else x.split(" ")), -1) for x in model["merges"]]
    if merged != sorted(merged) or len(merged) + len(letters) != len(vocabulary):
        return None
    return {bytes(letters[c] for c in x): i for x, i in vocabulary.items()}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], bytes]:
    """A text's ids as little-endian unsigned 32-bit numbers, as `tokenizers` gives them with add_special_tokens=False.

    A vocabulary of plain byte-level BPE is read into `tiktoken`, which gives the same ids (tests hold them together) in a
    fifth of the time; added tokens' strings in a text have those tokens' ids. Others go through `tokenizers` itself.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    ranks = byte_ranks(file)
    if ranks is None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: array("I", own.encode(text, add_special_tokens=False).ids).tobytes()
    import tiktoken

    added = {x["content"]: x["id"] for x in file["added_tokens"]}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    allowed = set(added)

    def ids(text: str) -> list[int]:
        if any(x in text for x in allowed):
            return encoding.encode(text, allowed_special=allowed, disallowed_special=())
        return encoding.encode_ordinary(text)

    return lambda text: array("I", ids(text)).tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(n: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of n ids' pieces: all full but the first."""
    if n <= budget:
        return [(0, n)]
    first = n % budget or budget
    return [(0, first), *((at, budget) for at in range(first, n, budget))]


def pieces(docs: DataFrame, tokenizer: str | None = None, budget: int = SEQUENCE_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its ids, then END_ID, cut into pieces of `budget` ids if there are more."""
    path = tokenizer or default_tokenizer()
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):  # so that few texts are Python strings at a time
                part = batch.slice(at, 200)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, x in enumerate(part.column("text").to_pylist()):
                    x = encode(x or "") + end
                    for j, (s, n) in enumerate(cut_points(len(x) // 4, budget)):
                        own = x[4 * s : 4 * (s + n)]
                        rows.append(k), piece.append(j), start.append(s), length.append(n), crc.append(zlib.crc32(own))
                        if keep_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                columns = [part.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_COLUMNS + ", ids array<int>" * keep_ids)


def place(lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares best fit in the order given: each piece's sequence and offset, and each sequence's residual gap."""
    count = np.zeros(budget + 1)  # open sequences by gap; [0] stays 0, full ones don't count
    waiting: list[list[int]] = [[] for _ in range(budget + 1)]
    sequence, offset, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        # With rest r the sum changes by 2 * (N(r) - N(r + s)) + 2, by 1 less if r = 0 as full sequences drop out.
        change = np.where(count[s:] > 0, count[: budget + 1 - s] - count[s:], np.inf)
        change[budget - s] = count[budget - s] - 0.5  # a new sequence: always to be had, and no gap that was counted goes
        change[0] -= 0.5
        rest = int(change.argmin())
        gap = rest + s
        if gap == budget:
            gaps.append(budget)
            own = len(gaps) - 1
        else:
            own = waiting[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i], gaps[own] = own, budget - gap, rest
        if rest:
            waiting[rest].append(own)
            count[rest] += 1
    return sequence, offset, np.asarray(gaps, np.int64)


def emptiest(own: np.ndarray, gaps: np.ndarray, most: int) -> np.ndarray:
    """Of pieces with their sequence: those of the sequences with the largest gaps, so many pieces at most."""
    pieces = np.bincount(own, minlength=len(gaps))
    order = np.argsort(-gaps, kind="stable")
    chosen = np.zeros(len(gaps), bool)
    chosen[order[(np.cumsum(pieces[order]) <= most) & (gaps[order] > 0)]] = True
    return chosen[own]


def pack(found: DataFrame, budget: int = SEQUENCE_TOKENS, per_task: int = PIECES_PER_TASK, fan_in: int = FAN_IN) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `budget`; sequences are gapless from 0."""
    found = cut(found)
    n = found.count()
    tasks, step = max(1, -(-n // per_task)), 0
    left = found.repartition(tasks) if n else found
    done = []
    while True:
        last = tasks == 1 and step > 0

        def run(batches: Iterator[pa.RecordBatch], step: int = step, last: bool = last) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(kept) if (kept := [b for b in batches if b.num_rows]) else None
            if table is None:
                return
            lengths = np.asarray(table.column("length"), np.int64)
            # At random first, where the rule leaves few gaps; what is packed again comes large pieces first.
            order = np.argsort(-lengths, kind="stable") if step else np.random.default_rng(7).permutation(len(lengths))
            sequence, offset, gaps = place(lengths[order], budget)
            base = (step << 58) + (TaskContext.get().partitionId() << 28)
            own, at = np.empty_like(sequence), np.empty_like(offset)
            own[order], at[order] = sequence, offset
            again = np.zeros(len(own), bool) if last else emptiest(own, gaps, max(1, per_task // fan_in))
            table = table.append_column("sequence_id", pa.array(own + base)).append_column("offset", pa.array(at)).append_column("_open", pa.array(again))
            yield from table.to_batches()

        names = [x for x in found.columns if x not in ("sequence_id", "offset", "_open")]
        placed = left.select(names).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(names).schema) + ", sequence_id long, offset long, _open boolean")
        placed = cut(placed)
        done.append(placed.where(~F.col("_open")).drop("_open"))
        if last:
            return reduce(DataFrame.unionAll, done)
        tasks, step = -(-tasks // fan_in), step + 1
        left = placed.where("_open").drop("_open").repartition(tasks)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None, budget: int = SEQUENCE_TOKENS) -> DataFrame:
    """The token sequences: sequence_id and its `ids`, pieces in order of offset. Needs distinct, non-null doc_ids."""
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces(docs, tokenizer, budget, keep_ids=True), ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)).alias("ids"))
