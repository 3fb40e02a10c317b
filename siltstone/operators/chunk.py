"""Chunking of page text, with overlap: by sentences and by size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import WS_RE2, sql_strip

SIZE, OVERLAP = 500, 50
BOUNDARY = " .,!?\n"


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def sentence_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Sentences put together while they fit (the joining space isn't counted); a sentence is never cut.

    A chunk begins with what the one before repeats: all of a short one, else its last characters, stripped; nothing at
    overlap 0. Linear in the text: parts are joined when a chunk is full.
    """
    out, parts, length, text = [], [], 0, text.strip()
    for s in _SENTENCE_END.split(text) if text else ():
        if parts and length + len(s) > size:
            whole = " ".join(parts)
            out.append(whole.strip())
            tail = "" if not overlap else whole if len(whole) <= overlap else whole[-overlap:].strip()
            parts, length = ([tail], len(tail)) if tail else ([], 0)
        length += len(s) + bool(parts)
        parts.append(s)
    last = " ".join(parts).strip()
    return [*out, last] if last else out


def chunk_by_sentences(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """page_id, chunk_index (from 0), chunk_text."""
    return _pieces(pages, lambda x: sentence_pieces(x, size, overlap))


def fixed_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size`, cut back to a boundary character; the next begins `overlap` before the end of the last.

    If that would not move on, the next begins at the end of the last.
    """
    text, out, start = text.strip(), [], 0
    while start < len(text):
        stop = start + size
        if stop < len(text):
            last = max(text.rfind(c, start + 1, stop + 1) for c in BOUNDARY)
            stop = last if last > 0 else stop
        out.append(text[start:stop])
        start = stop - overlap if stop - overlap > start else stop
    return out


def chunk_by_size(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """page_id, chunk_index, chunk_text."""
    return _pieces(pages, lambda x: fixed_pieces(x, size, overlap))


def _pieces(pages: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    """Where a chunk ends depends on the one before, so the recurrence runs in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, index, text = [], [], []
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, piece in enumerate(cut(content or "")):
                    page.append(i), index.append(k), text.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(index, pa.int32()), pa.array(text, pa.string())], ["page_id", "chunk_index", "chunk_text"])

    return pages.select(F.col("id").cast("long"), "content").mapInArrow(run, "page_id long, chunk_index int, chunk_text string")


def chunk_text(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, method: str = "sentences") -> DataFrame:
    return chunk_by_sentences(pages, size, overlap) if method == "sentences" else chunk_by_size(pages, size, overlap)


def sentences_sql(pages: str) -> str:
    """SQL for the sentence chunks of rows (page_id, content)."""
    return f"""with recursive src as (select page_id, {sql_strip("content")} as t from ({pages})),
    s as (select page_id, string_split(regexp_replace(t, '([.!?]){WS_RE2}+', '\\1' || chr(1), 'g'), chr(1)) as sents from src where t <> ''),
    f as (select page_id, sents, 1 as i, '' as cur, null::varchar as emitted, 0 as idx from s
        union all
        select page_id, sents, i + 1,
            case when i > len(sents) then null
                when length(cur) + length(sents[i]) > {SIZE} and cur <> '' then
                    case when (case when length(cur) <= {OVERLAP} then cur else {sql_strip(f"right(cur, {OVERLAP})")} end) <> ''
                        then (case when length(cur) <= {OVERLAP} then cur else {sql_strip(f"right(cur, {OVERLAP})")} end) || ' ' || sents[i] else sents[i] end
                when cur <> '' then cur || ' ' || sents[i] else sents[i] end,
            case when i > len(sents) then {sql_strip("cur")} when length(cur) + length(sents[i]) > {SIZE} and cur <> '' then {sql_strip("cur")} end,
            idx + (case when emitted is not null then 1 else 0 end)
        from f where i <= len(sents) + 1)
    select page_id, idx::int as chunk_index, emitted as chunk_text from f where emitted is not null and emitted <> ''"""


SENTENCES_SQL = sentences_sql("select doc_id as page_id, text as content from documents")

_STOP = f"""a + case when a + {SIZE} >= n then {SIZE} else
    case when length(regexp_extract(substring(t, a + 1, {SIZE + 1}), '(?s)^(.+)[ .,!?\n]', 1)) > 0 then length(regexp_extract(substring(t, a + 1, {SIZE + 1}), '(?s)^(.+)[ .,!?\n]', 1)) else {SIZE} end end"""
FIXED_SQL = f"""with recursive src as (select doc_id as page_id, {sql_strip("text")} as t from documents),
    f as (select page_id, t, length(t) as n, 0::bigint as a, 0 as idx from src where t <> ''
        union all
        select page_id, t, n, case when stop - {OVERLAP} > a then stop - {OVERLAP} else stop end as b, idx + 1
        from (select *, {_STOP} as stop from f) where case when stop - {OVERLAP} > a then stop - {OVERLAP} else stop end < n)
    select page_id, idx::int as chunk_index, substring(t, a + 1, stop - a) as chunk_text from (select *, {_STOP} as stop from f)"""
