"""The operators' queries against their SQL in DuckDB, on the tables and on rows made for it."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siltstone.llm import queries


def odd_documents():
    """Nulls, empty and wordless texts, copies, near copies, a chain of links, runs that overlap themselves, wide characters."""
    words = [f"w{k}" for k in range(120)]
    near = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    texts = [
        None, "", " \t\n", "one", "ONE", "one two", "Two one", near(), near().upper(), near(3), near(3, 60), near(3, 60, 90), near(3, 60, 90, 30),
        "ab " * 700, "é漢😀 b " * 60, "é漢😀 b " * 60, "tail é " + " ".join(words[20:70]), " ".join(words[21:70]), "a" * 399, "a" * 400, "b" * 399, "c" * 401,
        " ".join(words[:49]), " ".join(words[:50]) + "\x0b\x0c\r" + " ".join(words[:50]),
    ]
    return [(7 * k % 24, t) for k, t in enumerate(texts)]


def same(df, sql, folder, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    at = sorted(names)
    want = sorted(repr([r[names.index(c)] for c in at]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in at]) for r in df.collect()) == want
    return want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_tables(spark, sf, name):
    assert same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf, ["documents", "pages", "benchmark", "conversations"])


@pytest.mark.parametrize("name", ["op2_substrings", "op4_suffixes", "op5_minhash", "op11_exact", "op13_middle"])
def test_odd_documents(spark, tmp_path, name):
    ids, texts = zip(*odd_documents())
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    rows = same(queries.QUERIES[name](spark, str(tmp_path)), queries.ORACLE_SQL[name], tmp_path, ["documents"])
    assert len(rows) == len(ids)


def test_odd_benchmark(spark, tmp_path):
    """Marked answers, items shorter than a shingle, empty ones, two length classes, items across the edges of passages."""
    w = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    items = [None, "", "...", "lone", "two words", w(0, 20), f"{w(20, 40)}\nAnswer: {w(40, 48)}", f"{w(50, 60)}\nA: no\n a : {w(60, 70)}", w(100, 200), w(190, 290)]
    texts = [
        None, "", "-", "a LONE b", "Two, words!", "two other words", w(0, 19), w(0, 14), w(2, 20).replace("w9", "x"), w(20, 48), w(20, 42), w(50, 70), f"{w(50, 60)} no {w(60, 70)}",
        *(f"{w(900, 900 + n)} {w(100, 290)} {w(0, 20)}" for n in (5, 31, 95, 250)), w(100, 150) + " x " + w(150, 200), w(0, 300), w(120, 200),
    ]
    for name, key, rows in [("documents", "doc_id", texts), ("benchmark", "item_id", items)]:
        pq.write_table(pa.table({key: pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string())}), tmp_path / f"{name}.parquet")
    name = "op10_decontaminate"
    assert len(same(queries.QUERIES[name](spark, str(tmp_path)), queries.ORACLE_SQL[name], tmp_path, ["documents", "benchmark"])) > 15
