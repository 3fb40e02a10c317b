"""Every query that has SQL gives what DuckDB gives; the others run."""

import importlib
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone import queries
from siltstone.operators import links

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 9) if isinstance(value, float) else [plain(v) for v in value] if isinstance(value, list) else str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in queries.ORACLE_SQL:
        assert got
        return
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, r))]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got) == want


def test_all_hits_are_all(spark, tmp_path):
    n = 1_000_003
    rows = spark.range(n).selectExpr("id as doc_id", "'tion' as text", "'en' as lang", "'web' as source", "4L as n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["search_all_hits"](spark, str(tmp_path)).count() == n


def test_bursts_count_every_key(spark, tmp_path):
    n = 25_000
    rows = spark.range(2 * n).selectExpr("id as event_id", f"id % {n} as user_id", "timestamp_ntz'2024-01-01 01:00:00' as ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["trend_bursts"](spark, str(tmp_path)).groupBy("start", "n").agg(F.count("*").alias("keys")).collect()
    assert len(got) == 4 and {(r.n, r["keys"]) for r in got} == {(2, n)}


def test_authority_goes_by_numbers(spark, sf, monkeypatch):
    seen, real = [], links.authority
    monkeypatch.setattr(links, "authority", lambda nodes, edges, *a, **k: seen.extend([nodes, edges]) or real(nodes, edges, *a, **k))
    assert queries.QUERIES["link_authority"](spark, sf).dtypes == [("node", "string"), ("mass", "bigint")]
    plan = queries.QUERIES["rank_extended"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 4 and {t for df in seen for _, t in df.dtypes} == {"bigint"}
    assert all("translate(" in line or "Relation" in line for line in plan.split("\n") if "text#" in line)  # no text is joined


def test_ranking_is_whole(spark, sf, monkeypatch):
    seen, real = [], links.authority

    def kept(nodes, edges, *a, **k):
        seen.extend([nodes, edges, real(nodes, edges, *a, **k)])
        return seen[2]

    monkeypatch.setattr(links, "authority", kept)
    ranked = queries.QUERIES["rank_extended"](spark, sf).collect()
    assert sorted(r.doc_id for r in ranked) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert ranked == sorted(ranked, key=lambda r: (-r.score, r.doc_id))
    nodes, edges, mass = ([tuple(r) for r in df.collect()] for df in seen)
    place = {node: i for i, (node,) in enumerate(nodes)}
    follow = np.zeros((len(nodes), len(nodes)))
    for source, target in edges:
        follow[place[target], place[source]] = 1
    follow = follow / np.maximum(follow.sum(axis=0), 1) * 0.85
    jump = np.ones_like(follow) * (1 - follow.sum(axis=0)) / len(nodes)
    want = np.full(len(nodes), 1 / len(nodes))
    for _ in range(400):
        want = (follow + jump) @ want
    got = np.array([m / links.MASS for _, m in sorted(mass, key=lambda r: place[r[0]])])
    assert np.abs(got - want).sum() < 1e-9


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("siltstone.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(name)

    for name in [n for n in sys.modules if n.startswith(("siltstone.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(queries.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
