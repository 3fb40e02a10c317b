"""Every stage of the pipeline against a plain version, and the whole on odd rows."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import pii, quality
from siltstone.llm.common import texts_of

from . import cases
from .test_packing import check, ids_of
from .test_search import items, passages, plain_leaks

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def documents():
    own = [t for _, t in cases.texts()] + [t for _, t, *_ in passages()]
    own += [f"{cases.prose(40, k)} mail a{k}@b.org or call +1 (706) 555-31{k:02d}, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f9{k:02d}\"" for k in range(4)]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(own)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), COLUMNS).repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(i, int(len(cases.words(t)) > 60), 0) for i, t, *_ in documents()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_quality(docs, trees):
    out = []
    for row in docs:
        x = quality.statistics(texts_of(pa.array([row[1] or ""], pa.string())))[0]
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[f[node]] > t[node])
            total += v[node - len(f)]
        if 1 / (1 + np.exp(-total)) >= corpus_pipeline.QUALITY_AT_LEAST:
            out.append(row)
    return out


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = documents()
    trees = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = plain_quality(own, trees)
    assert 5 < len(kept) < len(own)
    assert rows_of(STAGES["quality"](spark, docs, folder)) == sorted(kept, key=repr)

    component = cases.near_components([(i, t) for i, t, *_ in own], 5, 80)
    assert rows_of(STAGES["near_duplicates"](spark, docs, folder)) == sorted([r for r in own if component[r[0]][1] == r[0]], key=repr)

    leaking = {i for i, _ in plain_leaks([(i, t) for i, t, *_ in own], items())}
    assert leaking
    assert rows_of(STAGES["decontaminate"](spark, docs, folder)) == sorted([r for r in own if r[0] not in leaking], key=repr)

    field = pii.trained()
    masked = [(i, t if t is None else pii.masked(t, pii.all_spans(t, field)[1]), *rest) for i, t, *rest in own]
    assert sum("[EMAIL]" in (r[1] or "") and "[SECRET]" in r[1] for r in masked) == 4
    assert rows_of(STAGES["pii"](spark, docs, folder)) == sorted([(*r[:4], None if r[1] is None else len(r[1])) for r in masked], key=repr)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = STAGES["packing"](spark, docs, folder).collect()
    assert check(packed, plain_pieces(tokenizer, own), 2048) < len(own)


def plain_pieces(tokenizer, docs, budget=2048):
    import zlib

    out = []
    for i, t, *_ in docs:
        ids = ids_of(tokenizer, t)
        first = len(ids) if len(ids) <= budget else len(ids) % budget or budget
        starts = [0, *range(first, len(ids), budget)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def test_run_is_the_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(corpus_pipeline.run(spark, folder).collect(), plain_pieces(tokenizer, docs.collect()), 2048)


def test_stages_take_odd_rows(spark, folder):
    """Null ids and texts, repeated rows, clashing columns, no rows: each stage keeps the schema and what it should."""
    odd = spark.createDataFrame(cases.rows(), cases.SCHEMA)
    rows = cases.rows()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        got = out.collect()
        assert stage(spark, odd.where("false"), folder).collect() == []
        if name != "packing":
            assert out.columns == odd.columns, name
        ids = [r.doc_id for r in got]
        if name == "near_duplicates":  # rows without doc_id stay, and those that share one stay together
            assert ids.count(None) == 2 and ids.count(cases.texts()[9][0]) in (0, 2)
        if name in ("decontaminate", "pii"):
            assert len(got) == len(rows) and ids.count(None) == 2
        if name == "packing":
            assert len({(r.doc_id, r.piece, r.ids_crc32) for r in got}) <= len(got) and ids.count(None) == 2
