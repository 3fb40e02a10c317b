"""Fill-in-middle: whole results against a plain version, and exact round trips."""

import hashlib
import re

import pytest

from siltstone.llm import middle

from . import cases

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, text, n, "plain", None, None, text
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    return i, text, n, "spm" if spm else "psm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if spm else f"<P>{x}<S>{z}<M>{y}"


def odd_rows():
    own = [(r[0], r[1]) for r in cases.rows()]
    odd = ["<", "P>", "<P", "<S><", "a<P>b", "x <M>", "<M", "S><P", "😀é漢字 a1b\n\r\nć", " x\x85y", "Z" * 50, "<" * 40, "S>M>P>" * 5, "a<b>c" * 9]
    own += [(500 + 20 * k + j, t) for k, t in enumerate(odd) for j in range(12)]
    return own + [(9999, "ab cd. " * 300_000), (7, "same"), (7, "same"), (None, "no name"), (None, "no name"), (None, None)]


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_equal_brute_force(spark, parts):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, n int, form string, id_1 int").repartition(parts)
    done = middle.transform(docs).withColumn("again", middle.restored())
    got = sorted((tuple(r) for r in done.collect()), key=repr)
    assert got == sorted(((*plain(i, t), t or "") for i, t in rows), key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_of_nothing(spark):
    assert middle.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_travel_once(spark, sf):
    """One exchange of texts, used by all three sides; units and cut requests don't move."""
    from siltstone.llm.queries import op13_middle

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = op13_middle(spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 1, plan
