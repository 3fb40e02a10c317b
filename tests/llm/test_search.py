"""Archives, quotations, decontamination, the pipeline."""

import gzip
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, queries, quotes, warc
from siltstone.llm.common import texts_of, words_of

from . import cases


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "x" * 1200 + "</p>", "<p>" + "é" * 900 + "</p>"
    rows = [(1, "http://www.b.org/a?q=1", big), (2, "https://a.b.org:8080/", big), (3, None, big), (4, "http://b.org/é x\n", "small"), (5, "http://b.org/2", "small"), (6, "no url", None), (7, "http://c.org/", ""), (8, "http://c.org/", other), (8, "http://c.org/", other), (None, "http://d.org/", big), (9, "http://[bad", "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "http://c.org/", other)]
    return spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, `key` string, `offset` long").repartition(3)


def test_archives_read_back(spark, pages):
    got = sorted((tuple(r) for r in warc.archive_and_read(pages).collect()), key=repr)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    import hashlib

    want = []
    for i, payload in rows:
        same = [j for j, p in rows if p == payload and j is not None]
        head = max(same) if same and len(payload) >= 1000 else None
        revisit = head is not None and i is not None and i < head
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    assert got == sorted(want, key=repr)
    assert sum(x[3] == "revisit" for x in want) == 4


def test_archives_of_nothing(pages):
    assert warc.archive_and_read(pages.where("false")).collect() == []


def test_lookup_and_plain_gzip(spark, pages):
    folder = warc.new_folder(spark)
    captures = warc.write(pages, folder)
    find = warc.Lookup(warc.index(captures, folder, block_lines=2), folder).find
    assert sorted(c.page_id for c in find("http://c.org/")) == [7, 8, 8, 10]
    assert [c.page_id for c in find("http://b.org/a?q=1")] == [1] and find("http://nowhere.org/") == []
    assert [c.payload for c in find("http://b.org/2")] == [b"small"]
    at = folder.removeprefix("file:")
    names = [n for n in os.listdir(at) if n.endswith(".warc.gz")]
    whole = b"".join(gzip.open(f"{at}/{n}").read() for n in names)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == pages.count()


def test_urls_are_found_in_batches(spark):
    """Every capture through the directory and its blocks, with keys that fill several blocks and files."""
    rows = [(k, f"http://h{k % 23}.org/{'hot' if k % 3 == 0 else k // 40}", f"page {k}") for k in range(600)] + [(1000 + k, "http://one.org/", "same") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = warc.new_folder(spark)
    captures = warc.write(pages, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        directory = warc.index(captures, folder, block_lines=7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert directory.select("file").distinct().count() > 1
    want = sorted(map(tuple, captures.collect()))
    assert sorted(map(tuple, warc.lookup(warc.keys_of(pages), directory, folder).collect())) == want
    some = spark.createDataFrame([("http://one.org/",), ("http://h4.org/hot",), ("http://nowhere.org/",), ("",)], "url string")
    keys = {warc.surt(r.url) for r in some.collect()}
    assert sorted(map(tuple, warc.lookup(warc.keys_of(some), directory, folder).collect())) == [c for c in want if c[0] in keys]
    read = warc.records(captures, folder, read_bytes=10_000)
    assert read.rdd.getNumPartitions() > 5 and read.count() == len(rows)


def test_surt_keys():
    assert warc.surt("https://www.B.example.org/x?y=1") == "org,example,b)/x?y=1"
    assert warc.surt("http://a.org:8080") == "org,a:8080)/"


def test_quotes_are_parsed_and_linked(spark):
    rows = [
        (1, 0, "user", "First point here. Second point there.\n\nThird one."),
        (1, 1, "assistant", "An answer to it. With two sentences."),
        (1, 2, "user", "On Monday, someone wrote:\n> An answer to it. With\n> two sentences.\n>> First point here.\n\nI see."),
        (1, 3, "assistant", "Well."),
        (1, 4, "user", "> > old text\n> third  ONE.\nBack to that."),
        (1, 5, "assistant", "Fine."),
        (1, 6, "user", "> nobody said so\nHm."),
        (2, 3, "user", None),
        (2, 3, "user", ">\n> Well."),
        (2, 9, None, ""),
        (None, 1, "user", "> a"),
        (3, None, "user", "b"),
    ]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, hash string, found int")
    got = [((r.conv_id, r.turn, r.content), (r.parent_turn, r.link, r.quote_levels, r.n_linked, r.thread)) for r in quotes.linked(docs.repartition(3)).collect()]
    want = {
        (1, 0, rows[0][3]): (None, "root", 0, 0, 0),
        (1, 1, rows[1][3]): (0, "previous", 0, 0, 0),
        (1, 2, "I see."): (1, "quote", 2, 2, 0),
        (1, 3, "Well."): (2, "previous", 0, 0, 0),
        (1, 4, "Back to that."): (0, "quote", 2, 1, 4),
        (1, 5, "Fine."): (4, "previous", 0, 0, 4),
        (1, 6, "Hm."): (5, "previous", 1, 0, 4),
        (2, 9, ""): (3, "previous", 0, 0, 3),
        (None, 1, ""): (None, "root", 1, 0, 1),
        (3, None, "b"): (None, "root", 0, 0, None),
    }
    twice = [v for k, v in got if k == (2, 3, "")]
    assert sorted(twice) == [(None, "root", 0, 0, 3), (None, "root", 1, 0, 3)]
    assert {k: v for k, v in got if k != (2, 3, "")} == want and len(got) == len(rows)
    assert quotes.linked(docs.where("false")).collect() == []


def test_quotes_of_parts_of_sentences_and_of_lines(spark):
    rows = [
        (1, 0, "Hi Bob,\n\nWe ship on Monday. Bring the logs."),
        (1, 1, "- milk and honey\n- eggs\n- bread of rye"),
        (1, 2, "so be it"),
        (1, 3, "> We ship on Monday.\nGood."),  # fused with the greeting
        (1, 4, "> - eggs\nNo."),  # one line of a list
        (1, 5, "> - milk and honey\n> - bread of rye\nYes."),  # two lines that aren't neighbours
        (1, 6, "> ship on\n> monday\nWhen?"),  # within a sentence, wrapped anew
        (1, 7, "> We ship Monday\nNobody said that."),
        (1, 8, "I said that we ship on Monday. It is so."),
        (1, 9, "> We ship on Monday.\n> Bring\n> the logs, please.\nOld."),  # a whole line or sentence nowhere: the latest that holds it
        (2, 0, "Well. All is well."),
        (2, 1, "I think that he did well."),
        (2, 2, "> Well.\nWhole sentences come first."),
        (2, 3, "> \U0001f44d\n> ...\nNo words."),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.link, r.n_linked) for r in quotes.linked(docs.repartition(3)).collect()}
    want = {(1, 3): (0, "quote", 1), (1, 4): (1, "quote", 1), (1, 5): (1, "quote", 1), (1, 6): (0, "quote", 1), (1, 7): (6, "previous", 0), (1, 9): (8, "quote", 2), (2, 2): (0, "quote", 1), (2, 3): (2, "previous", 0)}
    assert {k: got[k] for k in want} == want


def test_nested_quotes_are_linked_where_level_1_is_not(spark):
    rows = [
        (1, 0, "Original point here. A second one."),
        (1, 1, "Other answer."),
        (1, 2, "> > Original point here.\nYes."),
        (1, 3, "> Other answer.\n>> Original point here.\n>> A second one.\nHm."),
        (1, 4, "> nobody said so\n>>> Other answer.\n>> A second one.\nWell."),
        (1, 5, ">> nobody said so\nEnd."),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    got = {r.turn: (r.parent_turn, r.link, r.n_linked) for r in quotes.linked(docs).collect()}
    assert [got[t] for t in range(2, 6)] == [(0, "quote", 1), (1, "quote", 1), (0, "quote", 1), (4, "previous", 0)]


def test_runs_of_words_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [str(w) for w in rng.choice(["a", "b", "c", "d"], n)]
    said = [words(rng.integers(3, 12)) for _ in range(60)]
    rows, want = [], {}
    for t, x in enumerate(said):
        quote = words(rng.integers(2, 7))
        rows.append((t % 3, t, "> " + " ".join(quote) + "\n" + " ".join(x)))
        holds = [u for u in range(t % 3, t, 3) if any(said[u][i : i + len(quote)] == quote for i in range(len(said[u])))]
        whole = [u for u in holds if said[u] == quote]
        want[t] = max(whole or holds, default=None)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    got = {r.turn: r.parent_turn if r.link == "quote" else None for r in quotes.linked(docs).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 20


def plain_links(rows):
    """rows: (conv, turn, text), distinct places. (parent, link, linked, thread) of each, by the definition."""
    parsed = {(c, t): quotes.parse(x or "") for c, t, x in rows}
    words = lambda x: quotes._WORD.findall(x)
    out = {}
    for (c, t), (_, passages) in parsed.items():
        earlier = sorted(u for d, u in parsed if d == c and u < t)
        bodies = {u: parsed[c, u][0] for u in earlier}
        entire = {u: {" ".join(x) for x in quotes.sentences(b)} | {quotes.normalised(x) for x in b.split("\n")} for u, b in bodies.items()}

        def holds(part, bodies=bodies, entire=entire):
            """The latest message that has it whole, else as a run of words."""
            whole = [u for u, x in entire.items() if part in x]
            w = words(part)
            run = [u for u, b in bodies.items() if w and any(words(quotes.normalised(b))[k : k + len(w)] == w for k in range(len(words(quotes.normalised(b)))))]
            return max(whole or run, default=None)

        votes = {}
        for level, passage in passages:
            for parts in quotes.sentences(passage):
                votes.setdefault((level, " ".join(parts)), parts)
        leads = {}
        for (level, sentence), parts in votes.items():
            to = holds(sentence)
            if to is None and len(parts) > 1:  # by most words of its own lines, the latest of equals
                weight = Counter()
                for part in parts:
                    if (u := holds(part)) is not None:
                        weight[u] += len(words(part))
                to = max(weight, key=lambda u: (weight[u], u), default=None)
            if to is not None:
                leads.setdefault(level, Counter())[to] += 1
        previous = max(earlier, default=None)
        if leads:
            own = leads[min(leads)]
            out[c, t] = (max(own, key=lambda u: (own[u], u)), "quote", sum(own.values()), previous)
        else:
            out[c, t] = (previous, "root" if previous is None else "previous", 0, previous)
    found = {}
    for c, t in sorted(out):
        parent, link, linked, previous = out[c, t]
        jumps = [u for d, u in out if d == c and u <= t and out[d, u][1] == "quote" and out[d, u][0] < out[d, u][3]]
        found[c, t] = (parent, link, linked, max(jumps, default=min(u for d, u in out if d == c)))
    return found


def test_links_equal_brute_force(spark):
    """Conversations made of few words, so that ties, nested quotes, wrapped lines and parts of sentences are many."""
    rng = np.random.default_rng(12)
    sentence = lambda: " ".join(rng.choice(["a", "bb", "c", "Dd"], rng.integers(1, 5)).tolist()) + str(rng.choice([".", "!", ""]))
    rows, bodies = [], {}
    for c in range(6):
        for t in range(14):
            lines = []
            for _ in range(rng.integers(0, 3) if t else 0):
                source = bodies[c, int(rng.integers(0, t))] if rng.random() < 0.7 else [sentence()]
                mark = str(rng.choice(["> ", "> > ", ">>> "]))
                for x in source[: rng.integers(1, 4)]:
                    w = x.split()
                    at = int(rng.integers(0, len(w) + 1)) if rng.random() < 0.4 else 0  # wrapped anew
                    lines += [mark + " ".join(p) for p in (w[:at], w[at:]) if p]
                lines.append("")
            bodies[c, t] = [sentence() for _ in range(rng.integers(1, 4))]
            rows.append((c, t, "\n".join([*lines, *bodies[c, t]])))
    docs = spark.createDataFrame([(*r, "user") for r in rows], "conv_id long, turn long, text string, role string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.link, r.n_linked, r.thread) for r in quotes.linked(docs.repartition(3)).collect()}
    want = plain_links(rows)
    assert got == want
    assert sum(v[1] == "quote" for v in want.values()) > 25 and len({v[3] for v in want.values()}) > 4


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before_equals_brute_force(spark, inclusive):
    rng = np.random.default_rng(4)
    have = [(int(a), int(b)) for a, b in zip(rng.choice([1, 1, 1, 2, 3], 300), rng.integers(0, 400, 300))]
    ask = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.choice([1, 1, 2, 4], 300), rng.integers(0, 400, 300)))]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = quotes.last_before(spark.createDataFrame(have, "g long, turn long"), spark.createDataFrame(ask, "g long, turn long, k long"), ["g"], inclusive).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.k: r.found for r in found} == {k: max((t for h, t in have if h == g and (t < at or inclusive and t == at)), default=None) for g, at, k in ask}


def test_op8_on_plain_conversations(spark, sf):
    rows = queries.op8_quotes(spark, sf).collect()
    source = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert {(r.conv_id, r.turn): r.content for r in rows} == {k: (v or "").strip() for k, v in source.items()}
    for r in rows:
        assert r.parent_turn == max((t for c, t in source if c == r.conv_id and t < r.turn), default=None)


def items():
    return [(1, cases.prose(30, 501)), (2, cases.prose(44, 502) + "\nAnswer: forty two of them"), (3, "Tiny item here"), (4, None), (5, " \n"), (6, cases.prose(200, 506)), (7, cases.prose(30, 501))]


def scattered():
    """Items of one length class, and texts that hold the first in two places far apart: which passages there are decides."""
    first, rows = cases.prose(20, 601).split(), [(31, cases.prose(20, 601)), (32, cases.prose(63, 602)), (33, cases.prose(40, 603)), (34, cases.prose(64, 604))]
    far = [(60 + gap, " ".join([*first[:12], *(f"g{k}" for k in range(gap)), *first[8:]])) for gap in (30, 60, 90, 110, 130)]
    return rows, far


def upper(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


def passages():
    a, b, c = (dict(items())[k] for k in (1, 2, 6))
    w = a.split()
    out = [(1, cases.prose(90, 1) + " " + a + " " + cases.prose(90, 2)), (2, upper(a)), (3, b.split("\nAnswer")[0]), (4, b), (5, " ".join(w[:12] + ["changed"] + w[13:])), (6, " ".join(w[: len(w) // 2])), (7, "so: tiny, ITEM here!"), (8, c + " end"), (9, None), (10, ""), (11, cases.prose(4000, 12) + "\n" + c), (12, cases.prose(500, 13)), (None, a), (2, upper(a))]
    return [(i, t, "x", "y") for i, t in out]


def plain_leaks(docs, tests):
    """Every passage against every item, by the definition."""
    out = []
    ids, texts = [i for i, _ in tests], [t for _, t in tests]
    for index in decontaminate.indexes(ids, texts):
        for i, t in docs:
            words = words_of(decontaminate.folded(texts_of(cases_array(t)))).hashes()
            for n, item in enumerate(index.items):
                steps = range(0, max(len(words) - index.step, 1), index.step)
                if any(index.verify(n, words[a : a + 2 * index.step]) for a in steps):
                    out.append((i, index.ids[n]))
    return sorted(out, key=repr)


def cases_array(text):
    import pyarrow as pa

    return pa.array([text], pa.string())


@pytest.mark.parametrize("most", [20_000, 5, 1])
def test_leaks_equal_brute_force(spark, most):
    more, far = scattered()
    own = passages() + [(i, t, "x", "y") for i, t in far]
    docs = spark.createDataFrame(own, "doc_id long, text string, item_id string, _leaks string")
    tests = spark.createDataFrame([(*r, "z") for r in items() + more], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, tests, most).collect()), key=repr)
    assert got == plain_leaks([(r[0], r[1]) for r in own], items() + more)
    assert 0 < len({i for i, _ in got} & {i for i, _ in far}) < len(far)
    assert {(1, 1), (1, 7), (2, 1), (4, 2), (7, 3), (8, 6), (11, 6), (None, 1)} <= set(got)
    assert not {i for i, _ in got} & {3, 6, 9, 10, 12}
    kept = decontaminate.clean(docs, tests, most)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(({3, 5, 6, 9, 10, 12} | {i for i, _ in far}) - {i for i, _ in got})
    assert decontaminate.leaks(docs, tests.where("false")).collect() == []
    assert decontaminate.clean(docs, tests.where("false")).count() == docs.count()
    assert decontaminate.leaks(docs.where("false"), tests).collect() == []


def test_wand_equals_full_scores():
    index = decontaminate.indexes([1, 2, 6, 7], [dict(items())[k] for k in (1, 2, 6, 7)])
    rng = np.random.default_rng(1)
    for x in index:
        for _ in range(100):
            terms = sorted(rng.choice(len(x.vocabulary), rng.integers(1, len(x.vocabulary)), replace=False).tolist())
            score = np.zeros(len(x.items))
            for t in terms:
                for i, v in x.lists[t]:
                    score[i] += v
            for least in (0.2, 0.6, 1.0):
                assert dict(x.retrieve(terms, least)).keys() == set(np.flatnonzero(score >= least).tolist())


def test_op10_finds_whole_items(spark, sf):
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, sf).collect()}
    tests = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {(d.doc_id, b.item_id) for d in docs for b in tests if b.text in d.text} <= got
