"""robots.txt: texts into a rule table, and requests against it by a path trie for each host.

Reading follows the published protocol (RFC 9309): user-agent lines that follow one another open a group, its allow and disallow
lines are the group's rules, other lines and comments are passed over; an agent is held by its product token, ASCII case ignored,
and obeys all groups that name it, or else those of `*`. A rule is a path from its beginning, in which `*` stands for anything
and a `$` at the end for the end; an empty one is none. The longest rule that matches decides, allow wins ties, and without one
the path is allowed, as /robots.txt always is. Paths and rules are compared as they are written, query included.

Defined results: a null or empty text has no rules; rows with a null host meet no rule; a host's texts, if there are several, are
read as one after the other; requests that repeat stay as often as they come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "host string, pattern string, allow boolean"
#: Different paths of a host that one task holds against its trie.
PIECE_PATHS = 50_000
_LINE = re.compile(r"[\r\n]+")
_TOKEN = re.compile(r"[A-Za-z_-]+|\*")


def path_of(url: Column) -> Column:
    """Path and query of a URL, "/" if there is neither."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))


def groups(text: str) -> Iterator[tuple[list[str], list[tuple[str, bool]]]]:
    """Each group's agents (product tokens, lower case) and rules (pattern, allow)."""
    agents: list[str] = []
    rules: list[tuple[str, bool]] = []
    naming = False
    for line in _LINE.split(text.removeprefix("﻿")):
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not naming and agents:
                yield agents, rules
                agents, rules = [], []
            naming = True
            token = _TOKEN.match(value)
            agents.append(token[0].lower() if token else "")
        elif key in ("allow", "disallow"):
            naming = False
            if value and agents:
                rules.append((value, key == "allow"))
    if agents:
        yield agents, rules


def rules_for(text: str, agent: str) -> list[tuple[str, bool]]:
    """The different rules that the agent obeys."""
    every = list(groups(text))
    own = agent.lower() if any(agent.lower() in a for a, _ in every) else "*"
    return sorted({r for a, rules in every if own in a for r in rules})


def parsed(texts: DataFrame, agent: str) -> DataFrame:
    """RULES for the agent, of texts (host, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *r) for h, t in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()) if h is not None and t for r in rules_for(t, agent)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["host", "pattern", "allow"])

    whole = texts.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return whole.mapInArrow(run, RULES)


class Trie:
    """One host's rules by the characters before their first wildcard."""

    def __init__(self, rules: list[tuple[str, bool]]) -> None:
        self.root: dict = {}
        for pattern, allow in rules:
            body, end = (pattern[:-1], True) if pattern.endswith("$") else (pattern, False)
            head, *rest = body.split("*")
            node = self.root
            for c in head:
                node = node.setdefault(c, {})
            tail = re.compile(".*".join(["", *map(re.escape, rest)]) + ("$(?!\n)" if end else ""), re.DOTALL) if rest or end else None
            node.setdefault("", []).append((len(pattern), allow, tail))

    def allows(self, path: str) -> bool:
        if path == "/robots.txt":
            return True
        best, node = (0, True), self.root
        for at in range(len(path) + 1):
            for size, allow, tail in node.get("", ()):
                if (size, allow) > best and (tail is None or tail.match(path, at)):
                    best = size, allow
            node = node.get(path[at]) if at < len(path) else None
            if node is None:
                break
        return best[1]


def allowed(requests: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Requests that no rule forbids. Each different path of a host is judged once, a host of many paths in pieces."""
    places = requests.select(F.col(host).alias("host"), F.col(path).alias("path")).where("host is not null and path is not null").distinct()
    sizes = places.groupBy("host").agg(F.ceil(F.count("*") / PIECE_PATHS).cast("int").alias("pieces"))
    ruled = rules.join(sizes, "host").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    # hosts with rules alone are asked; of a host without, nothing is forbidden
    asked = places.join(rules.select("host").distinct(), "host", "left_semi").join(sizes, "host").withColumn("piece", F.pmod(F.xxhash64("path"), F.col("pieces")).cast("int")).drop("pieces")

    def judge(own: pa.Table, have: pa.Table) -> pa.Table:
        trie = Trie(list(zip(have.column("pattern").to_pylist(), have.column("allow").to_pylist())))
        return own.select(["host", "path"]).filter(pa.array([not trie.allows(p) for p in own.column("path").to_pylist()], pa.bool_()))

    forbidden = asked.groupBy("host", "piece").cogroup(ruled.groupBy("host", "piece")).applyInArrow(judge, "host string, path string")
    return requests.join(forbidden.select(F.col("host").alias("_host"), F.col("path").alias("_path")), (F.col(host) == F.col("_host")) & (F.col(path) == F.col("_path")), "left_anti")
