"""Links of pages, and authority by the link graph.

Authority is the stationary share of a walk that follows a link of its page, or with a chance of 1 - DAMPING goes to any page; from pages
without links it always does. Mass is counted in whole units of 1 / MASS, each page's share of a link rounded down, so results are
the same in whatever order they are added up, in Spark and in SQL; what rounding leaves goes the way of the other jumps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.urls import canonical, resolve
from siltstone.operators.state import cut

MASS, DAMPING = 10**15, 85
#: Without a number of rounds, each MIX-th goes on from a mean that takes out what swings to and fro, as between two kinds of pages that
#: link to each other only: such mass changes sides each round, less 15 per cent. No other part of the error grows by it.
MIX = 3
#: Whatever the links, what is wrong falls by this in MIX rounds at least; after SETTLED rounds it is under a unit, but for rounding.
_LEFT = (DAMPING / 100) ** (MIX - 1) * 2 * DAMPING / (100 + DAMPING)
SETTLED = MIX * math.ceil(math.log(2 * MASS) / -math.log(_LEFT))
_HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    """What the html's anchors point to, as written, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_HREF), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def links(pages: DataFrame) -> DataFrame:
    """url, target: each different http or https link of pages (url, html), resolved and in canonical form; a link to the page itself is none."""
    found = pages.where("url is not null").select("url", F.explode(hrefs(F.col("html"))).alias("href"))
    meant = found.select("url", F.array(canonical(resolve(F.col("url"), F.regexp_replace(F.trim("href"), "[\\t\\r\\n]", ""))), canonical(F.col("url"))).alias("both")).distinct()
    different = meant.where(F.element_at("both", 1).rlike("^https?://[^/?#]") & (F.element_at("both", 1) != F.element_at("both", 2)))
    return different.select("url", F.element_at("both", 1).alias("target"))


def authority(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float = 0) -> DataFrame:
    """node, mass (of MASS in all): nodes (node) are distinct, edges (source, target) too; edges from or to other nodes don't count.

    Each round is one join by source and one aggregation by target, combined on the map side; a node with very many links in is
    added up before it travels, one with very many links out is joined as adaptive execution splits it. Rounds end when the mass
    that moved is at most `tolerance` of all, or after `rounds`. Without `rounds` they go on until authority is settled: a round moves no
    more than a unit for each node and link, which is rounding. Lineage is cut each round; the driver sees a round's two sums.
    Whole numbers as nodes make the rounds cheapest.
    """
    nodes = cut(nodes.select("node").where("node is not null"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("mass", F.lit(0).cast("long"))
    inside = edges.where("source <> target").join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")
    out = inside.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("links"))
    edges = cut(inside)
    rounding = n + edges.count() if rounds is None else 0
    state = cut(nodes.join(out, "node", "left").withColumn("mass", F.lit(MASS // n).cast("long")))
    for k in range(1, 1 + (SETTLED if rounds is None else rounds)):
        shares = state.where("links is not null").select(F.col("node").alias("source"), F.expr(f"mass * {DAMPING} div (100 * links)").alias("share"))
        got = edges.join(shares, "source").groupBy(F.col("target").alias("node")).agg(F.sum("share").alias("share"))
        moved = cut(state.join(got, "node", "left").withColumn("share", F.coalesce("share", F.lit(0).cast("long"))))
        rest = (MASS - (moved.agg(F.sum("share")).first()[0] or 0)) // n
        change = moved.agg(F.sum(F.abs(F.col("share") + rest - F.col("mass")))).first()[0] if tolerance or rounds is None else None
        state = moved.select("node", "links", (F.col("share") + rest).alias("mass"))
        if change is not None and change <= max(tolerance * MASS, rounding):
            break
        if rounds is None and k % MIX == 0:
            state = moved.select("node", "links", F.expr(f"(100 * (share + {rest}) + {DAMPING} * mass) div {100 + DAMPING}").alias("mass"))
    return state.select("node", "mass")


def authority_sql(nodes: str, edges: str, rounds: int) -> str:
    """SQL for `authority` after that many rounds without a tolerance, as common table expressions that end with `authority` (node, mass)."""
    own = [
        f"nodes as materialized ({nodes})", f"edges as materialized (select source, target from ({edges}) where source <> target and source in (select node from nodes) and target in (select node from nodes))",
        "outs as materialized (select source as node, count(*) as links from edges group by 1)", "total as (select count(*) as n from nodes)", f"r0 as materialized (select node, {MASS} // n as mass from nodes, total)",
    ]
    for k in range(1, rounds + 1):
        own.append(f"s{k} as materialized (select target as node, sum(mass * {DAMPING} // (100 * links))::bigint as share from edges join r{k - 1} on r{k - 1}.node = source join outs on outs.node = source group by 1)")
        own.append(f"r{k} as materialized (select nodes.node, coalesce(share, 0) + ({MASS} - (select coalesce(sum(share), 0)::bigint from s{k})) // n as mass from nodes left join s{k} using (node), total)")
    return ", ".join(own) + f", authority as (select node, mass from r{rounds})"


def settled_sql(nodes: str, edges: str) -> str:
    """SQL for `authority` without a number of rounds, as common table expressions for a `with recursive` that end with `authority` (node, mass)."""
    before = f"select k, node, moved, case when k > 0 and k % {MIX} = 0 then (100 * now + {DAMPING} * mass) // {100 + DAMPING} else now end as mass from settling"
    return f"""nodes as materialized ({nodes}), edges as materialized (select source, target from ({edges}) where source <> target and source in (select node from nodes) and target in (select node from nodes)),
        outs as materialized (select source as node, count(*) as links from edges group by 1), total as materialized (select (select count(*) from nodes) as n, (select count(*) from edges) as m),
        settling as (select 0 as k, node, {MASS} // n as mass, {MASS} // n as now, {MASS}::hugeint as moved from nodes, total
            union all select k + 1, node, mass, now, sum(abs(now - mass)) over () from (
                select k, own.node, mass, coalesce(share, 0) + ({MASS} - sum(coalesce(share, 0)) over ())::bigint // n as now from ({before}) own cross join total
                left join (select target, sum(mass * {DAMPING} // (100 * links))::bigint as share from edges join ({before}) b on b.node = source join outs on outs.node = source group by 1) on target = own.node
                where k < {SETTLED} and (k = 0 or moved > n + m))),
        authority as materialized (select node, now as mass from settling where k = (select max(k) from settling))"""
