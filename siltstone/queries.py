"""The engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text, urls
from siltstone.operators import chunk, dedup, extract, ivf, lease, links, queue, rank, robots, search, stats, trigram, vector, worklist
from siltstone.operators.state import Folder, cut
from siltstone.plans import ingestion
from siltstone.schemas import PAGES_SQL, QUEUE_SQL, pages_of, queue_of, table
from siltstone.sources.store import PageStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(table(spark, sf_dir, "documents"))


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_of(table(spark, sf_dir, "orders"))


# ---- search ------------------------------------------------------------------------------------------------------------


def _search(name: str, q: str, limit: int = 10, literal: bool = False) -> None:
    """A negative limit is none."""
    pattern = "%" + (q.replace("%", "$%").replace("_", "$_") if literal else q).translate(str.maketrans(text.UPPER, text.LOWER)) + "%"
    like = lambda c: f"translate({c}, '{text.UPPER}', '{text.LOWER}') like '{pattern}'" + (" escape '$'" if literal else "")
    sql = f"with {PAGES_SQL} select id, url, title, substring(content, 1, 500) as content, content_hash as hash from stored where {like('title')} or {like('content')} order by id" + (f" limit {limit}" if limit >= 0 else "")
    query(name, sql)(lambda spark, d: search.search(stored(spark, d), q, limit, literal))


_search("search_keyword", "The")
_search("search_empty_query", "", 20)
_search("search_wildcard", "o_ther")
_search("search_literal", "%%%", literal=True)
_search("search_ascii_case", "ÉT", 50)
_search("search_all_hits", "tion", -1)

query("search_memory", f"with {PAGES_SQL} select id, url, title, content, content_hash as hash from stored where contains(lower(title), lower('CIÓN')) or contains(lower(content), lower('CIÓN')) order by id limit 5")(
    lambda s, d: search.memory_search(stored(s, d), "CIÓN")
)
query("pages_paginated", f"with {PAGES_SQL} select * from stored order by id limit 50 offset 100")(lambda s, d: search.paginated(stored(s, d), 100, 50))
#: What is asked of the index: frequent and rare words, wildcards, a literal per cent, a phrase, what is in no page, under three characters.
INDEXED = {
    "frequent": ("the", False), "upper case": ("TION", False), "rare": ("license", False), "phrase": ("permission is hereby", False), "wildcards": ("e%mail_", False), "literal": ("100%", True),
    "not there": ("qzxqzxqzx", False), "wide": ("ünd", False), "two": ("a%b", False), "one": ("@", False),
}


def _indexed_sql() -> str:
    def one(name: str, q: str, literal: bool) -> str:
        pattern = "%" + (q.replace("%", "$%").replace("_", "$_") if literal else q).translate(str.maketrans(text.UPPER, text.LOWER)) + "%"
        own = [f"translate({c}, '{text.UPPER}', '{text.LOWER}') like '{pattern}' escape '$'" for c in ("title", "content")]
        return f"select '{name}' as query, id, url from stored where {' or '.join(own)}"

    return f"with {PAGES_SQL} " + " union all ".join(one(name, *q) for name, q in INDEXED.items())


@query("search_indexed", _indexed_sql())
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all pages is built, and ten queries are asked of it."""
    with Folder(spark, "trigrams") as path:
        trigram.build(stored(spark, sf_dir).select("id", "url", "title", "content"), path)
        return cut(trigram.search_many(spark, path, INDEXED).select("query", "id", "url"))


query("page_projection", f"with {PAGES_SQL} select id, url, title, content, content_hash as hash from stored")(lambda s, d: search.page_row(stored(s, d)))
query("snippet_web", f"with {PAGES_SQL} select id, url, coalesce(nullif(title, ''), 'No title') as title, case when length(content) > 200 then left(content, 200) || '...' else content end as snippet from stored")(
    lambda s, d: search.web_snippet(stored(s, d))
)
query("snippet_bot", f"with {PAGES_SQL} select row_number() over (order by id) as rank, left(title, 50) as title, left(url, 50) as url, case when length(content) > 100 then left(content, 100) || '...' else content end as snippet from stored order by id limit 5")(
    lambda s, d: search.bot_snippet(stored(s, d))
)
query("hash_prefix", f"with {PAGES_SQL} select id, url, coalesce(nullif(title, ''), 'NULL') as title, left(content_hash, 8) as hash8, left(content_hash, 12) as hash12 from stored")(lambda s, d: search.terminal_row(stored(s, d)))


@query(
    "page_detail",
    """select event_id as id, 'u' || user_id::varchar as url, event_type as title, props as content, sha256(props) as hash,
    case when date_part('microseconds', ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as crawl_time, value > 50 as embedded from events""",
)
def page_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return search.page_detail(e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("title"), F.col("props").alias("content"), F.sha2("props", 256).alias("content_hash"), F.col("ts").alias("crawl_time"), (F.col("value") > 50).alias("embedded")))


@query("search_log", f"with {PAGES_SQL}, h as (select 1 from stored where translate(content, '{text.UPPER}', '{text.LOWER}') like '%the%' order by id limit 10) select 'The' as query, count(*)::int as results_count from h")
def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.log_entry(search.search(stored(spark, sf_dir), "The"), "The").drop("timestamp")


@query("search_logged", f"with {PAGES_SQL} select 'The' as query, count(*)::int as results_count from stored where translate(title, '{text.UPPER}', '{text.LOWER}') like '%the%' or translate(content, '{text.UPPER}', '{text.LOWER}') like '%the%'")
def search_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits are written, and counted while they are."""
    with Folder(spark, "search") as path:
        search.logged(search.search(stored(spark, sf_dir), "The", -1), "The", f"{path}/hits", f"{path}/log")
        return cut(spark.read.parquet(f"{path}/log").select("query", "results_count"))


# ---- statistics and URLs -------------------------------------------------------------------------------------------------


@query(
    "stats",
    f"""with {QUEUE_SQL}, c as (select count(*) filter (status = 'queued') as queued, count(*) filter (status = 'processing') as processing, count(*) filter (status = 'completed') as completed,
    count(*) filter (status = 'failed') as failed from queue)
    select *, (select count(*) from documents) as pages, (select count(*) from lineitem) as chunks, (select count(*) from embeddings) as embeddings, queued + processing + completed + failed as total_queue from c""",
)
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stats(crawl_queue(spark, sf_dir), *(table(spark, sf_dir, t) for t in ("documents", "lineitem", "embeddings")))


query("memory_stats", f"with {QUEUE_SQL} select count(*) filter (status = 'queued') as queued, count(*) filter (status <> 'queued') as processed, (select count(*) from documents) as pages, count(*) as total from queue")(
    lambda s, d: stats.memory_stats(crawl_queue(s, d), table(s, d, "documents"))
)
# What a page may link to: its own URL, the same without or with other schemes, its host, and a deeper page of its host.
_REST = "split_part(url, '://', 2)"
_SITE = f"split_part({_REST}, '/', 1)"
_FORMS = ["url", _REST, f"'ftp://' || {_REST}", f"'httpx//' || {_REST}", f"'https://' || {_SITE}", f"'http://' || {_SITE} || '/'", f"'http://' || {_SITE} || '/en/6/x?q=/y/z'"]
_LINKS = f"links as (select page_id, generate_subscripts([{', '.join(_FORMS)}], 1) - 1 as k, unnest([{', '.join(_FORMS)}]) as url from pages)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"posexplode(array({', '.join(_FORMS)})) as (k, url)")


query("url_scheme_filter", f"with {_LINKS} select page_id, k::int as k, url from links where starts_with(url, 'http://') or starts_with(url, 'https://')")(lambda s, d: _links(s, d).where(urls.has_scheme(F.col("url"))))
query("url_prefix_filter", f"with {_LINKS} select page_id, k::int as k, url from links where starts_with(url, 'http')")(lambda s, d: _links(s, d).where(urls.looks_like_url(F.col("url"))))
query("url_host", "select page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) as host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) as authority from pages")(
    lambda s, d: table(s, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.authority(F.col("url")).alias("authority"))
)
query("url_well_formed", f"with {_LINKS} select page_id, k::int as k, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?# ]+') as ok from links")(lambda s, d: _links(s, d).select("page_id", "k", urls.is_well_formed(F.col("url")).alias("ok")))
query("word_count", f"select doc_id, len(list_filter(string_split_regex(text, '{text.WS_RE2}+'), lambda w: w <> ''))::bigint as word_count from documents")(lambda s, d: table(s, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("word_count")))
query("clean_text", f"select doc_id, {text.sql_clean('text')} as content from documents")(lambda s, d: table(s, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("content")))

# ---- extraction, ingestion -----------------------------------------------------------------------------------------------

#: Pages made by hand: containers of every kind, side blocks, descriptions, and what is missing or odd.
_KEEP = "<p>Enough words to stay in here.</p>"
_BODIES = [
    f"<header>no</header><article>{_KEEP}<ul><li>one&nbsp;item</li></ul></article><footer>no</footer>", f"<main>{_KEEP}</main><p>outside</p>", f"<div role='main'>{_KEEP}</div><p>outside</p>",
    *(f'<p>outside</p><section class="a {c} b">{_KEEP}</section>' for c in extract.CONTENT_CLASSES), f"<div class='Content'>{_KEEP}</div><p>no class of that name</p>", f"<div class='contents'>{_KEEP}</div><p>nor of that one</p>",
    f"{_KEEP}<div class='sidebar'>no</div><ul class='menu x'><li>no</li></ul><section class=\"comments\">no</section><p class='advertisement'>no</p>", f"<nav>no</nav>{_KEEP}<form>no</form><aside>no</aside>",
    f"<article></article><main>{_KEEP}</main>", "<p>short</p>", "", f"<!-- <article>no</article> --><script>'<main>'</script>{_KEEP}\xa0 <p>A second line of more than twenty.</p>", "one line\n  \n\nanother line of more than twenty\n",
]
_HAND_MADE = [(k, f"http://h/{k}", f"<html><head><title> A &amp; {k} </title>{'<meta name=\"description\" content=\"What &lt;it&gt; is\">' if k % 2 else ''}</head><body>{b}</body></html>") for k, b in enumerate(_BODIES)]
_HAND_MADE += [(100, "http://h/100", ""), (101, "http://h/101", "<p>no body, no title</p>"), (102, "http://h/102", f"<TITLE></TITLE><BODY class='content'>{_KEEP} and no end"), (103, "http://h/103", None)]
_HAND_MADE = [(k, None if h is None else h.replace("Enough words to stay in here.", "@")) for k, (_, _, h) in enumerate(_HAND_MADE)]
_FIRST_WORDS = "replace(regexp_extract(html, '<p>([^<>]*)', 1), '@', '')"
#: Each page's first paragraph in the container that its number picks.
_LAID_SQL = f"""hand(k, body) as (values {", ".join(f"({k}, {'null' if h is None else extract._quote(h)})" for k, h in _HAND_MADE)}),
    laid as (select page_id, url, replace(body, '@', {_FIRST_WORDS} || ' and enough words to stay in here.') as html from pages join hand on k = page_id % {len(_HAND_MADE)})"""


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    hand = F.broadcast(spark.createDataFrame(_HAND_MADE, "k int, body string"))  # the containers above
    rows = table(spark, sf_dir, "pages").withColumn("k", (F.col("page_id") % len(_HAND_MADE)).cast("int")).join(hand, "k")
    return rows.select("page_id", "url", F.replace("body", F.lit("@"), F.expr(f"{_FIRST_WORDS} || ' and enough words to stay in here.'")).alias("html"))


_EXTRACTORS = (("extract_lightweight", extract.lightweight), ("extract_minimal", extract.minimal), ("extract_worker", extract.worker), ("extract_body", extract.body_text), ("extract_direct", extract.direct))
for _name, _f in _EXTRACTORS[:2]:
    _own = extract.SQL[_name].removeprefix("with ").replace(" from pages", " from laid")
    _failed = repr("Failed to fetch" if _f is extract.lightweight else "Failed")
    query(f"{_name}_containers", f"with {_LAID_SQL}, {_own} where page_id in (select page_id from laid where html <> '') union all select page_id, {_failed}, '', '', 0 from laid where coalesce(html, '') = ''")(
        lambda s, d, f=_f: f(_laid(s, d))
    )
for _name, _f in _EXTRACTORS:
    query(_name, extract.SQL[_name])(lambda s, d, f=_f: f(table(s, d, "pages")))
query("extract_parser")(lambda s, d: extract.parse_html(table(s, d, "pages")))
query("dedup_content_hash", f"with {PAGES_SQL} select * from stored qualify row_number() over (partition by content_hash order by id) = 1")(lambda s, d: dedup.first_by_hash(stored(s, d)))


_WRITES = "select doc_id as id, 'u' || (doc_id % 700)::varchar as url, sha256(text) as content_hash from documents"


@query("ingest_first_writer", f"select id, url, content_hash from ({_WRITES}) where id in ({dedup.first_writer_sql(_WRITES)})")
def ingest_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A url is shared by ids that agree modulo 700, so that both constraints bite.
    d = table(spark, sf_dir, "documents")
    return dedup.ingest(d.select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("url"), F.sha2("text", 256).alias("content_hash")))


@query(
    "save_pages",
    f"""with w as ({_WRITES}), accepted as (select w.* from w where id in ({dedup.first_writer_sql(_WRITES)}))
    select w.id, w.url, w.content_hash, w.id in (select id from accepted) as stored,
        case when w.id in (select id from accepted) then w.id else coalesce(a.id, 0) end as page_id
    from w left join accepted a on a.content_hash = w.content_hash and a.id < w.id and a.content_hash <> ''""",
)
def save_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same writes in three batches, by ranges of ids, merged into a new store one after the other; the second comes twice."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("url"), F.sha2("text", 256).alias("content_hash"))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    part = F.floor((F.col("id") - F.lit(low)) * 3 / F.lit((high or 0) - (low or 0) + 1))
    with Folder(spark, "store") as path:
        store = PageStore(spark, path)
        for batch in (0, 1, 1, 2):
            store.merge(rows.where(part == batch), batch)
        return cut(store.decisions(0).unionByName(store.decisions(1)).unionByName(store.decisions(2)))


@query("is_duplicate", "with s as (select distinct sha256(text) as h from documents where lang = 'en') select doc_id, coalesce(sha256(text) in (select h from s), false) as duplicate from documents")
def is_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    return dedup.is_duplicate(d, d.where("lang = 'en'")).select("doc_id", "duplicate")


# Users' pages are asked for; those that have a supplier's number are in the queue, its status by the sign of the balance.
_ASKED = "asked as (select event_id as seq, 'https://u' || user_id::varchar || '.example.org/' as url from events)"
_HAVE = "have as (select 'https://u' || s_suppkey::varchar || '.example.org/' as url, case when s_acctbal > 0 then 'queued' else 'completed' end as status from supplier)"
_NEW = "select min(seq) as seq, url, 'queued' as status from asked where url not in (select url from have) group by url"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    url = lambda c: F.concat(F.lit("https://u"), F.col(c).cast("string"), F.lit(".example.org/")).alias("url")
    have = table(spark, sf_dir, "supplier").select(url("s_suppkey"), F.when(F.col("s_acctbal") > 0, "queued").otherwise("completed").alias("status"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), url("user_id")), have


query("enqueue_dedup", f"with {_ASKED}, {_HAVE} {_NEW}")(lambda s, d: dedup.enqueue(*_asked(s, d)))


@query("crawl_response", f"with {_ASKED}, {_HAVE}, new as ({_NEW}) select (select count(*) from new) as added, (select count(*) from new) + (select count(*) from have where status = 'queued') as queued")
def crawl_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, have = _asked(spark, sf_dir)
    return stats.added(dedup.enqueue(asked, have), have)


@query("request_urls", "select l_orderkey, list_distinct(list(l_partkey)).len()::bigint as n from lineitem group by 1")
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.size(urls.distinct_urls(F.collect_list("l_partkey"))).cast("long").alias("n"))


# ---- chunks --------------------------------------------------------------------------------------------------------------

query("chunk_sentences", chunk.SENTENCES_SQL)(lambda s, d: chunk.chunk_by_sentences(stored(s, d)))
query("chunk_fixed", chunk.FIXED_SQL)(lambda s, d: chunk.chunk_by_size(stored(s, d)))
query("chunk_counts", f"select page_id, count(*) as chunks, sum(length(chunk_text))::bigint as chars from ({chunk.SENTENCES_SQL}) group by 1")(
    lambda s, d: chunk.chunk_by_sentences(stored(s, d)).groupBy("page_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))
)

# ---- work lists: lineitem as chunks of orders, and a chunk that has an event's number has an embedding -----------------------

_CHUNKS = "ch as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as page_id, l_returnflag as chunk_text, l_linenumber as chunk_index from lineitem)"
_PG = "pg as (select o_orderkey as id, o_orderpriority as content, o_orderstatus = 'F' as embedded from orders)"
_EM = "em as (select event_id as chunk_id from events)"


def _work(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("chunk_text"), F.col("l_linenumber").alias("chunk_index"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"), (F.col("o_orderstatus") == "F").alias("embedded"))
    return pages, chunks, table(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"))


query("pages_needing_chunking", f"with {_CHUNKS}, {_PG} select id, content from pg where content <> '' and id not in (select page_id from ch) order by id")(lambda s, d: worklist.pages_needing_chunking(*_work(s, d)[:2]).select("id", "content"))
query(
    "pages_without_embeddings",
    f"with {_CHUNKS}, {_PG}, {_EM} select distinct pg.id from pg left join ch on ch.page_id = pg.id left join em on em.chunk_id = ch.id where not pg.embedded and em.chunk_id is null",
)(lambda s, d: worklist.pages_without_embeddings(*_work(s, d)).select("id"))
query("chunks_without_embeddings", f"with {_CHUNKS}, {_EM} select id, page_id, chunk_text, chunk_index from ch where chunk_text <> '' and id not in (select chunk_id from em)")(lambda s, d: worklist.chunks_without_embeddings(*_work(s, d)[1:]))
query("chunks_work_batch", f"with {_CHUNKS}, {_EM} select id, page_id from ch where chunk_text <> '' and id not in (select chunk_id from em) order by id limit 32")(lambda s, d: worklist.chunks_without_embeddings(*_work(s, d)[1:], limit=32).select("id", "page_id"))
query("chunk_exists", f"with {_CHUNKS} select event_id as id, event_id in (select id from ch) as found from events")(lambda s, d: worklist.exists(table(s, d, "events").select(F.col("event_id").alias("id")), _work(s, d)[1]))
query("mark_embedded", f"with {_CHUNKS}, {_PG}, {_EM} select id, content, id in (select page_id from ch) and id not in (select page_id from ch where id not in (select chunk_id from em)) as embedded from pg")(lambda s, d: worklist.mark_embedded(*_work(s, d)))
query("delete_pages", "select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")(
    lambda s, d: worklist.delete_pages(table(s, d, "orders").select(F.col("o_orderkey").alias("id")), table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")))
)
query("page_chunk_navigation", f"with {_CHUNKS}, {_PG}, {_EM} select pg.id as page_id, ch.id as chunk_id, pg.content from pg join ch on ch.page_id = pg.id join em on em.chunk_id = ch.id")(
    lambda s, d: (lambda p, c, e: p.select(F.col("id").alias("page_id"), "content").join(c.select(F.col("id").alias("chunk_id"), "page_id"), "page_id").join(e, "chunk_id").select("page_id", "chunk_id", "content"))(*_work(s, d))
)

# ---- claims that expire: users' events as what is asked of the queue -----------------------------------------------------------

_RULES = lease.Rules()


def _lease_sql() -> str:
    """One step an event and URL: a lease that has run out first, then the event; both may be changes."""
    expired = "s.status = 'processing' and s.lease_until <= coalesce(e.us, 9000000000000000000)"
    retries = f"(s.retries + case when {expired} then 1 else 0 end)"
    status = f"case when {expired} then case when {retries} > {_RULES.most} then 'dead' else 'queued' end else s.status end"
    due = f"case when {expired} then s.lease_until + {_RULES.backoff_us} * (1::bigint << (s.retries)) else s.due end"
    mine = "t.status = 'processing' and t.worker = t.asks"
    return f"""with recursive e as (
            select 'https://u' || user_id::varchar || '.example.org/' as url, epoch_us(ts) as us, value,
                case event_type when 'signup' then 'add' when 'purchase' then 'done' when 'error' then 'fail' else 'claim' end as kind,
                case when value < 20 then 'b' else 'a' end as worker
            from events),
        n as (select *, row_number() over (partition by url order by us, kind, worker) as k from e),
        last as (select url, max(k) as most from n group by url),
        ends as (select url, us, kind, worker, k from n union all select url, null, null, null, most + 1 from last),
        steps as (
            select url, 0::bigint as k, null::varchar as status, 0 as retries, 0::bigint as due, 0::bigint as lease_until, null::varchar as worker,
                null::struct(us bigint, status varchar, retries int, worker varchar) as one, null::struct(us bigint, status varchar, retries int, worker varchar) as two
            from last
            union all
            select url, k,
                case when added then 'queued' when claimed then 'processing' when done then 'completed' when failed and retries + 1 > {_RULES.most} then 'dead'
                    when failed then 'queued' else status end,
                retries + failed::int,
                case when added then us when failed then us + {_RULES.backoff_us} * (1::bigint << retries) else due end,
                case when claimed then us + {_RULES.lease_us} else lease_until end,
                case when claimed then asks when failed then null else worker end,
                one,
                case when added then {{'us': us, 'status': 'queued', 'retries': 0, 'worker': null}}
                    when claimed then {{'us': us, 'status': 'processing', 'retries': retries, 'worker': asks}}
                    when done then {{'us': us, 'status': 'completed', 'retries': retries, 'worker': asks}}
                    when failed then {{'us': us, 'status': case when retries + 1 > {_RULES.most} then 'dead' else 'queued' end, 'retries': retries + 1, 'worker': asks}} end
            from (
                select *, coalesce(kind = 'add' and status is null, false) as added, coalesce(kind = 'claim' and status = 'queued' and due <= us, false) as claimed,
                    coalesce(kind = 'done' and {mine}, false) as done, coalesce(kind = 'fail' and {mine}, false) as failed
                from (
                    select s.url, e.k, e.us, e.kind, e.worker as asks, {status} as status, {retries} as retries, {due} as due, s.lease_until,
                        case when {expired} then null else s.worker end as worker,
                        case when {expired} then {{'us': s.lease_until, 'status': {status}, 'retries': {retries}, 'worker': s.worker}} end as one
                    from steps s join ends e on e.url = s.url and e.k = s.k + 1) t) t)
        select url, make_timestamp(c.us) as at, c.status as status, c.retries::int as retries, c.worker as worker
        from (select url, unnest([one, two]) as c from steps) where c is not null"""


@query("queue_leases", _lease_sql())
def queue_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("claim")
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.org/"))
    events = table(spark, sf_dir, "events").select(url.alias("url"), kind.alias("kind"), F.when(F.col("value") < 20, "b").otherwise("a").alias("worker"), F.col("ts").cast("timestamp").alias("at"))
    return lease.replay(events, _RULES).withColumn("at", F.col("at").cast("timestamp_ntz"))


# ---- vectors and ranking ---------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity({a}::double[], {b}::double[])"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


query("vector_topk", f"with q as (select embedding as e from embeddings order by vec_id limit 1) select vec_id, round({_COS.format(a='embedding', b='e')}, 6) as score from embeddings, q order by 2 desc, 1 limit 10")(
    lambda s, d: vector.top_k(table(s, d, "embeddings"), _first_vector(s, d))
)
query("vector_json_roundtrip", "select vec_id, embedding::double[] as vector, len(embedding)::int as size from embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", vector.from_json(vector.to_json(F.col("embedding").cast("array<double>"))).alias("vector"), F.size("embedding").alias("size"))
)
query(
    "similar_pages",
    f"""select query_id, vec_id, score from (select q.vec_id as query_id, v.vec_id, round({_COS.format(a="q.embedding", b="v.embedding")}, 6) as score from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id)
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""",
)(lambda s, d: vector.top_k_each(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 20 = 0")))
query(
    "page_embedding_mean",
    "with c as (select label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, round(avg(x), 6) as x from c group by 1, 2) select label, list(x order by i) as vector from m group by 1",
)(lambda s, d: vector.mean_by(table(s, d, "embeddings"), "label"))


@query("vector_ann")
def vector_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors are indexed, and every id divisible by 20 asks."""
    vectors = table(spark, sf_dir, "embeddings")
    with Folder(spark, "vectors") as path:
        ivf.build(vectors, path)
        return cut(ivf.search(spark, path, vectors.where("vec_id % 20 = 0")))


query("vector_clusters")(lambda s, d: vector.clusters(table(s, d, "embeddings"), 8))


def _embedding_sql(rows: str, keys: str) -> str:
    """SQL for the hashed embedding of rows (keys, x), distinct keys."""
    own = ", ".join(f"d.{k}" for k in keys.split(", "))
    same = " and ".join(f"c.{k} = d.{k}" for k in keys.split(", "))
    return f"""with rw as ({rows}), w as (select {keys}, unnest(list_filter(string_split_regex(translate(x, '{text.UPPER}', '{text.LOWER}'), '{text.WS_RE2}+'), lambda v: v <> '')) as w from rw),
        c as (select {keys}, (('0x' || substr(md5(w), 1, 8))::ubigint % 64)::int as i, sum(case when substr(md5(w), 9, 1) < '8' then 1 else -1 end)::int as s from w group by all),
        g as (select {own}, r.i, coalesce(c.s, 0) as s from rw d cross join (select unnest(range(64))::int as i) r left join c on {same} and c.i = r.i)
        select {keys}, list(s order by i) as vector from g group by {keys}"""


_EMBED_DOCUMENTS = _embedding_sql("select doc_id, text as x from documents", "doc_id")
query("hashed_embedding", _EMBED_DOCUMENTS)(lambda s, d: table(s, d, "documents").select("doc_id", vector.hashed_embedding(F.col("text")).alias("vector")))
query("embed_chunks", f"select doc_id, vector::float[] as vector from ({_EMBED_DOCUMENTS})")(
    lambda s, d: vector.embed(table(s, d, "documents").select("doc_id", F.col("text").alias("chunk_text")), vector.hashing_embedder).select("doc_id", "vector")
)

_TERMS = ["the", "and"]
_KEYWORD = "(" + " + ".join(f"case when contains(translate(text, '{text.UPPER}', '{text.LOWER}'), '{t}') then 1.0::double else 0.0::double end" for t in _TERMS) + ")::double / 2"
_VECTOR = f"vec as (select vec_id, {_COS.format(a='embedding', b='(select embedding from embeddings order by vec_id limit 1)')} as v from embeddings)"
_HOSTS = "hosts as (select source, count(*)::double / (select max(n) from (select count(*) as n from documents group by source)) as domain_score from documents group by source)"


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, v: the similarity of the vector with the document's id to the first vector."""
    vectors, first = table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir)
    return vectors.select(F.col("vec_id").alias("doc_id"), vector.cosine(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, map(float, first)))).alias("v"))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, source, v, domain_score."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "source").join(_similar(spark, sf_dir), "doc_id", "left").withColumn("v", F.coalesce("v", F.lit(0.0))).join(rank.host_share(docs, "source"), "source")


query(
    "rank_basic",
    f"with {_VECTOR}, {_HOSTS} select doc_id, round(0.6::double * coalesce(v, 0) + 0.2::double * ({_KEYWORD}) + 0.1::double * least(length(text) / 500.0::double, 1.0::double) + 0.1::double * domain_score, 6) as score from documents left join vec on vec_id = doc_id join hosts using (source) order by 2 desc, 1 limit 20",
)(lambda s, d: _factors(s, d).select("doc_id", F.round(rank.basic(F.col("v"), rank.keyword_share(F.col("text"), _TERMS), rank.length_factor(F.col("text")), F.col("domain_score")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20))
# A link graph of the tables: a part's page links to the supplier's of each order line, and that to the part's of the order's next line.
_NODES = "select 'p' || p_partkey::varchar as node from part union all select 's' || s_suppkey::varchar from supplier"
_LINES = "select *, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as next_part from lineitem"
_EDGES = f"""select 'p' || l_partkey::varchar as source, 's' || l_suppkey::varchar as target from lineitem
    union select 's' || l_suppkey::varchar, 'p' || next_part::varchar from ({_LINES}) where next_part is not null"""


def _authority(spark: SparkSession, sf_dir: str, rounds: int | None = None) -> DataFrame:
    """node (twice a part's number, or twice a supplier's and one), mass: numbers travel in half the bytes of names."""
    number = lambda kind, c: (F.col(c) * 2 + kind)
    nodes = table(spark, sf_dir, "part").select(number(0, "p_partkey").alias("node")).unionAll(table(spark, sf_dir, "supplier").select(number(1, "s_suppkey")))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.lead("l_partkey").over(order).alias("next_part"))
    both = F.array(F.struct(number(0, "l_partkey").alias("source"), number(1, "l_suppkey").alias("target")), F.struct(number(1, "l_suppkey").alias("source"), number(0, "next_part").alias("target")))
    edges = lines.select(F.explode(both).alias("e")).select("e.*").where("source is not null and target is not null")  # one pass over the lines
    return links.authority(nodes, edges.distinct(), rounds, tolerance=0)


def _link_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.pmod("node", F.lit(2)) == 0, "p").otherwise("s")
    return _authority(spark, sf_dir, 6).select(F.concat(kind, F.shiftright("node", 1).cast("string")).alias("node"), "mass")


query("link_authority", f"with {links.authority_sql(_NODES, _EDGES, 6)} select node, mass from authority")(_link_authority)
_HREFS = """select url, unnest(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)) as href from pages"""


def _canonical_sql(x: str) -> str:
    """SQL for the canonical form of an absolute http or https URL without user and port."""
    encode = lambda t: f"list_aggregate(list_transform(string_split({t}, ''), lambda c: case when regexp_matches(c, '[^!-~]') then url_encode(c) else c end), 'string_agg', '')"
    parts = f"string_split(substring(regexp_extract({x}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), 2), '/')"
    path = f"'/' || list_aggregate(list_reduce(list_transform({parts}, lambda s: [s]), lambda a, s: case when s[1] = '..' then a[1 : greatest(len(a) - 1, 0)] when s[1] = '.' then a else a || s end), 'string_agg', '/')"
    query = rf"regexp_extract({x}, '^[^?#]*(\?[^#]*)', 1)"
    return f"(lower(regexp_extract({x}, '^[a-zA-Z]+://[^/?#]*')) || coalesce({encode(f'({path})')}, '/') || coalesce({encode(query)}, ''))"


query("url_canonical", f"select page_id, {_canonical_sql('url')} as canonical from pages")(lambda s, d: table(s, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical")))
query(
    "page_links",
    # the tables' links are either from the root of the site, beside the page, or absolute
    f"""with h as (select url, regexp_replace(href, '^["'']|["'']$', '', 'g') as href from ({_HREFS})), p as (
        select url, href, regexp_extract(url, '^[a-z]+://[^/?#]*') as site, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as folder from h),
    t as (select url, case when regexp_matches(href, '^https?://') then href when starts_with(href, '/') then site || href else site || coalesce(nullif(folder, ''), '/') || href end as target from p)
    select distinct url, {_canonical_sql("target")} as target from t where {_canonical_sql("target")} <> {_canonical_sql("url")}""",
)(lambda s, d: links.links(table(s, d, "pages")))

# Every document is ranked, by settled authority. A document was crawled when the event of its number was, and its page has the authority of the part of its number.
query(
    "rank_extended",
    f"""with recursive {_VECTOR}, {links.settled_sql(_NODES, _EDGES)}, au as (select node, mass::double / (select max(mass) from authority) as a from authority),
        fresh as (select event_id, least(pow(0.5::double, (epoch_us((select max(ts) from events)) - epoch_us(ts)) / 86400000000.0::double / 30.0::double), 1.0::double) as f from events)
    select doc_id, round(0.4::double * coalesce(v, 0) + 0.2::double * ({_KEYWORD}) + 0.15::double * coalesce(a, 0) + 0.15::double * coalesce(f, 0) + 0.1::double * coalesce(quality, 0), 6) as score
    from documents left join vec on vec_id = doc_id left join au on node = 'p' || doc_id::varchar left join fresh on event_id = doc_id left join labels using (doc_id) order by 2 desc, 1""",
)(lambda s, d: _rank_extended(s, d))


def _rank_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass, events = _authority(spark, sf_dir), table(spark, sf_dir, "events")
    one = F.broadcast(mass.agg(F.max("mass").alias("most")).crossJoin(events.agg(F.max("ts").alias("now"))))  # a single row
    docs = table(spark, sf_dir, "documents").select("doc_id", rank.keyword_share(F.col("text"), _TERMS).alias("k"), (F.col("doc_id") * 2).alias("node"))  # texts don't travel
    rows = docs.join(_similar(spark, sf_dir), "doc_id", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    rows = rows.join(mass, "node", "left").join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id", "left").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").crossJoin(one)
    score = rank.extended(F.col("v"), F.col("k"), rank.relative(F.col("mass"), F.col("most")), rank.freshness(F.col("ts"), F.col("now")), F.coalesce("quality", F.lit(0)))
    return rows.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id")


query(
    "hybrid_search",
    f"with {_VECTOR}, h as (select doc_id, substring(text, 1, 200) as snippet, {_KEYWORD} as k from documents) select doc_id, snippet, round(0.7::double * coalesce(v, 0) + 0.3::double * k, 6) as score from h left join vec on vec_id = doc_id where k > 0 or v > 0.2 order by 3 desc, 1 limit 20",
)(
    lambda s, d: _factors(s, d)
    .withColumn("k", rank.keyword_share(F.col("text"), _TERMS))
    .where("k > 0 or v > 0.2")
    .select("doc_id", F.substring("text", 1, 200).alias("snippet"), F.round(F.lit(0.7) * F.col("v") + F.lit(0.3) * F.col("k"), 6).alias("score"))
    .orderBy(F.desc("score"), "doc_id")
    .limit(20)
)


@query(
    "search_results",
    f"""with hits as (select vec_id as chunk_id, round({_COS.format(a="embedding", b="(select embedding from embeddings order by vec_id limit 1)")}, 6) as score from embeddings order by 2 desc, 1 limit 100),
    ch as (select doc_id as id, doc_id // 3 as page_id, text as chunk_text from documents), pg as (select page_id as id, split_part(split_part(html, '<title>', 2), '</title>', 1) as title, url from pages)
    select title, url, substring(chunk_text, 1, 200) as snippet, score from (select page_id, chunk_text, score, chunk_id from hits join ch on ch.id = chunk_id qualify row_number() over (partition by page_id order by score desc, chunk_id) = 1)
    join pg on pg.id = page_id order by score desc, page_id limit 10""",
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits, mapped to their chunks' pages. Three documents are the chunks of a page."""
    hits = vector.top_k(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 100).withColumnRenamed("vec_id", "chunk_id")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 3).cast("long").alias("page_id"), F.col("text").alias("chunk_text"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.split_part(F.split_part("html", F.lit("<title>"), F.lit(2)), F.lit("</title>"), F.lit(1)).alias("title"), "url")
    return rank.results(hits, chunks, pages)


query("domain_search", "select page_id, url from pages where regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) = (select min(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) from pages)")(
    lambda s, d: (lambda p: p.join(p.agg(F.min("h").alias("h")), "h", "left_semi").select("page_id", "url"))(table(s, d, "pages").withColumn("h", urls.host(F.col("url"))))
)
query("recent_search", "select event_id, event_type from events where ts >= timestamp '2024-01-20' and event_type = 'view' order by event_id")(lambda s, d: table(s, d, "events").where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_type") == "view")).select("event_id", "event_type"))

# ---- queue, logs -----------------------------------------------------------------------------------------------------------

query("queue_next", f"with {QUEUE_SQL} select id, url, status, retries from queue where status = 'queued' order by scheduled_at, id limit 1")(lambda s, d: queue.next_item(crawl_queue(s, d)))
query("queue_next_by_priority", f"with {QUEUE_SQL} select id, url, status, retries from queue where status = 'queued' order by priority, scheduled_at, id limit 1")(lambda s, d: queue.next_item(crawl_queue(s, d), by_priority=True))
query("queue_next_inserted", f"with {QUEUE_SQL} select id, url, status, retries from queue where status = 'queued' order by id limit 1")(lambda s, d: queue.next_inserted(crawl_queue(s, d)))
query("queue_claim_batch", f"with {QUEUE_SQL} select id, url, 'processing' as status, retries from queue where status = 'queued' order by scheduled_at, id limit 32")(lambda s, d: queue.claim(crawl_queue(s, d), 32))
query("queue_finish", f"with {QUEUE_SQL} select id, url, case when status = 'processing' then 'completed' else status end as status, retries, priority, scheduled_at, case when status = 'processing' then scheduled_at end as processed_at from queue")(
    lambda s, d: (lambda q: queue.finish(q.withColumn("processed_at", F.lit(None).cast("timestamp_ntz")), q.where("status = 'processing'").select("id", F.lit("completed").alias("status"), F.col("scheduled_at").alias("processed_at"))))(crawl_queue(s, d))
)
query("queue_finish_coerced", f"with {QUEUE_SQL}, ids as (select try_cast(o_orderpriority[1] || o_orderkey::varchar || case when o_orderstatus = 'F' then 'x' else '' end as bigint) as id from orders) select id, case when id in (select id from ids) then 'failed' else status end as status from queue")(
    lambda s, d: queue.finish(crawl_queue(s, d), table(s, d, "orders").select(F.concat(F.substring("o_orderpriority", 1, 1), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "x").otherwise("")).alias("id"), F.lit("failed").alias("status"), F.col("o_orderdate").alias("processed_at")).dropDuplicates(["id"])).select("id", "status")
)
query("queue_latest_status", "select user_id, max_by(event_type, (ts, event_id)) as status, max(ts) as at from events group by 1")(lambda s, d: queue.latest_status(table(s, d, "events"), "user_id", "event_type", "ts", "event_id"))
query(
    "politeness_schedule",
    """with r as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events)
    select event_id, (max(t - 2000000 * k) over (partition by user_id order by k rows unbounded preceding) + 2000000 * k - t)::bigint as wait_us from r""",
)(lambda s, d: queue.schedule(table(s, d, "events"), "user_id", "ts", "event_id").select("event_id", "wait_us"))
query("queue_retryable", f"with {QUEUE_SQL} select id, retries from queue where status = 'failed' and retries < 3")(lambda s, d: queue.retryable(crawl_queue(s, d), 3).select("id", "retries"))
query("queue_dead_letters", f"with {QUEUE_SQL} select id, retries from queue where status = 'failed' and retries >= 3")(lambda s, d: queue.dead_letters(crawl_queue(s, d), 3).select("id", "retries"))
query("queue_recrawl", "select user_id, max(ts) as last from events group by 1 having max(ts) <= timestamp '2024-01-31' - interval 1 day")(lambda s, d: queue.recrawl(table(s, d, "events"), "user_id", "ts", "2024-01-31", 1))
query("depth_limit", f"with {_LINKS} select page_id, k::int as k, url from links where len(list_filter(string_split(regexp_extract(url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '')) <= 2")(lambda s, d: queue.within_depth(_links(s, d), "url", 2))
query("popular_searches", "select event_type as query, count(*) as searches from events group by 1 order by 2 desc, 1 limit 10")(lambda s, d: stats.popular(table(s, d, "events").withColumnRenamed("event_type", "query")))
query("failed_searches", "select user_id as query, count(*) as searches, count(*) filter (value < 5) as empty from events group by 1 having count(*) filter (value < 5) > 0")(
    lambda s, d: stats.failed(table(s, d, "events").select(F.col("user_id").alias("query"), F.when(F.col("value") < 5, 0).otherwise(1).alias("results_count")))
)
query("trend_windows", "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")(lambda s, d: stats.trend(table(s, d, "events"), "ts", "event_type"))
# Windows of a day that begin every six hours; earlier ones are those that begin one to seven days before.
_PANE, _PANES, _EARLIER, _N_EARLIER = 21_600, 4, (7 * 86_400, 86_400), 25
query(
    "trend_bursts",
    f"""with panes as (select (epoch_us(ts) // 1000000 // {_PANE}) * {_PANE} as pane, user_id as key, count(*) as n from events group by all),
    counts as (select pane - k * {_PANE} as start, key, sum(n)::bigint as n from panes cross join (select unnest(range({_PANES})) as k) group by all),
    scored as (
        select start, key, n, coalesce(sum(n) over (partition by key order by start range between {_EARLIER[0]} preceding and {_EARLIER[1]} preceding), 0)::double / {_N_EARLIER} as expected
        from counts)
    select make_timestamp(start * 1000000) as start, key, n, round(expected, 6) as expected, round((n - expected) / sqrt(expected + 1), 6) as score from scored""",
)(
    lambda s, d: stats.bursts(stats.sliding(stats.panes(table(s, d, "events"), "ts", "user_id", f"{_PANE} seconds"), _PANE, _PANES), _EARLIER, _N_EARLIER).select(
        F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("expected", 6).alias("expected"), F.round("score", 6).alias("score")
    )
)
query(
    "trend_sessions",
    """with g as (select user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 21600000000, true) as opens from events),
    n as (select user_id, ts, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from n group by user_id, k""",
)(
    lambda s, d: stats.sessions(table(s, d, "events"), "ts", "user_id", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
)
query("recent_logs", "select event_id, event_type, ts from events order by ts desc, event_id desc limit 200")(lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type", "ts"))
query("domain_limit", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents) where n <= 5")(lambda s, d: dedup.domain_limit(table(s, d, "documents"), "source", ["doc_id"], 5).select("doc_id", "source"))
query("change_detection", "select event_id, previous, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) where previous is not null and previous <> event_type")(
    lambda s, d: queue.changed(table(s, d, "events"), "user_id", "ts", "event_type", "event_id").select("event_id", "previous", "event_type")
)


_ROBOTS = {"/": True, "/en": False, "/en/6": True}  # prefix: whether it may be fetched; the same for every host


# Each host's robots.txt, made of what its pages are called: groups of several agents, wildcards, ends, comments, longer rules that allow.
_SITE_PATH = "'^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)'"
_SITE_HOST = "'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)'"
_ROBOTS_LINES = [
    "'# ' || host", "'User-agent: other-bot'", "'Disallow: /'", "''", "'USER-AGENT : *  # all'", "'Disallow: ' || substring(low, 1, 4)", "'Allow: ' || high || '$'", "'Disallow:'", "'Disallow: /*?page='",
    "case when length(host) % 2 = 0 then 'User-agent: siltstone/1.0' else 'Sitemap: /map' end", "'User-agent: third'", "'disallow: /*' || right(low, 1) || '$'", "'Allow: /*/' || substring(high, 5, 2)", "'Disallow: ' || high", "'Crawl-delay: 2'",
    "'User-agent: *'", "'Disallow: /de/*5'", "'no rule'",
]
_ROBOTS_TEXT = " || chr(10) || ".join(_ROBOTS_LINES)
_SITES = f"""(select page_id, url, regexp_extract(url, {_SITE_HOST}, 1) as host,
    case when starts_with(regexp_extract(url, {_SITE_PATH}, 1), '/') then regexp_extract(url, {_SITE_PATH}, 1) else '/' || regexp_extract(url, {_SITE_PATH}, 1) end as path from pages)"""


@query(
    "robots_txt",
    f"""with sites as {_SITES}, texts as (select host, {_ROBOTS_TEXT} as text from (select host, min(path) as low, max(path) as high from sites group by 1)),
    lines as (select host, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as line from texts),
    parts as (
        select host, k, lower(trim(split_part(split_part(line, '#', 1), ':', 1))) as key, trim(substring(split_part(line, '#', 1), instr(split_part(line, '#', 1), ':') + 1)) as value
        from lines where contains(split_part(line, '#', 1), ':')),
    known as (select * from parts where key in ('user-agent', 'allow', 'disallow')),
    opened as (select *, key = 'user-agent' and coalesce(lag(key) over (partition by host order by k), '') <> 'user-agent' as opens from known),
    numbered as (select *, sum(opens::int) over (partition by host order by k) as number from opened),
    agents as (select host, number, lower(regexp_extract(value, '^([A-Za-z_-]+|[*])', 1)) as agent from numbered where key = 'user-agent'),
    named as (select host, max((agent = 'siltstone')::int) as own from agents group by 1),
    rules as (
        select distinct host, value as pattern, key = 'allow' as allow
        from numbered join agents using (host, number) join named using (host)
        where key <> 'user-agent' and value <> '' and agent = case when own = 1 then 'siltstone' else '*' end),
    tests as (
        select *, '^' || replace(regexp_escape(case when ends_with(pattern, '$') then left(pattern, length(pattern) - 1) else pattern end), '\\*', '.*')
            || case when ends_with(pattern, '$') then '$' else '' end as test
        from rules),
    verdicts as (
        select host, path, arg_max(allow, length(pattern) * 2 + allow::int) as allow
        from (select distinct host, path from sites) join tests using (host) where regexp_matches(path, test) group by 1, 2)
    select page_id, host, path from sites left join verdicts using (host, path) where coalesce(allow, true) or path = '/robots.txt'""",
)
def robots_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("host"), robots.path_of(F.col("url")).alias("path"))
    texts = pages.groupBy("host").agg(F.min("path").alias("low"), F.max("path").alias("high")).selectExpr("host", f"{_ROBOTS_TEXT} as text")
    return robots.allowed(pages, robots.parsed(texts, "siltstone"))


@query("robots_filter", f"with {_LINKS} select page_id, k::int as k from links where not regexp_matches(url, '^[a-z]+://[^/?#]+/en') or regexp_matches(url, '^[a-z]+://[^/?#]+/en/6')")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).select("page_id", "k", urls.host(F.col("url")).alias("h"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/")).alias("path"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(ok).alias("allow")) for p, ok in _ROBOTS.items())))
    rules = links.select(F.col("h").alias("host")).distinct().select("host", each.alias("r")).select("host", "r.*")
    return queue.allowed(links, rules, "h", "path").select("page_id", "k")


# ---- the whole plan --------------------------------------------------------------------------------------------------------


_EXTRACTED = f"select page_id as id, content, content_hash, url from ({extract.SQL['extract_lightweight']}) join (select page_id, url from pages) using (page_id) where content <> ''"
_INGESTED = chunk.sentences_sql(f"select id as page_id, content from ({_EXTRACTED}) where id in ({dedup.first_writer_sql(f'select id, url, content_hash from ({_EXTRACTED})')})")


@query("ingestion_chunks", _INGESTED)
def ingestion_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.chunks(ingestion.stored(table(spark, sf_dir, "pages")))


query("ingestion_vectors", _embedding_sql(f"select page_id, chunk_index, chunk_text as x from ({_INGESTED})", "page_id, chunk_index"))(lambda s, d: ingestion.vectors(ingestion.chunks(ingestion.stored(table(s, d, "pages")))))
