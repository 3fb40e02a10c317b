"""The training-data operators' queries, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, exact, middle, minhash, packing, pii, quality, quotes, rules, substrings, suffixes, tries, warc
from siltstone.llm.common import Scratch, cut

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = [(F.size(F.split("base", f"{k}:")) - 1).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", *kinds, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", n_spans)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the documents is the history, the other the batch that meets it."""
    docs = table(spark, sf_dir, "documents")
    later = F.xxhash64("doc_id") < 0
    with Scratch(spark) as scratch:
        done = exact.dedup(docs.where(later), docs.where(~later), scratch)
        return cut(done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return cut(tries.audit(table(spark, sf_dir, "documents"), scratch))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(middle.restored()).alias("restored_sha256"))


QUERIES: dict[str, Query] = {"op1_packing": op1_packing, "op2_substrings": op2_substrings, "op3_quality": op3_quality, "op4_suffixes": op4_suffixes, "op5_minhash": op5_minhash, "op6_pii": op6_pii, "op7_warc": op7_warc, "op8_quotes": op8_quotes, "op9_rules": op9_rules, "op10_decontaminate": op10_decontaminate,
    "op11_exact": op11_exact, "op12_divergence": op12_divergence, "op13_middle": op13_middle}
ORACLE_SQL: dict[str, str] = {
    "op2_substrings": r"""
        with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        places as (select doc_id, words, unnest(range(1, len(words) + 1)) as k from texts),
        windows as (
            select doc_id, k, words[k] as word,
                case when k + 49 <= len(words) then md5(array_to_string(words[k : k + 49], ' ')) end as hash
            from places),
        firsts as (select hash, min(doc_id) as first from windows where hash is not null group by hash),
        marked as (
            select doc_id, k, word, coalesce(max(first < doc_id) over (
                partition by doc_id order by k rows between 49 preceding and current row), false) as removed
            from windows left join firsts using (hash)),
        kept as (
            select doc_id, count(*) as n_words, count(*) filter (where removed) as n_removed,
                string_agg(word, ' ' order by k) filter (where not removed) as kept
            from marked group by doc_id)
        select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from texts left join kept using (doc_id)""",
    "op4_suffixes": r"""
        with texts as (select doc_id, encode(coalesce(text, '')) as bytes from documents),
        places as (select doc_id, bytes, unnest(range(1, octet_length(bytes) + 1)) as k from texts),
        strings as (
            select doc_id, k, bytes[k : k] as own,
                case when k + 399 <= octet_length(bytes) then md5(bytes[k : k + 399]) end as hash
            from places),
        repeated as (select hash, count(*) > 1 as more from strings where hash is not null group by hash),
        marked as (
            select doc_id, k, own, coalesce(max(more) over (
                partition by doc_id order by k rows between 399 preceding and current row), false) as removed
            from strings left join repeated using (hash)),
        edges as (select *, removed and not lag(removed, 1, false) over (partition by doc_id order by k) as opens from marked),
        kept as (
            select doc_id, count(*) as n_bytes, count(*) filter (where removed) as n_removed, count(*) filter (where opens) as n_spans,
                string_agg(hex(own), '' order by k) filter (where not removed) as kept
            from edges group by doc_id)
        select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
            sha256(unhex(coalesce(kept, ''))) as kept_sha256
        from texts left join kept using (doc_id)""",
    "op5_minhash": r"""
        with recursive texts as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') as words
            from documents),
        places as (select doc_id, words, unnest(range(1, greatest(len(words), 2))) as k from texts where len(words) > 0),
        shingles as (select distinct doc_id, array_to_string(words[k : k + 1], ' ') as shingle from places),
        sizes as (select doc_id, count(*) as size, md5(string_agg(shingle, chr(10) order by shingle)) as own from shingles group by doc_id),
        sets as (select own, min(doc_id) as head, any_value(size) as size from sizes group by own),
        parts as (select head, size, shingle from sets join shingles on head = doc_id),
        links as (
            select a.head as a, b.head as b from parts a join parts b using (shingle)
            where a.head <> b.head and 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
            group by a.head, b.head, a.size, b.size having 100 * count(*) >= 80 * (a.size + b.size - count(*))),
        reached as (select head, head as other from sets union select head, b as other from reached join links on other = a),
        classes as (select head, min(other) as component_id from reached group by head)
        select doc_id, coalesce(sizes.size, 0) as n_shingles, coalesce(component_id, doc_id) as component_id,
            coalesce(component_id, doc_id) = doc_id as kept
        from texts left join sizes using (doc_id) left join sets using (own) left join classes using (head)""",
    "op7_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        q as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as head from p)
        select page_id, payload_bytes, payload_digest,
            case when head is not null and page_id < head then 'revisit' else 'response' end as record_type,
            case when head is not null and page_id < head then head end as refers_to
        from q""",
    "op10_decontaminate": r"""
        with words_of as (
            select id, kind, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D!-/:-@\[-`{-~]+') as words
            from (select doc_id as id, 'text' as kind, text from documents
                union all select item_id, 'item', text from benchmark
                union all select item_id, 'question', regexp_extract(text, '(?is)^(.*\n|)[ \t]*(?:answer|a)[ \t]*:', 1) from benchmark
                where regexp_matches(text, '(?im)^[ \t]*(?:answer|a)[ \t]*:'))),
        items as (
            select i.id as item_id, i.words, coalesce(len(q.words), (2 * len(i.words) + 2) // 3) as answer_from,
                least(5, len(i.words)) as n, length(bin(greatest(len(i.words), 32))) as class
            from words_of i left join words_of q on q.id = i.id and q.kind = 'question' where i.kind = 'item' and len(i.words) > 0),
        steps as (select distinct class, 1::bigint << class as step from items),
        grams as (
            select distinct item_id, class, n, array_to_string(words[k : k + n - 1], ' ') as gram
            from (select *, unnest(range(1, len(words) - n + 2)) as k from items)),
        item_words as (
            select distinct item_id, k > answer_from as answer, words[k] as word from (select *, unnest(range(1, len(words) + 1)) as k from items)),
        texts as (select id as doc_id, words, len(words) as size from words_of where kind = 'text' and len(words) > 0),
        text_grams as (
            select doc_id, size, k - 1 as k, n, array_to_string(words[k : k + n - 1], ' ') as gram
            from (select *, unnest(range(1, size - n + 2)) as k from texts cross join (select distinct n from items)) where len(words[k : k + n - 1]) = n),
        held as (
            select doc_id, size, item_id, class, step, p, count(distinct gram) as held
            from (select *, unnest([k // step, k // step - 1]) as p from text_grams join grams using (n, gram) join steps using (class))
            where p >= 0 and p < greatest((size - 1) // step, 1) and k + n <= (p + 2) * step
            group by all),
        near as (
            select held.*, answer
            from held join (select item_id, count(*) as wanted from grams group by item_id) using (item_id)
                join (select distinct item_id, answer from item_words) using (item_id)
            where 10 * held >= 8 * wanted),
        passages as (
            select doc_id, item_id, answer, p, unnest(words[p * step + 1 : (p + 2) * step]) as word
            from near join texts using (doc_id)),
        parts as (
            select near.doc_id, near.item_id, near.p, near.answer, count(distinct passages.word) as held
            from near join passages using (doc_id, item_id, p, answer) join item_words using (item_id, answer, word) group by all),
        verified as (
            select doc_id, item_id, p, count(*) as parts
            from parts join (select item_id, answer, count(*) as wanted from item_words group by all) using (item_id, answer)
            where 10 * held >= 8 * wanted group by all)
        select distinct doc_id, item_id
        from verified join (select item_id, count(distinct answer) as parts from item_words group by item_id) using (item_id, parts)""",
    "op11_exact": r"""
        with t as (
            select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
            from documents),
        g as (
            select *, first_value(doc_id) over (partition by text_sha256 order by n_chars desc, doc_id) as keep_id,
                count(*) over (partition by text_sha256) as group_size
            from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""",
    "op12_divergence": r"""
        with d as (
            select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents),
        terms as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as item from d),
        counts as (select lang, source, item, count(*)::hugeint as n from terms group by all),
        kept as (select lang, item from terms group by all having count(distinct r) >= 3),
        groups as (select distinct lang, source from d),
        sizes as (select lang, count(*) as v from kept group by all),
        cells as (
            select lang, source, item, coalesce(n, 0)::hugeint as n
            from groups join kept using (lang) left join counts using (lang, source, item)),
        totals as (select lang, source, sum(n)::hugeint as total from cells group by all),
        p as (
            select lang, source, item, n, 1 + 1000000000::hugeint * (n + 1) // (total + v) as p
            from cells join totals using (lang, source) join sizes using (lang)),
        whole as (select lang, item, sum(n)::hugeint as n from cells group by all),
        q as (
            select lang, item, 1 + 1000000000::hugeint * (n + 1) // (total + v) as q
            from whole join (select lang, sum(total)::hugeint as total from totals group by all) using (lang) join sizes using (lang)),
        pairs as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
            from p a join p b on a.lang = b.lang and a.item = b.item and a.source <> b.source group by all),
        every_pair as (
            select g.lang, g.source, h.source as item, coalesce(value, 0) as value
            from groups g join groups h on g.lang = h.lang and g.source <> h.source
                left join pairs on pairs.lang = g.lang and pairs.source = g.source and pairs.item = h.source),
        every as (
            select lang, source, 'pair' as part, item, value from every_pair
            union all select lang, source, 'term', item, ((p - q) * (p - q) // q)::bigint from p join q using (lang, item) where n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every)
        select * from ranked where part = 'pair' or rank <= 200""",
    "op13_middle": r"""
        with t as (
            select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units
            from documents),
        d as (
            select *, len(units) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3,
                ('0x' || h[25:32])::bigint as h4
            from t),
        c as (
            select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
                    when h4 % 100 < 20 then 'spm' else 'psm' end as form
            from d),
        p as (select *, array_to_string(units[1:a], '') as x, array_to_string(units[a + 1:b], '') as y, array_to_string(units[b + 1:], '') as z from c)
        select doc_id, n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end)
                as output_sha256,
            sha256(text) as restored_sha256
        from p""",
}
