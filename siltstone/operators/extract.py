"""HTML to text, five variants, as Column expressions in one pass over the page: no Python row by row.

Regular expressions see elements that don't contain one of the same name exactly; for nested containers and rare entities
there is `parse_html`, an Arrow-batched fall-back on the standard library's parser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import WS, WS_RE2, clean_text, collapse, sha256_or_empty, sql_clean, sql_collapse, sql_strip, strip, word_count

#: Entities that are decoded, in this order; tags that are no content; classes of content, in the order tried,
#: and of what stands beside it.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
BOILERPLATE = ["script", "style", "nav", "header", "footer", "aside", "form"]
CODE = ["script", "style"]
CONTENT_CLASSES = ["content", "post-content", "entry-content", "article-content", "post-body", "story-content", "page-content"]
SIDE_CLASSES = ["sidebar", "menu", "comments", "advertisement"]
TAG, COMMENT = "<[^>]*>", "<!--.*?-->"


def element(tag: str, strict: bool = True) -> str:
    return rf"(?is)<{tag}\b[^>]*>(.*?){'' if strict else '(?:'}</{tag}\s*>{'' if strict else '|\\z)'}"


def opening(attribute: str, value: str) -> str:
    return rf"""(?is)<(\w+)\b[^>]*\b{attribute}\s*=\s*["']{value}["'][^>]*>"""


def class_value(name: str) -> str:
    return rf"""(?:[^"']*\s)?(?-i:{name})(?:\s[^"']*)?"""


def of_class(name: str) -> str:
    return rf"{opening('class', class_value(name))}(.*?)</\1\s*>"


ROLE_MAIN = rf"{opening('role', '(?-i:main)')}(.*?)</\1\s*>"
META, META_CONTENT = r"""(?is)<meta\b[^>]*\bname\s*=\s*["'](?-i:description)["'][^>]*>""", r"""(?is)\bcontent\s*=\s*["']([^"']*)["']"""


def removals(tags: list[str]) -> list[str]:
    """Patterns of what is taken out, one after the other: comments and code in one pass, then the other elements."""
    code = "|".join([COMMENT, *(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in tags if t in CODE)])
    rest = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in tags if t not in CODE)
    return [f"(?is){x}" for x in (code, rest) if x]


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c with c evaluated once, however often f refers to it, and wherever the optimizer puts the expression."""
    return F.transform(F.array(c), f)[0]


def without(html: Column, tags: list[str]) -> Column:
    for x in removals(tags):
        html = F.regexp_replace(html, x, "")
    return html


def first_of(html: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches has matched, or ''; a pattern is tried where none before has."""

    def then(pattern: str) -> Callable[[Column], Column]:
        return lambda found: F.when(found == "", F.regexp_extract(html, pattern, 0)).otherwise(found)

    found = F.regexp_extract(html, patterns[0], 0)
    for x in patterns[1:]:
        found = bound(found, then(x))
    return found


def decoded(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def joined_text(html: Column, separator: str) -> Column:
    """The strings between tags, stripped, empty ones left out."""
    return F.array_join(F.filter(F.transform(F.split(html, TAG), lambda x: strip(decoded(x))), lambda x: x != ""), separator)


def fused_text(html: Column) -> Column:
    return decoded(F.regexp_replace(html, TAG, ""))


def title(html: Column, default: Column) -> Column:
    return bound(F.regexp_extract(html, element("title"), 0), lambda t: F.when(t != "", strip(fused_text(t))).otherwise(default))


def description(html: Column) -> Column:
    return decoded(F.regexp_extract(F.regexp_extract(html, META, 0), META_CONTENT, 1))


def read(pages: DataFrame, tags: list[str], default: Column, content: Callable[[Column], Column]) -> DataFrame:
    """pages with `_p`: title, and content of the page without these elements."""
    return pages.withColumn("_p", bound(without(F.col("html"), tags), lambda h: F.struct(title(h, default).alias("title"), content(h).alias("content"))))


def lightweight(pages: DataFrame) -> DataFrame:
    """Boilerplate removed; article, main, role or content class, else the body without side blocks; title, description and text in one line."""

    def content(h: Column) -> Column:
        body = F.regexp_extract(h, element("body", False), 0)
        for c in SIDE_CLASSES:
            body = F.regexp_replace(body, of_class(c), "")
        found = first_of(h, [element("article"), element("main"), ROLE_MAIN, *map(of_class, CONTENT_CLASSES)])
        found = bound(found, lambda f: F.when(f == "", body).otherwise(f))
        return bound(F.concat_ws("\n", title(h, F.col("url")), description(h), bound(joined_text(found, "\n"), clean_text)), clean_text)

    return _out(read(pages, BOILERPLATE, F.col("url"), content), "Failed to fetch")


def minimal(pages: DataFrame) -> DataFrame:
    """article, main or content class, else the body; lines of over 20 characters."""

    def content(h: Column) -> Column:
        found = first_of(h, [element("article"), element("main"), *map(of_class, CONTENT_CLASSES[:2]), element("body", False)])
        text = F.regexp_replace(joined_text(found, "\n"), rf"\n{WS}*\n", "\n\n")
        return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) > 20), "\n")

    return _out(read(pages, CODE, F.col("url"), content), "Failed")


def worker(pages: DataFrame) -> DataFrame:
    """The body's text, cut at full stops; pieces of over 10 characters."""

    def content(h: Column) -> Column:
        text = collapse(fused_text(F.regexp_extract(h, element("body", False), 0)))
        return F.array_join(F.filter(F.transform(F.split(text, r"\."), strip), lambda x: F.length(x) > 10), ". ")

    return _out(read(pages, CODE, F.col("url"), content), "")


def body_text(pages: DataFrame) -> DataFrame:
    """The body's text, collapsed; 500 characters of it, hashed whole. A page without html has the text of an empty one."""
    rows = read(pages, CODE, F.col("url"), lambda h: collapse(fused_text(F.coalesce(F.regexp_extract(h, element("body", False), 0), F.lit("")))))
    return rows.select("page_id", "_p.title", F.substring("_p.content", 1, 500).alias("content"), F.sha2("_p.content", 256).alias("content_hash"))


def direct(pages: DataFrame) -> DataFrame:
    """article or main in the body, else the body; 1000 characters of it, hashed whole."""

    def content(h: Column) -> Column:
        found = bound(F.regexp_extract(h, element("body", False), 0), lambda b: first_of(b, [element("article"), element("main"), r"(?s).+"]))
        return collapse(bound(F.coalesce(found, F.lit("")), lambda f: F.when(f == "", "No content found").otherwise(joined_text(f, " "))))

    rows = read(pages, CODE, F.lit("No Title"), content)
    return rows.select("page_id", "_p.title", F.substring("_p.content", 1, 1000).alias("content"), F.sha2("_p.content", 256).alias("content_hash"))


def _out(rows: DataFrame, failed: str) -> DataFrame:
    empty = F.coalesce(F.col("html"), F.lit("")) == ""
    out = rows.select("page_id", F.when(empty, failed).otherwise(F.col("_p.title")).alias("title"), F.when(empty, "").otherwise(F.col("_p.content")).alias("content"))
    return out.withColumns({"content_hash": sha256_or_empty(F.col("content")), "word_count": word_count(F.col("content"))})


class _Parser(HTMLParser):
    def __init__(self, skip: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.in_title, self.title, self.parts = skip, 0, False, "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.skip
        self.in_title |= tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.skip and self.depth > 0
        self.in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.depth and data.strip():
            self.parts.append(data.strip())


def parse_html(pages: DataFrame, skip: list[str] = BOILERPLATE) -> DataFrame:
    """page_id, title and text of pages that regular expressions can't read: nested containers, any entity."""
    tags = frozenset(skip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                p = _Parser(tags)
                p.feed(html or "")
                p.close()
                rows.append((page_id, p.title.strip(), "\n".join(p.parts)))
            yield pd.DataFrame(rows, columns=["page_id", "title", "content"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, content string")


# ---- the same in SQL ---------------------------------------------------------------------------------------------------


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_decoded(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {_quote(a)}, {_quote(b)})"
    return x


def _sql_without(x: str, tags: list[str]) -> str:
    for pattern in removals(tags):
        x = rf"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


def _sql_block(x: str, attribute: str, value: str) -> str:
    """The inside of the first element with such an attribute. RE2 has no back references: the tag's name goes into a second pattern."""
    open_ = _quote(opening(attribute, value))
    after = f"substring({x}, position(regexp_extract({x}, {open_}, 0) in {x}) + length(regexp_extract({x}, {open_}, 0)))"
    close = rf"'(?is)^(.*?)</' || regexp_extract({x}, {open_}, 1) || '\s*>'"
    return f"case when regexp_matches({x}, {open_}) and regexp_matches({after}, {close}) then regexp_extract({after}, {close}, 1) end"


def _sql_without_blocks(x: str) -> str:
    """Side blocks taken out; for the same reason these tags only."""
    for c in SIDE_CLASSES:
        for t in ("div", "section", "ul", "p", "span"):
            pattern = opening("class", class_value(c)).replace(r"(\w+)", t) + rf".*?</{t}\s*>"
            x = f"regexp_replace({x}, {_quote(pattern)}, '', 'g')"
    return x


def _sql_inner(x: str, tag: str, strict: bool = True) -> str:
    return f"case when regexp_matches({x}, '{element(tag, strict)}') then regexp_extract({x}, '{element(tag, strict)}', 1) end"


def _sql_joined(x: str, separator: str) -> str:
    piece = sql_strip(_sql_decoded("v"))
    return f"array_to_string(list_filter(list_transform(string_split_regex({x}, '{TAG}'), lambda v: {piece}), lambda v: v <> ''), {separator})"


def _sql_title(default: str) -> str:
    return f"coalesce({sql_strip(_sql_decoded(f'''regexp_replace({_sql_inner('h', 'title')}, '{TAG}', '', 'g')'''))}, {default})"


_WORDS = f"len(list_filter(string_split_regex(content, '{WS_RE2}+'), lambda v: v <> ''))"
_FULL = f"select page_id, title, content, case when content <> '' then sha256(content) else '' end as content_hash, {_WORDS}::bigint as word_count from t"
SQL = {
    "extract_lightweight": f"""with p as (select page_id, url, {_sql_without("html", BOILERPLATE)} as h from pages),
        q as (select page_id, {_sql_title("url")} as title, {_sql_decoded(f"regexp_extract(regexp_extract(h, {_quote(META)}, 0), {_quote(META_CONTENT)}, 1)")} as about,
            coalesce({_sql_inner("h", "article")}, {_sql_inner("h", "main")}, {_sql_block("h", "role", "(?-i:main)")}, {", ".join(_sql_block("h", "class", class_value(c)) for c in CONTENT_CLASSES)}) as a, {_sql_inner("h", "body", False)} as b from p),
        s as (select page_id, title, about, coalesce({_sql_joined(f"coalesce(a, {_sql_without_blocks('b')})", "chr(10)")}, '') as x from q), r as (select page_id, title, about, {sql_clean("x")} as x from s),
        t as (select page_id, title, {sql_clean("title || chr(10) || about || chr(10) || x")} as content from r) {_FULL}""",
    "extract_minimal": f"""with p as (select page_id, url, {_sql_without("html", CODE)} as h from pages),
        q as (select page_id, {_sql_title("url")} as title, coalesce({_sql_inner("h", "article")}, {_sql_inner("h", "main")}, {", ".join(_sql_block("h", "class", class_value(c)) for c in CONTENT_CLASSES[:2])}, {_sql_inner("h", "body", False)}) as a from p),
        s as (select page_id, title, regexp_replace({_sql_joined("a", "chr(10)")}, '\\n{WS_RE2}*\\n', chr(10) || chr(10), 'g') as x from q),
        t as (select page_id, title, coalesce(array_to_string(list_filter(string_split(x, chr(10)), lambda w: length({sql_strip("w")}) > 20), chr(10)), '') as content from s) {_FULL}""",
    "extract_worker": f"""with p as (select page_id, url, {_sql_without("html", CODE)} as h from pages),
        q as (select page_id, {_sql_title("url")} as title, coalesce({_sql_inner("h", "body", False)}, '') as a from p),
        s as (select page_id, title, {sql_collapse(_sql_decoded(f"regexp_replace(a, '{TAG}', '', 'g')"))} as x from q),
        t as (select page_id, title, array_to_string(list_filter(list_transform(string_split(x, '.'), lambda w: {sql_strip("w")}), lambda w: length(w) > 10), '. ') as content from s) {_FULL}""",
    "extract_body": f"""with p as (select page_id, url, {_sql_without("html", CODE)} as h from pages),
        q as (select page_id, {_sql_title("url")} as title, coalesce({_sql_inner("h", "body", False)}, '') as a from p),
        s as (select page_id, title, {sql_collapse(_sql_decoded(f"regexp_replace(a, '{TAG}', '', 'g')"))} as x from q)
        select page_id, title, substring(x, 1, 500) as content, sha256(x) as content_hash from s""",
    "extract_direct": f"""with p as (select page_id, url, {_sql_without("html", CODE)} as h from pages),
        b as (select page_id, h, {_sql_inner("h", "body", False)} as b from p),
        q as (select page_id, {_sql_title("'No Title'")} as title, coalesce({_sql_inner("b", "article")}, {_sql_inner("b", "main")}, b) as a from b),
        s as (select page_id, title, {sql_collapse(f"coalesce({_sql_joined('a', chr(39) + ' ' + chr(39))}, 'No content found')")} as x from q)
        select page_id, title, substring(x, 1, 1000) as content, sha256(x) as content_hash from s""",
}
