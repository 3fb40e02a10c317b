"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_scheme(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def looks_like_url(url: Column) -> Column:
    return url.startswith("http")


def is_well_formed(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("HOST")).isNotNull()


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def authority(url: Column) -> Column:
    """Host and port, which is what politeness and robots rules go by."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def depth(url: Column) -> Column:
    """How many non-empty segments its path has; 0 without a path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def distinct_urls(urls: Column) -> Column:
    """An array's URLs without repeats, the first of each kept."""
    return F.array_distinct(urls)


# ---- resolving and canonical form: the generic syntax of RFC 3986, as expressions ----------------------------------------------

#: The generic syntax's parts (RFC 3986, appendix B); ports that a scheme has anyway.
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), where the value is computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _part(url: Column, k: int) -> Column:
    """Group k of the parts: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' if it isn't there."""
    return F.regexp_extract(url, f"(?s){_PARTS}", k)


def _has(url: Column, k: int) -> Column:
    """Whether scheme, authority, query or fragment is there, if empty."""
    return url.rlike({1: "^[^:/?#]+:", 2: "^(?:[^:/?#]+:)?//", 4: "(?s)^[^?#]*\\?", 5: "#"}[k])


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments (RFC 3986, 5.2.4); a path that began with a slash still does."""
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _let(path, _without_dots)).otherwise(path)


def _without_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    rooted = path.startswith("/")
    own = F.when(rooted, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(own, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    tail = F.when((last == ".") | (last == ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(tail, "/"))


def resolve(base: Column, reference: Column) -> Column:
    """The URL that a reference means where base is (RFC 3986, 5.2, strict); null if one of them is."""
    return _let(F.struct(base.alias("base"), reference.alias("reference")), lambda x: _resolve(x["base"], x["reference"]))


def _resolve(base: Column, reference: Column) -> Column:
    scheme, authority, path, query = (_part(base, k) for k in (1, 2, 3, 4))
    own = {k: _part(reference, k) for k in (1, 2, 3, 4, 5)}
    has = {k: _has(reference, k) for k in (1, 2, 4, 5)}
    folder = F.when(_has(base, 2) & (path == ""), "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    absolute = has[1] | has[2]
    as_written = F.when(absolute | own[3].startswith("/"), own[3]).otherwise(F.concat(folder, own[3]))
    new_path = F.when(~absolute & (own[3] == ""), path).otherwise(_let(as_written, without_dots))
    keeps_query = ~absolute & (own[3] == "") & ~has[4]
    text = lambda test, *x: F.when(test, F.concat(*x)).otherwise("")
    return F.concat(
        text(has[1] | _has(base, 1), F.when(has[1], own[1]).otherwise(scheme), F.lit(":")),
        text(has[2] | ~has[1] & _has(base, 2), F.lit("//"), F.when(absolute, own[2]).otherwise(authority)),
        new_path,
        text(has[4] | keeps_query & _has(base, 4), F.lit("?"), F.when(has[4], own[4]).otherwise(query)),
        text(has[5], F.lit("#"), own[5]),
    )


def percent_encoded(text: Column) -> Column:
    """What is no visible ASCII character in UTF-8 bytes as %XX; of what is encoded already, unreserved characters as themselves, the rest in upper case."""
    wide = F.when(text.rlike("[^!-~]"), _let(text, lambda x: F.array_join(F.transform(F.split(x, ""), _encoded), ""))).otherwise(text)
    return _let(wide, lambda x: F.when(x.contains("%"), _let(F.split(x, "%"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _known), "")))).otherwise(x))


def _encoded(c: Column) -> Column:
    return F.when(c.rlike("[^!-~]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)


def _known(x: Column) -> Column:
    """What follows a per cent sign, with it or as the character that it stands for."""
    letter = F.chr(F.conv(F.substring(x, 1, 2), 16, 10).cast("int"))
    plain = F.when(letter.rlike("^[A-Za-z0-9._~-]$"), letter).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2))))
    return F.when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(plain, F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%"), x))


def canonical(url: Column) -> Column:
    """A URL's canonical form: scheme and host in lower case, no default port, no dot segments, "/" for an empty path beside a host, percent-encoding as above, no fragment."""
    return _let(url, _canonical)


def _canonical(url: Column) -> Column:
    scheme = F.lower(_part(url, 1))
    site = F.regexp_extract(_part(url, 2), r"^((?:[^@]*@)?)(.*?)(?::([0-9]*))?$", 2)
    user, port = (F.regexp_extract(_part(url, 2), r"^((?:[^@]*@)?)(.*?)(?::([0-9]*))?$", k) for k in (1, 3))
    usual = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair)), scheme), F.lit(""))
    authority_ = F.concat(user, F.lower(site), F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port)))
    path = F.when(_has(url, 2) & (_part(url, 3) == ""), "/").otherwise(F.when(_has(url, 2), without_dots(_part(url, 3))).otherwise(_part(url, 3)))
    return F.concat(
        F.when(_has(url, 1), F.concat(scheme, F.lit(":"))).otherwise(""), F.when(_has(url, 2), F.concat(F.lit("//"), percent_encoded(authority_))).otherwise(""),
        percent_encoded(path), F.when(_has(url, 4), F.concat(F.lit("?"), percent_encoded(_part(url, 4)))).otherwise(""),
    )
