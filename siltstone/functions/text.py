"""Text functions as Column expressions: one white-space class everywhere, ASCII-only case folding, LIKE as SQLite has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that Python's str.strip() and \s treat as white space, for Java and for RE2.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_RE2 = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def collapse(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, f"{WS}+", " ")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like(c: Column, query: str, literal: bool = False) -> Column:
    r"""c contains query, ASCII case ignored. % and _ in it are wildcards unless literal; \ is an ordinary character."""
    pattern = query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    if literal:
        pattern = pattern.replace("%", r"\%").replace("_", r"\_")
    return ascii_lower(c).like(f"%{pattern}%")


def like_pattern(query: str, literal: bool = False) -> str:
    """A Java pattern that is found in a text just where `like` holds, ASCII case ignored, without a lower-case copy of the text.

    Wildcards part the query into runs, and each run's first place after the one before is the right one to take: atomic
    groups never look for another, so the search is linear.
    """
    quote = lambda run: "".join("." if c == "_" and not literal else c if c.isalnum() or ord(c) > 127 else f"\\{c}" for c in run)
    runs = [r for r in ([query] if literal else query.split("%")) if r]
    return "(?is)" + (quote(runs[0]) if len(runs) == 1 else "".join(["\\A", *(f"(?>.*?{quote(r)})" for r in runs)]))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, f"{WS}+"), lambda w: w != "")).cast("long")


def clean_text(c: Column) -> Column:
    """White space collapsed and stripped; '' if 20 characters or fewer are left."""
    line = strip(collapse(c))
    return F.when(F.length(line) > 20, line).otherwise("")


def sha256_or_empty(c: Column) -> Column:
    return F.when(c != "", F.sha2(c, 256)).otherwise("")


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS_RE2}+', ' ', 'g')"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS_RE2}+|{WS_RE2}+\z', '', 'g')"


def sql_clean(x: str) -> str:
    line = sql_strip(sql_collapse(x))
    return f"case when length({line}) > 20 then {line} else '' end"
