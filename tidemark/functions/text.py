"""Row-local text expressions.  Rule tables become arrays of CASE results inside one projection: no join, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\r\f\x0b"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z“\"(])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentences(text: Column, low: int = 40, high: int = 1500) -> Column:
    """Paragraphs of at least 40 characters, split after . ! ? before a capital or quote; 40 to 1500 characters."""
    paras = F.filter(F.transform(F.split(text, "\n+"), strip), lambda p: F.length(p) >= low)
    parts = F.flatten(F.transform(paras, lambda p: F.transform(F.split(p, SENTENCE_BREAK), strip)))
    return F.filter(parts, lambda s: F.length(s).between(low, high))


def clip(c: Column, n: int = 420) -> Column:
    """At most n characters, cut on a word."""
    t = strip(F.regexp_replace(c, r"\s+", " "))
    cut = F.regexp_replace(F.substring(t, 1, n), r" [^ ]*$", "")
    return F.when(F.length(t) <= n, t).otherwise(F.concat(cut, F.lit("…")))


def clean_text(c: Column) -> Column:
    """Collapse spaces, drop spaces before punctuation, add the missing space after a sentence."""
    t = strip(F.regexp_replace(c, r"\s+", " "))
    t = F.regexp_replace(t, r"\s+([,.;:!?)])", "$1")
    return F.regexp_replace(t, r"([a-z])\.([A-Z][a-z])", "$1. $2")


def canonical_url(c: Column) -> Column:
    """Lower case without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[?#].*$", ""), r"/+$", "")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def matched(text: Column, rules: Sequence[tuple], ignore_case: bool = True) -> Column:
    """Labels of every rule that matches, in rule order; one alternation rejects most texts first."""
    return F.when(any_rule(text, rules, ignore_case), each_rule(text, rules, ignore_case)).otherwise(F.array().cast("array<string>"))


def any_rule(text: Column, rules: Sequence[tuple], ignore_case: bool = True) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{r[1]})" for r in rules))


def each_rule(text: Column, rules: Sequence[tuple], ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    return F.filter(F.array(*[F.when(text.rlike(flag + r[1]), F.lit(r[0])) for r in rules]), lambda x: x.isNotNull())


def explode_matches(df: DataFrame, keep: Sequence[str], labels: Column, name: str) -> DataFrame:
    """One row per label.  The outer form keeps the optimizer from evaluating the rules a second time in a pushed filter."""
    return df.select(*keep, F.explode_outer(labels).alias(name)).filter(F.col(name).isNotNull())


def first_match(text: Column, rules: Sequence[tuple], default: str | None = None, ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    out = None
    for r in rules:
        out = F.when(text.rlike(flag + r[1]), r[0]) if out is None else out.when(text.rlike(flag + r[1]), r[0])
    return out.otherwise(F.lit(default).cast("string"))


def title_tokens(title: Column, drop: Sequence[str]) -> Column:
    """Distinct lower-case words longer than two letters without stop words."""
    words = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(list(drop))))


# Named entities worth decoding without leaving the JVM.
ENTITIES = [("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]


def html_to_text(raw: Column) -> Column:
    """Drop script, style and head, block tags to line breaks, cells to spaces, decode entities, collapse blanks."""
    t = F.regexp_replace(raw, r"(?is)<(script|style|head|ix:header)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|tr|li|h[1-6]|table|section)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(td|th)\b[^>]*>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\f\x0b]+", " ")
    return strip(F.regexp_replace(t, r"\n\s*\n+", "\n\n"))


def strip_tags(c: Column) -> Column:
    """Article text without tags, entities decoded, blanks collapsed; empty becomes null."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = strip(F.regexp_replace(t, r"\s+", " "))
    return F.nullif(t, F.lit(""))
