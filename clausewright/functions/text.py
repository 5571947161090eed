"""Cleaning, splitting, scoring and rendering of texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's space separators, which SQL's trim takes off.
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def clean(t: Column) -> Column:
    """Line ends to \\n, zero-width characters out, page-number lines out, blank runs shortened, lines trimmed."""
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[​‌‍﻿]", ""), " ", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:Page [0-9]+ of [0-9]+|[-—] ?[0-9]{1,3} ?[-—]|[0-9]{1,3})[ \t]*$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]+|[ \t]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "[ \t]+", " ")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def norm_str(t: Column) -> Column:
    return F.translate(F.lower(F.trim(t)), " 　\t", "")


def count_of(t: Column, word: str) -> Column:
    return ((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / len(word)).cast("int")


def readability(t: Column) -> Column:
    """Half the share of letters, digits and common marks, half the share free of control and replacement characters."""
    n = F.length(t)
    good, bad = n - F.length(F.regexp_replace(t, r"[\p{L}0-9 .,;:!?\n]", "")), n - F.length(F.regexp_replace(t, "[\u0000-\u0008\u000e-\u001f�]", ""))
    score = F.lit(0.5) * good / n + F.lit(0.5) * (1 - bad / n)
    return F.when(F.coalesce(F.trim(t), F.lit("")) == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))


def preview(t: Column, size: int = 60) -> Column:
    """The first line that isn't blank, cut to size with an ellipsis."""
    line = F.trim(F.get(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))
    return F.coalesce(F.when(F.length(line) > size, F.concat(F.left(line, F.lit(size)), F.lit("…"))).otherwise(line), F.lit(""))


def snippet(t: Column, size: int) -> Column:
    return F.when(F.length(t) > size, F.concat(F.left(t, F.lit(size)), F.lit("..."))).otherwise(t)


def tokens(t: Column) -> Column:
    return F.filter(F.split(t, r"[，。；：、 \t\n\r,;:]+"), lambda x: x != "")


def escaped(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def to_html(t: Column) -> Column:
    """Each line that isn't blank as a paragraph, escaped."""
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "")


def lines_with(t: Column, words: list[str], most: int = 12, size: int = 1200) -> Column:
    """The first distinct lines that hold one of the words, joined, at most `size` characters."""
    kept = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 4) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(x), w)))
    return F.left(F.array_join(F.slice(F.array_distinct(kept), 1, most), "\n"), F.lit(size))


def without_nul(t: Column) -> Column:
    return F.replace(t, F.lit("\u0000"), F.lit(""))


def paragraphs(t: Column, least: int = 10) -> Column:
    return F.filter(F.transform(F.split(t, r"\n[ \t]*\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def first_hit(t: Column, rules: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The name of the first rule of which a word is in the text."""
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(t), w)), name) for name, words in rules], F.lit(other))


def cer(a: Column, b: Column) -> Column:
    """Character error rate of b against a, white space aside."""
    x, y = F.regexp_replace(a, r"[ \t\n]", ""), F.regexp_replace(b, r"[ \t\n]", "")
    return F.when(F.length(x) == 0, F.when(F.length(y) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(x, y) / F.length(x))
