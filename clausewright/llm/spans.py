"""Regular-expression spans in code points, built from SQL expressions only.

Every pattern here runs in linear time: a match may only begin where a run of its first class begins (or where the
last match ended), and no group repeats, so that long texts neither go quadratic nor deepen the matcher's stack."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks the borders of matches; in a text it is first replaced by another character of one code point.
EDGE, OTHER = "\uE000", "\uE001"
#: Stands for a separator that cannot be part of a match.
OFF = "\uE002"

#: Matches that are gathered at a time: an array is copied as often as something is put to it.
FOLD = 256

SPAN = "array<struct<s:bigint,e:bigint,v:string>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A cheap test that fails only where no match can be.
    hint: Callable[[Column], Column]
    #: Whether a match stays.
    keep: Callable[[Column], Column]
    #: Changes characters one for one, before matching.
    prepare: Callable[[Column], Column] = lambda t: t


def plain(text: Column) -> Column:
    """The text, empty for null, without the characters that have a meaning here; as long as before."""
    return F.translate(F.coalesce(text, F.lit("")), EDGE + OFF, OTHER * 2)


def matches(text: Column, rule: Rule) -> Column:
    """The rule's kept matches in a plain() text, as array of (s, e, v), e exclusive."""
    cut = F.split(F.regexp_replace(rule.prepare(text), rule.pattern, f"{EDGE}$0{EDGE}"), EDGE)
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(False).alias("hit"), none.alias("now"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["pos"] + F.length(x)
        hit = F.struct(a["pos"].alias("s"), end.alias("e"), x.alias("v"))
        full = F.size(a["now"]) >= FOLD
        now = F.when(a["hit"] & rule.keep(x), F.array_append(F.when(full, none).otherwise(a["now"]), hit)).otherwise(F.when(full, none).otherwise(a["now"]))
        return F.struct(end.alias("pos"), (~a["hit"]).alias("hit"), now.alias("now"), F.when(full, F.array_append(a["out"], a["now"])).otherwise(a["out"]).alias("out"))

    found = F.aggregate(cut, start, step, lambda a: F.flatten(F.array_append(a["out"], a["now"])))
    return F.when(rule.hint(text), found).otherwise(none)


def tagged(found: dict[str, Column]) -> Column:
    """Spans of several kinds as one array of (s, k, e, kind, v), by start and then by the order of the kinds."""
    return F.array_sort(F.concat(*[as_kind(c, k, kind) for k, (kind, c) in enumerate(found.items())]))


def as_kind(spans: Column, k: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
