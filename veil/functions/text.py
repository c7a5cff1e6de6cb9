"""Native span extraction and small helpers on text columns.

Offsets are code points, from 0, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"

#: Signs for private use that stand before and behind a match, and the one that stands for either in a text meanwhile.
#: The patterns take all three alike.
MARK, BEHIND, OTHER = "\ue000", "\ue001", "\ue002"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed, and written in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_places(values: Column, by: Callable[[Column], Column]) -> Column:
    """values without those whose by() an earlier one has too; by() is computed once a value.

    Equal strings are looked up by array_position, which compares them in a loop of the JVM
    and not by a lambda.
    """
    return let(values, lambda v: let(F.transform(v, by), lambda k: F.filter(v, lambda _, i: F.array_position(k, F.get(k, i)) == i + 1)))


def strings(values: Sequence[str]) -> Column:
    """A constant array; the split of one literal is folded when the plan is made."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def cut_out(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with starts below 0 taken as 0."""
    s = F.greatest(start, F.lit(0))
    return text.substr((s + 1).cast("int"), F.greatest(end - s, F.lit(0)).cast("int"))


def left_of(text: Column, start: Column, window: int) -> Column:
    return cut_out(text, start - window, start)


def unmarked(text: Column) -> Column:
    """text with another sign for those that mark matches."""
    return F.replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), F.lit(BEHIND), F.lit(OTHER))


def spans(text: Column, pattern: Column | str, group: int = 0, copy: Column | None = None) -> Column:
    """All matches with offsets; the group must be a suffix of the match.

    A constant pattern is compiled once and read over a text once: matches are marked in a
    copy, which is cut at the marks.  For others, matches come from one expression and the
    gaps between them from a split by the same pattern, which is compiled at each text.
    Offsets are sums of lengths, and all stays inside the JVM.  copy is unmarked(text), where
    it is at hand.
    """
    found = marked(text, unmarked(text) if copy is None else copy, pattern, group) if isinstance(pattern, str) else split_at(text, pattern, group)
    return F.coalesce(found, F.array().cast(SPAN))


def marked(text: Column, copy: Column, pattern: str, group: int) -> Column:
    # a part is a match, the group if there is one, and the gap up to the next match
    kept = MARK + "$0" + BEHIND + (f"${group}" + BEHIND if group else "")
    parts = F.split(F.regexp_replace(copy, pattern, kept), MARK, -1)

    def one_more(acc: Column, part: Column) -> Column:
        whole = F.substring_index(part, BEHIND, 1)
        value = F.substring_index(F.substring_index(part, BEHIND, 2), BEHIND, -1) if group else whole
        end, rest = acc["at"] + F.length(whole), F.length(value) + 2 if group else F.lit(1)
        one = F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("text"))
        return F.struct((acc["at"] + F.length(part) - rest).alias("at"), F.array_append(acc["out"], one).alias("out"))

    def walked(p: Column) -> Column:
        before = F.struct(F.length(F.get(p, F.lit(0))).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(p, F.lit(2), F.size(p)), before, one_more, lambda acc: acc["out"])

    # a text with such signs of its own gives its values itself
    own = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), cut_out(text, s["start"], s["end"]).alias("text"))
    return let(let(parts, walked), lambda found: F.when(copy == text, found).otherwise(F.transform(found, own)))


def split_at(text: Column, pattern: Column, group: int) -> Column:
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = [F.regexp_extract_all(text, pattern, F.lit(group)).alias("value")] if group else []
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), *value)
    return F.aggregate(
        F.filter(parts, lambda x: x["whole"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: step(acc, x, "value" if group else "whole"),
        lambda acc: acc["out"],
    )


def step(acc: Column, x: Column, value: str) -> Column:
    end = acc["at"] + F.length(x["gap"]) + F.length(x["whole"])
    one = F.struct((end - F.length(x[value])).alias("start"), end.alias("end"), x[value].alias("text"))
    return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def squeeze(value: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def quoted(value: Column) -> Column:
    """value as a literal inside a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    """a covers b and is not the same span."""
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"]) & ((a["start"] != b["start"]) | (a["end"] != b["end"]))
