"""Context rules: what stands to the left of a span, and around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import BIRTH_CUES, NEGATIVE_CONTEXT, PERSON_CUES
from .text import cut_out, digits_of, left_of, strings

WINDOW = 40
# What may stand between a label and its number.
GAP = r"[\s:#\-./]*(?:no\.?|nos\.?|number|num\.?|#)*[\s:#\-./]*"
#: A run of more than 15 digits is seen in this many characters of either side.
RUN = 40


def preceding_label(text: Column, start: Column) -> Column:
    """The longest context label that ends right before start, or null."""
    left = F.lower(left_of(text, start, WINDOW))
    labels = sorted([*NEGATIVE_CONTEXT, *BIRTH_CUES], key=lambda x: (-len(x), x))
    fits = F.filter(
        strings(labels),
        lambda x: F.rlike(left, F.concat(F.lit(r"(?U)(?:^|(?<![\p{L}\p{N}]))\Q"), x, F.lit(r"\E" + GAP + "$"))),
    )
    return F.get(fits, F.lit(0))


def label_before(left: Column, labels: Sequence[str]) -> Column:
    """Whether one of some labels ends right before the end of left: one constant pattern, compiled once."""
    return F.rlike(left, F.lit(r"(?U)(?<![\p{L}\p{N}])(?:" + "|".join(rf"\Q{x}\E" for x in labels) + ")" + GAP + "$"))


def is_reference(text: Column, start: Column) -> Column:
    """Whether the nearest label says that the number is a reference.

    The labels are told apart one by one only where one of either kind fits.
    """
    left = F.lower(left_of(text, start, WINDOW))
    nearest = F.coalesce(F.array_contains(strings(NEGATIVE_CONTEXT), preceding_label(text, start)), F.lit(False))
    fits = F.coalesce(label_before(left, NEGATIVE_CONTEXT), F.lit(False))
    return F.when(~fits, F.lit(False)).when(~label_before(left, BIRTH_CUES), F.lit(True)).otherwise(nearest)


def has_birth_cue(text: Column, start: Column) -> Column:
    left = F.lower(left_of(text, start, WINDOW))
    return F.rlike(left, F.lit("|".join(rf"\Q{x}\E" for x in BIRTH_CUES)))


def digit_run(text: Column, start: Column, end: Column) -> Column:
    """Digits of the run of digits around a span, single separators between digits included."""
    left = F.regexp_extract(cut_out(text, start - RUN, start), r"(?U)((?:\d[ \t-]?)*)$", 1)
    right = F.regexp_extract(cut_out(text, end, end + RUN), r"(?U)^((?:[ \t-]?\d)*)", 1)
    # the left side counts only if it touches, or a separator stands between digits
    return F.concat(digits_of(left), digits_of(cut_out(text, start, end)), digits_of(right))


def version_before(text: Column, start: Column) -> Column:
    return F.rlike(left_of(text, start, 16), F.lit(r"(?iU)(?:version|section|ver|v)\s*$"))


def has_person_cue(text: Column, start: Column, end: Column, window: int = 48) -> Column:
    around = F.lower(cut_out(text, start - window, end + window))
    return F.exists(strings(PERSON_CUES), lambda cue: F.contains(around, cue))


def snippet(text: Column, start: Column, end: Column, window: int = 40) -> Column:
    """The span with its surroundings on one line."""
    return F.translate(cut_out(text, start - window, end + window), "\n", " ")
