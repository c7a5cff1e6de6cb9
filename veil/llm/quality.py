"""Quality rules from suffix-array repetition.

Each text's word suffix array is built by prefix doubling: the ranks of the first 1, 2, 4,
... words of every suffix, where only suffixes that still tie are sorted again.  The kept
ranks give the longest common prefix of neighbours.  Its intervals are the maximal repeated
substrings; the union of their occurrences is, for every suffix, its longest prefix that
stands elsewhere too.  A text fails if repeats of MIN_REPEAT words or more cover too large a
part of it, or if one repeat is too long.

Defined results: null and empty texts have no words and fail the base rule; repeated rows
get a row each, and rows without an id or with that of others are judged by their own text;
repeats that are equally long all count; other columns are ignored; an empty table gives no
rows; a very long text is handled alone, with 8 bytes a word for each doubling up to its
longest repeat, and some 100 besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytekit

MIN_REPEAT = 10
#: Gopher's limit for duplicate 10-grams (Rae et al. 2021, table A1).  Words of such repeats
#: also stand in repeated 3-word windows, so a limit near the base rule's 0.5 would not act.
MAX_COVERED = 0.1
MAX_REPEAT = 100
SYMBOLS = np.zeros(256, bool)
for _c in b"#*$%&|<>":
    SYMBOLS[_c] = True


def suffix_ranks(word: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of all rows (row by row) and the ranks after each doubling.

    ranks[k] is equal for two suffixes of a row if both have 2**k words and these agree.
    """
    n = len(word)
    owner = bytekit.row_of(rows).astype(np.int64)
    end = rows[1:][owner]
    ids = np.unique(word, return_inverse=True)[1].astype(np.int64)
    order = np.argsort((owner << 32) | ids, kind="stable")
    key = ((owner << 32) | ids)[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    # the rank of a group is the place of its first member, so ranks of others never change
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    ranks = [rank]
    step = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order, ranks
        sub = order[at]
        then = sub + step
        follow = np.where(then < end[sub], rank[np.minimum(then, n - 1)] + 1, 0)
        resort = np.lexsort((follow, rank[sub]))
        sub, follow, base = sub[resort], follow[resort], rank[sub][resort]
        order = order.copy()
        order[at] = sub
        fresh = np.ones(len(at), bool)
        fresh[1:] = (base[1:] != base[:-1]) | (follow[1:] != follow[:-1])
        new = new.copy()
        new[at] = fresh
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[sub] = first
        ranks.append(rank)
        step *= 2


def longest_repeats(word: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix of its suffix that occurs elsewhere in its row."""
    n = len(word)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order, ranks = suffix_ranks(word, rows)
    owner = bytekit.row_of(rows)
    a, b = order[:-1].copy(), order[1:].copy()
    same = owner[a] == owner[b]
    end_a, end_b = rows[1:][owner[a]], rows[1:][owner[b]]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        fits = same & (a < end_a) & (b < end_b)
        eq = np.zeros(n - 1, bool)
        eq[fits] = ranks[k][a[fits]] == ranks[k][b[fits]]
        common += eq.astype(np.int64) << k
        a += eq.astype(np.int64) << k
        b += eq.astype(np.int64) << k
    out[order[:-1]] = common
    out[order[1:]] = np.maximum(out[order[1:]], common)
    return out


def covered(lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words of each row inside the union of [i, i + lengths[i])."""
    n = len(lengths)
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(mark, at, 1)
    np.subtract.at(mark, at + lengths[at], 1)
    inside = np.cumsum(mark[:-1]) > 0
    return np.diff(np.concatenate([[0], np.cumsum(inside)])[rows])


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier line of it."""
    starts, ends, rows = bytekit.runs(data, offsets, NOT_LINE_END)
    key = bytekit.hashes(data, starts, ends)
    words = np.concatenate([[0], np.cumsum(bytekit.SPACE_WORD[data])])
    held = words[ends] > words[starts]
    owner = bytekit.row_of(rows)[held]
    key = key[held]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    again = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=len(offsets) - 1)


NOT_LINE_END = np.ones(256, bool)
NOT_LINE_END[0x0A] = False


def measure(batch: pa.RecordBatch, min_repeat: int, max_covered: float, max_repeat: int) -> pa.RecordBatch:
    data, offsets = bytekit.text_bytes(batch.column("text"))
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    starts, ends, rows = bytekit.runs(data, offsets, bytekit.SPACE_WORD)
    word = bytekit.hashes(data, starts, ends)
    n_words = np.diff(rows)
    repeat = longest_repeats(word, rows)
    n_repeat = covered(np.where(repeat >= 3, 3, 0), rows)
    n_covered = covered(np.where(repeat >= min_repeat, repeat, 0), rows)
    longest = np.zeros(len(n_words), np.int64)
    if len(repeat):
        some = n_words > 0
        longest[some] = np.maximum.reduceat(repeat, rows[:-1][some])
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~failed & (n_covered <= max_covered * n_words) & (longest <= max_repeat)
    return pa.record_batch(
        [
            batch.column("doc_id"),
            pa.array(n_words),
            pa.array(total(bytekit.SPACE_WORD[data] & bytekit.LEADS[data]).astype(np.int64)),
            pa.array(total(SYMBOLS[data]).astype(np.int64)),
            pa.array(duplicate_lines(data, offsets).astype(np.int64)),
            pa.array(n_repeat.astype(np.int64)),
            pa.array(failed),
            pa.array(kept),
            pa.array(n_covered.astype(np.int64)),
            pa.array(longest),
        ],
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"],
    )


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per row of docs; n_covered and longest_repeat are the method's figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches):
            yield measure(batch, min_repeat, max_covered, max_repeat)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
