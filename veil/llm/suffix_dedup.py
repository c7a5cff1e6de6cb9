"""Duplicate passages by sparse suffix arrays.

Of each text only the suffixes at minimiser positions stay: the place of the least of the
hashes of SEED words inside some window of `least` words, the leftmost of equals.  It
depends on the window's words alone, so a passage that repeats keeps the same suffixes in
every place, and every window of `least` words belongs to just one suffix, which stands in
it.  Suffixes are sorted over all texts by their seed and compared with their neighbours.

A suffix is extended left and right at once: its segment reaches over all windows that
belong to it.  Neighbours with equal segments agree over the whole of it.  Where neighbours
share the seed but not the segment, one suffix of each segment is extended window by
window; these windows are sorted in turn and compared with their neighbours.  So a
passage's inside costs one row for some twenty words, and only its edges a row a word.

The result is exact: the words covered by any passage of `least` words or more that stands
at two places, in one text or in several.  Segments and windows are equal if two hashes of
64 bits are, that of the seed and that of the whole; n of them meet by chance with a
probability of n * n / 2**129.

Both sorts are by range of (hashes, row, place), so a passage that a third of all texts
share is spread over many tasks.  A task looks at neighbours only and holds one row between
batches; what its first and last row would need of other tasks is settled by a group over
two rows of a task.

Defined results: null and empty texts and texts of fewer words than `least` have no
passage; copies of a text under another id are passages of each other; rows of the same id
and text are one place and no copies of each other, and get a row each; a row without an id
counts as any other and keeps a null id; other columns are ignored; an empty table gives no
rows; a very long text is handled alone, with memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit
from .common import cut, row_key, small

#: Words of a passage at least.
LEAST = 50
#: Words of the gram whose hash selects positions.
SEED = 8
#: Bytes of a text with places, and of each place, with what a hash table adds.
PLACE_BYTES = 64
#: Bits of a position that stand in for the last bits of a seed's hash while the least is sought.
PLACE = np.uint64((1 << 24) - 1)


def powers_of(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Grams:
    """Hashes of any window of words of a batch, by prefix sums."""

    BASE = 0xC2B2AE3D27D4EB4F
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, word: np.ndarray):
        n = len(word)
        self.down = powers_of(self.INVERSE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word * powers_of(self.BASE, n)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return bytekit.mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i, by windows of powers of two."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(seed: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The place of the least seed of the windows that begin at starts, the leftmost of equals."""
    place = np.arange(len(seed), dtype=np.uint64) & PLACE
    low = sliding_least((seed & ~PLACE) | place, width)[starts] & PLACE
    return starts + ((low - starts.astype(np.uint64)) & PLACE).astype(np.int64)


class Suffixes:
    """Kept suffixes of a batch: place, first window and number of windows, seed and segment."""

    def __init__(self, word: np.ndarray, rows: np.ndarray, least: int):
        self.owner = bytekit.row_of(rows)
        n = max(0, len(word) - least + 1)
        starts = np.flatnonzero(self.owner[:n] == self.owner[least - 1 : least - 1 + n])
        self.grams = Grams(word)
        if not len(starts):
            self.at = self.first = self.count = np.zeros(0, np.int64)
            self.seed = self.segment = np.zeros(0, np.uint64)
            return
        seed = bytekit.grams(word, SEED)
        at = anchors(seed, starts, least - SEED + 1)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        cuts = np.flatnonzero(new)
        self.at, self.first, self.count = at[cuts], starts[cuts], np.diff(np.append(cuts, len(starts)))
        self.seed = seed[self.at]
        shape = ((self.at - self.first) * least + self.count).astype(np.uint64)
        self.segment = bytekit.mix(self.grams.of(self.first, self.count + least - 1) + shape)


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """docs (row, text) to kept suffixes: (seed, whole, row, at, first, n), first and at in words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches):
            word, rows = bytekit.words(batch.column("text"), bytekit.SPACE_WORD, lower=False)
            s = Suffixes(word, rows, least)
            owner = s.owner[s.at]
            base = rows[:-1][owner]
            ids = batch.column("row").to_numpy()[owner]
            yield pa.record_batch(
                [pa.array(s.seed.view(np.int64)), pa.array(s.segment.view(np.int64)), pa.array(ids), pa.array((s.at - base).astype(np.int32)), pa.array((s.first - base).astype(np.int32)), pa.array(s.count.astype(np.int32))],
                ["seed", "whole", "row", "at", "first", "n"],
            )

    return docs.mapInArrow(run, "seed long, whole long, row long, at int, first int, n int")


ORDER = ("seed", "whole", "row", "at")


def in_order(table: DataFrame) -> DataFrame:
    return table.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def neighbours(table: DataFrame, speak: bool) -> DataFrame:
    """Rows of a table in ORDER that agree with a neighbour, and those that must be looked at again.

    sure: another place has the same seed and whole.  open: it is a task's first or last
    row, or, with speak, the row stands for its whole among others of the same seed.
    """
    kept = [f.name for f in table.schema]

    def judged(t: pa.Table, before: tuple | None, spoken: bool, last: bool) -> tuple[pa.Table, bool]:
        """All rows of t but the final one, which has no next row unless it is the task's last."""
        seed, whole, row, at = (t.column(c).to_numpy() for c in ORDER)
        n = len(seed)
        same_seed, same = np.zeros(n, bool), np.zeros(n, bool)
        same_seed[1:] = seed[1:] == seed[:-1]
        same[1:] = same_seed[1:] & (whole[1:] == whole[:-1])
        if before is not None:
            same_seed[0] = seed[0] == before[0]
            same[0] = same_seed[0] and whole[0] == before[1]
        after_seed, after = np.append(same_seed[1:], False), np.append(same[1:], False)
        # each whole speaks by its first row, or by its last where only that meets another whole
        head = ~same & same_seed & speak
        run = np.cumsum(~same)
        heads = np.bincount(run, head, minlength=int(run[-1]) + 1) > 0
        heads[0] |= spoken
        tail = ~after & after_seed & ~heads[run] & speak
        edge = np.zeros(n, bool)
        edge[0] = before is None
        edge[-1] = last
        sure = same | after
        out = t.append_column("sure", pa.array(sure)).append_column("open", pa.array(head | tail | edge))
        end = n if last else n - 1
        return out.slice(0, end).filter(pa.array((sure | head | tail | edge)[:end])), bool(heads[run[-1]])

    def distinct(t: pa.Table) -> pa.Table:
        """Without rows that are the same place as the one before."""
        cols = [t.column(c).to_numpy() for c in ORDER]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        return t.filter(pa.array(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, spoken = None, None, False
        for batch in batches:
            t = distinct(pa.Table.from_batches([*([held] if held is not None else []), batch]))
            if t.num_rows > 1:
                out, spoken = judged(t, before, spoken, False)
                yield from out.combine_chunks().to_batches()
                before = tuple(t.column(c)[t.num_rows - 2].as_py() for c in ORDER)
            if t.num_rows:
                held = t.slice(t.num_rows - 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield from judged(pa.Table.from_batches([held]), before, spoken, True)[0].combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.select(*kept).mapInArrow(run, f"{schema}, sure boolean, open boolean")


def windows(docs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """docs (row, text) and suffixes (row, seed, first, n, sure) to their windows: (seed, whole, row, at, known)."""
    places = found.groupBy("row").agg(F.collect_list(F.struct("seed", "first", "n", "sure")).alias("places"))
    places = cut(places)
    n, more = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    d = docs.join(small(places, 1, PLACE_BYTES * (n + more)), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches):
            word, rows = bytekit.words(batch.column("text"), bytekit.SPACE_WORD, lower=False)
            column = batch.column("places")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            seed, first, n, sure = (column.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            start = bytekit.ranges(first.astype(np.int64) + rows[:-1][owner], n.astype(np.int64))
            of = np.repeat(np.arange(len(n)), n)
            h = Grams(word).of(start, least)
            yield pa.record_batch(
                [pa.array(seed[of]), pa.array(h.view(np.int64)), pa.array(batch.column("row").to_numpy()[owner[of]]), pa.array((start - rows[:-1][owner[of]]).astype(np.int32)), pa.array(sure[of])],
                ["seed", "whole", "row", "at", "known"],
            )

    return d.select("row", "text", "places").mapInArrow(run, "seed long, whole long, row long, at int, known boolean")


def repeated(docs: DataFrame, least: int) -> DataFrame:
    """docs (row, text) to (row, start, end): parts in words, overlapping ones too, that stand at another place."""
    kept = cut(suffixes(docs, least))
    found = cut(neighbours(in_order(kept), True), kept)
    sure = found.where("sure").select("row", F.col("first").alias("start"), (F.col("first") + F.col("n") + (least - 1)).alias("end"))
    again = cut(windows(docs, found.where("open").select("row", "seed", "first", "n", "sure"), least))
    hit = cut(neighbours(in_order(again), False), again)
    # a window that had no neighbour in its task may have one in the next: two rows of a task at most
    lone = hit.where("open and not sure").alias("a")
    other = hit.where("open").groupBy("seed", "whole").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("at").alias("a0"), F.max("at").alias("a1"))
    met = lone.join(other.where("r0 <> r1 or a0 <> a1"), ["seed", "whole"], "left_semi")
    part = hit.where("sure and not known").select("row", "at").unionByName(met.where("not known").select("row", "at"))
    return sure.unionByName(part.select("row", F.col("at").alias("start"), (F.col("at") + least).alias("end")))


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of docs with a repeated passage: doc_id, n_dup_words, longest, spans (start, end in words)."""
    if least < 2 * SEED:
        raise ValueError(f"passages need {2 * SEED} words at least")
    keyed = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = repeated(keyed.select("row", "text"), least)
    # parts that overlap or touch are one span
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    parts = parts.withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("row", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = (F.col("end") - F.col("start")).cast("long")
    of = cut(spans.groupBy("row").agg(F.sum(length).alias("n_dup_words"), F.max(length).alias("longest"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    return keyed.select("row", "doc_id").join(of, "row").select("doc_id", "n_dup_words", "longest", "spans")
