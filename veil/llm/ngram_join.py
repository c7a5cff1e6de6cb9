"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct word 5-grams.  Equal sets are one class.  A set's tokens
are hashed into groups and counted: two sets share at most the sum of the smaller counts,
and an R-tree over these points prunes whole boxes by their largest counts before pairs are
looked at.  What survives is verified exactly, by 64-bit hashes of the 5-grams.

The tree alone cannot be dealt over machines, as boxes of unrelated documents overlap.  So
sets meet by their prefixes: with all tokens in one order, two sets with a Jaccard of 0.75
or more share one of the first quarter (and one more) of either's.  This holds in any order;
the order used puts rare tokens first, by counts of all tokens of all documents in
hashed counters, so that a passage in very many documents is in the prefix of those alone
that hold little else.  No linked pair is missed.

Tokens of prefixes are sorted by range, with a band of the set's size behind each, and
compared with their neighbours, so a token that no set of a like size has too goes no
further; of tokens with the same members one stays.  The members of a
token are joined twice: first against the most central one, then, once these links are
components, by the tree between members of different components only.  So finding the
components of a group of thousands of near copies takes a few links each.  Groups above
BLOCK members are dealt as pairs of blocks.

near_links() then counts all links.  A link lies inside one component, so the classes of a
component are joined with each other by the tree, in pairs of blocks, and every pair that
the tree leaves is verified where it is found; the tasks return a count per class, not
pairs.  This costs the square of a component's classes at worst, as its links may.

Defined results: null and empty texts have no shingles and link with nothing, so each is
its own component, with 0 links; fewer words than a shingle's make one shingle; every row
gets a row, repeated rows the same component; a row without an id links as any other, and
its class and component are the least ids there are among those, null if there are none;
other columns are ignored; an empty table gives no rows; a very long text is handled alone,
with memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.store import scratch

from . import bytekit
from .common import cut, row_key, small
from .components import components

SHINGLE = 5
GROUPS = 256
#: Bits of a hash that choose a counter of tokens (four million, a byte each), and the parts they are sent in.
SLOT_BITS, CHUNKS = 22, 64
#: Bits of a token that give way to the band of a size.
BAND_BITS = np.uint64(8)
#: Pairs whose hub's text is sent once.
HUB_PAIRS = 500
#: Members of a key that one task joins; a larger group is dealt as pairs of such blocks.
BLOCK = 1000
#: Shingles of a block of a component's classes, on average.
BLOCK_SHINGLES = 1_000_000
#: Points of a node of the tree.
FAN = 16
#: Column that carries a row's key beside columns of any name.
KEY = "_veil_row"
#: Bytes of a broadcast row of two numbers, with what a hash table adds.
PAIR_BYTES = 64


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the n + 1 offsets of the rows."""
    word, rows = bytekit.words(column, bytekit.SPACE_WORD, lower=True)
    n = np.diff(rows)
    gram = bytekit.grams(word, k)
    count = np.maximum(n - k + 1, 0)
    values = [gram[bytekit.ranges(rows[:-1], count)]]
    owner = [np.repeat(np.arange(len(n)), count)]
    for j in range(1, k):
        short = np.flatnonzero(n == j)
        if len(short):
            values.append(bytekit.grams(word, j)[rows[short]] ^ np.uint64(j))
            owner.append(short)
    v, o = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(n) + 1))


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """The binary logarithm of the count of each hashed counter of tokens, over all docs.

    A task sends its counters in chunks of a byte each, full ones at 255; a chunk's bytes
    are summed as they come in, so memory is that of the counters.
    """
    size = 1 << SLOT_BITS
    chunk = size // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(size, np.int64), []
        for batch in bytekit.slices(batches):
            word, _ = bytekit.words(batch.column("text"), bytekit.SPACE_WORD, lower=True)
            held.append(slots(bytekit.grams(word, SHINGLE)))
            if sum(map(len, held)) > size // 4:
                sums += np.bincount(np.concatenate(held), minlength=size)
                held = []
        if held:
            sums += np.bincount(np.concatenate(held), minlength=size)
        each = np.minimum(sums, 255).astype(np.uint8).reshape(CHUNKS, chunk)
        for i, x in enumerate(each):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([x.tobytes()])], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64)
        for i, x in sums.items():
            classes = np.log2(np.maximum(x, 1)).astype(np.uint8)
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([classes.tobytes()])], ["chunk", "classes"])

    rows = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    table = rows.repartition("chunk").mapInArrow(add, "chunk int, classes binary").toArrow()
    out = np.zeros((CHUNKS, chunk), np.uint8)
    for i, x in zip(table.column("chunk").to_pylist(), table.column("classes"), strict=True):
        out[i] = np.frombuffer(x.as_buffer(), np.uint8)
    return out.reshape(-1)


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefixes(v: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each row's prefix, rare ones first, and how many they are."""
    order = (classes[slots(v)].astype(np.uint64) << np.uint64(58)) | (v & np.uint64((1 << 58) - 1))
    owner = bytekit.row_of(rows)
    sorted_ = np.lexsort((order, owner))
    n = np.diff(rows)
    size = np.where(n > 0, n // 4 + 1, 0)
    place = np.arange(len(v)) - rows[:-1][owner]
    return v[sorted_][place < size[owner]], size


def sketch_batch(batch: pa.RecordBatch, classes: np.ndarray) -> pa.RecordBatch:
    v, rows = shingle_sets(batch.column("text"))
    n = np.diff(rows)
    some = np.flatnonzero(n)
    high, low = set_hashes(v, rows)
    counts = np.zeros((len(n), GROUPS), np.int64)
    if len(some):
        counts = np.bincount(bytekit.row_of(rows) * GROUPS + group_of(v), minlength=len(n) * GROUPS).reshape(len(n), GROUPS)
    vectors = np.minimum(counts, 255).astype(np.uint8)
    keys, size = prefixes(v, rows, classes)
    keys = with_band(keys, np.repeat(n, size))
    return pa.record_batch(
        [
            batch.column("row"),
            batch.column("doc_id"),
            pa.array(n.astype(np.int64)),
            pa.array(high.view(np.int64)),
            pa.array(low.view(np.int64)),
            pa.array([x.tobytes() for x in vectors], pa.binary()),
            bytekit.list_array(pa.array(keys.view(np.int64)), size),
        ],
        ["row", "doc_id", "n_shingles", "set_high", "set_low", "counts", "keys"],
    )


def with_band(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens with the band of their set's size in the last bits; linked sets are in one band or two next to each other."""
    band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(4 / 3)).astype(np.uint64)
    return (tokens >> BAND_BITS << BAND_BITS) | band


def group_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(11)).astype(np.int64) % GROUPS


def set_hashes(v: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set, 0 where it is empty."""
    high, low = np.zeros(len(rows) - 1, np.uint64), np.zeros(len(rows) - 1, np.uint64)
    some = np.flatnonzero(np.diff(rows))
    if len(some):
        high[some] = np.add.reduceat(v, rows[:-1][some])
        low[some] = np.add.reduceat(bytekit.mix(v), rows[:-1][some])
    return high, low


def sketches(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) to sizes, hashes, count vectors and prefixes of their sets."""
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches):
            yield sketch_batch(batch, classes.value)

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, set_high long, set_low long, counts binary, keys array<long>")


def widened(vectors: np.ndarray) -> np.ndarray:
    """Counts with those that did not fit a byte taken as unbounded."""
    out = vectors.astype(np.int32)
    out[vectors == 255] = 1 << 20
    return out


class Tree:
    """A packed R-tree over count vectors; nodes keep the largest count of each group and the span of sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        # packed along sizes, then along one half of the coordinates
        self.order = np.lexsort((vectors[:, ::2].sum(1), sizes))
        self.levels = [(vectors[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FAN:
            top, least, most = self.levels[-1]
            at = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def search(self, vector: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap with the vector may reach 3/7 of both sizes."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[depth]
            at = at[(100 * np.minimum(most[at], size) >= 75 * np.maximum(least[at], size))]
            bound = np.minimum(top[at], vector).sum(1)
            at = at[7 * bound >= 3 * (np.maximum(least[at], -(-75 * size // 100)) + size)]
            if depth:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def group_pairs(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, sides: np.ndarray) -> Iterator[tuple[int, int]]:
    """Surviving pairs of different labels; sides 0 and 1 are two blocks, 2 a block with itself."""
    wide = widened(vectors)
    if (sides == 2).all():
        left = right = np.arange(len(ids))
    else:
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(left) or not len(right) or len(np.unique(labels)) < 2:
        return
    tree = Tree(wide[right], sizes[right])
    for i in left:
        found = right[tree.search(wide[i], int(sizes[i]))]
        found = found[labels[found] != labels[i]]
        for j in found[ids[found] > ids[i]] if sides[i] == 2 else found:
            yield (int(ids[i]), int(ids[j]))


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the columns by, which the batches are sorted by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, int)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            part = batch.slice(int(a), int(b - a))
            now = tuple(int(c[a]) for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            last = now
    if held:
        yield pa.Table.from_batches(held)


def tree_pairs(members: DataFrame) -> DataFrame:
    """members (key, w, id, label, size, counts) to candidate pairs (a, b) across labels.

    w is the number of tokens that have the key's members.  Two sets of sizes s and t that
    share o tokens or more have the least o - s + p of them in the prefix of p tokens, so both
    prefixes share the smaller of the two numbers; pairs that share fewer are out.
    """
    big = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    d = members.join(big, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    d = d.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    d = d.select("key", "w", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), side.alias("side"), "id", "label", "size", "counts")
    # the pairs of a block inside itself are made where it stands alone
    d = d.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int, int], int] = {}
        for t in groups(batches, ("key", "lo", "hi")):
            if t.num_rows < 2:
                continue
            vectors = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(t.num_rows, GROUPS)
            ids, labels, sizes, sides = (t.column(c).to_numpy() for c in ("id", "label", "size", "side"))
            size, w = dict(zip(ids.tolist(), sizes.tolist(), strict=True)), t.column("w")[0].as_py()
            for x, y in {(min(p), max(p)) for p in group_pairs(ids, labels, sizes, vectors, sides)}:
                pair = (x, y, size[x], size[y])
                seen[pair] = seen.get(pair, 0) + w
            if len(seen) > 50_000:
                yield _pairs(seen)
                seen = {}
        if seen:
            yield _pairs(seen)

    d = d.mapInArrow(run, "a long, b long, s long, t long, w long").groupBy("a", "b").agg(F.max("s").alias("s"), F.max("t").alias("t"), F.sum("w").alias("w"))
    least = F.floor((3 * (F.col("s") + F.col("t")) + 6) / 7)
    in_prefix = lambda c: least - F.col(c) + F.floor(F.col(c) / 4) + 1
    return d.where(F.col("w") >= F.least(in_prefix("s"), in_prefix("t"))).select("a", "b")


def _pairs(seen: dict[tuple[int, int, int, int], int]) -> pa.RecordBatch:
    x = np.array(list(seen), np.int64).reshape(-1, 4)
    return pa.record_batch([*[pa.array(x[:, i]) for i in range(4)], pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["a", "b", "s", "t", "w"])


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs (a, b) that the sum of smaller counts does not rule out."""
    p = points.select("id", "size", "counts")
    n = pairs.count()
    d = p.withColumnRenamed("id", "a").join(small(pairs, PAIR_BYTES, n), "a")
    d = d.select("a", "b", F.col("size").alias("size_a"), F.col("counts").alias("counts_a")).join(p.withColumnRenamed("id", "b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (widened(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS)) for c in ("counts_a", "counts"))
            both = batch.column("size_a").to_numpy() + batch.column("size").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(7 * np.minimum(x, y).sum(1) >= 3 * both))

    return d.select("a", "b", "size_a", "counts_a", "size", "counts").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of rows whose sets have 100 * shared >= 75 * united; b is the hub of many pairs.

    A hub's text meets HUB_PAIRS of its partners at a time, so it is sent once for all of
    these and a hub of any number of partners is spread over tasks.
    """
    pairs = cut(pairs.distinct())
    n = pairs.count()
    hubs = cut(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("parts")))
    m = hubs.count()
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")
    left = pairs.join(small(hubs, PAIR_BYTES, m), "b").select("a", "b", part)
    left = texts.withColumnRenamed("row", "a").join(small(left, PAIR_BYTES, n), "a").select("b", "part", "a", "text")
    right = texts.withColumnRenamed("row", "b").join(small(hubs, PAIR_BYTES, m), "b")
    right = right.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text")
    d = left.unionByName(right).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, tokens = None, np.zeros(0, np.uint64)
        for batch in bytekit.slices(batches):
            v, rows = shingle_sets(batch.column("text"))
            n = np.diff(rows)
            b = batch.column("b").to_numpy()
            is_hub = batch.column("a").is_null().to_numpy(zero_copy_only=False)
            good = np.zeros(len(n), bool)
            # rows of one hub follow each other, its own first
            cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                for i in x + np.flatnonzero(is_hub[x:y])[:1]:
                    hub, tokens = b[i], v[rows[i] : rows[i + 1]]
                own = np.arange(x, y)[~is_hub[x:y]]
                if b[x] != hub or not len(own):
                    continue
                mine = v[rows[x] : rows[y]]
                at = np.minimum(np.searchsorted(tokens, mine), max(len(tokens) - 1, 0))
                hit = np.concatenate([[0], np.cumsum(tokens[at] == mine if len(tokens) else np.zeros(len(mine), bool))])
                shared = hit[rows[own + 1] - rows[x]] - hit[rows[own] - rows[x]]
                good[own] = 100 * shared >= 75 * (n[own] + len(tokens) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return d.mapInArrow(run, "a long, b long").distinct()


def link_counts(values: np.ndarray, rows: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Links of each set to sets of the other side; sides 0 and 1 are two blocks, 2 a block with itself."""
    sizes = np.diff(rows)
    n = len(sizes)
    out = np.zeros(n, np.int64)
    left, right = (np.flatnonzero(sides == x) for x in ((2, 2) if (sides == 2).all() else (0, 1)))
    if not len(left) or not len(right):
        return out
    vectors = np.bincount(bytekit.row_of(rows) * GROUPS + (values >> np.uint64(11)).astype(np.int64) % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)
    distinct, item = np.unique(values, return_inverse=True)
    mark = np.zeros(len(distinct), bool)
    tree = Tree(vectors[right], sizes[right])
    for i in left:
        found = right[tree.search(vectors[i], int(sizes[i]))]
        if sides[i] == 2:
            found = found[found > i]
        mine = item[rows[i] : rows[i + 1]]
        mark[mine] = True
        # as many sets at once as have about a block's shingles
        for some in np.split(found, np.flatnonzero(np.diff(np.cumsum(sizes[found]) // BLOCK_SHINGLES)) + 1):
            if len(some):
                hit = mark[item[bytekit.ranges(rows[:-1][some], sizes[some])]]
                shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                linked = some[100 * shared >= 75 * (sizes[i] + sizes[some] - shared)]
                out[linked] += 1
                out[i] += len(linked)
        mark[mine] = False
    return out


def counted_links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """classes (id, size, component) to (id, n_links), those without links left out; texts are (row, text)."""
    groups_ = classes.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("shingles")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    d = cut(classes.join(groups_.select("component", blocks.alias("blocks")), "component").select(F.col("id").alias("row"), "component", "blocks"))
    d = texts.join(small(d, 2 * PAIR_BYTES), "row").withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    d = d.select("component", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), side.alias("side"), "row", "text")
    # a block's pairs inside itself are made where it stands alone
    d = d.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ("component", "lo", "hi")):
            # repeated rows are one
            t = t.take(np.unique(t.column("row").to_numpy(), return_index=True)[1])
            values, rows = shingle_sets(t.column("text").combine_chunks())
            links = link_counts(values, rows, t.column("side").to_numpy())
            out = t.filter(pa.array(links > 0))
            for batch in out.select(["row"]).append_column("n", pa.array(links[links > 0])).combine_chunks().to_batches():
                yield batch

    return d.mapInArrow(run, "row long, n long").groupBy("row").agg(F.sum("n").alias("n_links")).withColumnRenamed("row", "id")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Distinct rows of tokens (key, id) whose token another id of a like size has too; key is the token alone.

    Sorted by range, so a token of very many ids is spread; a task holds one row between
    batches, and what its first and last row need of other tasks is settled by a group over
    two rows of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None

        def judged(t: pa.Table, last: bool) -> pa.Table:
            key = t.column("key").to_numpy()
            token, band = key >> np.int64(BAND_BITS), key & np.int64(255)
            same = np.zeros(len(key), bool)
            # bands rise within a token, by rounding one of two that may link can be off by one more
            same[1:] = (token[1:] == token[:-1]) & (band[1:] - band[:-1] <= 2)
            same[0] = before is not None and token[0] == before >> int(BAND_BITS) and band[0] - (before & 255) <= 2
            edge = np.zeros(len(key), bool)
            edge[0], edge[-1] = before is None, last
            sure = same | np.append(same[1:], False)
            end = len(key) if last else len(key) - 1
            return t.append_column("sure", pa.array(sure)).append_column("edge", pa.array(edge)).slice(0, end).filter(pa.array((sure | edge)[:end]))

        def distinct(t: pa.Table) -> pa.Table:
            key, id_ = t.column("key").to_numpy(), t.column("id").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])
            return t.filter(pa.array(new))

        for batch in batches:
            t = distinct(pa.Table.from_batches([b for b in (held, batch) if b is not None]))
            if t.num_rows > 1:
                yield from judged(t, False).combine_chunks().to_batches()
                before = t.column("key")[t.num_rows - 2].as_py()
            if t.num_rows:
                held = t.slice(t.num_rows - 1).combine_chunks().to_batches()[0]
        if held is not None:
            yield from judged(pa.Table.from_batches([held]), True).combine_chunks().to_batches()

    held_rows = cut(tokens.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long, sure boolean, edge boolean"))
    d = held_rows.withColumn("key", F.shiftright("key", int(BAND_BITS)))
    ends = d.where("edge").groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key")
    met = d.where("not sure").join(ends, "key", "left_semi")
    return cut(d.where("sure").unionByName(met).select("key", "id"), held_rows)


def memberships(tokens: DataFrame) -> DataFrame:
    """(key, id, m, w): members of shared tokens, m of them; one token of each set of members stands for w of them."""
    d = shared_tokens(tokens)
    sets = cut(d.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("g")))
    one = sets.groupBy("m", "h", "g").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("w"))
    return cut(d.join(one.select("key", "m", "w"), "key"), d, sets)


def _near(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """near_components() with the id of each row's class, the classes (id, size, component), and the texts by row."""
    keyed = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = keyed.select("row", "text")
    s = cut(sketches(keyed))
    # a class goes by one of its rows, which stands for all of them
    classes = cut(s.where("n_shingles > 0").groupBy("set_high", "set_low").agg(F.min("row").alias("id"), F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("size")))
    # rows that are alike are several points of one id, which what follows takes for one
    reps = s.where("n_shingles > 0").join(small(classes.select(F.col("id").alias("row")), PAIR_BYTES), "row", "left_semi")
    points = cut(reps.select(F.col("row").alias("id"), F.col("n_shingles").alias("size"), "counts", "keys"))
    tokens = points.select("id", F.explode("keys").alias("key"))
    s = cut(s.drop("counts", "keys"), s)
    members = memberships(tokens)
    central = members.groupBy("id").agg(F.sum("m").alias("weight"))
    weighed = members.join(central, "id")
    # the heaviest member, the least of equals, by two hash aggregates
    most = weighed.groupBy("key").agg(F.max("weight").alias("weight"))
    leaders = weighed.join(most, ["key", "weight"]).groupBy("key").agg(F.min("id").alias("leader"))
    first = members.join(leaders, "key").where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    links = cut(verified(bounded(cut(first), points), texts))
    labels = cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))).withColumnRenamed("node", "id")
    named = members.select("key", "w", "id").join(labels, "id", "left").select("key", "w", "id", F.coalesce("component", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    open_members = cut(named.join(mixed, "key").join(points.select("id", "size", "counts"), "id"), members)
    more = cut(verified(tree_pairs(open_members), texts), open_members, points)
    every = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    final = components(every).withColumnRenamed("node", "id")
    classes = cut(classes.join(final, "id", "left").withColumn("component", F.coalesce("component", "id")), classes)
    least = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of = classes.join(least, "component").select("set_high", "set_low", "id", "class_id", "component_id", "component")
    d = s.join(of, ["set_high", "set_low"], "left")
    some = F.col("n_shingles") > 0
    own = lambda c: F.when(some, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return d.select("row", "doc_id", "n_shingles", own("class_id"), own("component_id"), "id", "component"), classes, texts


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: row (its key), doc_id, n_shingles, class_id, component_id.

    class_id is the least id with the very same set; component_id the least id reached by links.
    """
    return _near(docs)[0].drop("id", "component")


def near_links(docs: DataFrame) -> DataFrame:
    """near_components() with n_links: how many other classes, each one different set, the row's class is linked to."""
    d, classes, texts = _near(docs)
    d = cut(d)
    links = counted_links(classes.select("id", "size", "component"), texts)
    d = d.join(links, "id", "left")
    return d.select("row", "doc_id", "n_shingles", "class_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, without those that another row of their component stands for.

    That is the one of the least id, then of the least key.  Rows that are alike are one; rows
    without shingles all stay.
    """
    with scratch(docs.sparkSession):
        found = cut(_near(docs)[0].where("component is not null").select("row", "doc_id", "component", "component_id"))
        first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("first"))
        found = found.join(first, "component")
        lost = cut(found.where("row <> first").select(F.col("row").alias(KEY)).distinct(), keep=True)
        again = cut(found.where("row = first").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row").alias(KEY)), keep=True)
    keyed = docs.withColumn(KEY, row_key("doc_id", "text"))
    kept = keyed.join(small(lost, PAIR_BYTES), KEY, "left_anti")
    if n := again.count():
        more = small(again, PAIR_BYTES, n)
        kept = kept.join(more, KEY, "left_anti").unionByName(kept.join(more, KEY, "left_semi").dropDuplicates([KEY]))
    return kept.select(*docs.columns)
