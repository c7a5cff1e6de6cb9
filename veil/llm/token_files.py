"""Token ids in Arrow stream files of fixed-size-list batches.

Documents are dealt by ranges of their id and encoded in ascending order.  Each shard is
one stream file of some SHARD_BYTES of text: its token ids, an end id after every document,
are cut into sequences of equal length; a row holds one sequence of ids and one of mask
bits, false only behind the shard's last id.  A Shard maps a file and gives sequence i, or
any range of ids, as a view of the file's buffers, as every batch but the last holds the
same number of sequences.  Ids of vocabularies up to 65,536 are stored as uint16, others as
uint32.

Beside the files the folder holds an index of documents (id, shard, file, first id in the
shard, number of ids).  It is written last and names the files that count: files that
failed or repeated tasks left are deleted then, and a folder without an index is not whole.

A text is encoded piece by piece: a piece begins at white space that follows another
character, where every byte-level tokenizer of this kind ends a pre-token, so the pieces'
ids in a row are the text's.  A worker encodes a distinct piece once and keeps a bounded
memory of pieces, by hashes of 64 bits, from task to task.

Defined results: null texts are empty and get the end id alone; repeated rows are encoded
each; rows whose id is null come first; equal ids are ordered by a hash of the text, then
by text, and may go to several shards; an empty table makes no file; other columns are
ignored; a very long text is handled alone, with memory in proportion to its length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytekit
from .common import shared_path

#: Ids of a sequence.
LENGTH = 2048
#: Sequences of a batch.
ROWS = 256
#: Bytes of documents, as Spark counts them, for each shard at most.
SHARD_BYTES = 128 << 20
#: Pieces that a worker keeps, some 45 bytes each; beyond these it begins anew.
KEPT = 2_000_000


#: Of a byte: 1 visible ASCII, 2 ASCII letter, 4 ASCII white space, 8 ASCII punctuation.
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = 9
KINDS[0x30:0x3A] = 1
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    KINDS[_c] = 3
KINDS[~bytekit.SPACE_WORD] = 4


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Entries of hashed pieces: an open table of keys, at most half full."""

    def __init__(self, kind: type, most: int):
        self.most, self.bits = most, max(1, (2 * most - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.first)

    def slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key >> np.uint64(64 - self.bits)).astype(np.int64) + step) & (len(self.keys) - 1)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out = np.full(len(key), -1, np.int32)
        open_, step = np.arange(len(key)), 0
        while len(open_):
            at = self.slot(key[open_], step)
            there = self.keys[at]
            hit = there == key[open_]
            out[open_[hit]] = self.entry[at[hit]]
            open_, step = open_[~hit & (there != 0)], step + 1
        return out

    def add(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New entries of distinct keys that are not there yet, with their ids in turn."""
        number = np.arange(len(self), len(self) + len(key), dtype=np.int32)
        self.first = np.append(self.first, np.cumsum(count) - count + len(self.ids))
        self.count, self.ids = np.append(self.count, count.astype(np.int32)), np.append(self.ids, ids)
        open_, step = np.arange(len(key)), 0
        while len(open_):
            at = self.slot(key[open_], step)
            free = self.keys[at] == 0
            self.keys[at[free]] = key[open_[free]]
            # of several that want one place the last has it
            won = self.keys[at] == key[open_]
            self.entry[at[won]] = number[open_[won]]
            open_, step = open_[~won], step + 1


class Encoder:
    """Ids of texts by a memory of encoded pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        line = self.model.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1
        self.memory = Memory(self.kind, KEPT)

    def encode_pieces(self, pieces: list[bytes], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in turn, and the number of each one's.

        Simple pieces are encoded as lines of one text: a single line end between
        characters, or before one space, is a token of its own.
        """
        if simple and self.line >= 0:
            ids = np.array(self.model.encode_batch_fast([b"\n".join(pieces).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(ids == self.line)
            if len(at) == len(pieces) - 1:
                ends = np.append(at, len(ids))
                return ids[ids != self.line], np.diff(ends, prepend=-1) - 1
        got = [e.ids for e in self.model.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), self.kind, int(count.sum())), count

    def learn(self, raw: bytes, data: np.ndarray, key: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        simple = lines(data, starts, ends)
        for yes in (True, False):
            some = np.flatnonzero(simple == yes)
            if len(some):
                cuts = zip(starts[some].tolist(), ends[some].tolist(), strict=True)
                self.memory.add(key[some], *self.encode_pieces([raw[a:b] for a, b in cuts], yes))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and the number of each row's."""
        data, offsets = bytekit.text_bytes(column)
        raw = data.tobytes()
        starts, rows = pieces(data, offsets, fine=not any(t in raw for t in self.added))
        ends = np.append(starts[1:], len(data))
        # 0 marks a free place of the memory
        key = np.maximum(bytekit.hashes(data, starts, ends), np.uint64(1))
        entry = self.memory.find(key)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            new, at = np.unique(key[lost], return_index=True)
            if len(self.memory) + len(new) > KEPT:
                # begin anew with this slice's own pieces
                new, at = np.unique(key, return_index=True)
                lost, self.memory = np.arange(len(key)), Memory(self.kind, max(KEPT, len(new)))
            self.learn(raw, data, new, starts[lost[at]], ends[lost[at]])
            entry[lost] = self.memory.find(key[lost])
        count = self.memory.count[entry].astype(np.int64)
        ids = self.memory.ids[bytekit.ranges(self.memory.first[entry], count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(sums[rows])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this process, which keeps its memory from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(data: np.ndarray, offsets: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pieces, and the n + 1 offsets of rows in them.

    Pieces begin with rows and at ASCII white space behind what is surely not white space;
    fine ones also at ASCII punctuation behind a letter.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = KINDS[data]
    # bit 0: surely not white space, bit 1: surely a letter, both as a character's last byte
    last = kind & 3
    pair = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    last[1:][pair] = 1
    last[1:][pair & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)] = 3
    begin = np.zeros(len(data), bool)
    begin[1:] = (kind[1:] & 4 > 0) & (last[:-1] & 1 > 0)
    if fine:
        begin[1:] |= (kind[1:] & 8 > 0) & (last[:-1] & 2 > 0)
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether pieces can be lines of one text: at most one space, then no ASCII white space."""
    blank = np.concatenate([[0], np.cumsum(~bytekit.SPACE_WORD[data])])
    space = (data[starts] == 0x20) & (ends - starts > 1)
    return (blank[ends] - blank[starts] == space) & (data[np.minimum(starts + space, len(data) - 1)] < 0x7F) & (data[np.minimum(starts + space, len(data) - 1)] > 0x20)


class ShardWriter:
    """Writer of one stream file."""

    def __init__(self, uri: str, kind: type, length: int):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.length, self.kind, self.rest = length, kind, np.zeros(0, kind)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = fs.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.file, self.schema)

    def write(self, ids: np.ndarray, valid: np.ndarray) -> None:
        column = pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(valid), self.length)
        self.out.write_batch(pa.record_batch([column, mask], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.rest, ids])
        step = self.length * ROWS
        at = 0
        while len(ids) - at >= step:
            self.write(ids[at : at + step], np.ones(step, bool))
            at += step
        self.rest = ids[at:]

    def close(self) -> None:
        if n := len(self.rest):
            full = -(-n // self.length) * self.length
            self.write(np.pad(self.rest, (0, full - n)), np.arange(full) < n)
        self.out.close()
        self.file.close()


def shard_count(docs: DataFrame) -> int:
    """As many as shuffles have partitions, and more where these would be too large."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-min(size, 1 << 50) // SHARD_BYTES))


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Write docs (doc_id, text) as shards in folder; return the index, a row per document."""
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shard_count(docs), *order).sortWithinPartitions(*order, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, at = encoder_of(tokenizer), None, 0
        part = TaskContext.get()
        number = part.partitionId()
        # tasks that run twice write files of their own; the index names the one that counts
        name = f"shard-{number:06d}-{part.taskAttemptId()}.arrows"
        for batch in bytekit.slices(batches):
            shard = shard or ShardWriter(f"{folder}/{name}", encoder.kind, length)
            ids, count = encoder.encode(batch.column("text"))
            ends = np.cumsum(count)
            ids = np.insert(ids, ends, end_id)
            shard.add(ids)
            count = count + 1
            first = at + np.cumsum(count) - count
            at += int(count.sum())
            k = batch.num_rows
            yield pa.record_batch([batch.column("doc_id"), pa.array([number] * k, pa.int32()), pa.array([name] * k), pa.array(first), pa.array(count)], ["doc_id", "shard", "file", "first", "n_tokens"])
        if shard:
            shard.close()

    fs, path = hadoop_path(spark, folder)
    fs.mkdirs(path)
    index = ordered.mapInArrow(encode, INDEX)
    index.write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    drop_strays(spark, folder, index)
    return index


INDEX = "doc_id long, shard int, file string, first long, n_tokens long"


def hadoop_path(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_strays(spark: SparkSession, folder: str, index: DataFrame) -> None:
    """Delete shards that the index does not name; their names are one a shard."""
    named = {r[0] for r in index.select("file").distinct().collect()}
    fs, path = hadoop_path(spark, folder)
    for found in fs.listStatus(path):
        if found.isFile() and found.getPath().getName().endswith(".arrows") and found.getPath().getName() not in named:
            fs.delete(found.getPath(), False)


def with_starts(index: DataFrame) -> DataFrame:
    """index with start, the ids of all documents before; sums of shards are few."""
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(sums, "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


class Shard:
    """Random access to one stream file; where the store allows, everything is a view of the mapped file."""

    def __init__(self, uri: str):
        if urlsplit(uri).scheme in ("", "file"):
            self.source = pa.memory_map(urlsplit(uri).path)
        else:
            fs, path = pa.fs.FileSystem.from_uri(uri)
            self.source = fs.open_input_file(path)
        # only the batches' heads are read here
        with pa.ipc.open_stream(self.source) as stream:
            self.batches = list(stream)

    def __len__(self) -> int:
        """Sequences of the shard."""
        return (len(self.batches) - 1) * ROWS + self.batches[-1].num_rows if self.batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        row = self.batches[i // ROWS].slice(i % ROWS, 1)
        return row.column("ids").flatten().to_numpy(), row.column("mask").flatten().to_numpy(zero_copy_only=False)

    def ids(self, first: int, count: int) -> Iterator[np.ndarray]:
        """The ids from place first on, a view for each batch that they lie in."""
        while count > 0:
            column = self.batches[first // (ROWS * length_of(self.batches[0]))].column("ids")
            at = first % (ROWS * length_of(self.batches[0]))
            part = column.flatten()[at : at + count].to_numpy()
            yield part
            first, count = first + len(part), count - len(part)

    def close(self) -> None:
        self.batches = []
        self.source.close()


def length_of(batch: pa.RecordBatch) -> int:
    return batch.schema.field("ids").type.list_size


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what the files hold.

    A shard's documents meet its file in one task, in order.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            sums, lengths = [], []
            for file, first, count in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if file != name:
                    if shard:
                        shard.close()
                    name, shard = file, Shard(f"{folder}/{file}")
                crc, seen = 0, 0
                for part in shard.ids(first, count):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    seen += len(part)
                sums.append(crc)
                lengths.append(seen)
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ordered = with_starts(index).repartition("shard").sortWithinPartitions("shard", "first")
    return ordered.select("doc_id", "start", "file", "first", "n_tokens").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write docs as token files and return what the files hold, a row per document."""
    folder = folder or shared_path(spark, "tokens")
    return read_back(write_shards(spark, docs, folder, tokenizer or tokenizer_path()), folder)
