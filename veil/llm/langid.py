"""Language identification by script ranges and Viterbi over per-word scores.

Learning counts, over all labelled texts, the byte trigrams of lower-cased words per
language (into BUCKETS hashed buckets) and the scripts of words per language.  A word's
score for a language is the log-likelihood of its trigrams; languages that do not use the
word's script are out.  Viterbi over the words of a text, with a penalty for each switch,
labels spans of mixed-language texts; the text's language is the one with most letters'
words on the best path, and the score is its share of them.

The model is BUCKETS counts a language, collected on the driver and sent to every task; the
words of a text are handled at once, a score for each language.  Texts of more than two
blocks are cut into blocks, so no step runs once a word.

Defined results: a text that is null or has no letter is "und" with score 0; with nothing
to learn from every text is; equal shares go to the language that is first by code point;
repeated rows count each and get a row each; rows without an id are judged as any other and
are not held out; rows without lang or text teach nothing; other columns are ignored; an
empty table gives no rows; a very long text is handled alone, with memory in proportion to
its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit

BUCKETS = 1 << 15
#: Cost of a change of language between neighbouring words, in nats.
SWITCH = 12.0
#: Words of a block that a very long text is cut into, and the languages up to which that pays.
BLOCK, FEW = 4096, 32
#: A language is a candidate for a script if at least this share of its words use it.
SCRIPT_SHARE = 0.01
OUT = -40.0
UND = "und"

# Scripts by the lead bytes of UTF-8, first and last.
SCRIPTS = [
    ("Latin", 0xC3, 0xCA),
    ("Greek", 0xCE, 0xCF),
    ("Cyrillic", 0xD0, 0xD3),
    ("Armenian", 0xD4, 0xD5),
    ("Hebrew", 0xD6, 0xD7),
    ("Arabic", 0xD8, 0xDB),
    ("Indic", 0xE0, 0xE0),
    ("Southeast", 0xE1, 0xE1),
    ("Kana", 0xE3, 0xE3),
    ("Han", 0xE4, 0xE9),
    ("Hangul", 0xEA, 0xED),
]
N_SCRIPTS = len(SCRIPTS)
#: Rank of a byte's script plus one; a word's script is the highest of its bytes, Latin for ASCII letters.
SCRIPT_OF = np.zeros(256, np.uint8)
for _i, (_name, _a, _b) in enumerate(SCRIPTS):
    SCRIPT_OF[_a : _b + 1] = _i + 1
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    SCRIPT_OF[_c] = 1


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part


class Words:
    """Words of a batch: offsets of rows, scripts (0: no letter), and their bytes' buckets."""

    def __init__(self, column: pa.Array):
        data, offsets = bytekit.text_bytes(column)
        self.starts, self.ends, self.rows = bytekit.runs(data, offsets, bytekit.NAME_WORD)
        clean = np.where(bytekit.NAME_WORD[data], bytekit.LOWER[data], np.uint8(0x20)).astype(np.uint32)
        before, after = np.full(len(data), 0x20, np.uint32), np.full(len(data), 0x20, np.uint32)
        before[1:], after[:-1] = clean[:-1], clean[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        before[inner] = 0x20
        after[inner - 1] = 0x20
        h = (before * np.uint32(0x9E3779B1) ^ clean * np.uint32(0x85EBCA77)) + after * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        self.buckets = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)
        script = SCRIPT_OF[data]
        # Latin and Greek letters with marks share a lead byte with scripts of the southeast
        wide = np.flatnonzero(data[:-1] == 0xE1)
        second = data[wide + 1]
        script[wide[(second >= 0xB8) & (second <= 0xBB)]] = 1
        script[wide[second >= 0xBC]] = 2
        self.scripts = np.maximum.reduceat(script, self.starts) if len(self.starts) else np.zeros(0, np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


LETTERS = bytekit._table((0x41, 0x5A), (0x61, 0x7A))


def with_letters(column: pa.Array) -> np.ndarray:
    """has_letter() of each row; only rows without an ASCII letter are decoded."""
    data, offsets = bytekit.text_bytes(column)
    some = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]) > 0
    out = some(LETTERS[data])
    for i in np.flatnonzero(~out & some(data >= 0x80)):
        out[i] = has_letter(column[int(i)].as_py())
    return out


def counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, slot, n): trigram counts (kind 0) and words by script (kind 1) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in bytekit.slices(batches):
            w = Words(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            size = (w.ends - w.starts)[...]
            owner = bytekit.row_of(w.rows)
            for lang in sorted(set(langs)):
                mine = np.fromiter((x == lang for x in langs), bool, len(langs))[owner] & (w.scripts > 0)
                tri, scr = sums.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(N_SCRIPTS + 1, np.int64)))
                tri += np.bincount(w.buckets[bytekit.ranges(w.starts[mine], size[mine])], minlength=BUCKETS)
                scr += np.bincount(w.scripts[mine], minlength=N_SCRIPTS + 1)
        for lang, both in sums.items():
            for kind, x in enumerate(both):
                at = np.flatnonzero(x)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "kind", "slot", "n"])

    d = docs.where("text is not null and lang is not null").select("text", "lang")
    return d.mapInArrow(run, "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], trigrams: np.ndarray, scripts: np.ndarray):
        """trigrams: (BUCKETS, L) counts; scripts: (N_SCRIPTS + 1, L) words."""
        self.langs = langs
        p = (trigrams + 0.5) / (trigrams.sum(0) + 0.5 * BUCKETS)
        score = np.log(p)
        self.scores = (score - score.mean(1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        out = np.where(share >= SCRIPT_SHARE, 0.0, OUT)
        out[(share < SCRIPT_SHARE).all(1)] = 0.0
        self.out = out.astype(np.float32)

    def emissions(self, w: Words) -> np.ndarray:
        """(words, L) scores; words without a letter say nothing."""
        out = np.zeros((len(w.starts), len(self.langs)), np.float32)
        step = max(1, (1 << 22) // max(1, len(self.langs)))
        at = 0
        while at < len(w.starts):
            to = max(at + 1, int(np.searchsorted(w.ends, w.starts[at] + step, "right")))
            size = w.ends[at:to] - w.starts[at:to]
            each = self.scores[w.buckets[bytekit.ranges(w.starts[at:to], size)]]
            out[at:to] = np.add.reduceat(each, np.cumsum(size) - size, axis=0)
            at = to
        out += self.out[w.scripts]
        out[w.scripts == 0] = 0
        return out


def sweep(emit: np.ndarray, first: np.ndarray, n: np.ndarray, switch: float, enter: np.ndarray | None = None, back: tuple | None = None) -> np.ndarray:
    """(runs, L) best scores of a path over each run of n words that ends in a language; all runs at once.

    enter: the language of the word before a run, -1 for none.  back: arrays (stay, best) that
    get, for each word, which languages stay and which is best before it.
    """
    order = np.argsort(-n, kind="stable")
    starts, longest, every = first[order], int(n.max(initial=0)), np.arange(emit.shape[1])
    active = np.searchsorted(-n[order], -np.arange(longest), "left")
    v, base = np.zeros((len(n), emit.shape[1]), np.float32), np.zeros(len(n))
    if enter is not None:
        e = enter[order][:, None]
        v = np.where((e < 0) | (every == e), 0, -switch).astype(np.float32)
    for t in range(longest):
        m = active[t]
        at = starts[:m] + t
        if t:
            top = v[:m].argmax(1)
            most = v[np.arange(m), top][:, None] - switch
            kept = v[:m] >= most
            if back:
                back[0][at], back[1][at] = kept, top
            v[:m] = np.where(kept, v[:m], most) - most
            base[:m] += most[:, 0]
        v[:m] += emit[at]
    out = np.empty((len(n), emit.shape[1]))
    out[order] = v + base[:, None]
    return out


def decoded(emit: np.ndarray, first: np.ndarray, n: np.ndarray, switch: float, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The best path's label of each word of the runs; leave: the last word's language, -1 for the best."""
    back = (np.zeros(emit.shape, bool), np.zeros(len(emit), np.int16))
    v = sweep(emit, first, n, switch, enter, back)
    state = np.where(leave >= 0, leave, v.argmax(1))
    path = np.zeros(len(emit), np.int16)
    order = np.argsort(-n, kind="stable")
    starts, state, longest = first[order], state[order].astype(np.int64), int(n.max(initial=0))
    active = np.searchsorted(-n[order], -np.arange(longest), "left")
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = np.where(back[0][at, state[:m]], state[:m], back[1][at])
    return path


def viterbi(emit: np.ndarray, rows: np.ndarray, switch: float, block: int = BLOCK) -> np.ndarray:
    """The best path's label of each word, all rows at once.

    A very long row is cut into blocks.  What each block adds between any two languages is
    found for all blocks at once; these sums, block by block, give the languages at the cuts.
    """
    n, first = np.diff(rows), rows[:-1]
    few = emit.shape[1]
    long = np.flatnonzero(n > 2 * block) if few <= FEW else np.zeros(0, np.int64)
    short = np.setdiff1d(np.flatnonzero(n > 0), long)
    starts, sizes, enter, leave = [first[short]], [n[short]], [np.full(len(short), -1)], [np.full(len(short), -1)]
    for row in long:
        at = np.arange(0, n[row], block)
        size = np.minimum(block, n[row] - at)
        at = at + first[row]
        through = sweep(emit, np.repeat(at[1:], few), np.repeat(size[1:], few), switch, np.tile(np.arange(few), len(at) - 1)).reshape(-1, few, few)
        score = sweep(emit, at[:1], size[:1], switch)[0]
        came = np.zeros((len(at), few), np.int64)
        for i, t in enumerate(through, 1):
            both = score[:, None] + t
            came[i] = both.argmax(0)
            score = both.max(0)
            score -= score.max()
        into, out = np.full(len(at), -1), np.empty(len(at), np.int64)
        out[-1] = score.argmax()
        for i in range(len(at) - 1, 0, -1):
            into[i] = out[i - 1] = came[i][out[i]]
        for held, x in ((starts, at), (sizes, size), (enter, into), (leave, out)):
            held.append(x)
    if not len(emit):
        return np.zeros(0, np.int16)
    return decoded(emit, np.concatenate(starts), np.concatenate(sizes), switch, np.concatenate(enter), np.concatenate(leave))


def labelled(batch: pa.RecordBatch, model: Model | None, switch: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language and score of each row; the path of all words, and the rows' offsets in it."""
    k = batch.num_rows
    lang, score = [UND] * k, np.zeros(k)
    if model is None:
        return lang, score, np.zeros(0, np.int16), np.zeros(k + 1, np.int64)
    texts = batch.column("text")
    w = Words(texts)
    path = viterbi(model.emissions(w), w.rows, switch)
    letters = w.scripts > 0
    owner = bytekit.row_of(w.rows)
    votes = np.bincount(owner[letters] * len(model.langs) + path[letters], minlength=k * len(model.langs)).reshape(k, -1)
    top, total = votes.argmax(1), votes.sum(1)
    # bytes tell scripts, characters tell letters; a letter of no listed script leaves the first language at score 0
    for i in np.flatnonzero(with_letters(texts)).tolist():
        lang[i] = model.langs[top[i]]
        score[i] = votes[i, top[i]] / max(1, total[i])
    return lang, score, path, w.rows


def slice_size(model: Model | None) -> int:
    """Bytes of text handled at once: a word has a score for each language."""
    return max(1 << 14, bytekit.SLICE * 8 // max(8, len(model.langs) if model else 0))


def identify(docs: DataFrame, model: Model | None, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """docs (doc_id, text) to (doc_id, lang_pred, score), and spans of words by language if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches, size=slice_size(shared.value)):
            lang, score, path, rows = labelled(batch, shared.value, switch)
            cols = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)]
            if spans:
                found = [span_list(path[a:b], shared.value.langs if shared.value else []) for a, b in zip(rows[:-1], rows[1:], strict=True)]
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.record_batch(cols, ["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans)


def span_list(path: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(path):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
    return [{"start": int(a), "end": int(b), "lang": langs[path[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def learn(docs: DataFrame) -> Model | None:
    """A model of labelled docs (text, lang): counts over all of them, collected by language and bucket."""
    table = counts(docs)
    rows = table.toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    which = np.array([number[x] for x in rows.column("lang").to_pylist()])
    kind, slot, n = (rows.column(c).to_numpy() for c in ("kind", "slot", "n"))
    tri, scr = np.zeros((BUCKETS, len(langs))), np.zeros((N_SCRIPTS + 1, len(langs)))
    tri[slot[kind == 0], which[kind == 0]] = n[kind == 0]
    scr[slot[kind == 1], which[kind == 1]] = n[kind == 1]
    return Model(langs, tri, scr)


def language_of(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from rows that are not held out, predicts all."""
    out = F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))
    model = learn(docs.where(~out))
    return identify(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, least: float, switch: float = SWITCH) -> DataFrame:
    """Rows of docs, all columns, whose language is known with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches, size=slice_size(shared.value)):
            yield batch.filter(pa.array([x >= least for x in labelled(batch, shared.value, switch)[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
