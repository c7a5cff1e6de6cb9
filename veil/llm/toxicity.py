"""Toxicity by multiple-instance learning.

A text is a bag of sentences; its label says whether any is toxic.  A sentence scores
sigmoid(bias + sum of its words' weights), the text 1 - prod(1 - sentence score) (noisy
or).  Weights and bias are trained by gradient descent on that likelihood.  Candidate
words come from counts over all labelled texts: those whose share of toxic texts is
significantly above the rest, all of them, however many; the driver and each task hold 16
bytes a word.  The fit then uses at most FIT_ROWS labelled texts of FIT_BYTES, those with the
least hash of their id, which bounds what the driver collects; words that are no candidates have weight 0, so a text
is fitted by its candidate words and its sentences' number alone.  A candidate in none of
these texts has the weight at which a sentence of it alone scores its share of toxic texts.

Defined results: null and empty texts have one empty sentence; a text that is labelled
twice counts with its highest label; without labels of both kinds every text scores the
base rate; repeated rows get a row each; a row without an id has no label, is not held out
and is scored as any other; candidate words that are equally good all stay; other columns
are ignored; an empty table gives no rows; a very long text is handled alone, with memory in
proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit
from .common import cut, small
from .langid import held_out

#: Labelled texts that the fit takes at most, and their bytes on average of the draw.
FIT_ROWS, FIT_BYTES = 20_000, 256 << 20
#: Texts in which a candidate word stands at least, and its least z-score.
LEAST_TEXTS, LEAST_Z = 4, 4.0
#: Bytes of a broadcast label, with what a hash table adds.
LABEL_BYTES = 64
#: Sentences end with these bytes.
ENDS = np.ones(256, bool)
for _c in b".!?\n":
    ENDS[_c] = False


class Sentences:
    """Words of a batch with the sentence of each, and the sentences of each row."""

    def __init__(self, column: pa.Array):
        data, offsets = bytekit.text_bytes(column)
        starts, ends, self.rows = bytekit.runs(data, offsets, bytekit.NAME_WORD)
        self.word = bytekit.hashes(bytekit.LOWER[data], starts, ends)
        self.starts, self.ends, self.of_rows = bytekit.runs(data, offsets, ENDS)
        self.offsets = offsets
        # a word lies inside one run of bytes that end no sentence
        self.sentence = np.searchsorted(self.starts, starts, "right") - 1


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows that may be learned from."""
    y = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = cut(y)
    return docs.select("doc_id", "text").join(small(y, LABEL_BYTES), "doc_id")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, plain, toxic): texts of either label with the word, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches):
            s = Sentences(batch.column("text"))
            y = batch.column("toxic").to_numpy()
            owner = bytekit.row_of(s.rows)
            order = np.lexsort((s.word, owner))
            w, o = s.word[order], owner[order]
            first = np.ones(len(w), bool)
            first[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
            w, yes = w[first], y[o[first]] > 0
            words, at = np.unique(w, return_inverse=True)
            n = np.bincount(at, minlength=len(words))
            t = np.bincount(at[yes], minlength=len(words))
            yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n - t), pa.array(t)], ["word", "plain", "toxic"])

    d = rows.select("text", "toxic").mapInArrow(run, "word long, plain long, toxic long")
    return d.groupBy("word").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))


def candidates(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sorted hashes of all candidate words, their logits of the share of toxic texts, that share over all texts, and the share of texts for the fit."""
    n, t, size = rows.agg(F.count(F.lit(1)), F.sum((F.col("toxic") > 0).cast("long")), F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()
    if not n or not t or t == n:
        return np.zeros(0, np.uint64), np.zeros(0), (t or 0) / n if n else 0.0, 1.0
    rate = t / n
    both = F.col("plain") + F.col("toxic")
    z = (F.col("toxic") - both * rate) / F.sqrt(both * (rate * (1 - rate)))
    d = word_counts(rows).where((both >= LEAST_TEXTS) & (z >= LEAST_Z))
    # as Arrow columns, as rows would be hundreds of bytes a word
    found = d.select("word", F.log((F.col("toxic") + 0.5) / (F.col("plain") + 0.5)).alias("logit")).toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], found.column("logit").to_numpy()[order], rate, min(1.0, 0.95 * FIT_ROWS / n, 0.95 * FIT_BYTES / max(1, size))


def bags(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """(toxic, sentences, at, item): per text, its number of sentences and its candidate words by sentence."""

    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytekit.slices(batches):
            s = Sentences(batch.column("text"))
            at, item = known(s.word, shared.value)
            owner = bytekit.row_of(s.rows)[at]
            local = s.sentence[at] - s.of_rows[:-1][owner]
            size = np.bincount(owner, minlength=batch.num_rows)
            yield pa.record_batch(
                [batch.column("toxic").cast(pa.int32()), pa.array(np.diff(s.of_rows)), bytekit.list_array(pa.array(local.astype(np.int32)), size), bytekit.list_array(pa.array(item.astype(np.int32)), size)],
                ["toxic", "sentences", "at", "item"],
            )

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, sentences long, at array<int>, item array<int>")


def known(word: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of word that are in the sorted words, and their numbers there."""
    if not len(words) or not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    item = np.minimum(np.searchsorted(words, word), len(words) - 1)
    at = np.flatnonzero(words[item] == word)
    return at, item[at]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """words: sorted hashes; a sentence's logit is bias + the sum of its distinct words' weights."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float, rate: float):
        self.words, self.weights, self.bias, self.rate = words, weights, bias, rate


def fit(y: np.ndarray, of_text: np.ndarray, empty: np.ndarray, sentence: np.ndarray, item: np.ndarray, n_words: int, rate: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of the noisy-or likelihood, by Adam.

    of_text: the text of each sentence that holds a candidate; empty: sentences of each text
    that hold none; sentence, item: a row per candidate word of a sentence.
    """
    w, b = np.zeros(n_words), float(np.log(0.01))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    n = len(y)
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, w[item], minlength=len(of_text))
        # -log(1 - p) of each sentence; their sum s gives the text's score 1 - exp(-s)
        p, p0 = sigmoid(z), sigmoid(np.array([b]))[0]
        s = np.bincount(of_text, np.logaddexp(0, z), minlength=n) + empty * np.logaddexp(0, b)
        gone = np.exp(-s)
        slope = np.where(y > 0, -gone / np.maximum(1 - gone, 1e-9), 1.0) / n
        each = slope[of_text] * p
        grad = np.append(np.bincount(item, each[sentence], minlength=n_words) + 1e-4 * w / max(1, n_words), each.sum() + (slope * empty).sum() * p0)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels)
    words, logits, rate, share = candidates(rows)
    if not len(words):
        return Model(words, np.zeros(0), -30.0, rate)
    # the hash is uniform, so a threshold leaves FIT_ROWS texts at most (19,000 are expected of 20,000)
    scale = 1 << 40
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(share * scale))
    t = bags(some, words).toArrow()
    y = t.column("toxic").to_numpy()
    at, item = t.column("at").combine_chunks(), t.column("item").combine_chunks()
    size = np.fromiter((len(x) for x in at), np.int64, len(y))
    text = np.repeat(np.arange(len(y)), size)
    local, item = at.flatten().to_numpy(), item.flatten().to_numpy()
    pair = np.unique(np.stack([text, local, item], 1), axis=0) if len(item) else np.zeros((0, 3), np.int64)
    cuts = np.ones(len(pair), bool)
    cuts[1:] = (pair[1:, :2] != pair[:-1, :2]).any(1)
    sentence = np.cumsum(cuts) - 1
    of_text = pair[cuts, 0]
    empty = t.column("sentences").to_numpy() - np.bincount(of_text, minlength=len(y))
    weights, bias = fit(y, of_text, np.maximum(empty, 0), sentence, pair[:, 2], len(words), rate)
    unseen = np.bincount(pair[:, 2], minlength=len(words)) == 0
    weights[unseen] = logits[unseen] - bias
    return Model(words, weights, bias, rate)


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs (doc_id, text) to (doc_id, score), with the offending sentences if asked for.

    Sentences are spans of the text's UTF-8 bytes with the score of each of 0.5 or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in bytekit.slices(batches):
            k = batch.num_rows
            s = Sentences(batch.column("text"))
            cols = [batch.column("doc_id")]
            found: list[list[dict]] = [[] for _ in range(k)]
            if len(m.words):
                at, item = known(s.word, m.words)
                pair = np.unique(s.sentence[at].astype(np.int64) * len(m.words) + item)
                z = m.bias + np.bincount(pair // len(m.words), m.weights[pair % len(m.words)], minlength=len(s.starts))
                owner = bytekit.row_of(s.of_rows)
                total = np.bincount(owner, np.logaddexp(0, z), minlength=k).astype(float)
                total[np.diff(s.of_rows) == 0] = np.logaddexp(0, m.bias)
                p = 1 - np.exp(-total)
                for i in np.flatnonzero(z >= 0) if spans else []:
                    row, from_ = owner[i], s.offsets[owner[i]]
                    found[row].append({"start": int(s.starts[i] - from_), "end": int(s.ends[i] - from_), "score": float(sigmoid(z[i : i + 1])[0])})
            else:
                p = np.full(k, m.rate)
            cols.append(pa.array(p))
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
            yield pa.record_batch(cols, ["doc_id", "score", "sentences"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double" + ", sentences array<struct<start: long, end: long, score: double>>" * spans)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences): the last are the offending ones."""
    d = score(docs, learn(docs, labels), spans=True)
    out = F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False))
    return d.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
