"""The seam to a named-entity model.

A model is a function from texts to labelled spans, one list of (start, end, label) for each
text.  It is loaded by name, once in each Python worker, and sees chunks of whole lines in
Arrow batches; chunks go to any task, so a long text is spread.  What it finds is a plain
table for candidates.judged().

Defined results: null and empty texts have no chunk; a line longer than a chunk is a chunk
of its own; labels that are not mapped are dropped by candidates; a model whose confidence
is below the threshold gives nothing; an unknown model, or one whose library is not there,
raises ModelUnavailable before any task starts.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import chunks, normalise_spaces

Model = Callable[[Sequence[str]], list[list[tuple[int, int, str]]]]
#: Characters of a chunk.
CHUNK = 80_000
#: Models that give no score of their own count as sure.
CONFIDENCE = 1.0


class ModelUnavailable(RuntimeError):
    """A model, or the library that it needs, is not installed."""


def _spacy(name: str) -> Model:
    import spacy

    pipe = spacy.load(name)
    return lambda texts: [[(e.start_char, e.end_char, e.label_) for e in d.ents] for d in pipe.pipe(texts)]


#: A name or a firm as plain spelling shows it, for TITLE_CASE; what ends in a colon is a label.
SPELLED = re.compile(r"\b[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3}\b(?!\s*:)")
FIRM = re.compile(r"\b(?:Ltd|Limited|LLP|Inc)$")
TITLE_CASE = "title-case"


def _title_case() -> Model:
    """A model of spelling alone: two to four capitalised words are a person, with a legal form a firm."""
    return lambda texts: [[(m.start(), m.end(), "ORG" if FIRM.search(m.group()) else "PERSON") for m in SPELLED.finditer(t)] for t in texts]


LOADERS: dict[str, Callable[[], Model]] = {TITLE_CASE: _title_case}
_loaded: dict[str, Model] = {}


def register_model(name: str, load: Callable[[], Model]) -> None:
    """Make a model known; load runs in the workers and must be importable there or picklable."""
    LOADERS[name] = load


def loader(name: str) -> Callable[[], Model]:
    """What loads a model; checked on the driver, run in the workers."""
    if name in LOADERS:
        return LOADERS[name]
    if not importlib.util.find_spec("spacy") or not importlib.util.find_spec(name):
        raise ModelUnavailable(f"model {name} or its library is not installed")
    return lambda: _spacy(name)


def loaded(name: str, load: Callable[[], Model]) -> Model:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def raw_spans(docs: DataFrame, model: str, key: str = "doc_id", most: int = CHUNK, threshold: float = 0.5, load: Callable[[], Model] | None = None) -> DataFrame:
    """(key, start, end, label) of a model over docs (key, text); offsets are those of the whole text."""
    load = load or loader(model)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start int, end int, label string"
    d = docs.where("text is not null").select(key, F.explode(chunks(normalise_spaces(F.col("text")), most)).alias("c")).select(key, "c.start", "c.text")
    if CONFIDENCE < threshold:
        return d.limit(0).selectExpr(f"`{key}`", "start", "start as end", "text as label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = loaded(model, load)
        for batch in batches:
            rows = [(k, base + a, base + b, label) for k, base, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), find(batch.column(2).to_pylist()), strict=True) for a, b, label in found]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], [key, "start", "end", "label"])

    return d.mapInArrow(run, schema)
