"""Word packages as a source and a sink, with the standard library alone.

A package is one row: (key, content).  Everything that needs its XML runs in Arrow batches
of whole packages, row by row, without a shuffle; what comes out are plain columns: the flat
text with its blocks for the engine, or the parts for leak checks.  Blocks are paragraphs of
the main part, then of headers and footers by name, wherever they stand in a part, each
field code after all of them.  Offsets count one separator between blocks.

The sink splices replacements into the runs that hold them, so formatting around them stays,
blanks the fields that name people, and rewrites mail and web targets of links.  Members of
a package that do not change keep their bytes.

A package that cannot be read has a null text and its error as a column; nothing fails until
someone asks for it (see unreadable()).
"""

from __future__ import annotations

import contextlib
import gc
import io
import os
import re
import zipfile
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from xml.dom import minidom
from xml.parsers import expat
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
APP = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
STORY = re.compile(r"word/(?:header|footer)\d+\.xml")
#: What XML 1.0 cannot hold, and what its readers change.
UNWRITABLE = re.compile("[^\t\n\x20-퟿-�\U00010000-\U0010ffff]")


class PackageError(ValueError):
    """A package that cannot be read or written; the message names no content."""


# Runs


def run_text(run: minidom.Element) -> str:
    out = []
    for c in run.childNodes:
        if c.namespaceURI != W:
            continue
        if c.localName == "t":
            out.append("".join(x.data for x in c.childNodes if x.nodeType in (x.TEXT_NODE, x.CDATA_SECTION_NODE)))
        elif c.localName == "tab":
            out.append("\t")
        elif c.localName in ("br", "cr"):
            out.append("\n")
        elif c.localName == "noBreakHyphen":
            out.append("-")
    return "".join(out)


def set_run_text(run: minidom.Element, text: str) -> None:
    """Replace what run_text() reads; properties and drawings stay."""
    doc = run.ownerDocument
    prefix = f"{run.prefix}:" if run.prefix else ""
    for c in list(run.childNodes):
        if c.namespaceURI == W and c.localName in ("t", "tab", "br", "cr", "noBreakHyphen"):
            run.removeChild(c)
    for piece in re.findall(r"[^\t\n]+|[\t\n]", UNWRITABLE.sub("", text)):
        if piece in "\t\n":
            run.appendChild(doc.createElementNS(W, prefix + ("tab" if piece == "\t" else "br")))
        else:
            t = doc.createElementNS(W, prefix + "t")
            t.setAttribute("xml:space", "preserve")
            t.appendChild(doc.createTextNode(piece))
            run.appendChild(t)


def spliced(texts: list[str], edits: list[tuple[int, int, str]]) -> list[str]:
    """Texts of runs with spans (start, end, new) of their concatenation replaced, all at once.

    The first run that a span touches takes the replacement, those inside become empty, the
    last keeps what follows.  Going from the last span to the first, places before a span
    stay where they were.
    """
    starts = [0, *accumulate(map(len, texts))]
    out = list(texts)
    for start, end, new in sorted(edits, reverse=True):
        if not 0 <= start < end <= starts[-1]:
            raise PackageError(f"span {start}:{end} is outside its paragraph")
        first = bisect_right(starts, start) - 1
        run = first
        while starts[run] < end:
            a, b = max(start - starts[run], 0), min(end, starts[run + 1]) - starts[run]
            if a < b:
                out[run] = out[run][:a] + (new if run == first else "") + out[run][b:]
            run += 1
    return out


@dataclass
class Block:
    """A paragraph with its runs, or a field code with itself."""

    kind: str
    part: str
    runs: list[minidom.Element]

    @property
    def texts(self) -> list[str]:
        if self.kind == "instr":
            return ["".join(x.data for x in self.runs[0].childNodes if x.nodeType in (x.TEXT_NODE, x.CDATA_SECTION_NODE))]
        return [run_text(r) for r in self.runs]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        before = self.texts
        texts = spliced(before, edits)
        if self.kind == "instr":
            node = self.runs[0]
            while node.firstChild:
                node.removeChild(node.firstChild)
            node.appendChild(node.ownerDocument.createTextNode(UNWRITABLE.sub("", texts[0])))
            return
        for run, old, now in zip(self.runs, before, texts, strict=True):
            if old != now:
                set_run_text(run, now)


# Packages


@dataclass
class Package:
    """An opened package: its members, and the parsed story parts in order."""

    names: list[str]
    members: dict[str, bytes]
    stories: dict[str, minidom.Document | Story] = field(default_factory=dict)

    @classmethod
    def open(cls, content: bytes, parse: Callable[[bytes], minidom.Document | Story] = minidom.parseString) -> Package:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = list(dict.fromkeys(z.namelist()))
                p = cls(names, {n: z.read(n) for n in names})
            main = p.main()
            for name in [main, *sorted(n for n in names if STORY.fullmatch(n) and n != main)]:
                p.stories[name] = parse(p.members[name])
            return p
        except (zipfile.BadZipFile, KeyError, ExpatError, ValueError, EOFError, NotImplementedError) as e:
            raise PackageError(f"not a readable package: {type(e).__name__}") from e

    def main(self) -> str:
        if rels := self.members.get("_rels/.rels"):
            for r in minidom.parseString(rels).getElementsByTagNameNS(RELS, "Relationship"):
                if r.getAttribute("Type") == MAIN:
                    return r.getAttribute("Target").lstrip("/")
        return "word/document.xml"

    def blocks(self) -> list[Block]:
        paragraphs, fields = [], []
        for part, doc in self.stories.items():
            for p in doc.getElementsByTagNameNS(W, "p"):
                paragraphs.append(Block("paragraph", part, [r for r in p.getElementsByTagNameNS(W, "r") if owner(r) is p]))
            fields += [Block("instr", part, [n]) for n in doc.getElementsByTagNameNS(W, "instrText")]
        return [*paragraphs, *fields]

    def tables(self) -> int:
        """Tables that stand in the main part's body itself."""
        main = next(iter(self.stories.values()))
        body = main.getElementsByTagNameNS(W, "body")
        return sum(c.namespaceURI == W and c.localName == "tbl" for c in body[0].childNodes) if body else 0

    def parts(self) -> list[tuple[str, str]]:
        return [(n, self.members[n].decode("utf-8", "ignore")) for n in self.names]

    def blank_people(self) -> None:
        """Empty author and last editor, and company and manager, which are made where they lack."""
        if core := self.members.get("docProps/core.xml"):
            doc = minidom.parseString(core)
            for tag in ("creator", "lastModifiedBy"):
                for e in [x for x in doc.getElementsByTagName("*") if x.localName == tag]:
                    while e.firstChild:
                        e.removeChild(e.firstChild)
            self.members["docProps/core.xml"] = doc.toxml("utf-8")
        if app := self.members.get("docProps/app.xml"):
            try:
                doc = minidom.parseString(app)
            except ExpatError:
                return  # no reader finds a name in it either
            root = doc.documentElement
            for tag in ("Company", "Manager"):
                found = doc.getElementsByTagNameNS(APP, tag)
                if not found:
                    root.appendChild(doc.createElementNS(APP, f"{root.prefix}:{tag}" if root.prefix else tag))
                for e in found:
                    while e.firstChild:
                        e.removeChild(e.firstChild)
            self.members["docProps/app.xml"] = doc.toxml("utf-8")

    def rewrite_targets(self, pairs: list[tuple[str, str]]) -> None:
        """Mail and web targets of external links with each original replaced, the longest first."""
        pairs = sorted(((a, b) for a, b in pairs if a and b and a != b), key=lambda x: -len(x[0]))
        for name in [n for n in self.names if n.endswith(".rels")]:
            try:
                doc = minidom.parseString(self.members[name])
            except ExpatError:
                continue
            changed = False
            for r in doc.getElementsByTagNameNS(RELS, "Relationship"):
                old = new = r.getAttribute("Target")
                if r.getAttribute("TargetMode") != "External" or not re.match(r"(?i)mailto:|https?://", old):
                    continue
                for a, b in pairs:
                    new = new.replace(a, b)
                if new != old:
                    r.setAttribute("Target", new)
                    changed = True
            if changed:
                self.members[name] = doc.toxml("utf-8")

    def save(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in self.names:
                z.writestr(zipfile.ZipInfo(n), self.members[n], zipfile.ZIP_DEFLATED)
        return out.getvalue()


def owner(node: minidom.Node) -> minidom.Node | None:
    """The nearest paragraph around a node; a text box in a run has paragraphs of its own."""
    node = node.parentNode
    while node is not None and not (node.namespaceURI == W and node.localName == "p"):
        node = node.parentNode
    return node


def flat(blocks: list[Block]) -> tuple[str, list[dict]]:
    """The blocks' texts joined by line ends, and where each stands."""
    texts, at, spans = [b.text for b in blocks], 0, []
    for b, t in zip(blocks, texts, strict=True):
        spans.append({"start": at, "end": at + len(t), "kind": b.kind, "part": b.part})
        at += len(t) + 1
    return "\n".join(texts), spans


def rewritten(content: bytes, edits: list[dict]) -> bytes:
    """A package with edits (start, end, text, replacement; offsets in its flat text) applied."""
    p = Package.open(content)
    blocks = p.blocks()
    text, spans = flat(blocks)
    edits = sorted(edits, key=lambda e: e["start"])
    for a, b in zip(edits, edits[1:], strict=False):
        if b["start"] < a["end"]:
            raise PackageError(f"overlapping spans at {a['start']}:{a['end']} and {b['start']}:{b['end']}")
    by_block: dict[int, list[tuple[int, int, str]]] = {}
    begins = [x["start"] for x in spans]
    for e in edits:
        if e["replacement"] is None or text[e["start"] : e["end"]] != e["text"]:
            raise PackageError(f"span {e['start']}:{e['end']} has no replacement or another text")
        n = bisect_right(begins, e["start"]) - 1
        if n < 0 or e["end"] > spans[n]["end"]:
            raise PackageError(f"span {e['start']}:{e['end']} is not inside one block")
        by_block.setdefault(n, []).append((e["start"] - begins[n], e["end"] - begins[n], e["replacement"]))
    for n, found in by_block.items():
        blocks[n].replace(found)
    for part in {blocks[n].part for n in by_block}:
        p.members[part] = p.stories[part].toxml("utf-8")
    p.blank_people()
    p.rewrite_targets([(e["text"], e["replacement"]) for e in edits])
    return p.save()


# Packages from texts

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _xml(text: str) -> str:
    return UNWRITABLE.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _runs(text: str, run_length: int | None) -> str:
    step = run_length or max(1, len(text))
    cuts = [text[i : i + step] for i in range(0, len(text), step)]
    return "".join(f'<w:r><w:t xml:space="preserve">{_xml(c)}</w:t></w:r>' for c in cuts)


def build(lines: list[str], header: str = "", field_code: str = "", author: str = "", links: tuple[str, ...] = (), run_length: int | None = None) -> bytes:
    """A package of paragraphs, one a line, cut into runs of some length."""
    lines = [UNWRITABLE.sub("", x).replace("\t", " ") for x in lines]
    body = "".join(f"<w:p>{_runs(x, run_length)}</w:p>" for x in lines)
    if field_code:
        body += f'<w:p><w:r><w:instrText xml:space="preserve">{_xml(field_code)}</w:instrText></w:r></w:p>'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = "".join(f'<Relationship Id="rId{i + 10}" Type="{kind}/hyperlink" Target="{_xml(x)}" TargetMode="External"/>' for i, x in enumerate(links))
    members = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{MAIN}" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>',
        "word/_rels/document.xml.rels": f'{_HEAD}<Relationships xmlns="{RELS}">{rels}</Relationships>',
        "docProps/core.xml": f'{_HEAD}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{_xml(author)}</dc:creator><cp:lastModifiedBy>{_xml(author)}</cp:lastModifiedBy></cp:coreProperties>',
        "docProps/app.xml": f'{_HEAD}<Properties xmlns="{APP}"><Company>{_xml(author)}</Company></Properties>',
    }
    if header:
        members["word/header1.xml"] = f'{_HEAD}<w:hdr xmlns:w="{W}"><w:p>{_runs(UNWRITABLE.sub("", header), run_length)}</w:p></w:hdr>'
    return Package(list(members), {k: v.encode() for k, v in members.items()}).save()


# Packages that are only read


class Story:
    """The texts of a story part in one pass, without a tree: those of Package.blocks(), and of tables().

    Each text is a list of pieces; a run's pieces are strings or the lists of its direct children's own texts.
    """

    MARKS = {f"{W} tab": "\t", f"{W} br": "\n", f"{W} cr": "\n", f"{W} noBreakHyphen": "-"}

    def __init__(self, data: bytes):
        self.paragraphs: list[list[list]] = []
        self.fields: list[list[str]] = []
        self.tables = 0
        # of each open element: its name, its run or body if it is one, and where its own text goes
        stack: list[tuple[str, list | None, list[str] | None]] = [("", None, None)]
        around: list[list[list]] = []
        bodies = 0

        def start(name: str, _: dict) -> None:
            nonlocal bodies
            above, inside, _own = stack[-1]
            run = own = None
            if name == f"{W} r":
                run = []
                if around:
                    around[-1].append(run)
            elif name == f"{W} p":
                around.append([])
                self.paragraphs.append(around[-1])
            elif name == f"{W} instrText":
                own = []
                self.fields.append(own)
            elif name == f"{W} body":
                bodies += 1
                run = [] if bodies == 1 else None
            elif name == f"{W} tbl":
                self.tables += above == f"{W} body" and inside is not None
            elif above == f"{W} r" and name == f"{W} t":
                own = []
                inside.append(own)
            elif above == f"{W} r" and name in self.MARKS:
                inside.append(self.MARKS[name])
            stack.append((name, run, own))

        def end(name: str) -> None:
            stack.pop()
            if name == f"{W} p":
                around.pop()

        def text(data: str) -> None:
            if (own := stack[-1][2]) is not None:
                own.append(data)

        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
        parser.Parse(data, True)

    def texts(self) -> tuple[list[str], list[str]]:
        """The paragraphs and the field codes."""
        said = lambda run: "".join(x if isinstance(x, str) else "".join(x) for x in run)
        return ["".join(map(said, p)) for p in self.paragraphs], ["".join(f) for f in self.fields]


def well_formed(data: bytes) -> None:
    """Raise as a parser would."""
    expat.ParserCreate(namespace_separator=" ").Parse(data, True)


def scanned(content: bytes) -> tuple[str, list[dict], int, Package]:
    """What flat(), tables() and members of Package.open(content) would be, with no story parsed into a tree."""
    p = Package.open(content, Story)
    paragraphs, fields, tables = [], [], 0
    for n, (part, story) in enumerate(p.stories.items()):
        ps, fs = story.texts()
        paragraphs += [("paragraph", part, x) for x in ps]
        fields += [("instr", part, x) for x in fs]
        tables = tables if n else story.tables
    at, spans = 0, []
    for kind, part, x in (blocks := [*paragraphs, *fields]):
        spans.append({"start": at, "end": at + len(x), "kind": kind, "part": part})
        at += len(x) + 1
    return "\n".join(x for *_, x in blocks), spans, tables, p


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for garbage cycles meanwhile: trees are cycles that stay alive until they are written."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


# DataFrames of packages

BLOCKS = "array<struct<start:int,end:int,kind:string,part:string>>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all packages below a path, from any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def opened(packages: DataFrame, key: str = "doc_id") -> DataFrame:
    """packages (key, content, ...) with text, blocks, n_tables, n_parts and error."""
    names = packages.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in packages.schema)}, text string, blocks {BLOCKS}, n_tables int, n_parts int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"text": [], "blocks": [], "n_tables": [], "n_parts": [], "error": []}
            for content in batch.column("content"):
                try:
                    text, spans, tables, p = scanned(content.as_py() or b"")
                    row = (text, spans, tables, len(p.names), None)
                except PackageError as e:
                    row = (None, None, None, None, str(e))
                for c, v in zip(out.values(), row, strict=True):
                    c.append(v)
            kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("part", pa.string())])), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([*batch.columns, *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], [*names, *out])

    return packages.mapInArrow(run, schema)


def unreadable(packages: DataFrame) -> DataFrame:
    """Rows of opened() that could not be read."""
    return packages.where("error is not null")


def block_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, kind, part, start, end, text) of opened() packages."""
    d = docs.select(key, "text", F.posexplode("blocks").alias("block", "b"))
    return d.select(key, "block", "b.kind", "b.part", "b.start", "b.end", F.substring("text", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")).alias("text"))


def part_rows(packages: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, part_no, part_name, text) of every member of every readable package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    parts = Package.open(data.as_py() or b"", well_formed).parts()
                except PackageError:
                    continue
                yield pa.record_batch([pa.array([k.as_py()] * len(parts), batch.column(0).type), pa.array(range(len(parts)), pa.int32()), pa.array([n for n, _ in parts]), pa.array([t for _, t in parts])], [key, "part_no", "part_name", "text"])

    kind = packages.schema[key].dataType.simpleString()
    return packages.select(key, content).mapInArrow(run, f"`{key}` {kind}, part_no int, part_name string, text string")


def saved(docs: DataFrame, key: str = "doc_id", edits: str = "assigned") -> DataFrame:
    """docs (key, content, edits) to (key, content, error): packages with their edits applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, errors = [], []
            for content, found in zip(batch.column(1), batch.column(2), strict=True):
                try:
                    with uncollected():
                        new.append(rewritten(content.as_py() or b"", found.as_py() or []))
                    errors.append(None)
                except PackageError as e:
                    new.append(None)
                    errors.append(str(e))
            yield pa.record_batch([batch.column(0), pa.array(new, pa.binary()), pa.array(errors, pa.string())], [key, "content", "error"])

    kind = docs.schema[key].dataType.simpleString()
    few = F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), e["replacement"].alias("replacement")))
    return docs.select(key, "content", few.alias("edits")).mapInArrow(run, f"`{key}` {kind}, content binary, error string")


# The data source "docx": files by name, in a folder that all executors reach


def _store(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), os.path.abspath(path))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        import pyarrow.fs

        fs, path = _store(self.path)
        if fs.get_file_info(path).is_file:
            return [_File(path)]
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".docx")]

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = _store(self.path)
        with fs.open_input_stream(partition.path) as f:
            text, spans = flat(Package.open(f.read()).blocks())
        for n, s in enumerate(spans):
            yield partition.path, n, s["kind"], s["part"], s["start"], s["end"], text[s["start"] : s["end"]]


@dataclass
class _Written(WriterCommitMessage):
    pairs: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Rows (name, content) become files; each is written beside its name and moved at commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> _Written:
        from pyspark import TaskContext

        fs, folder = _store(self.path)
        fs.create_dir(folder, recursive=True)
        pairs = []
        for row in iterator:
            to = f"{folder}/{os.path.basename(row['name'])}"
            now = f"{to}.{TaskContext.get().taskAttemptId()}.part"
            with fs.open_output_stream(now) as f:
                f.write(bytes(row["content"]))
            pairs.append((now, to))
        return _Written(pairs)

    def commit(self, messages: list[_Written | None]) -> None:
        import pyarrow.fs

        fs, _ = _store(self.path)
        pairs = [p for m in messages if m for p in m.pairs]
        for now, to in pairs:
            if not self.overwrite and fs.get_file_info(to).type != pyarrow.fs.FileType.NotFound:
                self.abort(messages)
                raise PackageError(f"refusing to overwrite {to}")
        for now, to in pairs:
            fs.move(now, to)

    def abort(self, messages: list[_Written | None]) -> None:
        import pyarrow.fs

        fs, _ = _store(self.path)
        for now in [p[0] for m in messages if m for p in m.pairs]:
            if fs.get_file_info(now).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(now)


class DocxSource(DataSource):
    """spark.read.format("docx") gives blocks; write.format("docx") takes (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "path string, block int, kind string, part string, start int, end int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)
