"""Word packages: reading, splicing, metadata, links, and the data source."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from veil.operators.rules import Config
from veil.plans.engine import Engine
from veil.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body, **parts):
    data = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **{k.replace("__", "/"): v for k, v in parts.items()}}
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in data.items():
            z.writestr(k, v)
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def text_of(content):
    return docx.flat(docx.Package.open(content).blocks())[0]


def test_paragraphs_stand_in_document_order_wherever_they_are():
    table = f"<w:tbl><w:tr><w:tc>{p('cell')}<w:tbl><w:tr><w:tc>{p('inner')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    box = f"<w:p><w:r><w:t>outer</w:t><w:txbxContent>{p('boxed')}</w:txbxContent></w:r></w:p>"
    content = package(p("one", "", " two") + table + box + "<w:p/>", **{"word/header2.xml": f"<w:hdr {W}>{p('second')}</w:hdr>", "word/header1.xml": f"<w:hdr {W}>{p('first')}</w:hdr>", "word/footer1.xml": f"<w:ftr {W}>{p('foot')}</w:ftr>"})
    assert text_of(content).split("\n") == ["one two", "cell", "inner", "outer", "boxed", "", "foot", "first", "second"]
    assert docx.Package.open(content).tables() == 1


def test_tabs_breaks_and_field_codes():
    content = package("<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>" + '<w:p><w:r><w:instrText>HYPERLINK "x"</w:instrText></w:r></w:p>' + p("last"))
    blocks = docx.Package.open(content).blocks()
    assert [(b.kind, b.text) for b in blocks] == [("paragraph", "a\tb\nc"), ("paragraph", ""), ("paragraph", "last"), ("instr", 'HYPERLINK "x"')]


def edit(text, value, new, at=0):
    s = text.index(value, at)
    return {"start": s, "end": s + len(value), "text": value, "replacement": new}


@pytest.mark.parametrize("runs", [("Mail jane@x.org now",), ("Mail ja", "ne@x", ".org now"), tuple("Mail jane@x.org now"), ("Mail ", "jane@x.org", " now")])
def test_a_splice_keeps_what_is_around_it(runs):
    content = package(p(*runs) + p("untouched"))
    new = docx.rewritten(content, [edit(text_of(content), "jane@x.org", "al@y.net")])
    assert text_of(new) == "Mail al@y.net now\nuntouched"
    old_runs, new_runs = (docx.Package.open(c).blocks()[0].runs for c in (content, new))
    assert len(new_runs) == len(old_runs) and all(r.getElementsByTagName("w:b") for r in new_runs)


def test_several_splices_of_one_paragraph_and_of_a_field_code():
    content = package(p("a@x.org and b", "@x.org") + '<w:p><w:r><w:instrText>to a@x.org</w:instrText></w:r></w:p>')
    t = text_of(content)
    new = docx.rewritten(content, [edit(t, "a@x.org", "<1>&"), edit(t, "b@x.org", "2"), edit(t, "a@x.org", "3", 20)])
    assert text_of(new) == "<1>& and 2\n\nto 3"


def test_bad_spans_raise():
    content = package(p("one") + p("two"))
    for bad in ([{"start": 1, "end": 5, "text": "ne\nt", "replacement": "x"}], [edit("one\ntwo", "one", None)], [{"start": 0, "end": 3, "text": "two", "replacement": "x"}], [edit("one", "one", "x"), edit("one", "ne", "y")]):
        with pytest.raises(docx.PackageError):
            docx.rewritten(content, bad)
    with pytest.raises(docx.PackageError):
        docx.Package.open(b"PK no")


def test_people_and_links():
    content = docx.build(["to jane@x.org"], author="Bob", links=("mailto:jane@x.org?subject=jane", "https://x.org/jane", "file:///jane@x.org"))
    new = docx.Package.open(docx.rewritten(content, [edit("to jane@x.org", "jane@x.org", "al@y.net")]))
    parts = dict(new.parts())
    assert "Bob" not in "".join(parts.values()) and "Manager" in parts["docProps/app.xml"]
    rels = parts["word/_rels/document.xml.rels"]
    assert "mailto:al@y.net?subject=jane" in rels and "https://x.org/jane" in rels and "file:///jane@x.org" in rels


def test_an_unreadable_app_part_is_left_and_names_stay_as_they_were():
    content = package(p("a@x.org"), **{"docProps/app.xml": "<no", "custom/item.bin": "\x00"})
    new = docx.Package.open(docx.rewritten(content, [edit("a@x.org", "a@x.org", "b")]))
    assert new.members["docProps/app.xml"] == b"<no" and new.names == docx.Package.open(content).names


def test_engine_and_source(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx.build(["Write to jane.roe@site.org", "jane.roe@site.org it is"], field_code='HYPERLINK "mailto:jane.roe@site.org"', links=("mailto:jane.roe@site.org",), run_length=4))
    (folder / "bad.docx").write_bytes(b"nothing")
    packages = docx.load(spark, f"file://{folder}").withColumn("doc_id", F.xxhash64("path"))
    before = (folder / "a.docx").read_bytes()
    engine = Engine(Config(as_of="2024-06-30"))
    done = engine.rewrite_packages(packages).collect()
    assert sorted(r["error"] is None for r in done) == [False, True] and (folder / "a.docx").read_bytes() == before
    good = next(r for r in done if not r["error"])
    assert b"jane" not in good["saved"] and "jane" not in text_of(bytes(good["saved"])) and len(good["assigned"]) == 3
    engine.verify(engine.rewrite_packages(packages.where("path like '%/a.docx'")))
    docx.register(spark)
    rows = spark.createDataFrame([("n.docx", bytearray(good["saved"]))], "name string, content binary")
    rows.write.format("docx").mode("append").save(str(out))
    assert [r["text"] for r in spark.read.format("docx").load(str(out)).orderBy("block").collect()] == text_of(bytes(good["saved"])).split("\n")
    with pytest.raises(Exception, match="refusing to overwrite"):
        rows.write.format("docx").mode("append").save(str(out))
    assert [x.name for x in out.iterdir()] == ["n.docx"]
