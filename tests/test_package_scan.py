"""Packages that are only read give what their trees give."""

import pytest

from veil.sources import docx

ODD = [
    "<w:p><w:r><w:t>a<x/>b</w:t><w:tab/><w:pict><w:p><w:r><w:t>in</w:t></w:r></w:p></w:pict><w:t>c</w:t></w:r></w:p>",
    "<w:r><w:t>lost</w:t></w:r><w:p>x<w:r>y<w:t><![CDATA[<&]]>z&amp;</w:t><!-- c --><w:br/><w:cr/><w:noBreakHyphen/><w:r><w:t>n</w:t></w:r></w:r></w:p>",
    "<w:tbl><w:tr><w:tc><w:p/><w:tbl/></w:tc></w:tr></w:tbl><w:tbl/><w:body><w:tbl/></w:body>",
    "<w:p><w:r><w:instrText>A<!--c-->B</w:instrText><t>no</t></w:r><w:instrText>C<w:t>d</w:t></w:instrText><w:hyperlink><w:r><w:t>h</w:t></w:r></w:hyperlink></w:p><w:p></w:p>",
]


def package(body):
    return docx.Package(["word/document.xml"], {"word/document.xml": f'<w:document xmlns:w="{docx.W}"><w:body>{body}</w:body></w:document>'.encode()}).save()


def test_scan_gives_what_the_tree_gives():
    built = [docx.build(["one two", "", "three\té"], "Head", "PAGE", "Bob", ("mailto:a@x.org",), run_length=3)]
    for content in [package(x) for x in ODD] + built:
        p = docx.Package.open(content)
        text, spans, tables, q = docx.scanned(content)
        assert (text, spans, tables, q.names, q.members) == (*docx.flat(p.blocks()), p.tables(), p.names, p.members)
    for read in (docx.scanned, lambda c: docx.Package.open(c, docx.well_formed)):
        with pytest.raises(docx.PackageError, match="ExpatError"):
            read(package("<w:p>"))
