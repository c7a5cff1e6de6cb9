"""The command line: what it writes, what it prints, and its exit codes."""

import json

import pytest

from veil import cli
from veil.operators import mapping
from veil.sources import docx


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "in.docx"
    path.write_bytes(docx.build(["Write to jane.roe@site.org or 10.1.2.3.", "Invoice No. 123-45-6789"]))
    return path


def text_of(path):
    return docx.flat(docx.Package.open(path.read_bytes()).blocks())[0]


def test_rewrites_and_counts(spark, source, tmp_path, capsys):
    out = tmp_path / "new" / "out.docx"
    assert cli.main([str(source), "-o", str(out), "--report", str(tmp_path / "report")], spark) == 0
    said = capsys.readouterr().out
    assert "  EMAIL: 1\n  IP_ADDRESS: 1\ntotal: 2\n" in said and "elapsed:" in said
    assert "jane" not in text_of(out) and "123-45-6789" in text_of(out)
    report = json.loads(next((tmp_path / "report").glob("*.txt")).read_text())
    assert report["counts_by_type"] == {"EMAIL": 1, "IP_ADDRESS": 1} and len(report["entities"]) == 2 and "jane.roe@site.org" in report["mapping"]


def test_dump_dry_run_and_types(spark, source, tmp_path, capsys):
    assert cli.main([str(source), "--dump-text"], spark) == 0
    assert capsys.readouterr().out == "Write to jane.roe@site.org or 10.1.2.3.\nInvoice No. 123-45-6789\n"
    assert cli.main([str(source), "--dry-run", "--types", "IP_ADDRESS"], spark) == 0
    assert "  IP_ADDRESS: 1\ntotal: 1\n" in capsys.readouterr().out
    assert cli.main([str(source), "--dry-run", "--types", "SSN", "--reference-numbers"], spark) == 0
    assert "  SSN: 1\n" in capsys.readouterr().out
    assert [x.name for x in tmp_path.iterdir()] == ["in.docx"]


@pytest.mark.parametrize("args", [["--types", "NONE", "--dry-run"], ["--types", " , ", "--dry-run"], [], ["-o", "{source}"]])
def test_bad_input(spark, source, capsys, args):
    assert cli.main([str(source), *[a.replace("{source}", str(source)) for a in args]], spark) == cli.BAD_INPUT
    assert capsys.readouterr().err


def test_missing_and_broken_packages(spark, tmp_path):
    assert cli.main([str(tmp_path / "none.docx"), "--dry-run"], spark) == cli.BAD_INPUT
    (tmp_path / "bad.docx").write_bytes(b"no")
    assert cli.main([str(tmp_path / "bad.docx"), "--dry-run"], spark) == cli.BAD_INPUT


def test_no_model(spark, source):
    assert cli.main([str(source), "--dry-run", "--ner-model", "none_such"], spark) == cli.NO_MODEL
    assert cli.main([str(source), "--dry-run", "--ner-model", "none_such", "--no-ner"], spark) == cli.OK


def test_a_leak_writes_nothing(spark, source, tmp_path, monkeypatch):
    keep = mapping.assign

    def same(docs, config, scope="doc_id", column="entities"):
        from pyspark.sql import functions as F

        return keep(docs, config, scope, column).withColumn("assigned", F.transform("assigned", lambda e: e.withField("replacement", e["text"])))

    monkeypatch.setattr(mapping, "assign", same)
    out = tmp_path / "out.docx"
    assert cli.main([str(source), "-o", str(out)], spark) == cli.LEAK and not out.exists()
    assert cli.main([str(source), "-o", str(out), "--no-verify"], spark) == cli.OK and out.exists()
