"""PDF text with and without the optional reader."""

import sys
import types

import pytest

from dossier.sources import files


class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        return self.text


def reader(pages, fails=False):
    class PdfReader:
        def __init__(self, stream):
            assert stream.read(4) == b"%PDF"
            if fails:
                raise ValueError("no trailer")
            self.pages = [Page(p) for p in pages]

    return types.SimpleNamespace(PdfReader=PdfReader)


def test_pages_are_joined_and_empty_ones_left_out(monkeypatch):
    monkeypatch.setitem(sys.modules, "pypdf", reader(["One.", "", None, "Two.\nThree."]))
    assert files.pdf_text(b"%PDF-1.7 ...") == "One.\n\nTwo.\nThree."
    monkeypatch.setitem(sys.modules, "pypdf", reader([]))
    assert files.pdf_text(b"%PDF-1.7 ...") == ""


def test_reader_errors_pass_on(monkeypatch):
    monkeypatch.setitem(sys.modules, "pypdf", reader([], fails=True))
    with pytest.raises(ValueError, match="no trailer"):
        files.pdf_text(b"%PDF-1.7 ...")


def test_without_the_reader_a_file_keeps_its_row_with_the_error(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(ModuleNotFoundError):
        files.pdf_text(b"%PDF-1.7 ...")
    rows = spark.createDataFrame(
        [("raw/r/a.pdf", bytearray(b"%PDF-1.7")), ("raw/r/b.txt", bytearray(b"plain \xff"))], "source_key string, content binary"
    )
    got = {r.source_key: r for r in files.read_text(rows).collect()}
    assert got["raw/r/a.pdf"].content is None and got["raw/r/a.pdf"].error
    assert got["raw/r/b.txt"].content == "plain �" and got["raw/r/b.txt"].error is None
    assert got["raw/r/a.pdf"].repo_prefix == "raw/r/"
