"""Text of pages written here: structure, status and search."""

import zlib

import pytest
from test_pdf import build

from quiresmith.operators import pdf, pdf_text
from quiresmith.sources.pdf import parse_files


def file(content, more=b"", font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", filters=b""):
    body = b"<< %s /Length %d >>\nstream\n%s\nendstream" % (filters, len(content), content)
    return build([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 210 130] /Resources << /Font << /F1 4 0 R >> >> >>", b"<< /Type /Page /Contents 5 0 R >>", font, body, more or b"null"])


@pytest.fixture(scope="module")
def pages(spark):
    styled = b"BT /F1 21 Tf 10 80 Td (Grau ) Tj 1 0 0 rg /F1 9 Tf (M\xf6we) Tj ET"
    lines = b"q 1 0 0 1 5 5 cm BT /F1 10 Tf 12 TL 0 50 Td (one) Tj T* [(t) -2000 (wo) 10 (x)] TJ ET Q"
    cmap = b"<< /Length 70 >>\nstream\n" + b"1 beginbfrange <0001> <0003> <0061> endbfrange".ljust(70) + b"\nendstream"
    files = {
        "styled": file(styled), "lines": file(zlib.compress(lines), filters=b"/Filter /FlateDecode"),
        "wide": file(b"BT /F1 10 Tf <000100020009> Tj ET", cmap, b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"),
        "unknown": file(b"BT /F1 10 Tf (x) Tj zz ET"), "unbalanced": file(b"q BT ET"), "empty": file(b""), "nofont": file(b"BT /F9 1 Tf ET"),
    }
    corpus = parse_files(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"))
    return pdf_text.page_glyphs(corpus, pdf.pages(corpus))


def test_status(pages):
    assert {r.doc_id: r.text_status for r in pages.collect()} == {"styled": "OK", "lines": "OK", "wide": "OK", "unknown": "UNSUPPORTED", "unbalanced": "FORMAT", "empty": "OK", "nofont": "FORMAT"}


def test_structure(pages):
    chars = pdf_text.text_chars(pages)
    spans = sorted((r.span, r.text, r.size, r.argb) for r in pdf_text.text_spans(chars).where("doc_id = 'styled'").collect())
    assert spans == [(0, "Grau ", 21.0, 0xFF000000), (1, "Möwe", 9.0, 0xFFFF0000)]
    text = {r.doc_id: r.text for r in pdf_text.page_text(pdf_text.text_lines(chars)).collect()}
    assert text == {"styled": "Grau Möwe", "lines": "one\r\nt wox", "wide": "ab�"}


@pytest.mark.parametrize(("needle", "n"), [("au Mö", 1), ("a", 1), ("missing", 0)])
def test_search(pages, needle, n):
    lines = pdf_text.text_lines(pdf_text.text_chars(pages)).where("doc_id = 'styled'")
    assert pdf_text.search(lines, needle).count() == n


def test_forms_are_not_dropped(spark):
    form = b"<< /Type /XObject /Subtype %s /Length 30 >>\nstream\n" + b"BT /F1 10 Tf (in form) Tj ET".ljust(30) + b"\nendstream"
    body = b"<< /Length 6 >>\nstream\n/X1 Do\nendstream"
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    head = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 210 130] /Resources << /Font << /F1 4 0 R >> /XObject << /X1 6 0 R >> >> >>", b"<< /Type /Page /Contents 5 0 R >>", font, body]
    files = [(k.decode(), bytearray(build([*head, form % (b"/" + k)]))) for k in (b"Form", b"Image")]
    corpus = parse_files(spark.createDataFrame(files, "path string, content binary"))
    assert {r.doc_id: r.text_status for r in pdf_text.page_glyphs(corpus, pdf.pages(corpus)).collect()} == {"Form": "UNSUPPORTED", "Image": "OK"}
