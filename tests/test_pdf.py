"""Documents written here, read as tables and questioned."""

import zlib

import pytest
from pyspark.sql import functions as F

from quiresmith.operators import pdf, pdf_checks, pdf_edit
from quiresmith.sources.pdf import parse_files
from quiresmith.sources.pdf_write import serialize


def build(objects, trailer=b"/Root 1 0 R"):
    """A file of numbered objects with a cross-reference table."""
    out, places = b"%PDF-1.7\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer, start)


def build_compressed(objects):
    """The same with an object stream and a cross-reference stream with a predictor."""
    bodies, heads = b"", b""
    for i, body in enumerate(objects, 1):
        heads += b"%d %d " % (i, len(bodies))
        bodies += body + b" "
    packed = zlib.compress(heads + bodies)
    n = len(objects)
    out = b"%PDF-1.5\n"
    place = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n + 1, n, len(heads), len(packed), packed)
    start = len(out)
    rows = [bytes([0, 0, 0, 0])] + [bytes([2]) + (n + 1).to_bytes(2, "big") + bytes([i]) for i in range(n)] + [bytes([1]) + place.to_bytes(2, "big") + b"\0", bytes([1]) + start.to_bytes(2, "big") + b"\0"]
    before, coded = bytes(4), b""
    for r in rows:
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before, strict=True))
        before = r
    table = zlib.compress(coded)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n + 2, n + 3, len(table), table)
    return out + b"startxref\n%d\n%%%%EOF\n" % start


OBJECTS = [
    b"<< /Type /Catalog /Pages 2 0 R /Outlines 8 0 R /AcroForm << /Fields [16 0 R] >> >>",
    b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 210 130] /Rotate 90 >>",
    b"<< /Type /Page /Parent 2 0 R /Annots [6 0 R 7 0 R 15 0 R] /CropBox [10 10 150 90] >>",
    b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 14 0 R] /Rotate 0 >>",
    b"<< /Type /Page /Parent 4 0 R /MediaBox [0 0 100 50] /UserUnit 2 >>",
    b"<< /Subtype /Link /Rect [20 20 40 30] /A << /S /URI /URI (http://a/) >> >>",
    b"<< /Subtype /Link /Rect [0 0 1 1] /Dest [5 0 R /XYZ 15 25 0] >>",
    b"<< /First 9 0 R >>",
    b"<< /Title (Opening) /Parent 8 0 R /Next 12 0 R /First 10 0 R /Count 2 >>",
    b"<< /Title <FEFF00E9> /Parent 9 0 R /Next 11 0 R >>",
    b"<< /Title (Journal) /Parent 9 0 R /A << /S /URI /URI (http://journal/) >> >>",
    b"<< /Title (Closing) /Parent 8 0 R >>",
    b"<< /Title (Entwurf f\\374r Mai) /Author () /CreationDate (D:2026) >>",
    b"<< /Type /Page /Parent 4 0 R >>",
    b"<< /Subtype /Text /Rect [50 50 60 60] /Contents (note) /F 4 >>",
    b"<< /T (a) /FT /Tx /V (top) /Kids [17 0 R 18 0 R] >>",
    b"<< /T (b) >>",
    b"<< /T (c) /V (own) /FT /Ch >>",
]


@pytest.fixture(scope="module")
def corpus(spark):
    trailer = b"/Root 1 0 R /Info 13 0 R"
    scripted = [b"<< /Type /Catalog /Pages 2 0 R /OpenAction << /S /JavaScript /JS (x) /Next << /S /Launch >> >> >>", b"<< /Type /Pages /Kids [] >>"]
    cyclic = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [2 0 R 3 0 R] /MediaBox [0 0 1 1] >>", b"<< /Type /Page >>"]
    files = {"plain": build(OBJECTS, trailer), "packed": build_compressed(OBJECTS), "script": build(scripted), "cycle": build(cyclic), "cut": build(OBJECTS)[:-60], "empty": b"", "none": None, "locked": build(OBJECTS, b"/Root 1 0 R /Encrypt << >>")}
    return parse_files(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary"))


def test_status(corpus):
    status = {r.doc_id: r.status for r in corpus.documents.collect()}
    assert status == {"plain": "OK", "packed": "OK", "script": "OK", "cycle": "OK", "cut": "FORMAT", "empty": "FORMAT", "none": "FORMAT", "locked": "PASSWORD"}


def test_pages_and_geometry(corpus):
    rows = pdf.visible_geometry(pdf.pages(corpus)).orderBy("doc_id", "page_index").collect()
    for doc in ("plain", "packed"):
        got = [r for r in rows if r.doc_id == doc]
        assert [(r.page_index, r.rotate, r.unit, r.width, r.height, r.geometry_status) for r in got] == [(0, 90, 1.0, 80.0, 140.0, "OK"), (1, 0, 2.0, 200.0, 100.0, "OK"), (2, 0, 1.0, 210.0, 130.0, "OK")]
        assert tuple(got[0].crop) == (10, 10, 150, 90)
    assert [(r.page_index, r.width) for r in rows if r.doc_id == "cycle"] == [(0, 1.0)]


def test_page_tree_status(spark, corpus):
    bad = {
        "typeless": [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R << >>] >>", b"<< /Type /Page >>"], "twice": [b"<< /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 3 0 R] >>", b"<< /Type /Page >>"],
        "kidless": [b"<< /Pages 2 0 R >>", b"<< /Type /Pages >>"], "none": [b"<< /Type /Catalog >>"], "one": [b"<< /Pages 2 0 R >>", b"<< /Type /Page >>"],
    }
    made = parse_files(spark.createDataFrame([(k, bytearray(build(v))) for k, v in bad.items()], "path string, content binary"))
    assert {r.doc_id: r.tree_status for r in pdf.page_tree_status(made).collect()} == {"typeless": "FORMAT", "twice": "FORMAT", "kidless": "FORMAT", "none": "FORMAT", "one": "OK"}
    assert {r.doc_id: r.tree_status for r in pdf.page_tree_status(corpus).collect()} == {"plain": "OK", "packed": "OK", "script": "OK", "cycle": "FORMAT"}


def test_document_encoding(spark):
    row = spark.createDataFrame([(bytearray(b"\x18a\x80\xa0\xe9\x93"),)], "b binary").select(pdf.decode_text(F.col("b")).alias("t")).first()
    assert row.t == "\u02d8a\u2022\u20ac\u00e9\ufb01"


def test_metadata(corpus):
    got = {r.doc_id: r for r in pdf.metadata(corpus).collect()}
    assert (got["plain"].Title, got["plain"].Author, got["plain"].Subject, got["plain"].CreationDate) == ("Entwurf für Mai", "", None, "D:2026")
    assert got["packed"].Title is None and got["packed"].metadata_status == "OK" and "cut" not in got


def test_outline(corpus):
    got = [r for r in pdf.outline(corpus).orderBy("doc_id", "index").collect() if r.doc_id == "plain"]
    assert [(r.title, r.parent_index, r.first_child, r.next_sibling, r.uri, r.is_open) for r in got] == [
        ("Opening", None, 1, 3, None, True), ("é", 0, None, 2, None, False), ("Journal", 0, None, None, "http://journal/", False), ("Closing", None, None, None, None, False),
    ]


def test_links_and_annotations(corpus):
    pages = pdf.pages(corpus)
    got = sorted((r for r in pdf.links(corpus, pages).collect() if r.doc_id == "plain"), key=lambda r: r.ordinal)
    assert [(r.uri, r.target_page, r.target and tuple(r.target)) for r in got] == [("http://a/", None, None), (None, 1, (30.0, 50.0))]
    assert tuple(got[0].hotspot) == (10.0, 10.0, 20.0, 30.0)
    assert [(r.subtype, r.contents, r.flags) for r in pdf.annotations(corpus, pages).where("doc_id = 'packed'").collect()] == [("Text", "note", 4)]


def test_forms_and_audit(corpus):
    got = {(r.full_name, r.type, r.value) for r in pdf.form_fields(corpus).where("doc_id = 'plain'").collect()}
    assert got == {("a", "Tx", "top"), ("a.b", "Tx", "top"), ("a.c", "Ch", "own")}
    findings = {r.doc_id: r.findings for r in pdf.audit(corpus).collect()}
    assert findings == {"plain": 4, "packed": 4, "script": 1 + 2, "cycle": 0}


def again(spark, tables):
    return parse_files(serialize(*tables).withColumnRenamed("doc_id", "path"))


def test_round_trip(spark, corpus):
    back = again(spark, (corpus.nodes, corpus.edges))
    want = {(r.doc_id, r.page_index, r.width, r.height) for r in pdf.visible_geometry(pdf.pages(corpus)).collect()}
    assert {(r.doc_id, r.page_index, r.width, r.height) for r in pdf.visible_geometry(pdf.pages(back)).collect()} == want
    assert {r.doc_id: r.Title for r in pdf.metadata(back).collect()}["plain"] == "Entwurf für Mai"
    assert serialize(back.nodes, back.edges).where("doc_id = 'plain'").first().content == serialize(corpus.nodes, corpus.edges).where("doc_id = 'plain'").first().content


def test_crop_and_trim(spark, corpus):
    pages = pdf.pages(corpus)
    boxes = spark.createDataFrame([("plain", 1, (10.0, 20.0, 60.0, 80.0)), ("packed", 0, (0.0, 0.0, 900.0, 10.0))], "doc_id string, page_index int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    status, tables = pdf_edit.crop_pages(corpus, pages, boxes)
    assert {r.doc_id: r.status for r in status.collect()} == {"plain": "OK", "packed": "ARGUMENT"}
    got = {(r.doc_id, r.page_index): r for r in pdf.pages(again(spark, tables)).collect()}
    assert tuple(got["plain", 1].crop) == (5.0, 10.0, 30.0, 40.0) and tuple(got["plain", 1].media) == (0, 0, 100, 50)
    assert tuple(got["packed", 0].crop) == (10, 10, 150, 90)
    status, tables = pdf_edit.trim_pages(corpus, pages, boxes)
    assert {r.doc_id: r.status for r in status.collect()} == {"plain": "OK", "packed": "ARGUMENT"}
    got = {(r.doc_id, r.page_index): r for r in pdf.pages(again(spark, tables)).collect()}
    assert tuple(got["plain", 1].media) == (5.0, 10.0, 30.0, 40.0)


def test_export_and_merge(spark, corpus):
    pages = pdf.pages(corpus)
    got = pdf.pages(again(spark, pdf_edit.export_pages(corpus, pages, [2, 0, 0]))).orderBy("doc_id", "page_index").collect()
    assert [(r.doc_id, tuple(r.media), r.rotate) for r in got if r.doc_id == "plain"] == [("plain", (0, 0, 210, 130), 0), ("plain", (0, 0, 210, 130), 90), ("plain", (0, 0, 210, 130), 90)]
    assert {r.doc_id for r in got} == {"plain", "packed"}
    plan = spark.createDataFrame([("m", i, d, p) for i, (d, p) in enumerate([("plain", 1), ("cycle", 0), ("packed", 0)])] + [("bad", 0, "plain", 9)], "out_id string, out_page int, doc_id string, page_index int")
    merged = again(spark, pdf_edit.assemble(corpus, pages, plan))
    assert [(r.doc_id, r.media.x1) for r in pdf.pages(merged).orderBy("page_index").collect()] == [("m", 100.0), ("m", 1.0), ("m", 210.0)]


AUDITED = [
    b"<< /Type /Catalog /Pages 2 0 R /Names << /JavaScript << /Kids [5 0 R] >> /EmbeddedFiles << >> >> /AcroForm << /XFA (x) /Fields [6 0 R] >> /Perms << /DocMDP << /ByteRange [0 1] >> >> /OpenAction [3 0 R /Fit] >>",
    b"<< /Type /Pages /Kids [3 0 R] /AA << /O << /S /Named >> /C << /S /GoTo /Next [<< /S /Launch >> << /S /SubmitForm /Next 4 0 R >>] >> >> >>",
    b"<< /Type /Page /Annots [<< /Subtype /Screen >> << /Subtype /FileAttachment >> << /Subtype /Text /S /JavaScript /JS (no action) >>] >>",
    b"<< /S /URI /Next 4 0 R >>",
    b"<< /Names [(run) << /S /JavaScript >>] >>",
    b"<< /FT /Sig /T (s) /Kids [<< /V << >> >>] >>",
]


def test_audit_and_sanitize(spark, corpus):
    # no destination leads to its page, which would be a second use of an object that loses annotations
    unsigned = [AUDITED[0].replace(b"/Perms << /DocMDP << /ByteRange [0 1] >> >>", b"").replace(b"[3 0 R /Fit]", b"/first"), *AUDITED[1:5], AUDITED[5].replace(b"/V << >>", b"")]
    files = {"all": AUDITED, "unsigned": unsigned, "bare": [b"<< /Pages 2 0 R /Metadata << /JS (x) /S /Launch /XFA 1 /ByteRange [] >> >>", b"<< /Type /Pages >>"], "aa": [b"<< /AA [] >>"], "kindless": [b"<< /OpenAction << /JS (x) >> >>"], "annots": [b"<< /Annots [1 0 R (x)] >>"], "null": [b"<< /OpenAction null /A null >>"]}
    made = parse_files(spark.createDataFrame([(k, bytearray(build(v))) for k, v in files.items()], "path string, content binary"))
    found = {r.doc_id: (r.audit_status, r.findings) for r in pdf.audit(made).collect()}
    assert found == {"all": ("OK", 255), "unsigned": ("OK", 127), "bare": ("OK", 0), "aa": ("FORMAT", None), "kindless": ("FORMAT", None), "annots": ("FORMAT", None), "null": ("OK", 0)}
    for chosen, left in ((pdf_edit.SANITIZED, 0), (["launch", "xfa"], 127 - 2 - 32)):
        status, tables = pdf_edit.sanitize(made, chosen)
        # a signed document is refused
        assert {r.doc_id: r.status for r in status.collect()} == {"all": "UNSUPPORTED", "unsigned": "OK", "bare": "OK", "null": "OK", "aa": "FORMAT", "kindless": "FORMAT", "annots": "FORMAT"}
        after = {r.doc_id: r.findings for r in pdf.audit(again(spark, tables)).collect()}
        assert after == {"unsigned": left, "bare": 0, "null": 0}, chosen
    with pytest.raises(ValueError):
        pdf_edit.sanitize(made, ["signature"])


def test_named_destinations(spark):
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /Dests << /old [3 0 R /XYZ 1 2 0] /both [3 0 R /Fit] >> /Names << /Dests 5 0 R >> >>",
        b"<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 100 50] >>",
        b"<< /Type /Page /Annots [<< /Subtype /Link /Rect [0 0 1 1] /Dest /old >> << /Subtype /Link /Rect [0 0 1 1] /A << /S /GoTo /D (new) >> >> << /Subtype /Link /Rect [0 0 1 1] /Dest (both) >> << /Subtype /Link /Rect [0 0 1 1] /Dest (gone) >>] >>",
        b"<< /Type /Page >>",
        b"<< /Kids [6 0 R 5 0 R] >>",
        b"<< /Names [(both) [4 0 R /Fit] (new) << /D [4 0 R /XYZ 10 20 0] >>] >>",
    ]
    corpus = parse_files(spark.createDataFrame([("n", bytearray(build(objects)))], "path string, content binary"))
    got = pdf.links(corpus, pdf.pages(corpus)).orderBy("ordinal").collect()
    assert [(r.target_page, r.target and tuple(r.target)) for r in got] == [(0, (1.0, 48.0)), (1, (10.0, 30.0)), (0, (0.0, 0.0)), (None, None)]


def parsed(spark, files):
    return parse_files(spark.createDataFrame([(k, bytearray(build(v))) for k, v in files.items()], "path string, content binary"))


def test_strict_geometry(spark):
    top = b"<< /Type /Catalog /Pages 2 0 R >>"
    tree = b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 80 60] >>"
    leaf = b"<< /Type /Page /Parent 2 0 R >>"
    files = {
        "plain": [top, tree, leaf], "unit": [top, tree, b"<< /Type /Page /Parent 2 0 R /UserUnit 2 /Rotate -90 >>"], "orphan": [top, tree, b"<< /Type /Page >>"],
        "twice": [top, b"<< /Type /Pages /Kids [3 0 R 3 0 R] /MediaBox [0 0 80 60] >>", leaf], "rooted": [top, b"<< /Type /Pages /Parent 1 0 R /Kids [3 0 R] /MediaBox [0 0 80 60] >>", leaf],
        "turned": [top, tree, b"<< /Type /Page /Parent 2 0 R /Rotate 45 >>"], "flat": [top, b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 80 0] >>", leaf], "boxless": [top, b"<< /Type /Pages /Kids [3 0 R] >>", leaf],
    }
    made = parsed(spark, files)
    size = pdf_checks.canonical_size(F.col("media"), F.col("crop"), F.col("rotate"), F.col("unit"))
    got = {r.doc_id: r for r in pdf_checks.strict_geometry(made, pdf.pages(made)).withColumn("size", size).collect()}
    assert {k for k, r in got.items() if r.strict_status == "OK"} == {"plain", "unit"} and set(got) == set(files)
    assert tuple(got["plain"].size) == (80, 60) and got["unit"].size is None and (got["unit"].rotate, got["unit"].unit) == (270, 2.0) and got["flat"].media is None


def test_guards(spark):
    form = lambda fields, *objects: [b"<< /Pages 2 0 R /AcroForm << /Fields " + fields + b" >> >>", b"<< /Type /Pages >>", *objects]
    files = {
        "none": [b"<< /Pages 2 0 R >>", b"<< /Type /Pages >>"], "sound": form(b"[3 0 R]", b"<< /FT /Tx /Kids [4 0 R] >>", b"<< /Parent 3 0 R >>"), "signed": form(b"[3 0 R]", b"<< /FT /Sig /V << /Type /Sig >> >>"),
        "below": form(b"[3 0 R]", b"<< /FT /Sig /Kids [4 0 R] >>", b"<< /Parent 3 0 R /V << >> >>"), "odd": form(b"[3 0 R]", b"<< /FT /Sig /V (x) >>"), "twice": form(b"[3 0 R 3 0 R]", b"<< /FT /Tx >>"),
        "ring": form(b"[3 0 R]", b"<< /Kids [3 0 R] >>"), "astray": form(b"[3 0 R]", b"<< /Kids [4 0 R] >>", b"<< >>"), "listless": form(b"(x)"), "granted": [b"<< /Pages 2 0 R /Perms << /UR3 << >> >> >>", b"<< /Type /Pages >>"],
    }
    got = {r.doc_id: (r.edit_guard, r.sanitize_guard, r.lossless_guard) for r in pdf_checks.guards(parsed(spark, files)).collect()}
    no, ok, odd = "UNSUPPORTED", "OK", "FORMAT"
    assert got == {
        "none": (ok, ok, ok), "sound": (ok, ok, ok), "signed": (no, no, no), "below": (ok, no, no), "odd": (no, no, odd), "twice": (no, ok, odd), "ring": (no, ok, odd), "astray": (ok, ok, odd), "listless": (no, ok, odd), "granted": (ok, no, no),
    }


def test_outline_status_and_destinations(spark):
    top = [b"<< /Pages 2 0 R /Outlines 4 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /MediaBox [10 0 110 50] >>", b"<< /Type /Page /UserUnit 2 >>"]
    two = lambda first=b"", second=b"", root=b"/First 5 0 R /Last 6 0 R": [*top, b"<< " + root + b" >>", b"<< /Title (a) /Parent 4 0 R /Next 6 0 R " + first + b" >>", b"<< /Title (b) /Parent 4 0 R /Prev 5 0 R " + second + b" >>"]
    files = {
        "bare": [b"<< /Pages 2 0 R >>", top[1], top[2]], "sound": two(b"/Dest [3 0 R /XYZ 30 45 0]", b"/A << /S /GoTo /D [3 0 R /Fit] >>"), "nested": [*two(b"/First 7 0 R /Last 7 0 R"), b"<< /Title (c) /Parent 5 0 R >>"],
        "astray": [*two(b"/First 7 0 R /Last 7 0 R"), b"<< /Title (c) /Parent 4 0 R >>"], "lastless": two(root=b"/First 5 0 R"), "short": two(root=b"/First 5 0 R /Last 5 0 R"), "back": two(b"/Prev 6 0 R"), "ring": two(second=b"/Next 5 0 R"),
        "counted": two(b"/Count (x)"), "pageless": two(b"/Dest [4 0 R /Fit]"), "named": two(b"/A << /S /Named >>"), "web": two(b"/A << /S /URI /URI (http://a/) >>"),
    }
    made = parsed(spark, files)
    pages = pdf.pages(made)
    got = {r.doc_id: r.outline_status for r in pdf_checks.outline_status(made, pages).collect()}
    sound = {"bare", "sound", "nested", "web"}
    assert got == {k: "OK" if k in sound else "UNSUPPORTED" if k == "named" else "FORMAT" for k in files}
    there = [(r.target_page, tuple(r.target)) for r in pdf_checks.outline_destinations(made, pages).where("doc_id = 'sound'").orderBy("node").collect()]
    assert there == [(0, (40.0, 10.0)), (0, (0.0, 0.0))]
