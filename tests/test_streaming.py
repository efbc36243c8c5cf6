"""Streamed ingest gives what a batch read gives."""

import os

from test_pdf import OBJECTS, build

from quiresmith.operators import pdf
from quiresmith.sources.pdf import SCHEMA, Corpus, read_pdf
from quiresmith.streaming import ingest


def test_ingest(spark, tmp_path):
    drop, table = tmp_path / "drop", tmp_path / "table"
    drop.mkdir()
    (drop / "a.pdf").write_bytes(build(OBJECTS))
    (drop / "broken.pdf").write_bytes(b"no")
    run = lambda: ingest.ingest(ingest.distinct_contents(ingest.file_stream(spark, str(drop))), str(table), str(tmp_path / "check")).awaitTermination()
    run()
    (drop / "copy.pdf").write_bytes(build(OBJECTS))
    (drop / "b.pdf").write_bytes(build(OBJECTS[:2]))
    run()
    streamed = Corpus.of(spark.read.schema(SCHEMA).parquet(str(table)))
    assert sorted((r.doc_id.rsplit("/", 1)[1], r.status) for r in streamed.documents.collect()) == [("a.pdf", "OK"), ("b.pdf", "OK"), ("broken.pdf", "FORMAT")]
    batch = read_pdf(spark, str(drop))
    one = lambda c: sorted((r.page_index, r.rotate) for r in pdf.pages(c).collect() if r.doc_id.endswith("/a.pdf"))
    assert one(streamed) == one(batch) and len(one(batch)) == 3


def test_old_files_arrive_late(spark, tmp_path):
    drop, table = tmp_path / "drop", tmp_path / "table"
    drop.mkdir()
    run = lambda: ingest.ingest(ingest.distinct_contents(ingest.file_stream(spark, str(drop))), str(table), str(tmp_path / "check")).awaitTermination()
    for name, n, age in (("new", 3, 0), ("newer", 2, 0), ("old", 1, 10 * 86400), ("older", 3, 20 * 86400)):
        path = drop / f"{name}.pdf"
        path.write_bytes(build(OBJECTS[:n]))
        os.utime(path, (path.stat().st_mtime - age,) * 2)
        run()
    assert sorted(r.doc_id.rsplit("/", 1)[1] for r in spark.read.schema(SCHEMA).parquet(str(table)).collect()) == ["new.pdf", "newer.pdf", "old.pdf"]
