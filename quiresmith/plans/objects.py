"""Queries of the document operators over object tables made from the driver's tables, with the same in DuckDB SQL.

A customer is a document, an order a page, a line of an order an annotation: of odd number a link, else a note.
The SQL asks the driver's tables, not the objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quiresmith.operators import edits, graph_model, graphics_state, name_trees, pdf, pdf_checks, pdf_edit, pdf_text, poster, traversal
from quiresmith.plans.kernels import _query
from quiresmith.session import table, written
from quiresmith.sources.pdf import Corpus


def _node(node: Column | int, kind: str, value: Column | str | int | None = None) -> Column:
    value = F.lit(value) if not isinstance(value, Column) else value
    number = value.cast("double") if kind in ("integer", "real") else F.lit(None).cast("double")
    data = F.lit(None).cast("binary") if kind in ("dictionary", "array") else value.cast("string").cast("binary")
    whole = F.lit(node) if isinstance(node, int) else node
    return F.struct(whole.cast("int").alias("node"), F.lit(kind).alias("kind"), F.lit(kind == "dictionary").alias("indirect"), number.alias("number"), data.alias("data"), F.lit(None).cast("binary").alias("stream"))


def _edge(src: Column | int, key: str | None, dst: Column | int, ordinal: Column | int = 0) -> Column:
    whole = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(whole(src).alias("src"), whole(ordinal).alias("ordinal"), F.lit(key).cast("string").alias("key"), whole(dst).alias("dst"))


def _box(owner, key: str, at, numbers: list) -> tuple[list[Column], list[Column]]:
    """An array of four numbers at ``at ... at + 4`` as a member of ``owner``."""
    nodes = [_node(at, "array")] + [_node(at + 1 + i, "real", n) for i, n in enumerate(numbers)]
    return nodes, [_edge(owner, key, at)] + [_edge(at, None, at + 1 + i, i) for i in range(4)]


def _exploded(rows: DataFrame) -> DataFrame:
    """Nodes (of _node()) or edges (of _edge()) from ``doc_id, x``; what is null goes after the explode, as a filter of arrays has no generated code."""
    return rows.where("x IS NOT NULL").select("doc_id", "x.*")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with ``place``, their number from 0 within the customer: numbers of objects are local to a document, whatever the keys of the tables."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").withColumn("place", place)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The object tables. Nodes below 1000 belong to the document, 256 from ``1000 + 256 * place`` on to the page of that place."""
    key, order, line, place = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_linenumber"), F.col("place")
    media, media_edges = _box(2, "MediaBox", 30, [0, 0, 300 + key % 100, 400])
    kind = F.when(key % 15 == 0, "JavaScript").when(key % 15 == 5, "Launch").otherwise("Named")
    odd = key % 7 == 0
    of_doc = [
        *(_node(i, "dictionary") for i in (0, 1, 2, 3, 8, 9, 10, 19, 23, 26)), *(_node(i, "array") for i in (5, 18, 22)), *media, _node(4, "name", "Pages"), F.when(key % 2 == 0, _node(7, "integer", 90)),
        _node(15, "string", F.col("c_name")), F.when(odd, _node(16, "integer", 1)).otherwise(_node(16, "string", F.col("c_mktsegment"))), _node(17, "name", kind), _node(20, "string", "customer"), _node(21, "name", "Tx"),
        _node(24, "string", "segment"), _node(25, "string", F.col("c_mktsegment")), _node(27, "string", "nation"), _node(28, "string", F.col("c_nationkey")),
    ]
    doc_edges = [
        _edge(0, "Root", 1), _edge(0, "Info", 3), _edge(1, "Pages", 2), _edge(1, "AcroForm", 8), _edge(1, "Outlines", 9), F.when(key % 5 == 0, _edge(1, "OpenAction", 10)), _edge(10, "S", 17), _edge(2, "Type", 4), _edge(2, "Kids", 5), *media_edges,
        F.when(key % 2 == 0, _edge(2, "Rotate", 7)), _edge(3, "Title", 15), _edge(3, "Author", 16), _edge(8, "Fields", 18), _edge(18, None, 19), _edge(19, "T", 20), _edge(19, "FT", 21), _edge(19, "Kids", 22),
        _edge(22, None, 23, 0), _edge(22, None, 26, 1), _edge(23, "T", 24), _edge(23, "V", 25), _edge(26, "T", 27), _edge(26, "V", 28),
    ]
    base = 1000 + 256 * place
    crop, crop_edges = _box(base, "CropBox", base + 2, [10, 20, 200 + order % 50, 390])
    third, fourth, fifth = order % 3 == 0, order % 4 == 0, order % 5 == 0
    of_page = [_node(base, "dictionary"), _node(base + 1, "name", "Page"), *(F.when(third, n) for n in crop), F.when(fourth, _node(base + 7, "integer", 2)), F.when(fifth, _node(base + 8, "integer", 180)), _node(base + 9, "array"), _node(base + 200, "dictionary"), _node(base + 201, "string", F.col("o_orderpriority"))]
    page_edges = [
        _edge(5, None, base, place), _edge(base, "Type", base + 1), *(F.when(third, e) for e in crop_edges), F.when(fourth, _edge(base, "UserUnit", base + 7)), F.when(fifth, _edge(base, "Rotate", base + 8)), _edge(base, "Annots", base + 9),
        _edge(9, "First", base + 200), _edge(base + 200, "Title", base + 201), _edge(base + 200, "Parent", 9), F.when(F.col("more"), _edge(base + 200, "Next", base + 456)),
    ]
    at = base + 10 + 16 * line
    rect, rect_edges = _box(at, "Rect", at + 2, [10 * line, 30, 10 * line + F.col("l_quantity"), 60])
    link = line % 2 == 1
    of_line = [_node(at, "dictionary"), F.when(link, _node(at + 1, "name", "Link")).otherwise(_node(at + 1, "name", "Text")), *rect, F.when(link, _node(at + 7, "dictionary")), F.when(link, _node(at + 8, "name", "URI")), F.when(link, _node(at + 9, "string", F.concat(F.lit("http://part/"), "l_partkey")))]
    of_line += [F.when(~link, _node(at + 10, "string", F.col("l_returnflag"))), F.when(~link, _node(at + 11, "integer", 4 * line)), _node(at + 12, "dictionary"), _node(at + 13, "string", F.col("l_linestatus"))]
    line_edges = [
        _edge(base + 9, None, at, line), _edge(at, "Subtype", at + 1), *rect_edges, F.when(link, _edge(at, "A", at + 7)), F.when(link, _edge(at + 7, "S", at + 8)), F.when(link, _edge(at + 7, "URI", at + 9)), F.when(~link, _edge(at, "Contents", at + 10)), F.when(~link, _edge(at, "F", at + 11)),
        _edge(at + 12, "Title", at + 13), _edge(at + 12, "Parent", base + 200), F.when(F.col("next_line").isNotNull(), _edge(at + 12, "Next", base + 22 + 16 * F.col("next_line"))),
    ]
    customers = table(spark, sf_dir, "customer")
    orders = _places(spark, sf_dir)
    orders = written(orders.withColumn("more", F.lead("place").over(Window.partitionBy("o_custkey").orderBy("place")).isNotNull()), "object-pages")
    facts = [F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")]  # numbers repeat within an order
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*facts)
    lines = lines.withColumn("next_line", F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    lines = written(lines.join(orders.select("o_orderkey", "o_custkey", "place"), F.col("l_orderkey") == F.col("o_orderkey")), "object-lines")
    sources = [(customers, key, of_doc, doc_edges), (orders, F.col("o_custkey"), of_page, page_edges), (lines, F.col("o_custkey"), of_line, line_edges)]

    def exploded(which: int, name: str) -> DataFrame:
        made = [_exploded(rows.select(doc.cast("string").alias("doc_id"), F.explode(F.array(*parts[which])).alias("x"))) for rows, doc, *parts in sources]
        rows = made[0].unionByName(made[1]).unionByName(made[2])
        return written(rows.sortWithinPartitions(F.xxhash64("key")) if "key" in rows.columns else rows, name)

    documents = customers.select(key.cast("string").alias("doc_id"), F.lit("OK").alias("status"), F.lit("1.7").alias("version"))
    return Corpus(documents, exploded(0, "object-nodes"), exploded(1, "object-edges"))


_PAGES = """(SELECT CAST(c_custkey AS VARCHAR) AS doc_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page_index,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN 180 WHEN c_custkey % 2 = 0 THEN 90 ELSE 0 END AS INTEGER) AS rotate, CASE WHEN o_orderkey % 4 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS unit,
    CASE WHEN o_orderkey % 3 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS x0, CASE WHEN o_orderkey % 3 = 0 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS y0,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN 200 + o_orderkey % 50 ELSE 300 + c_custkey % 100 END AS DOUBLE) AS x1, CASE WHEN o_orderkey % 3 = 0 THEN 390.0::DOUBLE ELSE 400.0::DOUBLE END AS y1
    FROM orders JOIN customer ON c_custkey = o_custkey)"""
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_ANNOTS = f"(SELECT p.*, CAST(l_linenumber AS INTEGER) AS ordinal, l_linenumber AS n, l_partkey, l_returnflag, 10.0::DOUBLE * l_linenumber AS ax, 10.0::DOUBLE * l_linenumber + l_quantity AS bx FROM {_PAGES} AS p JOIN {_LINES} AS l ON l_orderkey = o_orderkey)"


@_query(f"SELECT doc_id, page_index, rotate, unit, 'OK' AS geometry_status, unit * CASE rotate WHEN 90 THEN y1 - y0 ELSE x1 - x0 END AS width, unit * CASE rotate WHEN 90 THEN x1 - x0 ELSE y1 - y0 END AS height FROM {_PAGES}")
def pdf_page_geometry(spark, sf_dir):
    return pdf.visible_geometry(pdf.pages(corpus(spark, sf_dir))).select("doc_id", "page_index", "rotate", "unit", "geometry_status", "width", "height")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN 'FORMAT' ELSE 'OK' END AS metadata_status, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS author, CAST(NULL AS VARCHAR) AS subject FROM customer")
def pdf_metadata(spark, sf_dir):
    return pdf.metadata(corpus(spark, sf_dir)).select("doc_id", "metadata_status", F.col("Title").alias("title"), F.col("Author").alias("author"), F.col("Subject").alias("subject"))


@_query(f"SELECT doc_id, page_index, ordinal, 'Text' AS subtype, CAST(4 * n AS BIGINT) AS flags, l_returnflag AS contents, least(ax, bx) AS x0, 30.0::DOUBLE AS y0, greatest(ax, bx) AS x1, 60.0::DOUBLE AS y1 FROM {_ANNOTS} WHERE n % 2 = 0")
def pdf_annotations(spark, sf_dir):
    made = corpus(spark, sf_dir)
    return pdf.annotations(made, pdf.pages(made)).select("doc_id", "page_index", "ordinal", "subtype", "flags", "contents", "rect.*")


@_query(f"""WITH m AS (SELECT *, CASE rotate WHEN 90 THEN 30 - y0 WHEN 180 THEN x1 - ax ELSE ax - x0 END AS px, CASE rotate WHEN 90 THEN ax - x0 WHEN 180 THEN 30 - y0 ELSE y1 - 30 END AS py,
        CASE rotate WHEN 90 THEN 60 - y0 WHEN 180 THEN x1 - bx ELSE bx - x0 END AS qx, CASE rotate WHEN 90 THEN bx - x0 WHEN 180 THEN 60 - y0 ELSE y1 - 60 END AS qy FROM {_ANNOTS} WHERE n % 2 = 1)
    SELECT doc_id, page_index, ordinal, 'http://part/' || l_partkey AS uri, unit * least(px, qx) AS x0, unit * least(py, qy) AS y0, unit * greatest(px, qx) AS x1, unit * greatest(py, qy) AS y1 FROM m""")
def pdf_links(spark, sf_dir):
    made = corpus(spark, sf_dir)
    return pdf.links(made, pdf.pages(made)).select("doc_id", "page_index", "ordinal", "uri", "hotspot.*")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, f AS full_name, 'Tx' AS type, CASE f WHEN 'customer.segment' THEN c_mktsegment WHEN 'customer.nation' THEN CAST(c_nationkey AS VARCHAR) END AS value
    FROM customer, LATERAL unnest(['customer', 'customer.segment', 'customer.nation']) AS t(f)""")
def pdf_form_fields(spark, sf_dir):
    return pdf.form_fields(corpus(spark, sf_dir)).select("doc_id", "full_name", "type", "value")


_LINKED = "EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_linenumber % 2 = 1)"
_OPENED = "CASE WHEN c_custkey % 15 = 0 THEN 1 WHEN c_custkey % 15 = 5 THEN 2 WHEN c_custkey % 5 = 0 THEN 8 ELSE 0 END"


@_query(f"SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'OK' AS audit_status, CAST(CASE WHEN {_LINKED} THEN 4 ELSE 0 END + {_OPENED} AS INTEGER) AS findings FROM customer")
def pdf_audit(spark, sf_dir):
    return pdf.audit(corpus(spark, sf_dir))


@_query(f"SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'OK' AS status, CAST(CASE WHEN c_custkey % 15 = 0 THEN 1 WHEN c_custkey % 15 = 10 THEN 8 ELSE 0 END AS INTEGER) AS findings FROM customer")
def pdf_sanitize(spark, sf_dir):
    made = corpus(spark, sf_dir)
    status, tables = pdf_edit.sanitize(made, ["launch", "external"])
    return status.join(pdf.audit(Corpus(made.documents, *tables)), "doc_id").select("doc_id", "status", "findings")


@_query(f"""WITH i AS (SELECT o_custkey, o_orderkey, -1 AS n, o_orderpriority AS title FROM orders UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, l_linestatus FROM orders JOIN {_LINES} AS l ON l_orderkey = o_orderkey),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, n) - 1 AS INTEGER) AS place FROM i),
    q AS (SELECT *, CASE WHEN n >= 0 THEN min(place) OVER (PARTITION BY o_custkey, o_orderkey) END AS up, CASE WHEN n < 0 AND count(*) OVER (PARTITION BY o_custkey, o_orderkey) > 1 THEN place + 1 END AS down,
        CASE WHEN n < 0 THEN lead(place) OVER (PARTITION BY o_custkey, n < 0 ORDER BY o_orderkey) ELSE lead(place) OVER (PARTITION BY o_custkey, o_orderkey, n < 0 ORDER BY n) END AS after FROM p)
    SELECT CAST(o_custkey AS VARCHAR) AS doc_id, place AS "index", up AS parent_index, CAST(down AS INTEGER) AS first_child, after AS next_sibling, title, false AS is_open FROM q""")
def pdf_outline(spark, sf_dir):
    ints = [F.col(c).cast("int").alias(c) for c in ("index", "parent_index", "first_child", "next_sibling")]
    return pdf.outline(corpus(spark, sf_dir)).select("doc_id", *ints, "title", "is_open")


@_query(f"SELECT a.doc_id, CAST(w AS INTEGER) AS page_index, rotate, x0, y0, x1, y1, unit FROM {_PAGES} AS a JOIN (VALUES (0, 1), (1, 0), (2, 1)) AS t(w, i) ON i = page_index WHERE a.doc_id IN (SELECT doc_id FROM {_PAGES} GROUP BY doc_id HAVING count(*) > 1)")
def pdf_export(spark, sf_dir):
    made = corpus(spark, sf_dir)
    tables = pdf_edit.export_pages(made, pdf.pages(made), [1, 0, 1])
    return pdf.pages(Corpus(made.documents, *tables)).select("doc_id", "page_index", "rotate", "crop.*", "unit")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'FORMAT' ELSE 'OK' END AS tree_status FROM customer")
def pdf_page_tree(spark, sf_dir):
    made = corpus(spark, sf_dir)
    # every fourth document names its own catalog as a page
    extra = made.documents.where(F.col("doc_id").cast("long") % 4 == 0).select("doc_id", F.lit(5).alias("src"), F.lit(-1).alias("ordinal"), F.lit(None).cast("string").alias("key"), F.lit(1).alias("dst"))
    return pdf.page_tree_status(Corpus(made.documents, made.nodes, made.edges.unionByName(extra)))


@_query(f"""SELECT doc_id, page_index, CASE WHEN n % 7 = 0 OR c % 5 = 0 THEN 'FORMAT' ELSE 'OK' END AS strict_status, CASE WHEN n % 7 <> 0 AND c % 5 <> 0 THEN rotate END AS rotate, CASE WHEN n % 7 <> 0 AND c % 5 <> 0 THEN unit END AS unit,
    CASE WHEN n % 7 <> 0 AND c % 5 <> 0 AND rotate = 0 AND unit = 1 AND x0 = 0 THEN x1 END AS width, CASE WHEN n % 7 <> 0 AND c % 5 <> 0 AND rotate = 0 AND unit = 1 AND x0 = 0 THEN 400.0::DOUBLE END AS height
    FROM (SELECT *, o_orderkey AS n, CAST(doc_id AS BIGINT) AS c FROM {_PAGES})""")
def pdf_strict_geometry(spark, sf_dir):
    made = corpus(spark, sf_dir)
    pages = pdf.pages(made)
    # pages name the tree above them, every seventh the catalog; the tree of every fifth document names the catalog above itself
    edge = lambda rows, src, dst: rows.select("doc_id", src.alias("src"), F.lit(-1).alias("ordinal"), F.lit("Parent").alias("key"), dst.cast("int").alias("dst"))
    placed = _places(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("doc_id"), (1000 + 256 * F.col("place")).cast("int").alias("node"), "o_orderkey")
    up = edge(pages.join(placed, ["doc_id", "node"]), F.col("node"), F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(2)).unionByName(edge(made.documents.where(F.col("doc_id").cast("long") % 5 == 0), F.lit(2), F.lit(1)))
    found = pdf_checks.strict_geometry(Corpus(made.documents, made.nodes, made.edges.unionByName(up)), pages)
    size = pdf_checks.canonical_size(F.col("media"), F.col("crop"), F.col("rotate"), F.col("unit"))
    return found.select("doc_id", "page_index", "strict_status", "rotate", "unit", size["width"].alias("width"), size["height"].alias("height"))


@_query("""SELECT CAST(c AS VARCHAR) AS doc_id, CASE WHEN c % 11 = 0 OR c % 6 = 1 OR c % 6 = 2 THEN 'UNSUPPORTED' ELSE 'OK' END AS edit_guard, CASE WHEN c % 11 = 0 OR c % 6 = 1 THEN 'UNSUPPORTED' ELSE 'OK' END AS sanitize_guard,
    CASE WHEN c % 11 = 0 THEN 'UNSUPPORTED' WHEN c % 6 = 1 OR c % 6 = 3 THEN 'FORMAT' WHEN c % 6 = 2 THEN 'FORMAT' ELSE 'OK' END AS lossless_guard FROM (SELECT c_custkey AS c FROM customer)""")
def pdf_guards(spark, sf_dir):
    made = corpus(spark, sf_dir)
    rest = F.col("doc_id").cast("long") % 6
    add = lambda rows, src, key, dst, ordinal=-1: rows.select("doc_id", F.lit(src).alias("src"), F.lit(ordinal).alias("ordinal"), F.lit(key).cast("string").alias("key"), F.lit(dst).alias("dst"))
    docs = made.documents
    # by remainder: 1 a signed field whose value is a text, 2 a field listed twice, 3 without a parent in the fields, the others whole
    signed = docs.where(rest == 1)
    edges = made.edges.where(~((rest == 1) & (F.col("src") == 19) & (F.col("key") == "FT"))).unionByName(add(signed, 19, "FT", 900)).unionByName(add(signed, 19, "V", 25))
    edges = edges.unionByName(add(docs.where(rest == 2), 18, None, 19, 1)).unionByName(add(docs.where(F.col("doc_id").cast("long") % 11 == 0), 0, "Encrypt", 10))
    for child in (23, 26):
        edges = edges.unionByName(add(docs.where(rest != 3), child, "Parent", 19))
    name = signed.select("doc_id", F.lit(900).alias("node"), F.lit("name").alias("kind"), F.lit(False).alias("indirect"), F.lit(None).cast("double").alias("number"), F.lit("Sig").cast("binary").alias("data"), F.lit(None).cast("binary").alias("stream"))
    return pdf_checks.guards(Corpus(docs, made.nodes.unionByName(name), edges))


@_query(f"""WITH p AS (SELECT doc_id, CAST(doc_id AS BIGINT) % 3 = 0 AS out, rotate, unit AS u, x0, y0, x1, y1 FROM {_PAGES} WHERE page_index = 0),
    b AS (SELECT *, CASE rotate WHEN 90 THEN x0 + 8 / u WHEN 180 THEN x1 - 6 / u ELSE x0 + 6 / u END AS ax, CASE rotate WHEN 90 THEN y0 + 6 / u WHEN 180 THEN y0 + 8 / u ELSE y1 - 8 / u END AS ay,
        CASE rotate WHEN 90 THEN x0 + 40 / u WHEN 180 THEN x1 - 30 / u ELSE x0 + 30 / u END AS bx, CASE rotate WHEN 90 THEN y0 + 30 / u WHEN 180 THEN y0 + 40 / u ELSE y1 - 40 / u END AS b_y FROM p)
    SELECT doc_id, CASE WHEN out THEN 'ARGUMENT' ELSE 'OK' END AS status, CASE WHEN out THEN x0 ELSE least(ax, bx) END AS x0, CASE WHEN out THEN y0 ELSE least(ay, b_y) END AS y0, CASE WHEN out THEN x1 ELSE greatest(ax, bx) END AS x1, CASE WHEN out THEN y1 ELSE greatest(ay, b_y) END AS y1 FROM b""")
def pdf_crop(spark, sf_dir):
    made = corpus(spark, sf_dir)
    pages = pdf.pages(made)
    # the first page of every document; every third box reaches outside
    side = F.when(F.col("doc_id").cast("long") % 3 == 0, 9000.0).otherwise(30.0)
    boxes = pages.where("page_index = 0").select("doc_id", "page_index", F.struct(F.lit(6.0).alias("x0"), F.lit(8.0).alias("y0"), side.alias("x1"), F.lit(40.0).alias("y1")).alias("rect"))
    status, tables = pdf_edit.crop_pages(made, pages, boxes)
    return status.join(pdf.pages(Corpus(made.documents, *tables)).where("page_index = 0"), "doc_id").select("doc_id", "status", "crop.*")


CHAIN = 20


def _with(made: Corpus, nodes: list[tuple[Column, list]], edges: list[tuple[Column, list]]) -> Corpus:
    """More nodes (kind of _node()) and edges (of _edge()) in the documents that a condition picks."""
    added = lambda parts: [made.documents.where(where).select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*") for where, rows in parts]
    all_nodes, all_edges = made.nodes, made.edges
    for rows in added(nodes):
        all_nodes = all_nodes.unionByName(rows)
    for rows in added(edges):
        all_edges = all_edges.unionByName(rows)
    return Corpus(made.documents, all_nodes, all_edges)


@_query("""SELECT CAST(c AS VARCHAR) AS doc_id, n + CASE WHEN c % 5 = 1 THEN 40 ELSE 1 END AS tree_visits, CASE WHEN c % 5 = 1 THEN 'FORMAT' WHEN c % 5 = 3 AND n + 1 > 8 THEN 'UNSUPPORTED' ELSE 'OK' END AS tree_status, n AS n_pages,
    CAST(CASE WHEN c % 5 = 2 THEN 5 ELSE 3 END AS BIGINT) AS form_visits, CASE WHEN c % 5 = 2 THEN 'FORMAT' ELSE 'OK' END AS form_status, CAST(3 AS BIGINT) AS n_fields
    FROM (SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def pdf_work_budget(spark, sf_dir):
    rest = F.col("doc_id").cast("long") % 5
    # by remainder: 1 a chain of branches that each list the next one twice (2^19 paths), 2 a field that lists itself twice, 3 a budget of eight visits
    chain = [_edge(5, None, 500, -1)]
    for i in range(CHAIN):
        chain += [_edge(500 + i, "Type", 4), _edge(500 + i, "Kids", 600 + i)] + ([_edge(600 + i, None, 501 + i, k) for k in range(2)] if i < CHAIN - 1 else [])
    nodes = [(rest == 1, [x for i in range(CHAIN) for x in (_node(500 + i, "dictionary"), _node(600 + i, "array"))])]
    made = _with(corpus(spark, sf_dir), nodes, [(rest == 1, chain), (rest == 2, [_edge(22, None, 19, k) for k in (2, 3)])])
    budget = traversal.budgets(made).withColumn("budget", F.when(rest == 3, F.lit(8).cast("long")).otherwise(F.col("budget")))
    tree, form = pdf.page_tree(made, budget), pdf.field_tree(made, budget)
    out = traversal.walk_status(tree).select("doc_id", F.col("n_visits").alias("tree_visits"), F.col("walk_status").alias("tree_status"))
    out = out.join(traversal.walk_status(form).select("doc_id", F.col("n_visits").alias("form_visits"), F.col("walk_status").alias("form_status")), "doc_id")
    for name, rows in (("n_pages", pdf.pages(made, tree)), ("n_fields", pdf.form_fields(made, form))):
        out = out.join(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@_query("""SELECT CAST(c AS VARCHAR) AS doc_id, CASE WHEN c % 6 IN (0, 5) THEN 'UNSUPPORTED' ELSE 'OK' END AS status, CAST(CASE c % 6 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS n_actions, c % 6 IN (2, 3) AS has_additional, CAST(0 AS BIGINT) AS n_next, c % 6 IN (2, 3, 4) AS has_kept,
    CASE WHEN c % 6 IN (0, 5) THEN NULL ELSE CASE WHEN c % 15 = 0 THEN 1 WHEN c % 15 = 10 THEN 8 ELSE 0 END + linked END AS findings
    FROM (SELECT c_custkey AS c, CAST(CASE WHEN EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_linenumber % 2 = 1) THEN 4 ELSE 0 END AS INTEGER) AS linked FROM customer)""")
def pdf_sanitize_prune(spark, sf_dir):
    rest = F.col("doc_id").cast("long") % 6
    # additional actions 910 of the catalog, by remainder: 1 two launches, 2 a launch and a destination, 3 none, 5 a launch in a dictionary that the
    # information of the outline uses too; 4 a destination followed by an array of two launches; 0 a signed field
    names = [_node(911, "dictionary"), _node(912, "dictionary"), _node(913, "dictionary"), _node(915, "name", "Launch"), _node(916, "name", "GoTo")]
    kinds = [_edge(911, "S", 915), _edge(912, "S", 915), _edge(913, "S", 916)]
    held = rest.isin(1, 2, 3, 5)
    nodes = [(rest.isin(1, 2, 4, 5), names), (held, [_node(910, "dictionary")]), (rest == 4, [_node(914, "array")]), (rest == 0, [_node(900, "name", "Sig")])]
    edges = [
        (rest.isin(1, 2, 4, 5), kinds), (held, [_edge(1, "AA", 910)]), (rest == 1, [_edge(910, "O", 911), _edge(910, "C", 912)]), (rest == 2, [_edge(910, "O", 911), _edge(910, "C", 913)]), (rest == 5, [_edge(910, "O", 911), _edge(9, "Own", 910)]),
        (rest == 4, [_edge(9, "A", 913), _edge(913, "Next", 914), _edge(914, None, 911, 0), _edge(914, None, 912, 1)]), (rest == 0, [_edge(23, "FT", 900)]),
    ]
    made = _with(corpus(spark, sf_dir), nodes, edges)
    status, tables = pdf_edit.sanitize(made, ["launch"])
    left = tables[1]
    flag = lambda where, name: left.groupBy("doc_id").agg(F.count(F.when(F.expr(where), 1)).alias(name))
    facts = flag("src = 910", "n_actions").join(flag("src = 1 AND key = 'AA'", "aa"), "doc_id").join(flag("src = 913 AND key = 'Next'", "n_next"), "doc_id").join(flag("dst IN (913, 910)", "kept"), "doc_id")
    after = pdf.audit(Corpus(made.documents.join(status.where("status = 'OK'"), "doc_id", "left_semi"), *tables)).select("doc_id", "findings")
    out = status.join(facts, "doc_id", "left").join(after, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", "status", zero("n_actions").alias("n_actions"), (zero("aa") > 0).alias("has_additional"), zero("n_next").alias("n_next"), (zero("kept") > 0).alias("has_kept"), "findings")


def _text_page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(characters, pages): a page for every customer, in four rotations and two units, with one line: the name in size 10, the segment in size 20."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.concat("c_name", F.lit(" ")).alias("name"), "c_mktsegment")
    doc, page = F.col("c").cast("string").alias("doc_id"), F.lit(0).alias("page_index")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1"))
    pages = rows.select(doc, page, box.alias("crop"), (F.col("c") % 4 * 90).cast("int").alias("rotate"), (1.0 + F.col("c") % 3 / 2).alias("unit"))
    chars = rows.select(doc, page, F.length("name").alias("n"), F.posexplode(F.split(F.concat("name", "c_mktsegment"), "")).alias("ord", "ch"))
    place = lambda i: F.when(i < F.col("n"), 50.0 + 5 * i).otherwise(50.0 + 5 * F.col("n") + 10 * (i - F.col("n")))
    size = F.when(F.col("ord") < F.col("n"), 10.0).otherwise(20.0)
    return chars.select("doc_id", "page_index", "ord", F.lit(0).alias("line"), "ch", place(F.col("ord")).alias("x0"), F.lit(200.0).alias("y0"), place(F.col("ord") + 1).alias("x1"), F.lit(200.0).alias("y1"), size.alias("height"), size.alias("size"), F.lit(0).cast("long").alias("argb")), pages


@_query("""WITH t AS (SELECT c_custkey AS c, c_name || ' ' || c_mktsegment AS s, length(c_name) + 1 AS n, 1.0::DOUBLE + (c_custkey % 3) / 2.0::DOUBLE AS u FROM customer),
    m AS (SELECT c, u, n, needle, o, length(needle) AS k FROM t, (VALUES ('00'), (' B'), ('1 A')) AS v(needle), LATERAL unnest(range(0, length(s) - length(needle) + 1)) AS w(o) WHERE substring(s, o + 1, length(needle)) = needle),
    b AS (SELECT *, CASE WHEN o < n THEN 50 + 5 * o ELSE 50 + 5 * n + 10 * (o - n) END AS ax, CASE WHEN o + k < n THEN 50 + 5 * (o + k) ELSE 50 + 5 * n + 10 * (o + k - n) END AS bx, CASE WHEN o + k <= n THEN 10 ELSE 20 END AS size FROM m),
    q AS (SELECT *, 200 + 0.8::DOUBLE * size AS t, 200 - 0.2::DOUBLE * size AS d FROM b)
    SELECT CAST(c AS VARCHAR) AS doc_id, needle, CAST(o AS INTEGER) AS "offset",
        round(u * CASE c % 4 WHEN 0 THEN ax WHEN 1 THEN t - 10 WHEN 2 THEN 600 - ax ELSE 800 - t END, 6) AS ulx, round(u * CASE c % 4 WHEN 0 THEN 800 - t WHEN 1 THEN ax WHEN 2 THEN t - 10 ELSE 600 - ax END, 6) AS uly,
        round(u * CASE c % 4 WHEN 0 THEN bx WHEN 1 THEN d - 10 WHEN 2 THEN 600 - bx ELSE 800 - d END, 6) AS lrx, round(u * CASE c % 4 WHEN 0 THEN 800 - d WHEN 1 THEN bx WHEN 2 THEN d - 10 ELSE 600 - bx END, 6) AS lry FROM q""")
def pdf_search_quads(spark, sf_dir):
    chars, pages = _text_page(spark, sf_dir)
    cells = written(pdf_text.char_cells(chars, pages), "cells")
    out = None
    for needle in ("00", " B", "1 A"):
        at = lambda corner, axis: F.round(F.col(f"quad.{corner}.{axis}"), 6).alias(corner + axis)
        found = pdf_text.search_quads(cells, needle).select("doc_id", F.lit(needle).alias("needle"), F.col("offset").cast("int").alias("offset"), at("ul", "x"), at("ul", "y"), at("lr", "x"), at("lr", "y"))
        out = found if out is None else out.unionByName(found)
    return out


@_query(f"""WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, l_linenumber AS n, l_quantity AS v, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM {_LINES} AS x),
    a AS (SELECT *, pow(2, sum(CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS outside FROM l),
    s AS (SELECT o, k, n, lines, coalesce(outside, 1) * CASE WHEN n % 2 = 1 THEN 2 ELSE 1 END AS a, sum(n * coalesce(outside, 1)) OVER w AS e, sum(v * coalesce(outside, 1)) OVER w AS f, sum(CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) OVER w AS clips FROM a WINDOW w AS (PARTITION BY o ORDER BY k)),
    f AS (SELECT o, k AS place, a, e, f, CAST(k AS BIGINT) AS depth, clips FROM s UNION ALL SELECT DISTINCT o, 0, 1, 0, 0, 0, 0 FROM s)
    SELECT o AS page, 'OK' AS status, CAST(place AS BIGINT) AS place, CAST(a AS DOUBLE) AS scale, CAST(e AS DOUBLE) AS e, CAST(f AS DOUBLE) AS f, depth, CAST(clips AS BIGINT) AS clips FROM f WHERE o % 7 <> 0 AND o % 11 <> 0
    UNION ALL SELECT DISTINCT o, 'FORMAT', NULL, NULL, NULL, NULL, NULL, NULL FROM s WHERE o % 7 = 0 OR o % 11 = 0""")
def pdf_state_fold(spark, sf_dir):
    # a page for every order: each line opens a scope inside that of the line before, moves and (odd lines) doubles what is drawn, clips (every third line) and
    # fills; then all scopes close and a last fill follows. Every seventh page leaves a scope open, every eleventh closes one too many
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("v"))
    lines = lines.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    scale = F.when(F.col("l_linenumber") % 2 == 1, 2.0).otherwise(1.0)
    op = lambda at, name, args=None: F.struct(at.cast("long").alias("ord"), F.lit(name).alias("op"), (F.array() if args is None else args).cast("array<double>").alias("args"))
    at = 5 * F.col("k")
    clip = F.col("l_linenumber") % 3 == 0
    opened = [op(at, "q"), op(at + 1, "cm", F.array(scale, F.lit(0.0), F.lit(0.0), scale, F.col("l_linenumber").cast("double"), F.col("v"))), F.when(clip, op(at + 2, "W")), F.when(clip, op(at + 3, "n")), op(at + 4, "f"), op(5 * F.col("n") + 10 + F.col("k"), "Q")]
    ops = lines.select("l_orderkey", F.explode(F.filter(F.array(*opened), lambda x: x.isNotNull())).alias("x")).select("l_orderkey", "x.*")
    ends = lines.groupBy("l_orderkey").agg(F.max("n").alias("n"))
    odd = F.when(F.col("l_orderkey") % 7 == 0, op(6 * F.col("n") + 12, "q")).when(F.col("l_orderkey") % 11 == 0, op(6 * F.col("n") + 12, "Q"))
    last = ends.select("l_orderkey", F.explode(F.filter(F.array(op(6 * F.col("n") + 11, "f"), odd), lambda x: x.isNotNull())).alias("x")).select("l_orderkey", "x.*")
    status, states = graphics_state.graphics_states(ops.unionByName(last).select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), "ord", "op", "args"))
    fills = states.where("op = 'f'").select("doc_id", F.when(F.col("depth") > 0, F.floor(F.col("ord") / 5)).otherwise(0).cast("long").alias("place"), F.col("ctm.a").alias("scale"), "ctm.e", "ctm.f", F.col("depth").cast("long").alias("depth"), "clips")
    return status.join(fills, "doc_id", "left").select(F.col("doc_id").cast("long").alias("page"), F.col("state_status").alias("status"), "place", "scale", "e", "f", "depth", "clips")


@_query(f"""WITH p AS (SELECT *, CAST(doc_id AS BIGINT) AS c, (x1 - x0) / 2 AS w, (y1 - y0) / 2 AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM {_PAGES}),
    f AS (SELECT *, 10 + c % 100 AS dx, CASE WHEN c % 7 = 0 THEN 500 ELSE 35 + c % 300 END AS dy FROM p WHERE page_index = 0),
    cells AS (SELECT *, CAST(2 * r + k AS INTEGER) AS tile, CASE rotate WHEN 90 THEN r WHEN 180 THEN 1 - k ELSE k END AS xi, CASE rotate WHEN 90 THEN k WHEN 180 THEN r ELSE 1 - r END AS yi FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(r, k)),
    boxes AS (SELECT doc_id, c, o_orderkey, page_index, tile, rotate, dx, dy, x0 AS ox, y0 AS oy, x1 AS px, y1 AS py, w, h, x0 + w * xi AS x0, y0 + h * yi AS y0, x0 + w * (xi + 1) AS x1, y0 + h * (yi + 1) AS y1 FROM cells),
    marks AS (SELECT b.*, n, ax, bx, ax < b.x1 AND bx > b.x0 AND 30 < b.y1 AND 60 > b.y0 AS met, ax >= b.x0 AND bx <= b.x1 AND b.y0 <= 30 AND b.y1 >= 60 AS inside FROM boxes AS b JOIN {_ANNOTS} AS a ON a.o_orderkey = b.o_orderkey),
    crossing AS (SELECT DISTINCT c FROM (SELECT c, n FROM marks WHERE n % 2 = 0 GROUP BY c, n HAVING count(*) FILTER (WHERE inside) <> 1)),
    s AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 17 = 0 OR c_custkey NOT IN (SELECT c FROM f) THEN 'ARGUMENT' WHEN c_custkey % 4 = 3 THEN 'OK' WHEN c_custkey % 5 = 0 OR c_custkey IN (SELECT c FROM crossing) THEN 'UNSUPPORTED'
        WHEN c_custkey % 11 = 0 THEN 'UNSUPPORTED' WHEN c_custkey % 13 = 0 THEN 'FORMAT' WHEN c_custkey % 7 = 0 THEN 'UNSUPPORTED' ELSE 'OK' END AS status FROM customer),
    cut AS (SELECT c FROM s WHERE status = 'OK' AND c % 4 <> 3),
    counts AS (SELECT c, tile, count(*) FILTER (WHERE met AND n % 2 = 1) AS n_links, count(*) FILTER (WHERE inside AND n % 2 = 0) AS n_notes, coalesce(sum((least(bx, x1) - greatest(ax, x0)) * (least(60, y1) - greatest(30, y0))) FILTER (WHERE met AND n % 2 = 1), 0) AS area FROM marks GROUP BY c, tile),
    goal AS (SELECT c, CAST(2 * least(1, floor(CASE rotate WHEN 90 THEN dx - x0 WHEN 180 THEN dy - y0 ELSE y1 - dy END / CASE rotate WHEN 90 THEN w ELSE h END)) + least(1, floor(CASE rotate WHEN 90 THEN dy - y0 WHEN 180 THEN x1 - dx ELSE dx - x0 END / CASE rotate WHEN 90 THEN h ELSE w END)) AS INTEGER) AS tile FROM f),
    plain AS (SELECT o_orderkey, count(*) FILTER (WHERE n % 2 = 1) AS n_links, count(*) FILTER (WHERE n % 2 = 0) AS n_notes, coalesce(sum((bx - ax) * 30) FILTER (WHERE n % 2 = 1), 0) AS area FROM {_ANNOTS} GROUP BY o_orderkey),
    after AS (SELECT b.c, b.tile AS page_index, b.x0, b.y0, b.x1, b.y1, n_links, n_notes, area, CASE WHEN g.tile = b.tile THEN 1 ELSE 0 END AS n_dests FROM boxes AS b JOIN cut USING (c) LEFT JOIN counts AS k ON k.c = b.c AND k.tile = b.tile JOIN goal AS g ON g.c = b.c
        UNION ALL SELECT p.c, page_index + CASE WHEN cut.c IS NULL THEN 0 ELSE 3 END, x0, y0, x1, y1, n_links, n_notes, area, CASE WHEN page_index = 0 THEN 1 ELSE 0 END FROM p LEFT JOIN cut ON cut.c = p.c LEFT JOIN plain AS q ON q.o_orderkey = p.o_orderkey WHERE cut.c IS NULL OR page_index > 0)
    SELECT CAST(s.c AS VARCHAR) AS doc_id, status, CAST(1000 + s.c + CASE WHEN cut.c IS NULL THEN 0 ELSE 3 END AS BIGINT) AS tree_count, CAST(page_index AS INTEGER) AS page_index, x0, y0, x1, y1, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_notes, 0) AS BIGINT) AS n_notes, round(CAST(coalesce(area, 0) AS DOUBLE), 6) AS link_area, CAST(coalesce(n_dests, 0) AS BIGINT) AS n_dests
    FROM s LEFT JOIN cut ON cut.c = s.c LEFT JOIN after ON after.c = s.c""")
def pdf_poster_split(spark, sf_dir):
    c = F.col("doc_id").cast("long")
    # the outline has a destination on the first page, which is cut into two by two tiles. By remainder: 11 it fits the page, 13 it lacks a
    # coordinate, 7 it is outside; 4 asks for one tile, 17 for none
    dest = [_node(700, "array"), _node(701, "name", F.when(c % 11 == 0, "Fit").otherwise("XYZ")), _node(702, "integer", 10 + c % 100), _node(703, "integer", F.when(c % 7 == 0, 500).otherwise(35 + c % 300)), _node(704, "null"), _node(690, "integer", 1000 + c)]
    edges = [(c >= 0, [_edge(2, "Count", 690), _edge(9, "Dest", 700), _edge(700, None, 701, 1), _edge(700, None, 702, 2)]), (c % 13 != 0, [_edge(700, None, 703, 3), _edge(700, None, 704, 4)])]
    made = _with(corpus(spark, sf_dir), [(c >= 0, dest)], edges)
    first = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id")).distinct()
    first = first.select("doc_id", F.lit(700).alias("src"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("key"), F.lit(1000).alias("dst"))
    made = Corpus(made.documents, written(made.nodes, "poster-nodes"), written(made.edges.unionByName(first.join(made.documents, "doc_id", "left_semi")), "poster-edges"))
    splits = made.documents.select("doc_id", F.lit(0).alias("page_index"), F.when(c % 17 == 0, 0).when(c % 4 == 3, 1).otherwise(2).alias("cols"), F.when(c % 4 == 3, 1).otherwise(2).alias("rows"))
    status, tables = poster.split_pages(made, splits)
    after = Corpus(made.documents, *(written(t, "poster-tables") for t in tables))
    shown = written(pdf.pages(after), "poster-pages")
    annots = pdf.page_annotations(after, shown).withColumn("area", (F.col("rect.x1") - F.col("rect.x0")) * (F.col("rect.y1") - F.col("rect.y0")))
    link = F.col("subtype") == "Link"
    marks = annots.groupBy("doc_id", "page_index").agg(F.count(F.when(link, 1)).alias("n_links"), F.count(F.when(~link, 1)).alias("n_notes"), F.sum(F.when(link, F.col("area"))).alias("area"))
    dests = after.edges.where("src = 700 AND ordinal = 0").groupBy("doc_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_dests"))
    count = after.nodes.where("node = 690").select("doc_id", F.col("number").cast("long").alias("tree_count"))
    rows = status.join(count, "doc_id").join(shown.select("doc_id", "page_index", "node", "crop.*"), "doc_id", "left").join(marks, ["doc_id", "page_index"], "left").join(dests, ["doc_id", "node"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.select("doc_id", "status", "tree_count", F.col("page_index").cast("int").alias("page_index"), "x0", "y0", "x1", "y1", zero("n_links"), zero("n_notes"), F.round(F.coalesce("area", F.lit(0.0)), 6).alias("link_area"), zero("n_dests"))


def _spread(rows: DataFrame, parts: list[Column]) -> DataFrame:
    """Nodes (of _node()) or edges (of _edge()) for every row that has a doc_id."""
    return _exploded(rows.select("doc_id", F.explode(F.array(*parts)).alias("x")))


def _line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, c, o, place, n``: customer, order, its place and number of every line."""
    orders = _places(spark, sf_dir).select("o_orderkey", "o_custkey", "place").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_custkey").alias("c"), F.col("o_orderkey").alias("o"), "place", F.col("l_linenumber").alias("n"))


@_query(f"""WITH o AS (SELECT o_custkey AS c, o_orderkey, count(l_linenumber) AS t FROM orders LEFT JOIN {_LINES} AS l ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
    f AS (SELECT c_custkey AS c, count(o_orderkey) AS n, count(CASE WHEN t > 0 THEN 1 END) AS m, coalesce(sum(t), 0) AS t, coalesce(max(t), 0) AS most FROM customer LEFT JOIN o ON c = c_custkey GROUP BY c_custkey),
    s AS (SELECT *, CASE WHEN CASE c % 8 WHEN 1 THEN m > 1 WHEN 2 THEN m > 0 WHEN 3 THEN t > 0 WHEN 4 THEN true WHEN 5 THEN n > 0 WHEN 6 THEN t > 0 WHEN 7 THEN most > 1 ELSE false END THEN 'FORMAT' WHEN c % 16 = 8 AND 1 + n + t + 2 * m > 40 THEN 'UNSUPPORTED' ELSE 'OK' END AS status FROM f)
    SELECT CAST(c AS VARCHAR) AS doc_id, status AS name_tree_status, CAST(CASE WHEN status = 'OK' THEN t END AS BIGINT) AS n_names FROM s""")
def pdf_name_tree(spark, sf_dir):
    # a name tree of scripts in every document: a leaf for each order with its limits, a name for each line. By remainder: 1 leaves in the wrong order, 2 a
    # last name that isn't there, 3 values that are numbers, 4 a root with names of its own, 5 a leaf listed twice, 6 a name without a value, 7 equal names, 8 of 16 a small budget
    base = corpus(spark, sf_dir)
    rest = F.col("c") % 8
    lines = written(_line_keys(spark, sf_dir), "lines")
    orders = _places(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_custkey").alias("c"), "place").join(base.documents.select("doc_id"), "doc_id")
    page, at = 1000 + 256 * F.col("place"), 1010 + 256 * F.col("place") + 16 * F.col("n")
    name = lambda n: F.concat(F.lpad(F.col("place").cast("string"), 10, "0"), F.when(rest == 7, "").otherwise(F.concat(F.lit("-"), n.cast("string"))))
    ends = lines.groupBy("doc_id", "c", "place").agg(F.min("n").alias("low"), F.max("n").alias("n"))
    firsts = orders.groupBy("doc_id", "c").agg(F.min("place").alias("place"))
    high = F.when(rest == 2, "zzz").otherwise(name(F.col("n")))
    nodes = base.nodes.unionByName(_spread(orders, [_node(page + 210, "dictionary"), _node(page + 211, "array")]))
    nodes = nodes.unionByName(_spread(ends, [_node(page + 212, "array"), _node(page + 213, "string", name(F.col("low"))), _node(page + 214, "string", high)]))
    nodes = nodes.unionByName(_spread(lines, [_node(at + 14, "string", name(F.col("n"))), F.when(rest == 3, _node(at + 15, "integer", 1)).otherwise(_node(at + 15, "dictionary"))]))
    edges = base.edges.unionByName(_spread(orders, [_edge(802, None, page + 210, F.when(rest == 1, -F.col("place")).otherwise(F.col("place"))), _edge(page + 210, "Names", page + 211)]))
    edges = edges.unionByName(_spread(ends, [_edge(page + 210, "Limits", page + 212), _edge(page + 212, None, page + 213, 0), _edge(page + 212, None, page + 214, 1)]))
    paired = lines.join(ends.select("doc_id", "place", "low"), ["doc_id", "place"])
    edges = edges.unionByName(_spread(paired, [_edge(page + 211, None, at + 14, 2 * F.col("n")), F.when((rest != 6) | (F.col("n") != F.col("low")), _edge(page + 211, None, at + 15, 2 * F.col("n") + 1))]))
    edges = edges.unionByName(_spread(firsts.where(rest == 5), [_edge(802, None, page + 210, 1 << 30)]))
    c = F.col("doc_id").cast("long")
    made = _with(Corpus(base.documents, nodes, edges), [(c >= 0, [_node(800, "dictionary"), _node(801, "dictionary"), _node(802, "array"), _node(803, "array")])], [(c >= 0, [_edge(1, "Names", 800), _edge(800, "JavaScript", 801), _edge(801, "Kids", 802)]), (c % 8 == 4, [_edge(801, "Names", 803)])])
    made = Corpus(made.documents, written(made.nodes, "name-tree-nodes"), written(made.edges, "name-tree-edges"))
    budget = traversal.budgets(made).withColumn("budget", F.when(c % 16 == 8, F.lit(40).cast("long")).otherwise(F.col("budget")))
    found = name_trees.name_tree_status(made, name_trees.roots(made, "JavaScript"), ["dictionary"], budget)
    return found.select("doc_id", "name_tree_status", F.when(F.col("name_tree_status") == "OK", F.col("n_names")).alias("n_names"))


_SESSION = f"""m AS (SELECT *, CAST(doc_id AS BIGINT) AS c, 1000 * page_index + 10 * n AS spot, CASE WHEN CAST(doc_id AS BIGINT) % 6 = 0 AND page_index = 1 THEN 0 ELSE page_index END AS list FROM {_ANNOTS})"""


def _edited(spark, sf_dir):
    """(lists, annotations, judged log): a change or several for every line, in the order of pages and lines.

    In every sixth document the second page has the annotations of the first.
    """
    base = corpus(spark, sf_dir)
    ranked = _places(spark, sf_dir).where("place = 1").select(F.col("o_custkey").cast("string").alias("doc_id")).where(F.col("doc_id").cast("long") % 6 == 0)
    gone = ranked.select("doc_id", F.lit(1256).alias("src"), F.lit("Annots").alias("key"))
    shared = ranked.select("doc_id", F.lit(1256).alias("src"), F.lit(0).alias("ordinal"), F.lit("Annots").alias("key"), F.lit(1009).alias("dst")).join(base.documents.select("doc_id"), "doc_id", "left_semi")
    edges = written(base.edges.join(gone, ["doc_id", "src", "key"], "left_anti").select(*shared.columns).unionByName(shared), "shared-annotations")
    made = Corpus(base.documents, base.nodes, edges)
    pages = written(pdf.pages(made), "session-pages")
    lines = _line_keys(spark, sf_dir).withColumn("node", (1000 + 256 * F.col("place")).cast("int"))
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"))
    lines = lines.join(pages.select("doc_id", "node", "page_index"), ["doc_id", "node"]).join(parts, ["o", "n"]).withColumn("at", 1000 * F.col("page_index") + 10 * F.col("n"))
    n, at = F.col("n"), F.col("at").cast("long")
    ref = (F.col("node") + 10 + 16 * n).cast("long")
    box = lambda *v: F.struct(*[(F.lit(x) if not isinstance(x, Column) else x).cast("double").alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])

    def change(k: int, op: str, of: Column, fields: int = 0, page=F.col("page_index"), kind=None, rect=None, flags=None, contents=None) -> Column:
        null = lambda x, t: F.lit(None).cast(t) if x is None else x.cast(t)
        return F.struct((at + k).alias("seq"), F.lit(op).alias("op"), page.cast("int").alias("page_index"), of.cast("long").alias("ref"), null(kind, "string").alias("subtype"), F.lit(fields).alias("fields"), (F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>") if rect is None else rect).alias("rect"), null(flags, "long").alias("flags"), null(contents, "string").alias("contents"))

    made_here = change(5, "create", -(at + 5), kind=F.when(n == 7, "Ink").otherwise("Square"), page=F.when(n % 4 == 1, 9999).otherwise(F.col("page_index")), rect=box(1, 2, 3 + n, 9), flags=n, contents=F.lit("new"))
    changes = [
        change(1, "update", ref, edits.FLAGS, flags=100 * n), F.when(n % 3 == 0, change(2, "delete", ref)), change(3, "update", ref, edits.CONTENTS, contents=F.when(n % 5 != 0, F.concat(F.lit("x"), F.col("part")))),
        change(4, "update", ref, edits.BOUNDS, rect=box(5, 6, 25, 36)), F.when((n % 2 == 0) | (n == 7) | (n % 4 == 1), made_here), F.when((n % 2 == 0) | (n % 4 == 3), change(6, "update", F.when(n % 2 == 0, -(at + 5)).otherwise(-1), edits.FLAGS, flags=F.lit(7))),
    ]
    log = lines.select("doc_id", F.explode(F.filter(F.array(*changes), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")
    lists = written(edits.annotation_lists(made, pages), "annotation-lists")
    annots = written(edits.listed_annotations(made, pages, lists), "listed-annotations")
    return lists, annots, written(edits.judged_log(pages, lists, annots, log), "judged-log")


@_query(f"""WITH {_SESSION}, e AS (SELECT doc_id, spot + k AS seq, k, n, list = page_index AS own FROM m, (VALUES (1), (2), (3), (4), (5), (6)) AS t(k) WHERE k IN (1, 3, 4) OR (k = 2 AND n % 3 = 0) OR (k = 5 AND (n % 2 = 0 OR n = 7 OR n % 4 = 1)) OR (k = 6 AND (n % 2 = 0 OR n % 4 = 3)))
    SELECT doc_id, CAST(seq AS BIGINT) AS seq, CASE WHEN k = 5 THEN CASE WHEN n % 4 = 1 THEN 'ARGUMENT' WHEN n = 7 THEN 'UNSUPPORTED' ELSE 'OK' END WHEN k = 6 THEN CASE WHEN n % 4 = 3 THEN 'ARGUMENT' ELSE 'OK' END
        WHEN NOT own THEN 'ARGUMENT' WHEN k > 2 AND n % 3 = 0 THEN 'STATE' WHEN k = 4 AND n % 2 = 1 THEN 'UNSUPPORTED' ELSE 'OK' END AS status FROM e""")
def pdf_edit_log(spark, sf_dir):
    return _edited(spark, sf_dir)[2].select("doc_id", "seq", "status")


_PLACED = "CASE rotate WHEN 90 THEN x0 + {1} / unit WHEN 180 THEN x1 - {0} / unit ELSE x0 + {0} / unit END, CASE rotate WHEN 90 THEN y0 + {0} / unit WHEN 180 THEN y0 + {1} / unit ELSE y1 - {1} / unit END"
SESSION_VERSION = 1035


@_query(f"""WITH {_SESSION}, v(version) AS (VALUES ({SESSION_VERSION}), (2000000000)),
    r AS (SELECT *, [{_PLACED.format("5", "6")}, {_PLACED.format("25", "36")}] AS moved, [{_PLACED.format("1", "2")}, {_PLACED.format("(3 + n)", "9")}] AS made FROM m),
    b AS (SELECT doc_id, version, list, 0 AS late, n AS place, CAST(1010 + 256 * o_orderkey + 16 * n AS BIGINT) AS ref, CASE WHEN n % 2 = 1 THEN 'Link' ELSE 'Text' END AS subtype, CASE WHEN n % 2 = 0 AND spot + 4 <= version THEN moved ELSE [ax, 30, bx, 60] END AS box,
        CASE WHEN spot + 1 <= version THEN 100 * n WHEN n % 2 = 0 THEN 4 * n ELSE 0 END AS flags, CASE WHEN spot + 3 <= version THEN CASE WHEN n % 5 <> 0 THEN 'x' || l_partkey END WHEN n % 2 = 0 THEN l_returnflag END AS contents FROM r, v WHERE list = page_index AND NOT (n % 3 = 0 AND spot + 2 <= version)
        UNION ALL SELECT doc_id, version, list, 1, spot + 5, -(spot + 5), 'Square', made, CASE WHEN spot + 6 <= version THEN 7 ELSE n END, 'new' FROM r, v WHERE n % 2 = 0 AND spot + 5 <= version),
    p AS (SELECT doc_id, page_index, CASE WHEN CAST(doc_id AS BIGINT) % 6 = 0 AND page_index = 1 THEN 0 ELSE page_index END AS list FROM {_PAGES})
    SELECT b.doc_id, CAST(version AS BIGINT) AS version, p.page_index, CAST(row_number() OVER (PARTITION BY b.doc_id, version, p.page_index ORDER BY late, place) - 1 AS INTEGER) AS place, CAST(ref AS BIGINT) AS ref, subtype,
        round(least(box[1], box[3]), 6) AS x0, round(least(box[2], box[4]), 6) AS y0, round(greatest(box[1], box[3]), 6) AS x1, round(greatest(box[2], box[4]), 6) AS y1, CAST(flags AS BIGINT) AS flags, contents FROM b JOIN p ON p.doc_id = b.doc_id AND p.list = b.list""")
def pdf_edit_snapshot(spark, sf_dir):
    lists, annots, judged = _edited(spark, sf_dir)
    out = [edits.snapshot(lists, annots, judged, v).withColumn("version", F.lit(v).cast("long")) for v in (SESSION_VERSION, 2_000_000_000)]
    corner = lambda c: F.round(F.col(f"rect.{c}"), 6).alias(c)
    # references are shown by the key of the order, not by its place
    orders = _places(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("place").cast("long").alias("at"), (256 * (F.col("o_orderkey") - F.col("place"))).alias("more"))
    rows = out[0].unionByName(out[1]).withColumn("at", F.when(F.col("ref") >= 0, F.floor((F.col("ref") - 1000) / 256))).join(orders, ["doc_id", "at"], "left").withColumn("ref", F.col("ref") + F.coalesce("more", F.lit(0)))
    return rows.select("doc_id", "version", "page_index", F.col("place").cast("int").alias("place"), "ref", "subtype", corner("x0"), corner("y0"), corner("x1"), corner("y1"), "flags", "contents")


@_query(f"""WITH o AS (SELECT c_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS rank FROM customer JOIN orders ON o_custkey = c_custkey),
    e AS (SELECT c, rank, l_linenumber AS n, CAST(row_number() OVER (PARTITION BY c ORDER BY rank, l_linenumber) + 1 AS BIGINT) AS i, row_number() OVER (PARTITION BY c, rank ORDER BY l_linenumber) AS j FROM o JOIN {_LINES} AS l ON l_orderkey = o),
    f AS (SELECT c_custkey AS c, (SELECT count(*) FROM o WHERE o.c = c_custkey) AS n, (SELECT min(rank) FROM e WHERE e.c = c_custkey) AS lined, (SELECT min(i) FROM e WHERE e.c = c_custkey) AS edge, (SELECT max(i) FROM e WHERE e.c = c_custkey) AS last, (SELECT min(i) FROM e WHERE e.c = c_custkey AND j = 2) AS second FROM customer),
    s AS (SELECT c, CASE c % 9 WHEN 1 THEN CASE WHEN n > 0 THEN 'STORAGE node' END WHEN 2 THEN CASE WHEN last IS NOT NULL THEN 'REFERENCE edge' END WHEN 3 THEN CASE WHEN second IS NOT NULL THEN 'VALUE edge' END WHEN 4 THEN CASE WHEN edge IS NOT NULL THEN 'VALUE edge' END
        WHEN 5 THEN CASE WHEN n > 0 THEN 'STORAGE node' END WHEN 6 THEN CASE WHEN n > 0 THEN 'VALUE node' END WHEN 7 THEN 'STORAGE model' WHEN 8 THEN 'VALUE root' END AS fault, CASE c % 9 WHEN 2 THEN last WHEN 3 THEN second WHEN 4 THEN edge WHEN 7 THEN 0 WHEN 8 THEN 1 ELSE 3 END AS i FROM f)
    SELECT CAST(c AS VARCHAR) AS doc_id, split_part(fault, ' ', 1) AS rule, CASE WHEN fault IS NOT NULL THEN split_part(fault, ' ', 2) END AS subject, CAST(CASE WHEN fault IS NOT NULL THEN i END AS BIGINT) AS "index" FROM s""")
def graph_first_failure(spark, sf_dir):
    # trailer 1, catalog 2, its type 3, then a dictionary for each order with a key for each line. By remainder: 1 the edges of the first order are named one too late, 2 the last
    # line leads nowhere, 3 equal keys, 4 arrays with keys, 5 bytes of the first order one too late, 6 an unknown kind, 7 a byte too many, 8 another type
    c = F.col("c")
    rest = c % 9
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_custkey").alias("c"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")).join(customers, "c")
    orders = orders.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy("o")).cast("long"))
    lines = _line_keys(spark, sf_dir).join(orders.select("o", "rank"), "o")
    in_doc = Window.partitionBy("c").orderBy("rank", "n")
    key = F.when(rest == 3, "/L").otherwise(F.concat(F.lit("/L"), "n"))
    lines = written(lines.withColumn("key", key).withColumn("index", (F.row_number().over(in_doc) + 1).cast("long")).withColumn("key_offset", F.sum(F.length("key")).over(in_doc) - F.length("key") + 18), "model-lines")
    counts = lines.groupBy("c", "rank").agg(F.count(F.lit(1)).alias("edge_count"), F.sum(F.length("key")).alias("bytes"))
    rows = orders.join(counts, ["c", "rank"], "left").fillna(0, ["edge_count", "bytes"])
    in_doc = Window.partitionBy("c").orderBy("rank")
    late = lambda r: F.when((rest == r) & (F.col("rank") == 1), 1).otherwise(0)
    kind = F.when(rest == 4, "array").when((rest == 6) & (F.col("rank") == 1), "thing").otherwise("dictionary")
    none = F.lit(None).cast("string").alias("data")
    nodes = rows.select("doc_id", (F.col("rank") + 3).alias("id"), kind.alias("kind"), (F.sum("bytes").over(in_doc) - F.col("bytes") + 18 + late(5)).alias("data_offset"), none, (F.sum("edge_count").over(in_doc) - F.col("edge_count") + 2 + late(1)).alias("edge_offset"), "edge_count")
    node = lambda i, kind, at, data, edge, n: customers.select("doc_id", F.lit(i).cast("long").alias("id"), F.lit(kind).alias("kind"), F.lit(at).cast("long").alias("data_offset"), data.alias("data"), F.lit(edge).cast("long").alias("edge_offset"), F.lit(n).cast("long").alias("edge_count"))
    nodes = nodes.unionByName(node(1, "dictionary", 0, none, 0, 1)).unionByName(node(2, "dictionary", 5, none, 1, 1)).unionByName(node(3, "name", 10, F.when(rest == 8, "/Cataloh").otherwise("/Catalog"), 2, 0))
    last = lines.groupBy("c").agg(F.max("index").alias("last"))
    edges = lines.join(last, "c").select("doc_id", "index", F.when((rest == 2) & (F.col("index") == F.col("last")), 9999).otherwise(1).cast("long").alias("target"), "key_offset", "key")
    edge = lambda i, to, at, key: customers.select("doc_id", F.lit(i).cast("long").alias("index"), F.lit(to).cast("long").alias("target"), F.lit(at).cast("long").alias("key_offset"), F.lit(key).alias("key"))
    edges = edges.unionByName(edge(0, 2, 0, "/Root")).unionByName(edge(1, 3, 5, "/Type"))
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("edge_count").alias("e"), F.sum("bytes").alias("b"))
    models = customers.join(sizes, "c", "left").fillna(0, ["n", "e", "b"]).select("doc_id", (F.col("n") + 3).alias("n_nodes"), (F.col("e") + 2).alias("n_edges"), (F.col("b") + 18 + F.when(rest == 7, 1).otherwise(0)).alias("n_bytes"), F.lit(1).alias("trailer"), F.lit(2).alias("catalog"))
    return graph_model.first_failure(models, nodes, edges)
