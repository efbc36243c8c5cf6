"""Text of PDF pages: glyph rows from a pass over the content, lines and spaces by windows, spans by a fold.

Order is that of the content; nothing is put into reading order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions import geometry
from quiresmith.functions.text import match_offsets
from quiresmith.operators.pdf import members, names_of, values
from quiresmith.session import written
from quiresmith.sources.pdf import Broken, Corpus, Stream, decoded
from quiresmith.sources.pdf_content import Font, glyphs

SAME_DIRECTION = 0.95
#: Shares of the size above and below the base line, for fonts that don't say.
ASCENT, DESCENT = 0.8, -0.2
GLYPH = "struct<text:string,x0:double,y0:double,x1:double,y1:double,height:double,size:double,argb:long>"


def _streams(corpus: Corpus) -> DataFrame:
    """``doc_id, node, stream, filters``: encoded streams with the names of their filters, in order."""
    own = corpus.edges.where("key = 'Filter'").select("doc_id", "src", F.col("dst").alias("f"))
    single = own.join(names_of(corpus, "f"), ["doc_id", "f"]).select("doc_id", F.col("src").alias("node"), F.array("f_name").alias("filters"))
    listed = own.join(corpus.edges.where("key IS NULL").select("doc_id", F.col("src").alias("f"), "ordinal", F.col("dst").alias("g")), ["doc_id", "f"]).join(names_of(corpus, "g"), ["doc_id", "g"])
    listed = listed.groupBy("doc_id", F.col("src").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "g_name"))), lambda x: x["g_name"]).alias("filters"))
    return corpus.nodes.where("stream IS NOT NULL").select("doc_id", "node", "stream").join(single.unionByName(listed), ["doc_id", "node"], "left").withColumn("filters", F.coalesce("filters", F.array().cast("array<string>")))


def _members_of(corpus: Corpus, parent: DataFrame, column: str) -> DataFrame:
    """``parent`` with a row per member of the object in ``column``: its ``key``, ``ordinal`` and ``dst``."""
    return parent.join(corpus.edges.select("doc_id", F.col("src").alias(column), "key", "ordinal", "dst"), ["doc_id", column])


def _fonts(corpus: Corpus, pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, fonts``: name, whether codes are wide, first code, widths and the ToUnicode stream of each font resource."""
    held = members(corpus, ["Font"]).withColumnRenamed("node", "resources")
    rows = _members_of(corpus, pages.select("doc_id", "page_index", "resources").join(held, ["doc_id", "resources"]), "Font").select("doc_id", "page_index", F.col("key").alias("name"), F.col("dst").alias("node"))
    facts = members(corpus, ["Subtype", "FirstChar", "Widths", "ToUnicode"])
    kinds = names_of(corpus, "Subtype")
    first = values(corpus, "FirstChar").select("doc_id", "FirstChar", F.col("FirstChar_number").cast("int").alias("first"))
    numbers = corpus.edges.where("key IS NULL").join(corpus.nodes.select("doc_id", F.col("node").alias("dst"), "number"), ["doc_id", "dst"]).groupBy("doc_id", F.col("src").alias("Widths")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "number"))), lambda x: F.coalesce(x["number"], F.lit(0.0))).alias("w"))
    maps = _streams(corpus).select("doc_id", F.col("node").alias("ToUnicode"), F.col("stream").alias("cmap"), F.col("filters").alias("cmap_filters"))
    full = rows.join(facts, ["doc_id", "node"]).join(kinds, ["doc_id", "Subtype"], "left").join(first, ["doc_id", "FirstChar"], "left").join(numbers, ["doc_id", "Widths"], "left").join(maps, ["doc_id", "ToUnicode"], "left")
    font = F.struct("name", (F.col("Subtype_name") == "Type0").alias("wide"), F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("w", F.array().cast("array<double>")).alias("widths"), "cmap", F.coalesce("cmap_filters", F.array().cast("array<string>")).alias("filters"))
    return full.groupBy("doc_id", "page_index").agg(F.collect_list(font).alias("fonts"))


def _forms(corpus: Corpus, pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, forms``: names of the form XObjects among each page's resources."""
    held = members(corpus, ["XObject"]).withColumnRenamed("node", "resources")
    rows = _members_of(corpus, pages.select("doc_id", "page_index", "resources").join(held, ["doc_id", "resources"]), "XObject").select("doc_id", "page_index", F.col("key").alias("name"), F.col("dst").alias("node"))
    kinds = members(corpus, ["Subtype"]).join(names_of(corpus, "Subtype"), ["doc_id", "Subtype"]).where("Subtype_name = 'Form'")
    return rows.join(kinds, ["doc_id", "node"]).groupBy("doc_id", "page_index").agg(F.collect_list("name").alias("forms"))


def _contents(corpus: Corpus, pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, parts``: the content streams of each page, in order."""
    held = members(corpus, ["Contents"]).join(pages.select("doc_id", "node", "page_index"), ["doc_id", "node"]).select("doc_id", "page_index", "Contents")
    listed = _members_of(corpus, held, "Contents").where("key IS NULL").select("doc_id", "page_index", "ordinal", F.col("dst").alias("node"))
    single = held.select("doc_id", "page_index", F.lit(0).alias("ordinal"), F.col("Contents").alias("node"))
    parts = listed.unionByName(single).join(_streams(corpus), ["doc_id", "node"])
    return parts.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("ordinal", "stream", "filters"))).alias("parts"))


def page_glyphs(corpus: Corpus, pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, text_status, glyphs`` of every page, a written table; a page that fails has no glyphs.

    Form XObjects aren't read: a page that draws one is UNSUPPORTED.
    """
    rows = pages.select("doc_id", "page_index").join(_contents(corpus, pages), ["doc_id", "page_index"], "left").join(_fonts(corpus, pages), ["doc_id", "page_index"], "left").join(_forms(corpus, pages), ["doc_id", "page_index"], "left")
    glyph_type = pa.list_(pa.struct([(n, t) for n, t in zip(("text", "x0", "y0", "x1", "y1", "height", "size", "argb"), (pa.string(), *[pa.float64()] * 6, pa.int64()), strict=True)]))

    def plain(stream: bytes, filters: list[str]) -> bytes:
        return decoded(Stream({b"Filter": [f.encode("latin-1") for f in filters]}, stream), lambda v: v)

    def page(parts: list[dict] | None, fonts: list[dict] | None, forms: list[str] | None) -> tuple[str, list[tuple]]:
        try:
            known = {f["name"]: Font(bool(f["wide"]), f["first"], f["widths"], plain(f["cmap"], f["filters"]) if f["cmap"] is not None else None) for f in fonts or []}
            return "OK", glyphs(b"\n".join(plain(p["stream"], p["filters"]) for p in parts or []), known, frozenset(forms or []))
        except Broken as e:
            return str(e), []
        except (ValueError, IndexError, TypeError, AttributeError):
            return "FORMAT", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page(*x) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in found]), pa.array([[dict(zip(("text", "x0", "y0", "x1", "y1", "height", "size", "argb"), x, strict=True)) for x in g] for _, g in found], glyph_type)], ["doc_id", "page_index", "text_status", "glyphs"])

    return written(rows.mapInArrow(run, f"doc_id string, page_index int, text_status string, glyphs array<{GLYPH}>"), "glyphs")


def text_chars(page_rows: DataFrame) -> DataFrame:
    """``doc_id, page_index, ord, ch, line, x0, y0, x1, y1, height, size, argb``: characters with the spaces inferred between them.

    A new line begins where the direction turns, or the step across the base line exceeds half the height; a
    space stands in a gap of more than a fifth of the height with no space on either side.
    """
    g = page_rows.select("doc_id", "page_index", F.posexplode("glyphs").alias("at", "g")).select("doc_id", "page_index", "at", "g.*")
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    g = g.withColumn("dx", F.when(length > 0, (F.col("x1") - F.col("x0")) / length).otherwise(1.0)).withColumn("dy", F.when(length > 0, (F.col("y1") - F.col("y0")) / length).otherwise(0.0))
    page = Window.partitionBy("doc_id", "page_index").orderBy("at")
    g = g.withColumn("p", F.lag(F.struct("text", "x1", "y1", "dx", "dy", "height")).over(page))
    mx, my, high = F.col("x0") - F.col("p.x1"), F.col("y0") - F.col("p.y1"), F.greatest("height", "p.height")
    across = F.abs(F.col("p.dx") * my - F.col("p.dy") * mx)
    along = F.col("p.dx") * mx + F.col("p.dy") * my
    broken = F.col("p").isNotNull() & ((F.col("dx") * F.col("p.dx") + F.col("dy") * F.col("p.dy") < SAME_DIRECTION) | (across > F.greatest(F.lit(0.1), 0.5 * high)))
    spaced = F.col("p").isNotNull() & ~broken & (along > F.greatest(F.lit(0.1), 0.2 * F.col("height"))) & (F.col("text") != " ") & (F.col("p.text") != " ")
    g = g.withColumn("spaced", spaced).withColumn("line", F.sum(broken.cast("int")).over(page))
    gap = F.struct(F.lit(" ").alias("ch"), F.col("p.x1").alias("x0"), F.col("p.y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    own = F.struct(F.col("text").alias("ch"), "x0", "y0", "x1", "y1")
    rows = g.withColumn("c", F.explode(F.when(F.col("spaced"), F.array(gap, own)).otherwise(F.array(own))))
    order = Window.partitionBy("doc_id", "page_index").orderBy("at", (F.col("c.ch") != " ").cast("int"))
    return rows.withColumn("ord", F.row_number().over(order) - 1).select("doc_id", "page_index", "ord", "line", "c.*", "height", "size", "argb")


def text_lines(chars: DataFrame) -> DataFrame:
    """``doc_id, page_index, line, text`` and the bounds of its base line."""
    grouped = chars.groupBy("doc_id", "page_index", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ch"))), lambda c: c["ch"]), "").alias("text"), F.min(F.least("x0", "x1")).alias("x0"), F.min(F.least("y0", "y1")).alias("y0"), F.max(F.greatest("x0", "x1")).alias("x1"), F.max(F.greatest("y0", "y1")).alias("y1"))
    return grouped


def text_spans(chars: DataFrame) -> DataFrame:
    """``doc_id, page_index, line, span, text, size, argb``: a new span where the size differs from that of the span's first character by more than 0.001, or the colour changes."""
    item = F.struct("ord", "ch", "size", "argb")
    lines = chars.groupBy("doc_id", "page_index", "line").agg(F.array_sort(F.collect_list(item)).alias("cs"))
    empty = F.array().cast("array<struct<text:string,size:double,argb:long>>")

    def step(done, c):
        last = F.try_element_at(done, F.lit(-1))
        same = F.coalesce((F.abs(last["size"] - c["size"]) <= 0.001) & (last["argb"] == c["argb"]), F.lit(False))
        grown = F.struct(F.concat(F.coalesce(last["text"], F.lit("")), c["ch"]).alias("text"), F.when(same, last["size"]).otherwise(c["size"]).alias("size"), c["argb"].alias("argb"))
        fresh = F.struct(c["ch"].alias("text"), c["size"].alias("size"), c["argb"].alias("argb"))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    return lines.select("doc_id", "page_index", "line", F.posexplode(F.aggregate("cs", empty, step)).alias("span", "s")).select("doc_id", "page_index", "line", "span", "s.*")


def page_text(lines: DataFrame) -> DataFrame:
    """``doc_id, page_index, text``: the lines of each page, CRLF between them."""
    return lines.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\r\n").alias("text"))


def search(lines: DataFrame, needle: str) -> DataFrame:
    """``doc_id, page_index, line, offset`` of every match inside a line, across spans, overlapping ones too."""
    return lines.where(F.contains("text", F.lit(needle))).select("doc_id", "page_index", "line", F.explode(match_offsets(F.col("text"), needle)).alias("offset"))


def char_cells(chars: DataFrame, pages: DataFrame, ascent: float = ASCENT, descent: float = DESCENT) -> DataFrame:
    """``chars`` with ``quad`` (ul, ur, ll, lr, each x, y), the cell as shown on its page, and ``dir`` (x, y), where the text runs there.

    A cell is as long as the advance; it reaches from ``descent`` to ``ascent`` of the size across the base line. Columns ``ascent``
    and ``descent`` of ``chars`` hold instead where they aren't null. A character without an advance runs to the right.
    ``pages``: doc_id, page_index, crop, rotate, unit; characters of other pages are left out. No shuffle but that of the join by page.
    """
    own = lambda name, else_: F.coalesce(name, F.lit(else_)) if name in chars.columns else F.lit(else_)
    rows = chars.join(pages.select("doc_id", "page_index", "crop", "rotate", "unit"), ["doc_id", "page_index"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    rows = rows.withColumn("_ux", F.when(length > 0, dx / length).otherwise(1.0)).withColumn("_uy", F.when(length > 0, dy / length).otherwise(0.0))
    shown = lambda x, y: geometry.to_display(x, y, F.col("crop"), F.col("rotate"), F.col("unit"))
    corner = lambda i, share: shown(F.col(f"x{i}") - F.col("_uy") * share * F.col("size"), F.col(f"y{i}") + F.col("_ux") * share * F.col("size"))
    top, bottom = own("ascent", ascent), own("descent", descent)
    quad = F.struct(corner(0, top).alias("ul"), corner(1, top).alias("ur"), corner(0, bottom).alias("ll"), corner(1, bottom).alias("lr"))
    rows = rows.withColumn("quad", quad).withColumn("_from", shown(F.col("x0"), F.col("y0"))).withColumn("_to", shown(F.col("x0") + F.col("_ux"), F.col("y0") + F.col("_uy")))
    run = F.struct(((F.col("_to.x") - F.col("_from.x")) / F.col("unit")).alias("x"), ((F.col("_to.y") - F.col("_from.y")) / F.col("unit")).alias("y"))
    return rows.withColumn("dir", run).drop("_ux", "_uy", "_from", "_to", "crop", "rotate", "unit")


def search_quads(cells: DataFrame, needle: str) -> DataFrame:
    """``doc_id, page_index, line, offset, quad`` of every match inside a line, overlapping ones too.

    The corners of the matched characters' cells are projected on the direction of the line, that of its first character, and across it; the
    extremes, turned back, are the quad. Matches meet their characters by place in the line, one row for each code point of the needle;
    nothing is gathered but the text of a line. An empty needle is an error.
    """
    keys = ["doc_id", "page_index", "line"]
    starts = cells.groupBy(*keys).agg(F.min("ord").alias("start"), F.min_by("dir", "ord").alias("way"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ch"))), lambda c: c["ch"]), "").alias("text"))
    starts = written(starts, "lines")
    places = search(starts, needle).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(needle) - 1)))).withColumn("place", F.col("offset") + F.col("i"))
    placed = cells.join(starts.select(*keys, "start", "way"), keys).withColumn("place", (F.col("ord") - F.col("start")).cast("int"))
    found = places.join(placed.select(*keys, "place", "way", "quad"), [*keys, "place"])
    corners = F.array("quad.ul", "quad.ur", "quad.ll", "quad.lr")
    along = F.transform(corners, lambda p: p["x"] * F.col("way.x") + p["y"] * F.col("way.y"))
    across = F.transform(corners, lambda p: p["y"] * F.col("way.x") - p["x"] * F.col("way.y"))
    ends = found.groupBy(*keys, "offset").agg(F.first("way").alias("w"), F.min(F.array_min(along)).alias("u0"), F.max(F.array_max(along)).alias("u1"), F.min(F.array_min(across)).alias("v0"), F.max(F.array_max(across)).alias("v1"))
    back = lambda u, v: F.struct((F.col("w.x") * F.col(u) - F.col("w.y") * F.col(v)).alias("x"), (F.col("w.y") * F.col(u) + F.col("w.x") * F.col(v)).alias("y"))
    return ends.select(*keys, "offset", F.struct(back("u0", "v0").alias("ul"), back("u1", "v0").alias("ur"), back("u0", "v1").alias("ll"), back("u1", "v1").alias("lr")).alias("quad"))
