"""Questions to PDF object tables, as joins over nodes and edges (quiresmith.sources.pdf).

Every operator works on all documents at once and is local to a document; loops run over tree depth only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.functions import geometry
from quiresmith.operators.graph import preorder
from quiresmith.operators.traversal import Walk, budgets, first_visits, walk, walk_status
from quiresmith.session import few, written
from quiresmith.sources.pdf import Corpus

# Metadata keys, annotation kinds and finding bits.
METADATA = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
NOT_ANNOTATIONS = ("Link", "Popup", "Widget")
EXTERNAL_ACTIONS = ("URI", "GoToR", "GoToE", "SubmitForm", "ImportData")
RICH_MEDIA = ("RichMedia", "3D", "Movie", "Sound", "Screen")
FINDING_BITS = {"javascript": 1, "launch": 2, "external": 4, "other_action": 8, "embedded_file": 16, "xfa": 32, "rich_media": 64, "signature": 128, "encryption": 256}
# Characters of the PDF document encoding that Latin-1 has not, from bytes 18 and 80 on.
ENCODED_18 = "˘ˇˆ˙˝˛˚˜"
ENCODED_80 = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž\ufffd€"


def decode_text(data: Column) -> Column:
    """A text string as UTF-8: UTF-16 or UTF-8 with a mark, else the PDF document encoding; null stays null, empty stays empty."""
    own = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0xA1)]))
    mark = F.hex(F.substring(data, 1, 3))
    body = lambda n: F.substring(data, n, F.octet_length(data))
    return (
        F.when(mark.startswith("FEFF"), F.decode(body(F.lit(3)), "UTF-16BE")).when(mark.startswith("FFFE"), F.decode(body(F.lit(3)), "UTF-16LE"))
        .when(mark == "EFBBBF", F.decode(body(F.lit(4)), "UTF-8")).otherwise(F.translate(F.decode(data, "ISO-8859-1"), own, ENCODED_18 + ENCODED_80))
    )


def members(corpus: Corpus, keys: list[str]) -> DataFrame:
    """``doc_id, node`` and one column per key with the member's node id; nodes without any of the keys are left out."""
    picked = corpus.edges.where(F.col("key").isin(keys))
    return picked.groupBy("doc_id", F.col("src").alias("node")).agg(*[F.max(F.when(F.col("key") == k, F.col("dst"))).alias(k) for k in keys])


def held(corpus: Corpus, keys: list[str]) -> DataFrame:
    """members() with what they are: one struct (dst, kind, indirect, number, name) per key."""
    picked = corpus.facts().where(F.col("key").isin(keys))
    return picked.groupBy("doc_id", F.col("src").alias("node")).agg(*[F.max(F.when(F.col("key") == k, F.struct("dst", "kind", "indirect", "number", "name"))).alias(k) for k in keys])


def values(corpus: Corpus, of: str) -> DataFrame:
    """``doc_id, <of>`` and kind, number and data of nodes, to be joined by id."""
    return corpus.nodes.select("doc_id", F.col("node").alias(of), F.col("kind").alias(f"{of}_kind"), F.col("number").alias(f"{of}_number"), F.col("data").alias(f"{of}_data"))


def names_of(corpus: Corpus, column: str) -> DataFrame:
    """``doc_id, <column>, <column>_name``: names as strings."""
    return corpus.nodes.where("kind = 'name'").select("doc_id", F.col("node").alias(column), F.decode("data", "ISO-8859-1").alias(f"{column}_name"))


def arrays(corpus: Corpus) -> DataFrame:
    """``doc_id, node, numbers``: the numbers of arrays, in order (null for members that aren't numbers)."""
    items = corpus.edges.where("key IS NULL").join(corpus.nodes.select("doc_id", F.col("node").alias("dst"), F.when(F.col("kind").isin("integer", "real"), F.col("number")).alias("v")), ["doc_id", "dst"])
    grouped = items.groupBy("doc_id", F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "v"))).alias("s"))
    return grouped.select("doc_id", "node", F.transform("s", lambda x: x["v"]).alias("numbers"))


def _numbers(corpus: Corpus, wanted: DataFrame) -> DataFrame:
    """arrays() of the nodes in ``wanted`` (doc_id, node) alone."""
    items = corpus.facts().where("key IS NULL AND kind IS NOT NULL").select("doc_id", F.col("src").alias("node"), "ordinal", F.when(F.col("kind").isin("integer", "real"), F.col("number")).alias("v"))
    grouped = items.join(wanted.select("doc_id", "node"), ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.array_sort(F.collect_list(F.struct("ordinal", "v"))).alias("s"))
    return grouped.select("doc_id", "node", F.transform("s", lambda x: x["v"]).alias("numbers"))


def _kids(corpus: Corpus) -> DataFrame:
    """``doc_id, list, ordinal, kid`` of Kids and Fields arrays alone."""
    return corpus.listed().select("doc_id", "list", "ordinal", "kid")


def page_tree(corpus: Corpus, budget: DataFrame | None = None) -> Walk:
    """The walk over all page trees (quiresmith.operators.traversal); ``type`` and the inherited ``state`` (MediaBox, CropBox, Rotate, Resources) of every visit.

    Bad is what isn't an indirect dictionary of type Page or Pages, and an inner node whose kids are no array.
    """
    inherited = ["MediaBox", "CropBox", "Rotate", "Resources"]
    attrs = held(corpus, ["Type", "Kids", "UserUnit", *inherited])
    attrs = attrs.select("doc_id", "node", F.col("Type.name").alias("type"), F.col("Kids.dst").alias("Kids"), F.col("Kids.kind").alias("Kids_kind"), *[F.col(f"{c}.dst").alias(c) for c in ("UserUnit", *inherited)])
    attrs = written(attrs, "page-attrs")
    root = members(corpus, ["Root"]).where("node = 0").select("doc_id", F.col("Root").alias("node"))
    no_state = F.lit(None).cast("struct<" + ",".join(f"{c}:int" for c in inherited) + ">")
    top = root.join(held(corpus, ["Pages"]), ["doc_id", "node"]).select("doc_id", F.col("Pages.dst").alias("node"), F.lit(0).alias("ordinal"), no_state.alias("up"), "Pages.kind", "Pages.indirect")

    def enter(level: DataFrame) -> DataFrame:
        level = level.join(attrs, ["doc_id", "node"], "left")
        bad = ~F.coalesce((F.col("kind") == "dictionary") & F.col("indirect"), F.lit(False)) | F.col("type").isNull() | ~F.col("type").isin("Page", "Pages") | ((F.col("type") == "Pages") & ~F.col("Kids_kind").eqNullSafe("array"))
        state = F.struct(*[F.coalesce(c, f"up.{c}").alias(c) for c in inherited])
        return level.select("doc_id", "node", "path", "above", "used", "budget", "up", "type", "UserUnit", state.alias("state"), F.when(F.col("type") == "Pages", F.col("Kids")).alias("list"), bad.alias("bad"))

    return walk(top, corpus.listed(), enter, budgets(corpus) if budget is None else budget, "page-level")


def pages(corpus: Corpus, tree: Walk | None = None) -> DataFrame:
    """``doc_id, page_index, node, media, crop, rotate, unit, resources, tree_status``: leaves of the page tree in order.

    Media, crop, rotation and resources come from the nearest ancestor that has them, the user unit from the page
    alone. A node that is met again has no pages; where the tree isn't sound, ``tree_status`` isn't OK: it is that of page_tree_status().
    """
    tree = page_tree(corpus) if tree is None else tree
    out = first_visits(tree.visits).where("type = 'Page'").select("doc_id", "node", "path", "UserUnit", "state.*")
    boxes = written(_numbers(corpus, out.select("doc_id", F.explode(F.array("MediaBox", "CropBox")).alias("node")).distinct()), "page-boxes")
    for c in ("MediaBox", "CropBox"):
        rect = F.when(F.size("numbers") == 4, geometry.rect(*[F.get("numbers", F.lit(i)) for i in range(4)]))
        out = out.join(boxes.select("doc_id", F.col("node").alias(c), rect.alias(f"{c}_rect")), ["doc_id", c], "left")
    for c in ("Rotate", "UserUnit"):
        number = corpus.facts().where(F.col("key") == c).select("doc_id", F.col("dst").alias(c), F.col("number").alias(f"{c}_number")).distinct()
        out = out.join(number, ["doc_id", c], "left")
    out = out.join(walk_status(tree), "doc_id", "left")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    turn = F.pmod(F.coalesce("Rotate_number", F.lit(0.0)).cast("int"), F.lit(360))
    return out.select("doc_id", index.alias("page_index"), "node", F.col("MediaBox_rect").alias("media"), F.coalesce("CropBox_rect", "MediaBox_rect").alias("crop"), turn.alias("rotate"), F.coalesce("UserUnit_number", F.lit(1.0)).alias("unit"), F.col("Resources").alias("resources"), F.col("walk_status").alias("tree_status"))


def page_tree_status(corpus: Corpus, tree: Walk | None = None) -> DataFrame:
    """``doc_id, tree_status`` of every readable document: FORMAT unless its page tree is one, UNSUPPORTED if the walk takes more than its budget.

    Every node is an indirect dictionary of type Page or Pages, inner ones list their kids in an array, no node is met twice,
    and the tree is no deeper than MAX_DEPTH; a document without a tree is FORMAT too.
    """
    found = walk_status(page_tree(corpus) if tree is None else tree)
    return corpus.documents.where("status = 'OK'").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("walk_status", F.lit("FORMAT")).alias("tree_status"))


def visible_geometry(pages: DataFrame) -> DataFrame:
    """Adds ``visible`` (media and crop in common), ``width``, ``height`` and ``geometry_status``: FORMAT without a visible area or with a bad unit or rotation."""
    seen = geometry.intersection(F.col("media"), F.col("crop"))
    out = pages.withColumn("visible", seen)
    good = F.col("visible").isNotNull() & (F.col("unit") > 0) & (F.col("unit") <= 75000) & (F.col("rotate") % 90 == 0)
    size = geometry.display_size(F.col("visible"), F.col("rotate"), F.col("unit"))
    return out.withColumn("geometry_status", F.when(good, "OK").otherwise("FORMAT")).withColumn("width", F.when(good, size["width"])).withColumn("height", F.when(good, size["height"]))


def metadata(corpus: Corpus) -> DataFrame:
    """One row per readable document: the eight fields, null if missing, and ``metadata_status``: FORMAT if one is no string."""
    info = members(corpus, ["Info"]).where("node = 0").select("doc_id", F.col("Info").alias("src"))
    fields = corpus.edges.where(F.col("key").isin(list(METADATA))).join(info, ["doc_id", "src"]).select("doc_id", "key", F.col("dst").alias("node"))
    known = fields.join(corpus.nodes.select("doc_id", "node", "kind", "data"), ["doc_id", "node"]).where("kind <> 'null'")
    texts = known.groupBy("doc_id").agg(F.max((F.col("kind") != "string").cast("int")).alias("bad"), *[F.max(F.when((F.col("key") == k) & (F.col("kind") == "string"), F.col("data"))).alias(k) for k in METADATA])
    out = corpus.documents.where("status = 'OK'").select("doc_id").join(texts, "doc_id", "left")
    fine = F.coalesce(F.col("bad"), F.lit(0)) == 0
    return out.select("doc_id", F.when(fine, "OK").otherwise("FORMAT").alias("metadata_status"), *[F.when(fine, decode_text(F.col(k))).alias(k) for k in METADATA])


def chain_ranks(links: DataFrame) -> DataFrame:
    """``doc_id, node, ordinal`` of linked lists (doc_id, node, before): places from 0, by pointer doubling; members of loops get none."""
    state = written(links.select("doc_id", "node", F.col("before").alias("jump"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("ordinal")), "chain")
    for _ in range(32):
        if state.where("jump IS NOT NULL").isEmpty():
            break
        there = state.select("doc_id", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("ordinal").alias("more"))
        state = written(state.join(there, ["doc_id", "jump"], "left").select("doc_id", "node", F.col("next").alias("jump"), (F.col("ordinal") + F.coalesce("more", F.lit(0))).alias("ordinal")), "chain")
    return state.where("jump IS NULL").select("doc_id", "node", "ordinal")


def outline(corpus: Corpus) -> DataFrame:
    """``doc_id, index, parent_index, first_child, next_sibling, title, uri, is_open`` in pre-order."""
    own = held(corpus, ["Title", "Parent", "Next", "Count", "A"])
    own = own.select("doc_id", "node", F.col("Count.number").alias("Count_number"), *[F.col(f"{c}.dst").alias(c) for c in ("Title", "Parent", "Next", "A")])
    items = written(own.where("Title IS NOT NULL AND Parent IS NOT NULL"), "outline")
    before = items.where("Next IS NOT NULL").select("doc_id", F.col("Next").alias("node"), F.col("node").alias("before"))
    ranks = chain_ranks(items.select("doc_id", "node").join(before, ["doc_id", "node"], "left"))
    inner = items.select("doc_id", F.col("node").alias("Parent"), F.lit(True).alias("inner"))
    tree = items.join(ranks, ["doc_id", "node"]).join(inner, ["doc_id", "Parent"], "left").select("doc_id", "node", F.when(F.col("inner"), F.col("Parent")).alias("parent"), "ordinal")
    placed = preorder(tree, tree="doc_id").withColumnRenamed("tree", "doc_id")
    uris = members(corpus, ["URI"]).withColumnRenamed("node", "A").join(values(corpus, "URI"), ["doc_id", "URI"]).select("doc_id", "A", decode_text(F.col("URI_data")).alias("uri"))
    facts = items.join(values(corpus, "Title"), ["doc_id", "Title"], "left").join(uris, ["doc_id", "A"], "left")
    facts = facts.select("doc_id", "node", decode_text(F.col("Title_data")).alias("title"), "uri", (F.coalesce("Count_number", F.lit(0.0)) > 0).alias("is_open"))
    return placed.join(facts, ["doc_id", "node"]).drop("node")


def page_annotations(corpus: Corpus, page_table: DataFrame) -> DataFrame:
    """``doc_id, page_index, ordinal, subtype, rect, flags, contents, A, Dest``: every annotation of every page, links and widgets too."""
    lists = members(corpus, ["Annots"]).join(page_table.select("doc_id", "node", "page_index"), ["doc_id", "node"])
    items = corpus.facts().where("key IS NULL").select("doc_id", F.col("src").alias("Annots"), "ordinal", F.col("dst").alias("node"))
    own = held(corpus, ["Subtype", "Rect", "F", "Contents", "A", "Dest"])
    own = own.select("doc_id", "node", F.col("Subtype.name").alias("Subtype_name"), F.col("F.number").alias("F_number"), *[F.col(f"{c}.dst").alias(c) for c in ("Rect", "Contents", "A", "Dest")])
    facts = lists.select("doc_id", "page_index", "Annots").join(items, ["doc_id", "Annots"]).join(own, ["doc_id", "node"]).join(values(corpus, "Contents"), ["doc_id", "Contents"], "left")
    wanted = corpus.facts().where("key = 'Rect'").select("doc_id", F.col("dst").alias("node"))
    rects = _numbers(corpus, wanted).select("doc_id", F.col("node").alias("Rect"), F.when(F.size("numbers") == 4, geometry.rect(*[F.get("numbers", F.lit(i)) for i in range(4)])).alias("bounds"))
    return facts.join(rects, ["doc_id", "Rect"], "left").select("doc_id", "page_index", "ordinal", F.col("Subtype_name").alias("subtype"), F.col("bounds").alias("rect"), F.coalesce("F_number", F.lit(0.0)).cast("long").alias("flags"), decode_text(F.col("Contents_data")).alias("contents"), "A", "Dest")


def annotations(corpus: Corpus, page_table: DataFrame) -> DataFrame:
    """Annotations but links, popups and widgets."""
    return page_annotations(corpus, page_table).where(~F.col("subtype").isin(list(NOT_ANNOTATIONS))).drop("A", "Dest")


def named_destinations(corpus: Corpus) -> DataFrame:
    """``doc_id, name, dest``: destination arrays by name, from the catalog's dictionary, else from its name tree.

    Of names given twice in the tree the first in its order holds. A node that is met again, or below MAX_DEPTH, has no
    names, nor has what is left when the walk has used up its budget.
    """
    root = members(corpus, ["Root"]).where("node = 0").select("doc_id", F.col("Root").alias("node"))
    catalog = written(root.join(members(corpus, ["Dests", "Names"]), ["doc_id", "node"]), "catalog")
    no_path = F.array().cast("array<int>")
    found = corpus.edges.where("key IS NOT NULL").withColumnRenamed("src", "Dests").join(catalog.select("doc_id", "Dests"), ["doc_id", "Dests"])
    found = found.select("doc_id", F.col("key").alias("name"), F.col("dst").alias("value"), F.lit(0).alias("rank"), no_path.alias("path"))
    attrs = written(members(corpus, ["Kids", "Names"]), "name-attrs")
    items = corpus.edges.where("key IS NULL").select("doc_id", "src", "ordinal", "dst")
    texts = corpus.nodes.where("kind = 'string'").select("doc_id", F.col("node").alias("text"), F.decode("data", "ISO-8859-1").alias("name"))
    tree = catalog.select("doc_id", F.col("Names").alias("node")).join(members(corpus, ["Dests"]), ["doc_id", "node"]).select("doc_id", F.col("Dests").alias("node"))
    enter = lambda level: level.join(attrs, ["doc_id", "node"]).select(*level.columns, "Names", F.col("Kids").alias("list"), F.lit(True).alias("state"), F.lit(False).alias("bad"))
    done = walk(tree.select("doc_id", "node", F.lit(0).alias("ordinal"), F.lit(True).alias("up")), _kids(corpus), enter, budgets(corpus), "name-level")
    listed = first_visits(done.visits).where("Names IS NOT NULL").join(items.withColumnRenamed("src", "Names"), ["doc_id", "Names"]).withColumn("pair", F.floor(F.col("ordinal") / 2).cast("int"))
    pairs = listed.groupBy("doc_id", "path", "node", "pair").agg(*[F.max(F.when(F.col("ordinal") % 2 == i, F.col("dst"))).alias(c) for i, c in enumerate(("text", "value"))])
    pairs = pairs.join(texts, ["doc_id", "text"]).where("value IS NOT NULL")
    found = found.unionByName(pairs.select("doc_id", "name", "value", F.lit(1).alias("rank"), F.concat("path", F.array("pair")).alias("path")))
    inner = members(corpus, ["D"]).withColumnRenamed("node", "value")
    found = found.join(inner, ["doc_id", "value"], "left").withColumn("dest", F.coalesce("D", "value"))
    return found.groupBy("doc_id", "name").agg(F.min_by("dest", F.struct("rank", "path")).alias("dest"))


def links(corpus: Corpus, page_table: DataFrame) -> DataFrame:
    """``doc_id, page_index, ordinal, hotspot, uri, target_page, target``: hotspot as shown; named destinations are looked up, points only of XYZ."""
    found = page_annotations(corpus, page_table).where("subtype = 'Link'")
    actions = members(corpus, ["S", "URI", "D"]).withColumnRenamed("node", "A").join(values(corpus, "URI"), ["doc_id", "URI"], "left").select("doc_id", "A", decode_text(F.col("URI_data")).alias("uri"), "D")
    found = found.join(actions, ["doc_id", "A"], "left").withColumn("dest", F.coalesce("Dest", "D"))
    named = corpus.nodes.where("kind IN ('name', 'string')").select("doc_id", F.col("node").alias("dest"), F.decode("data", "ISO-8859-1").alias("_name"))
    known = named_destinations(corpus).select("doc_id", F.col("name").alias("_name"), F.col("dest").alias("_named"))
    found = written(found, "links")
    # few links have destinations: what these are is asked for them alone
    dests = found.where("dest IS NOT NULL").select("doc_id", "dest").distinct().join(named, ["doc_id", "dest"], "left").join(known, ["doc_id", "_name"], "left")
    dests = written(dests.select("doc_id", "dest", F.coalesce("_named", "dest").alias("_to")), "link-destinations")
    found = found.join(dests, ["doc_id", "dest"], "left").withColumn("dest", F.col("_to")).drop("_to")
    asked = dests.select("doc_id", F.col("_to").alias("node")).distinct()
    items = corpus.facts().where("key IS NULL AND ordinal < 2").join(asked.withColumnRenamed("node", "src"), ["doc_id", "src"], "left_semi")
    first = items.where("ordinal = 0").select("doc_id", F.col("src").alias("dest"), F.col("dst").alias("_page"))
    kind = items.where("ordinal = 1 AND kind = 'name'").select("doc_id", F.col("src").alias("dest"), F.col("name").alias("_kind_name"))
    there = page_table.select("doc_id", F.col("node").alias("_page"), F.col("page_index").alias("target_page"), F.col("crop").alias("_box"), F.col("rotate").alias("_turn"), F.col("unit").alias("_unit"))
    here = page_table.select("doc_id", "page_index", "crop", "rotate", "unit")
    out = found.join(here, ["doc_id", "page_index"]).join(first, ["doc_id", "dest"], "left").join(kind, ["doc_id", "dest"], "left")
    out = out.join(there, ["doc_id", "_page"], "left").join(_numbers(corpus, asked).select("doc_id", F.col("node").alias("dest"), "numbers"), ["doc_id", "dest"], "left")
    at = lambda i: F.coalesce(F.get("numbers", F.lit(i)), F.lit(0.0))
    point = geometry.to_display(at(2), at(3), F.col("_box"), F.col("_turn"), F.col("_unit"))
    target = F.when(F.col("target_page").isNotNull(), F.when((F.col("_kind_name") == "XYZ") & (F.size("numbers") == 5), point).otherwise(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))
    hotspot = geometry.rect_by(geometry.to_display, F.col("rect"), F.col("crop"), F.col("rotate"), F.col("unit"))
    return out.select("doc_id", "page_index", "ordinal", hotspot.alias("hotspot"), "uri", "target_page", target.alias("target"))


def field_tree(corpus: Corpus, budget: DataFrame | None = None) -> Walk:
    """The walk over the fields of the catalogs' forms; ``name`` and ``state`` (full_name, FT, V, the last two from the nearest ancestor) of every visit.

    Bad is what isn't a dictionary, and a field whose Kids are no array.
    """
    attrs = held(corpus, ["T", "Kids", "FT", "V"])
    attrs = attrs.select("doc_id", "node", F.col("Kids.kind").alias("Kids_kind"), *[F.col(f"{c}.dst").alias(c) for c in ("T", "Kids", "FT", "V")])
    text = values(corpus, "T").select("doc_id", "T", decode_text(F.col("T_data")).alias("name"))
    attrs = written(attrs.join(text, ["doc_id", "T"], "left"), "field-attrs")
    root = members(corpus, ["Root"]).where("node = 0").select("doc_id", F.col("Root").alias("node"))
    form = root.join(members(corpus, ["AcroForm"]), ["doc_id", "node"]).select("doc_id", F.col("AcroForm").alias("node")).join(members(corpus, ["Fields"]), ["doc_id", "node"]).select("doc_id", F.col("Fields").alias("list"))
    none = F.lit(None).cast("struct<full_name:string,FT:int,V:int>")
    kids = corpus.listed()
    start = form.join(kids, ["doc_id", "list"]).select("doc_id", F.col("kid").alias("node"), "ordinal", none.alias("up"), "kind", "indirect")

    def enter(level: DataFrame) -> DataFrame:
        level = level.join(attrs, ["doc_id", "node"], "left")
        full = F.when(F.col("name").isNull(), F.col("up.full_name")).otherwise(F.concat_ws(".", "up.full_name", "name"))
        state = F.struct(full.alias("full_name"), F.coalesce("FT", "up.FT").alias("FT"), F.coalesce("V", "up.V").alias("V"))
        bad = ~F.col("kind").eqNullSafe("dictionary") | (F.col("Kids").isNotNull() & ~F.col("Kids_kind").isin("array", "null"))
        return level.select("doc_id", "node", "path", "above", "used", "budget", "up", "name", state.alias("state"), F.when(F.col("Kids_kind") == "array", F.col("Kids")).alias("list"), bad.alias("bad"))

    return walk(start, kids, enter, budgets(corpus) if budget is None else budget, "fields")


def form_fields(corpus: Corpus, tree: Walk | None = None) -> DataFrame:
    """``doc_id, node, full_name, type, value, form_status``: fields with a name, type and value from the nearest ancestor.

    ``form_status`` isn't OK where the fields of a document are no tree (FORMAT) or take more visits than its budget (UNSUPPORTED); a field that
    is met again has no second row.
    """
    tree = field_tree(corpus) if tree is None else tree
    out = first_visits(tree.visits).where("name IS NOT NULL").select("doc_id", "node", "state.*")
    types = corpus.facts().where("key = 'FT' AND kind = 'name'").select("doc_id", F.col("dst").alias("FT"), F.col("name").alias("FT_name")).distinct()
    out = out.join(types, ["doc_id", "FT"], "left").join(values(corpus, "V"), ["doc_id", "V"], "left").join(walk_status(tree), "doc_id")
    return out.select("doc_id", "node", "full_name", F.col("FT_name").alias("type"), decode_text(F.col("V_data")).alias("value"), F.col("walk_status").alias("form_status"))


def live_edges(corpus: Corpus) -> DataFrame:
    """``doc_id, src, ordinal, key, dst, kind, name``: members that aren't null, with the kind of their value and its name, if it is one."""
    return corpus.facts().where("kind <> 'null'").select("doc_id", "src", "ordinal", "key", "dst", "kind", "name")


def _member(edges: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """``doc_id, node, kind``: the member ``key`` of the nodes in ``of`` (doc_id, node)."""
    return edges.where(F.col("key") == key).join(of.select("doc_id", F.col("node").alias("src")), ["doc_id", "src"], "left_semi").select("doc_id", F.col("dst").alias("node"), "kind")


def _closure(start: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``doc_id, node`` and what is reached from them over edges (doc_id, src, dst)."""
    seen = level = written(start.select("doc_id", "node").distinct(), name)
    step = written(edges.select("doc_id", F.col("src").alias("node"), "dst"), name)
    while True:
        found = level.join(step, ["doc_id", "node"]).select("doc_id", F.col("dst").alias("node")).distinct()
        level = written(found.join(seen, ["doc_id", "node"], "left_anti"), name)
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def action_class(name: Column) -> Column:
    """The finding bit of an action's kind: 0 for GoTo."""
    bit = FINDING_BITS
    return F.when(name == "JavaScript", bit["javascript"]).when(name == "Launch", bit["launch"]).when(name.isin(list(EXTERNAL_ACTIONS)), bit["external"]).when(name == "GoTo", 0).otherwise(bit["other_action"])


def catalogs(edges: DataFrame) -> DataFrame:
    """``doc_id, node`` of the catalogs."""
    return edges.where("src = 0 AND key = 'Root'").select("doc_id", F.col("dst").alias("node"))


def actions(edges: DataFrame, kids: DataFrame | None = None) -> DataFrame:
    """``doc_id, via, node, finding, broken`` of all actions, by the edge ``via`` (src, key, dst) that leads there. ``kids``: what lists of kids hold, if known.

    Actions are what a catalog's OpenAction (if it is no destination), any A, any member of an AA, the JavaScript name tree
    and, from there on, Next lead to. ``broken`` marks what is no dictionary or has no kind.
    """
    root = catalogs(edges)
    names = _member(edges, root, "Names")
    lists = edges.where("key = 'Kids'").select("doc_id", "src", "dst")
    items = (edges.where("key IS NULL").select("doc_id", F.col("src").alias("dst"), F.col("dst").alias("kid")) if kids is None else kids.select("doc_id", F.col("list").alias("dst"), "kid"))
    tree = _closure(_member(edges, names, "JavaScript"), lists.join(items, ["doc_id", "dst"]).select("doc_id", "src", F.col("kid").alias("dst")), "script-tree")
    open_action = edges.join(root.withColumnRenamed("node", "src"), ["doc_id", "src"], "left_semi").where("key = 'OpenAction' AND kind NOT IN ('array', 'name', 'string')")
    additional = edges.join(few(edges.where("key = 'AA'").select("doc_id", F.col("dst").alias("src")).distinct(), "additional"), ["doc_id", "src"], "left_semi")
    scripts = edges.where("key IS NULL AND ordinal % 2 = 1").join(few(_member(edges, tree, "Names").withColumnRenamed("node", "src").select("doc_id", "src"), "script-names"), ["doc_id", "src"], "left_semi")
    start = open_action.unionByName(edges.where("key = 'A'")).unionByName(additional).unionByName(scripts)
    listed = edges.where("key IS NULL").join(few(edges.where("key = 'Next' AND kind = 'array'").select("doc_id", F.col("src").alias("from"), F.col("dst").alias("src")), "next-lists"), ["doc_id", "src"])
    follow = edges.where("key = 'Next' AND kind <> 'array'").select("doc_id", F.col("src").alias("from"), "src", "ordinal", "key", "dst", "kind", "name").unionByName(listed.select("doc_id", "from", "src", "ordinal", "key", "dst", "kind", "name"))
    reached = _closure(start.select("doc_id", F.col("dst").alias("node")), follow.select("doc_id", F.col("from").alias("src"), "dst"), "actions")
    after = follow.join(reached.withColumnRenamed("node", "from"), ["doc_id", "from"], "left_semi")
    every = start.unionByName(after.drop("from")).select("doc_id", F.struct("src", "key", "ordinal", "dst").alias("via"), F.col("dst").alias("node"), "kind").distinct()
    kinds = edges.where("key = 'S'").select("doc_id", F.col("src").alias("node"), F.col("name").alias("action"))
    return every.join(kinds, ["doc_id", "node"], "left").select("doc_id", "via", "node", F.when(F.col("action").isNotNull(), action_class(F.col("action"))).otherwise(0).alias("finding"), ((F.col("kind") != "dictionary") | F.col("action").isNull()).alias("broken"))


def audit(corpus: Corpus) -> DataFrame:
    """``doc_id, audit_status, findings`` of every readable document; FORMAT and null where an action, an AA or an annotation list isn't what it has to be.

    Findings are bits of FINDING_BITS, united over the whole document: actions by kind, a JavaScript name tree,
    embedded files, XFA forms, rich-media annotations, signatures (of permissions, and values of fields of that type) and encryption.
    """
    bit = FINDING_BITS
    edges = live_edges(corpus)
    root = catalogs(edges)
    kids = corpus.listed().where("kind <> 'null'").select("doc_id", "list", "kid")
    done = written(actions(edges, kids), "actions")
    names, form = _member(edges, root, "Names"), _member(edges, root, "AcroForm")
    held = lambda df, value: df.select("doc_id", F.lit(value).alias("b"))
    annots = edges.where("key IS NULL").join(edges.where("key = 'Annots' AND kind = 'array'").select("doc_id", F.col("dst").alias("src")).distinct(), ["doc_id", "src"], "left_semi")
    annots = written(annots.select("doc_id", "dst", "kind"), "audit-annotations")
    found_kinds = few(edges.where((F.col("key") == "Subtype") & F.col("name").isin("FileAttachment", *RICH_MEDIA)).select("doc_id", "src", "name"), "rich-kinds")
    subtypes = annots.select("doc_id", F.col("dst").alias("src")).join(found_kinds, ["doc_id", "src"])
    lists = edges.where("key = 'Kids' AND kind = 'array'").select("doc_id", F.col("src").alias("node"), F.col("dst").alias("list"))
    fields = _member(edges, form, "Fields").select("doc_id", F.col("node").alias("list")).join(kids, ["doc_id", "list"]).select("doc_id", F.col("kid").alias("node"))
    signed = _signed_fields(edges, fields, lists.join(kids, ["doc_id", "list"]).select("doc_id", "node", "kid"), budgets(corpus))
    permissions = edges.where("key IN ('DocMDP', 'UR', 'UR3')").join(_member(edges, root, "Perms").withColumnRenamed("node", "src").select("doc_id", "src"), ["doc_id", "src"], "left_semi")
    streams = corpus.nodes.where("kind = 'stream'").select("doc_id", F.col("node").alias("src"))
    found = [
        done.select("doc_id", F.col("finding").alias("b")),
        held(_member(edges, names, "JavaScript"), bit["javascript"]), held(_member(edges, names, "EmbeddedFiles"), bit["embedded_file"]), held(_member(edges, form, "XFA"), bit["xfa"]),
        held(edges.where("key IN ('AF', 'EF')"), bit["embedded_file"]), held(edges.where("key = 'Type' AND name = 'EmbeddedFile'").join(streams, ["doc_id", "src"], "left_semi"), bit["embedded_file"]),
        held(subtypes.where("name = 'FileAttachment'"), bit["embedded_file"]), held(subtypes.where(F.col("name").isin(list(RICH_MEDIA))), bit["rich_media"]),
        held(permissions, bit["signature"]), held(signed, bit["signature"]), held(edges.where("src = 0 AND key = 'Encrypt'"), bit["encryption"]),
    ]
    bits = found[0]
    for more in found[1:]:
        bits = bits.unionByName(more)
    bits = bits.groupBy("doc_id").agg(F.bit_or("b").alias("findings"))
    wrong = done.where("broken").select("doc_id").unionByName(edges.where("key = 'AA' AND kind <> 'dictionary' OR key = 'Annots' AND kind <> 'array'").select("doc_id"))
    wrong = wrong.unionByName(annots.where("kind <> 'dictionary'").select("doc_id")).distinct().withColumn("wrong", F.lit(True))
    out = corpus.documents.where("status = 'OK'").select("doc_id").join(bits, "doc_id", "left").join(wrong, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("wrong"), "FORMAT").otherwise("OK").alias("audit_status"), F.when(F.col("wrong").isNull(), F.coalesce("findings", F.lit(0))).alias("findings"))


def _signed_fields(edges: DataFrame, fields: DataFrame, kids: DataFrame, budget: DataFrame) -> DataFrame:
    """``doc_id, node`` of form fields of type Sig that have a value; both come from the nearest ancestor. A field that is met again isn't entered."""
    types = edges.where("key = 'FT'").select("doc_id", F.col("src").alias("node"), F.col("name").alias("own_type"))
    filled = edges.where("key = 'V'").select("doc_id", F.col("src").alias("node"), F.lit(True).alias("own_value"))
    start = fields.select("doc_id", "node", F.lit(0).alias("ordinal"), F.lit(None).cast("struct<type:string,value:boolean>").alias("up"))

    def enter(level: DataFrame) -> DataFrame:
        level = level.join(types, ["doc_id", "node"], "left").join(filled, ["doc_id", "node"], "left")
        state = F.struct(F.coalesce("own_type", "up.type").alias("type"), F.coalesce("own_value", "up.value", F.lit(False)).alias("value"))
        return level.select("doc_id", "node", "path", "above", "used", "budget", "up", state.alias("state"), F.col("node").alias("list"), F.lit(False).alias("bad"))

    listed = kids.select("doc_id", F.col("node").alias("list"), F.lit(0).alias("ordinal"), "kid")
    return walk(start, listed, enter, budget, "signed").visits.where("state.type = 'Sig' AND state.value").select("doc_id", "node")
