"""Main text of web pages by site style trees (operator 8).

The pages of a host are merged by the style paths of their elements. A
presentation node matters as far as the layouts of its children differ from
page to page (entropy over the host's pages); a content block matters as far as
its text is not spread over the pages that have a block at this path. Branches
of low importance are removed, inside an article or main element too.

What tags and classes say about a role is the prior. Names of menus, footers,
adverts, notices and comments remove a branch; weaker ones (header, share,
newsletter, ...) only where the tree has no better evidence of content. Blocks
outside an article stay if the tree speaks for them: their path occurs on other
pages of the host, with other texts, and they aren't links alone. An article
most of whose text is repeated is a reprint: its blocks stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.session import written

# Element names and class words of common page roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("head nav aside footer button select option dialog menu audio video".split())
NOISE_WORDS = frozenset("nav navbar navigation menu footer sidebar ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices comment comments disqus respond related recommended".split())
WEAK_WORDS = frozenset("aside breadcrumb breadcrumbs header masthead modal newsletter pager pagination popup share sharing signup social subscribe toolbar".split())
LANDMARKS = frozenset(["article", "main"])
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th article main section div body html nav aside header footer form blockquote figure".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*\Z|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
LOW_IMPORTANCE = 0.3
#: Weights of roles: outside the page's landmark, of weak noise words.
OUTSIDE = 0.25
WEAK = 0.4
PRESENTATION = 0.1
#: Inside a landmark a block goes from this importance down, given so many different articles.
LOW_INSIDE = 0.25
LEAST_PAGES = 4
#: Places of removed blocks that are broadcast to the pages; beyond it pages are joined by shuffle.
BROADCAST_BLOCKS = 2_000_000
BLOCK = "array<struct<text:string,path:int,parent:int,feature:long,weight:double,inside:boolean,fresh:boolean>>"


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag, names in lower case, values decoded; the first of equal names holds."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def noise(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """What an element's own tag or attributes say: 0 nothing, 1 weakly that it isn't content, 2 that it isn't."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return 2
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return 2
    if tag in ("html", "body") or tag in LANDMARKS or attrs.get("role") in LANDMARKS:
        return 0
    names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower().split()
    parts = [frozenset(filter(None, re.split(r"[^a-z0-9]+", n))) for n in names]
    if any(p and NOISE_WORDS.issuperset(p) for p in parts):
        return 2
    return int(bool(parts) and all(p and (NOISE_WORDS | WEAK_WORDS).issuperset(p) for p in parts))


class Element(NamedTuple):
    """An open element."""

    tag: str
    path: int
    #: As of noise(); 3 inside a block, where texts are not read.
    role: int
    inside: bool
    #: Number of the form around it; 0 for none.
    form: int


class Page:
    """Blocks and containers of one page, in time linear in its length."""

    def __init__(self, html: str):
        self.blocks: list[dict] = []
        self.layouts: dict[tuple[int, bool], list[int]] = {}
        self.has_landmark = False
        self.stack = [Element("", 0, 0, False, 0)]
        #: Places in the stack of elements that aren't inline, and how many of each name are open.
        self.block_at = [0]
        self.opened: Counter[str] = Counter()
        self.forms = 0
        #: Forms that hold a landmark.
        self.wrappers: set[int] = {0}
        self.open_text: list[str] = []
        #: Whether the open text has been in links alone.
        self.linked = True
        at = 0
        skip_to = 0
        for m in TOKEN.finditer(html):
            if m.start() < skip_to:
                continue
            self._text(html[at : m.start()])
            at = m.end()
            closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
                continue
            if tag in RAW:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = skip_to = end.end() if end else len(html)
                if tag not in INLINE:
                    self._flush()
                continue
            self._open(tag, rest)
        self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and self.stack[-1].role < 3:
            self.open_text.append(raw)
            if self.linked and not self.stack[-1].inside and raw.strip():
                self.linked = self.opened["a"] > 0

    def _flush(self) -> None:
        text = SPACE.sub(" ", unescape("".join(self.open_text))).strip()
        self.open_text.clear()
        if text:
            block, above = self.stack[self.block_at[-1]], self.stack[max(0, self.block_at[-1] - 1)]
            self.blocks.append({"text": text, "path": block.path, "parent": above.path, "inside": block.inside, "role": block.role, "form": block.form, "linked": self.linked})
        self.linked = True

    def _push(self, element: Element) -> None:
        if element.tag not in INLINE:
            self.block_at.append(len(self.stack))
        self.stack.append(element)
        self.opened[element.tag] += 1

    def _cut(self, at: int) -> None:
        for element in self.stack[at:]:
            self.opened[element.tag] -= 1
        del self.stack[at:]
        while self.block_at[-1] >= at:
            self.block_at.pop()

    def _open(self, tag: str, rest: str) -> None:
        top = self.stack[-1]
        if tag in INLINE:
            if tag == "br":
                self._text(" ")
            if tag not in VOID:
                attrs = attributes(rest) if rest.strip() else {}
                off = attrs and not top.role and noise(tag, attrs, top.inside) == 2
                self._push(top._replace(tag=tag, role=3 if off else top.role))
            return
        self._flush()
        self._close_implied(tag)
        if tag in VOID:
            return
        attrs = attributes(rest) if rest.strip() else {}
        top = self.stack[-1]
        landmark = tag in LANDMARKS or attrs.get("role") in LANDMARKS
        role = max(top.role, noise(tag, attrs, top.inside or landmark))
        style = crc32(f"{tag}.{'.'.join(sorted(attrs.get('class', '').split()))}".encode())
        path = crc32(style.to_bytes(4, "big"), top.path) & 0x7FFFFFFF
        self.layouts.setdefault((top.path, top.inside), []).append(style)
        form = top.form
        if tag == "form" and not form:
            self.forms += 1
            form = self.forms
        if landmark and role < 2:
            self.has_landmark = True
            self.wrappers.add(top.form)
        if not rest.rstrip().endswith("/"):
            self._push(Element(tag, path, role, top.inside or (landmark and role < 2), form))

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list items, cells and rows end their like."""
        closed = CLOSES.get(tag, frozenset()) | {"p"}
        if not any(self.opened[c] for c in closed):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i].tag
            if name in closed:
                self._cut(i)
                return
            if name in SCOPES:
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self.opened[tag]:
            self._cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag))

    def weighted(self) -> list[dict]:
        """Blocks with the hash of their text, whether it is the first at its path, and the weight of their role; texts of noise and of links outside a landmark are not kept.

        A form is noise, unless it holds the landmark or most of the text of a page without one.
        """
        total = sum(len(b["text"]) for b in self.blocks if b["role"] < 2)
        by_form = Counter()
        for b in self.blocks:
            if b["role"] < 2:
                by_form[b["form"]] += len(b["text"])
        wrappers = self.wrappers | ({f for f, n in by_form.items() if 2 * n > total} if not self.has_landmark else set())
        out, before = [], set()
        for b in self.blocks:
            role, linked, form = b.pop("role"), b.pop("linked"), b.pop("form")
            outside = self.has_landmark and not b["inside"]
            gone = role >= 2 or form not in wrappers or (outside and (role or linked))
            weight = 0.0 if gone else OUTSIDE if outside else WEAK if role else 1.0
            raw = b["text"].encode("utf-8", "surrogatepass")
            feature, inside = crc32(raw) << 31 | crc32(raw[::-1]) >> 1, b["inside"] and weight == 1.0
            fresh = (b["path"], feature, inside) not in before
            before.add((b["path"], feature, inside))
            out.append(b | {"text": None if gone else b["text"], "feature": feature, "weight": weight, "inside": inside, "fresh": fresh})
        return out


def _digest(value: object) -> int:
    return int.from_bytes(blake2b(repr(value).encode(), digest_size=8).digest(), "big", signed=True)


def parse_pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``page_id, url, host, uid, shape, article, blocks, layouts``: the content blocks of each page, the layouts of its containers, a hash of both and one of the blocks in landmarks."""
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.xxhash64(F.col(page_id), F.col(url), F.col(html)).alias("uid"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    schema = f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, host string, uid long, shape long, article long, blocks {BLOCK}, layouts array<struct<path:int,style:long,inside:boolean>>"
    block_type = pa.list_(pa.struct([("text", pa.string()), ("path", pa.int32()), ("parent", pa.int32()), ("feature", pa.int64()), ("weight", pa.float64()), ("inside", pa.bool_()), ("fresh", pa.bool_())]))
    layout_type = pa.list_(pa.struct([("path", pa.int32()), ("style", pa.int64()), ("inside", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, layouts, shapes, articles = [], [], [], []
            for source in batch.column(4):
                page = Page(source.as_py())
                blocks.append(page.weighted())
                layouts.append([{"path": p, "style": crc32(repr(s).encode()), "inside": inside} for (p, inside), s in page.layouts.items()])
                seen = [(b["path"], b["feature"], b["inside"]) for b in blocks[-1]]
                shapes.append(_digest((seen, page.layouts)))
                articles.append(_digest([b for b in seen if b[2]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shapes, pa.int64()), pa.array(articles, pa.int64()), pa.array(blocks, block_type), pa.array(layouts, layout_type)], ["page_id", "url", "host", "uid", "shape", "article", "blocks", "layouts"])

    return rows.mapInArrow(run, schema)


def style_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``node, feature, k, m, importance`` of texts on several pages; ``node, m, presentation`` of all nodes).

    A node is a style path of one host, apart for what stands inside landmarks and what outside; ``m`` pages have
    it. Pages that are the same in blocks and layouts count once, however often they are published; inside
    landmarks all pages with one and the same article are one. A text on k of the m pages has the importance
    1 - log k / log m; a container that of the entropy of its layouts. All counts are pre-aggregated.
    """

    def side(inside: bool) -> DataFrame:
        of = lambda c: F.filter(c, lambda x: x["inside"] if inside else ~x["inside"])
        pairs = F.transform(F.filter(of("blocks"), lambda b: b["fresh"]), lambda b: F.struct(b["path"].alias("path"), b["feature"].alias("feature")))
        return parsed.select("host", F.lit(inside).alias("inside"), F.col("article" if inside else "shape").alias("context"), pairs.alias("blocks"), of("layouts").alias("layouts"))

    pages = side(True).union(side(False)).where("size(blocks) > 0 or size(layouts) > 0").dropDuplicates(["host", "inside", "context"])
    node = lambda path: node_key(F.col("host"), F.col("inside"), path).alias("node")
    blocks = pages.select("host", "inside", F.explode("blocks").alias("b")).select(node(F.col("b.path")), F.col("b.feature").alias("feature"))
    per_text = blocks.groupBy("node", "feature").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    paths = pages.select("host", "inside", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["path"]))).alias("path"))
    per_path = paths.groupBy(node(F.col("path"))).agg(F.count(F.lit(1)).alias("m"))
    content = per_text.join(per_path.where("m > 1"), "node").withColumn("importance", 1 - F.log("k") / F.log("m"))
    layouts = pages.select("host", "inside", F.explode("layouts").alias("l")).groupBy(node(F.col("l.path")), F.col("l.style").alias("style")).agg(F.count(F.lit(1)).alias("c"))
    sums = layouts.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    presentation = sums.select("node", F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0).alias("presentation"))
    return content, per_path.join(presentation, "node", "full")


def node_key(host, inside, path):
    """The number of a style node."""
    return F.xxhash64(host, inside, path)


def removed_blocks(parsed: DataFrame, low: float = LOW_IMPORTANCE) -> DataFrame:
    """``uid, removed``: places of the blocks of a page that the style tree removes.

    Inside landmarks a block goes if its text is on so many of the host's different articles that its importance is
    at most LOW_INSIDE, given LEAST_PAGES of them. Other blocks have the importance of their text and, a tenth,
    of their container's layouts. Blocks of no weak or outside role go below ``low``; weak ones unless LEAST_PAGES
    tell their weighted importance; those outside the landmark unless other pages have the path, and the
    importance, to the power of 1 / weight, is ``low`` or more.
    """
    content, nodes = style_tree(parsed)
    at = parsed.select("uid", "host", F.posexplode(F.transform("blocks", lambda b: b.dropFields("text").withField("open", b["text"].isNotNull()))).alias("at", "b")).where("b.open")
    at = at.select("uid", "at", "host", "b.*")
    inside = at.where("inside").select("uid", "at", node_key(F.col("host"), F.lit(True), F.col("path")).alias("node"), "feature")
    spread = content.where((F.col("m") >= LEAST_PAGES) & (F.col("importance") <= LOW_INSIDE)).select("node", "feature")
    gone = inside.join(spread, ["node", "feature"], "left_semi").select("uid", "at")
    outside = at.where("not inside").select("uid", "at", "weight", "feature", *(node_key(F.col("host"), F.lit(False), F.col(c)).alias(n) for c, n in (("path", "node"), ("parent", "above"))))
    judged = outside.join(content.select("node", "feature", "importance"), ["node", "feature"], "left").join(nodes.select("node", F.coalesce("m", F.lit(1)).alias("m")), "node", "left")
    judged = judged.join(nodes.select(F.col("node").alias("above"), "presentation"), "above", "left")
    importance = PRESENTATION * F.coalesce("presentation", F.lit(1.0)) + (1 - PRESENTATION) * F.coalesce("importance", F.lit(1.0))
    value = F.when(F.col("weight") == 1, importance).when(F.col("weight") == WEAK, F.when(F.col("m") >= LEAST_PAGES, F.col("weight") * importance).otherwise(0.0))
    value = value.otherwise(F.when(F.col("m") > 1, F.pow(importance, 1 / F.col("weight"))).otherwise(0.0))
    return gone.union(judged.where(value < low).select("uid", "at")).groupBy("uid").agg(F.collect_set("at").alias("removed"))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", low: float = LOW_IMPORTANCE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: its content blocks in page order, two line feeds between them.

    Character references are decoded and white space in a block is one space; br is white space. A null html
    is empty and has the empty text; pages without a host form a site of their own; broken markup is read as
    far as it goes, an unfinished tag at the end is left out; repeated rows give repeated results; an empty table
    gives an empty result; other columns are ignored. Whole pages are read, of any length.

    The style tree judges all blocks but those of noise. Where it would take more than half of the text inside a
    page's landmarks, that text is a reprint, not repeated matter, and stays.
    """
    parsed = written(parse_pages(pages, page_id, url, html), "pages")
    removed = written(removed_blocks(parsed, low), "removed")
    few = (removed.agg(F.sum(F.size("removed"))).first()[0] or 0) <= BROADCAST_BLOCKS
    rows = parsed.join(F.broadcast(removed) if few else removed, "uid", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    inside = lambda b: F.when(b["inside"], F.length(b["text"])).otherwise(0)
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + inside(b))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, i: n + inside(F.col("blocks")[i]))
    rows = rows.withColumn("removed", F.when(2 * lost > total, F.filter("removed", lambda i: ~F.col("blocks")[i]["inside"])).otherwise(F.col("removed")))
    places = F.when(F.size("blocks") > 0, F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), "removed")).otherwise(F.array().cast("array<int>"))
    text = F.array_join(F.transform(places, lambda i: F.col("blocks")[i]["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
