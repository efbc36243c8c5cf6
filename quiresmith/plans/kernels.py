"""Queries that apply the operators to the driver's tables, with the same in DuckDB SQL.

Each is a proxy: it tests the meaning of one operator on plain tables, not the parsing of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.functions import barcode, geometry, text
from quiresmith.operators import audit, documents, graph, pages, raster
from quiresmith.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NEEDLE = "the"
INDICES = [3, 1, 3, 24, 0]
POLYGON = [(0.0, 0.0), (9000.0, 10.0), (7000.0, 90.0), (3000.0, 40.0), (-500.0, 95.0)]


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_LINES = "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), LATERAL unnest(range(1, len(parts) + 1)) AS t(i)"


@_query(f"SELECT doc_id, line_no, CAST(o AS INTEGER) AS \"offset\" FROM ({_LINES}) AS l, LATERAL unnest(list_filter(range(0, greatest(length(line) - 2, 0)), lambda i: substring(line, i + 1, 3) = 'the')) AS u(o)")
def search_overlap(spark, sf_dir):
    return documents.search_lines(table(spark, sf_dir, "documents"), NEEDLE)


@_query(f"SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches FROM documents AS d LEFT JOIN (SELECT doc_id, sum(len(list_filter(range(0, greatest(length(line) - 2, 0)), lambda i: substring(line, i + 1, 3) = 'the'))) AS n FROM ({_LINES}) AS l GROUP BY doc_id) AS c ON c.doc_id = d.doc_id")
def search_count(spark, sf_dir):
    return documents.search_counts(table(spark, sf_dir, "documents"), NEEDLE)


@_query(f"SELECT doc_id, line_no, CAST(length(line) AS INTEGER) AS n_chars, md5(line) AS line_md5 FROM ({_LINES}) AS l")
def line_table(spark, sf_dir):
    return documents.line_table(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.length("line").alias("n_chars"), F.md5("line").alias("line_md5"))


_ISLANDS = "SELECT *, CAST(sum(CASE WHEN abs(value - before) > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS line FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)"


def _islands(spark, sf_dir):
    return documents.break_islands(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 10.0)


@_query(f"SELECT event_id, user_id, line FROM ({_ISLANDS})")
def break_inference(spark, sf_dir):
    return _islands(spark, sf_dir).select("event_id", "user_id", "line")


@_query(f"SELECT user_id, line, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ({_ISLANDS}) GROUP BY user_id, line")
def line_bounds(spark, sf_dir):
    return documents.island_bounds(_islands(spark, sf_dir), "user_id", "value")


@_query("""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT event_id, user_id, n, value AS head, CAST(0 AS BIGINT) AS span FROM e WHERE n = 1
          UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN abs(e.value - f.head) > 20 THEN e.value ELSE f.head END, CASE WHEN abs(e.value - f.head) > 20 THEN f.span + 1 ELSE f.span END
          FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT event_id, user_id, span FROM f""")
def span_head_fold(spark, sf_dir):
    return documents.head_spans(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "value", 20.0)


@_query("""SELECT l_orderkey, l_linenumber, CAST(2 - grouping(l_orderkey) - grouping(l_linenumber) AS INTEGER) AS level, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
    min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY ROLLUP (l_orderkey, l_linenumber)""")
def bounds_rollup(spark, sf_dir):
    return documents.bounds_rollup(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@_query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def member_lookup(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(members, "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@_query("SELECT d.doc_id, lang, quality, toxic FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id")
def optional_metadata(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@_query("""SELECT c_custkey, coalesce(own, above, top) AS value, CAST(CASE WHEN own IS NOT NULL THEN 0 WHEN above IS NOT NULL THEN 1 WHEN top IS NOT NULL THEN 2 END AS INTEGER) AS depth FROM (
    SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS own, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS above, r_name AS top
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)""")
def nearest_ancestor(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("above"), F.col("r_name").alias("top"))
    leaf = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("own"))
    joined = leaf.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return documents.ancestors_first(joined, ["own", "above", "top"]).select("c_custkey", "value", "depth")


_PAGE = "SELECT p_partkey, p_size, p_size % 4 * 90 AS rot, CAST(100 + p_size AS DOUBLE) AS w, CAST(200 + p_size * 2 AS DOUBLE) AS h, CAST(1 + p_size % 3 AS DOUBLE) AS u FROM part"


def _part_pages(spark, sf_dir):
    size = F.col("p_size")
    base = table(spark, sf_dir, "part").select("p_partkey", "p_size", (size % 4 * 90).alias("rot"), (100 + size).cast("double").alias("w"), (200 + size * 2).cast("double").alias("h"), (1 + size % 3).cast("double").alias("u"))
    return base.withColumn("box", geometry.rect(0.0, 0.0, F.col("w"), F.col("h")))


@_query(f"""SELECT p_partkey, u * CASE rot WHEN 90 THEN 7 WHEN 180 THEN w - 5 WHEN 270 THEN h - 7 ELSE 5 END AS x, u * CASE rot WHEN 90 THEN 5 WHEN 180 THEN 7 WHEN 270 THEN w - 5 ELSE h - 7 END AS y,
    u * CASE WHEN rot IN (90, 270) THEN h ELSE w END AS width, u * CASE WHEN rot IN (90, 270) THEN w ELSE h END AS height FROM ({_PAGE})""")
def page_display_map(spark, sf_dir):
    rot, unit, box = F.col("rot"), F.col("u"), F.col("box")
    mapped = _part_pages(spark, sf_dir).withColumn("p", geometry.to_display(F.lit(5.0), F.lit(7.0), box, rot, unit)).withColumn("s", geometry.display_size(box, rot, unit))
    return mapped.select("p_partkey", "p.x", "p.y", "s.width", "s.height")


@_query("""SELECT l_orderkey, l_linenumber, greatest(0, l_discount * 100) AS x0, greatest(0, l_tax * 100) AS y0, least(l_quantity, 30) AS x1, least(10, l_quantity / 2) AS y1 FROM lineitem
    WHERE greatest(0, l_discount * 100) < least(l_quantity, 30) AND greatest(0, l_tax * 100) < least(10, l_quantity / 2)""")
def rect_intersection(spark, sf_dir):
    q = F.col("l_quantity")
    cut = geometry.intersection(geometry.rect(0.0, 0.0, q, 10.0), F.struct((F.col("l_discount") * 100).alias("x0"), (F.col("l_tax") * 100).alias("y0"), F.lit(30.0).alias("x1"), (q / 2).alias("y1")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cut.alias("r")).where("r IS NOT NULL").select("l_orderkey", "l_linenumber", "r.*")


@_query(f"""SELECT p_partkey, least(ax, bx) AS x0, least(ay, b_y) AS y0, greatest(ax, bx) AS x1, greatest(ay, b_y) AS y1 FROM (
    SELECT p_partkey, CASE rot WHEN 90 THEN 20 / u WHEN 180 THEN w - 10 / u WHEN 270 THEN w - 20 / u ELSE 10 / u END AS ax, CASE rot WHEN 90 THEN 10 / u WHEN 180 THEN 20 / u WHEN 270 THEN h - 10 / u ELSE h - 20 / u END AS ay,
           CASE rot WHEN 90 THEN 60 / u WHEN 180 THEN w - 40 / u WHEN 270 THEN w - 60 / u ELSE 40 / u END AS bx, CASE rot WHEN 90 THEN 40 / u WHEN 180 THEN 60 / u WHEN 270 THEN h - 40 / u ELSE h - 60 / u END AS b_y FROM ({_PAGE}))""")
def inverse_crop(spark, sf_dir):
    crop = geometry.rect_by(geometry.to_source, geometry.rect(10.0, 20.0, 40.0, 60.0), F.col("box"), F.col("rot"), F.col("u"))
    return _part_pages(spark, sf_dir).select("p_partkey", crop.alias("r")).select("p_partkey", "r.*")


@_query("SELECT CAST(i - 1 AS INTEGER) AS out_page, n_nationkey, n_name FROM (SELECT [3, 1, 3, 24, 0] AS idx), LATERAL unnest(range(1, 6)) AS t(i) JOIN nation ON n_nationkey = idx[i]")
def export_indices(spark, sf_dir):
    return pages.export_pages(table(spark, sf_dir, "nation"), INDICES, "n_nationkey").select("out_page", "n_nationkey", "n_name")


@_query("SELECT CAST(p_partkey - 11 AS INTEGER) AS out_page, p_partkey, p_name FROM part WHERE p_partkey BETWEEN 11 AND 60")
def export_range(spark, sf_dir):
    return pages.export_range(table(spark, sf_dir, "part"), 11, 50, "p_partkey").select("out_page", "p_partkey", "p_name")


@_query("""SELECT input_no, k, name, row_number() OVER (ORDER BY input_no, k) - 1 AS out_page FROM (
    SELECT 0 AS input_no, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)""")
def merge_all(spark, sf_dir):
    inputs = [table(spark, sf_dir, t).select(F.col(k).alias("k"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    return pages.merge(inputs, "k").select("input_no", "k", "name", "out_page")


@_query(f"""SELECT p_partkey, CAST(r * 3 + c AS INTEGER) AS tile, w * c / 3 AS x0, h * r / 2 AS y0, w * (c + 1) / 3 AS x1, h * (r + 1) / 2 AS y1
    FROM ({_PAGE}), LATERAL unnest(range(0, 2)) AS a(r), LATERAL unnest(range(0, 3)) AS b(c)""")
def poster_tiles(spark, sf_dir):
    return pages.tiles(_part_pages(spark, sf_dir), F.col("w"), F.col("h"), F.lit(3), F.lit(2), ["p_partkey"])


@_query(f"""WITH tiles AS (SELECT p_partkey, r * 3 + c AS tile, w * c / 3 AS x0, h * r / 2 AS y0, w * (c + 1) / 3 AS x1, h * (r + 1) / 2 AS y1
        FROM ({_PAGE}), LATERAL unnest(range(0, 2)) AS a(r), LATERAL unnest(range(0, 3)) AS b(c))
    SELECT l_orderkey, l_linenumber, CAST(tile AS BIGINT) AS tile FROM lineitem JOIN tiles ON p_partkey = l_partkey
        AND l_quantity < x1 AND l_quantity + 40 > x0 AND l_quantity * 2 < y1 AND l_quantity * 2 + 30 > y0""")
def poster_assign(spark, sf_dir):
    q = F.col("l_quantity")
    marks = table(spark, sf_dir, "lineitem").join(_part_pages(spark, sf_dir).drop("box"), F.col("l_partkey") == F.col("p_partkey"))
    box = F.struct(q.alias("x0"), (q * 2).alias("y0"), (q + 40).alias("x1"), (q * 2 + 30).alias("y1"))
    return pages.assign_to_tiles(marks, F.col("w"), F.col("h"), F.lit(3), F.lit(2), box, ["l_orderkey", "l_linenumber"])


@_query(f"SELECT p_partkey, CAST(least(greatest(floor((p_size * 4 - 20) * 3 / w), 0), 2) AS BIGINT) AS tile_col FROM ({_PAGE})")
def dest_retarget(spark, sf_dir):
    return _part_pages(spark, sf_dir).select("p_partkey", geometry.tile_of(F.col("p_size") * 4 - 20, F.col("w"), F.lit(3)).alias("tile_col"))


@_query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS link_no, uri, CASE WHEN regexp_matches(uri, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'uri' WHEN starts_with(uri, '#') THEN 'internal' WHEN starts_with(uri, '/') THEN 'site' ELSE 'relative' END AS kind
    FROM (SELECT page_id, i, found[i] AS uri FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS found FROM pages), LATERAL unnest(range(1, len(found) + 1)) AS t(i))""")
def links_extract(spark, sf_dir):
    return audit.links(table(spark, sf_dir, "pages"))


@_query("""WITH t AS (SELECT 'root' AS node, CAST(NULL AS VARCHAR) AS parent, [(0, 'root')] AS path UNION ALL SELECT 'r' || r_regionkey, 'root', [(0, 'root'), (r_regionkey, 'r' || r_regionkey)] FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, [(0, 'root'), (n_regionkey, 'r' || n_regionkey), (n_nationkey, 'n' || n_nationkey)] FROM nation),
    i AS (SELECT node, parent, CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS index FROM t)
    SELECT node, index, (SELECT min(p.index) FROM i AS p WHERE p.node = a.parent) AS parent_index, (SELECT min(c.index) FROM i AS c WHERE c.parent = a.node) AS first_child,
        (SELECT min(s.index) FROM i AS s WHERE s.parent = a.parent AND s.index > a.index) AS next_sibling FROM i AS a""")
def outline_preorder(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.col("r_regionkey").alias("ordinal"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("ordinal"))
    root = spark.createDataFrame([("root", None, 0)], "node string, parent string, ordinal int")
    tree = root.unionByName(regions).unionByName(nations).withColumn("tree", F.lit(0))
    return graph.preorder(tree).select("node", "index", "parent_index", "first_child", "next_sibling")


@_query("SELECT conv_id, turn % 2 AS side, count(DISTINCT role) AS n_values, CASE WHEN count(DISTINCT role) > 1 THEN 'FORMAT' ELSE 'OK' END AS status FROM conversations GROUP BY ALL")
def form_conflict(spark, sf_dir):
    return documents.conflicts(table(spark, sf_dir, "conversations").withColumn("side", F.col("turn") % 2), ["conv_id", "side"], "role")


_FINDS = [(1, r"(?is)<script[\s>]"), (2, r"(?is)<style[\s>]"), (4, r"(?is)<(?:form|input|button)[\s>]"), (8, r"(?is)<(?:iframe|object|embed)[\s>]"), (16, r"(?is)<[^>]*\son[a-z]+\s*="), (32, r'(?is)href="https?://'), (64, "(?s)<!--")]
_MASK = " + ".join(f"CASE WHEN regexp_matches(coalesce(html, ''), '{p}') THEN {bit} ELSE 0 END" for bit, p in _FINDS)


@_query(f"SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, CAST(bit_or({_MASK}) AS INTEGER) AS mask, count(*) AS n_pages FROM pages GROUP BY 1")
def audit_mask(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "pages"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"))


@_query(f"SELECT page_id, CAST(mask AS INTEGER) AS mask, CASE WHEN mask & 36 <> 0 THEN 'UNSUPPORTED' ELSE 'OK' END AS status FROM (SELECT page_id, {_MASK} AS mask FROM pages)")
def policy_check(spark, sf_dir):
    mask = audit.finding_mask(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", mask.alias("mask"), audit.policy_status(mask, 36).alias("status"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[\s>].*?</script>', '', 'g'), '(?is)<style[\s>].*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


@_query(f"SELECT page_id, md5(html) AS clean_md5, CAST({_MASK} AS INTEGER) AS after, CASE WHEN ({_MASK}) & 67 <> 0 THEN 'UNSUPPORTED' ELSE 'OK' END AS status FROM (SELECT page_id, {_CLEAN} AS html FROM pages)")
def sanitize_strip(spark, sf_dir):
    return audit.sanitized(table(spark, sf_dir, "pages"), ["script", "style", "comment"]).select("page_id", F.md5("clean").alias("clean_md5"), "after", "status")


@_query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, 'R', o_totalprice * 2 FROM orders WHERE o_orderkey % 10 = 3
    UNION ALL SELECT o_orderkey + 100000000, 'A', o_totalprice FROM orders WHERE o_orderkey % 10 = 7""")
def edit_commit(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    replaced = base.where("o_orderkey % 10 = 3").select("o_orderkey", F.lit("R").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    added = base.where("o_orderkey % 10 = 7").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("A").alias("o_orderstatus"), "o_totalprice")
    return graph.commit(base, replaced, added, "o_orderkey")


@_query("SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def reachable_gc(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = orders.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst")).union(customer.select(name("c", "c_custkey"), name("n", "c_nationkey")))
    roots = orders.where("o_totalprice > 300000").select(name("o", "o_orderkey").alias("node"))
    return graph.collect_garbage(customer.withColumn("id", name("c", "c_custkey")), "id", edges, roots).select("c_custkey", "c_nationkey")


@_query("""SELECT doc_id, dense_rank() OVER (ORDER BY first) AS pool_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)""")
def intern_first(spark, sf_dir):
    return documents.intern(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS raw, string_split(replace(replace(coalesce(text, ''), chr(13), ''), chr(9), ' '), chr(10)) AS lines FROM documents),
    w AS (SELECT doc_id, i AS line_no, 0 AS step, lines[i] AS rest, CAST(NULL AS VARCHAR) AS piece FROM d, LATERAL unnest(range(1, len(lines) + 1)) AS t(i) WHERE raw = '' OR len(lines) > 1 OR lines[1] <> ''
          UNION ALL SELECT doc_id, line_no, step + 1, CASE WHEN length(rest) <= 80 THEN NULL WHEN place > 1 THEN substring(rest, place + 1) ELSE substring(rest, 81) END,
              rtrim(CASE WHEN length(rest) <= 80 THEN rest WHEN place > 1 THEN substring(rest, 1, place - 1) ELSE substring(rest, 1, 80) END, ' ')
          FROM (SELECT *, CASE WHEN contains(substring(rest, 1, 81), ' ') THEN 82 - instr(reverse(substring(rest, 1, 81)), ' ') ELSE 0 END AS place FROM w WHERE rest IS NOT NULL))
    SELECT d.doc_id, count(piece) AS n_lines, CAST(coalesce(max(length(piece)), 0) AS BIGINT) AS width FROM d LEFT JOIN (SELECT doc_id, piece FROM w WHERE step > 0) AS p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def wrap_measure(spark, sf_dir):
    return text.measure(table(spark, sf_dir, "documents"), "doc_id", "text", 80)


@_query(f"SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x7F\\x{{A0}}-\\x{{FF}}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '', 'g')) AS n_rejected FROM documents")
def winansi_admit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.windows_latin(F.col("text")).alias("n_rejected"))


_GTIN = "(10 - list_sum(list_transform(range(1, length({0}) + 1), lambda i: CAST(substring({0}, length({0}) + 1 - i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10"


@_query(f"SELECT p_partkey, body, CAST({_GTIN.format('body')} AS INTEGER) AS digit FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7919 AS VARCHAR), 12, '0') AS body FROM part)")
def ean13_check(spark, sf_dir):
    body = F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0")
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"), barcode.gtin_check_digit(body).alias("digit"))


@_query(f"""WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey * 104729 % 2000000 AS VARCHAR), 7, '0') AS e FROM part),
    x AS (SELECT p_partkey, e, CASE WHEN e[7] IN ('0', '1', '2') THEN e[1:3] || e[7] || '0000' || e[4:6] WHEN e[7] = '3' THEN e[1:4] || '00000' || e[5:6] WHEN e[7] = '4' THEN e[1:5] || '00000' || e[6] ELSE e[1:6] || '0000' || e[7] END AS body FROM b)
    SELECT p_partkey, e || d AS code, body || d AS upca FROM (SELECT p_partkey, e, body, CAST(CAST({_GTIN.format('body')} AS INTEGER) AS VARCHAR) AS d FROM x)""")
def upce_expand(spark, sf_dir):
    seven = F.lpad((F.col("p_partkey") * 104729 % 2000000).cast("string"), 7, "0")
    codes = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(seven, d.cast("string")))).alias("code"))
    return codes.withColumn("upca", barcode.upce_expand(F.col("code"))).where("upca IS NOT NULL")


@_query("SELECT p_partkey, CAST((104 + list_sum(list_transform(range(1, length(p_name) + 1), lambda i: i * (ascii(substring(p_name, i, 1)) - 32)))) % 103 AS BIGINT) AS checksum FROM part")
def code128_checksum(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", barcode.code128b_checksum(F.col("p_name")).alias("checksum"))


_EAN_LEFT = "substring('0001101001100100100110111101010001101100010101111011101101101110001011', CAST({0} AS INTEGER) * 7 + 1, 7)"
_EAN_DIGIT = f"CASE substring(sets, i, 1) WHEN 'L' THEN {_EAN_LEFT.format('digits[i]')} WHEN 'R' THEN translate({_EAN_LEFT.format('digits[i]')}, '01', '10') ELSE reverse(translate({_EAN_LEFT.format('digits[i]')}, '01', '10')) END"


@_query(f"""WITH b AS (SELECT p_partkey, kind, before, after, CAST(p_partkey % 10 AS VARCHAR) || lpad(CAST(p_partkey * 7919 AS VARCHAR), len, '0') AS body FROM part, (VALUES ('EAN-13', 11, 11, 7), ('UPC-A', 10, 9, 9), ('EAN-8', 6, 7, 7)) AS k(kind, len, before, after)),
    c AS (SELECT *, body || CAST(CAST({_GTIN.format('body')} AS INTEGER) AS VARCHAR) AS code FROM b),
    s AS (SELECT *, CASE kind WHEN 'EAN-13' THEN code[2:] ELSE code END AS digits,
        CASE kind WHEN 'EAN-13' THEN substring('LLLLLLLLGLGGLLGGLGLLGGGLLGLLGGLGGLLGLGGGLLLGLGLGLGLGGLLGGLGL', CAST(code[1] AS INTEGER) * 6 + 1, 6) || 'RRRRRR' WHEN 'UPC-A' THEN 'LLLLLLRRRRRR' ELSE 'LLLLRRRR' END AS sets FROM c),
    m AS (SELECT p_partkey, kind, code, before, after, length(sets) AS n, i, {_EAN_DIGIT} AS x FROM s, LATERAL unnest(range(1, length(sets) + 1)) AS t(i))
    SELECT p_partkey, kind, code, repeat('0', before) || '101' || string_agg(x || CASE WHEN 2 * i = n THEN '01010' ELSE '' END, '' ORDER BY i) || '101' || repeat('0', after) AS modules FROM m GROUP BY p_partkey, kind, code, before, after""")
def ean_modules(spark, sf_dir):
    kinds = {"EAN-13": (11, barcode.ean13_modules), "UPC-A": (10, barcode.upca_modules), "EAN-8": (6, barcode.ean8_modules)}

    def of(kind: str, digits: int, modules):
        body = F.concat((F.col("p_partkey") % 10).cast("string"), F.lpad((F.col("p_partkey") * 7919).cast("string"), digits, "0"))
        code = F.concat(body, barcode.gtin_check_digit(body).cast("string"))
        return F.struct(F.lit(kind).alias("kind"), code.alias("code"), modules(code).alias("modules"))

    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[of(k, *v) for k, v in kinds.items()])).alias("x")).select("p_partkey", "x.*")


@_query(f"""WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey * 104729 % 2000000 AS VARCHAR), 7, '0') AS e FROM part),
    x AS (SELECT p_partkey, e, CASE WHEN e[7] IN ('0', '1', '2') THEN e[1:3] || e[7] || '0000' || e[4:6] WHEN e[7] = '3' THEN e[1:4] || '00000' || e[5:6] WHEN e[7] = '4' THEN e[1:5] || '00000' || e[6] ELSE e[1:6] || '0000' || e[7] END AS body FROM b),
    c AS (SELECT p_partkey, e, CAST({_GTIN.format('body')} AS INTEGER) AS d FROM x),
    s AS (SELECT p_partkey, e || d AS code, e[2:] AS digits, CASE WHEN e[1] = '1' THEN sets ELSE translate(sets, 'LG', 'GL') END AS sets FROM (SELECT *, substring('LLLGGGLLGLGGLLGGLGLLGGGLLGLLGGLGGLLGLGGGLLLGLGLGLGLGGLLGGLGL', d * 6 + 1, 6) AS sets FROM c)),
    m AS (SELECT p_partkey, code, i, {_EAN_DIGIT} AS x FROM s, LATERAL unnest(range(1, 7)) AS t(i))
    SELECT p_partkey, code, '000000000101' || string_agg(x, '' ORDER BY i) || '0101010000000' AS modules FROM m GROUP BY p_partkey, code""")
def upce_modules(spark, sf_dir):
    return upce_expand(spark, sf_dir).select("p_partkey", "code", barcode.upce_modules(F.col("code")).alias("modules"))


@_query("""WITH v AS (SELECT p_partkey, p_name, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substring(p_name, i, 1)) - 32) AS vs FROM part),
    c AS (SELECT p_partkey, p_name, [104] || vs || [CAST((104 + list_sum(list_transform(range(1, len(vs) + 1), lambda i: i * vs[i]))) % 103 AS INTEGER)] || [106] AS vs FROM v),
    w AS (SELECT p_partkey, p_name, i, string_split('212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132 221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313 231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111 314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111 111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 114131 311141 411131 211412 211214 211232 2331112', ' ')[vs[i] + 1] AS widths FROM c, LATERAL unnest(range(1, len(vs) + 1)) AS t(i))
    SELECT p_partkey, p_name, '0000000000' || string_agg(array_to_string(list_transform(range(1, length(widths) + 1), lambda k: repeat(CASE WHEN k % 2 = 1 THEN '1' ELSE '0' END, CAST(substring(widths, k, 1) AS INTEGER))), ''), '' ORDER BY i) || '0000000000' AS modules FROM w GROUP BY p_partkey, p_name""")
def code128_modules(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", barcode.code128b_modules(F.col("p_name")).alias("modules"))


@_query("""WITH RECURSIVE m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CAST(1 + l_linenumber % 2 AS DOUBLE) AS a, CAST(l_suppkey % 3 AS DOUBLE) AS b, CAST(l_partkey % 2 AS DOUBLE) AS c, 1.0::DOUBLE AS d, l_quantity AS e, CAST(l_partkey % 10 AS DOUBLE) AS f FROM lineitem),
    p AS (SELECT * FROM m WHERE n = 1 UNION ALL SELECT m.l_orderkey, m.n, p.a * m.a + p.b * m.c, p.a * m.b + p.b * m.d, p.c * m.a + p.d * m.c, p.c * m.b + p.d * m.d, p.e * m.a + p.f * m.c + m.e, p.e * m.b + p.f * m.d + m.f FROM p JOIN m ON m.l_orderkey = p.l_orderkey AND m.n = p.n + 1)
    SELECT l_orderkey, max(n) AS n, arg_max(a, n) AS a, arg_max(b, n) AS b, arg_max(c, n) AS c, arg_max(d, n) AS d, arg_max(e, n) AS e, arg_max(f, n) AS f FROM p GROUP BY l_orderkey""")
def affine_compose(spark, sf_dir):
    num = lambda e: F.expr(e).cast("double")
    matrix = F.struct(num("1 + l_linenumber % 2").alias("a"), num("l_suppkey % 3").alias("b"), num("l_partkey % 2").alias("c"), F.lit(1.0).alias("d"), F.col("l_quantity").alias("e"), num("l_partkey % 10").alias("f"))
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", matrix.alias("m")))).alias("s"))
    identity = F.struct(*[F.lit(v).alias(n) for n, v in zip("abcdef", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), strict=True)])
    return steps.select("l_orderkey", F.size("s").cast("long").alias("n"), F.aggregate("s", identity, lambda m, x: geometry.affine_product(m, x["m"])).alias("r")).select("l_orderkey", "n", "r.*")


def _thumbnail_sql() -> str:
    thirds = lambda x, c: max(0, min(3 * (x + 1), 8 * (c + 1)) - max(3 * x, 8 * c))  # noqa: E731  of pixel x in cell c
    weights = [[(x, thirds(x, c)) for x in range(8) if thirds(x, c)] for c in range(3)]
    cells = [" + ".join(f"p[{y * 8 + x + 1}] * {wy * wx}" for y, wy in row for x, wx in col) for row in weights for col in weights]
    cells = ", ".join(f"(2 * ({c}) + 64) // 128" for c in cells)
    return f"SELECT vec_id, CAST([{cells}] AS INTEGER[]) AS cells FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(CAST(x AS DOUBLE) * 127) + 127, 0), 255) AS INTEGER)) AS p FROM embeddings)"


@_query(f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS cell, cells[i] AS value FROM ({_thumbnail_sql()}), LATERAL unnest(range(1, 10)) AS t(i)")
def thumbnail_area(spark, sf_dir):
    pixels = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 127) + 127, F.lit(0).cast("long")), F.lit(255).cast("long")).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", pixels.alias("p")).select("vec_id", F.posexplode(raster.thumbnail(F.col("p"), 8, 8, 3, 3)).alias("cell", "value"))


_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True))


@_query(f"""SELECT s_suppkey, CAST(coalesce(sum(CASE WHEN y >= least(y0, y1) AND y < greatest(y0, y1) AND x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x THEN CASE WHEN y1 > y0 THEN 1 ELSE -1 END ELSE 0 END), 0) AS INTEGER) AS winding
    FROM (SELECT s_suppkey, s_acctbal AS x, CAST(s_suppkey % 100 AS DOUBLE) AS y FROM supplier), (SELECT CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM (VALUES {_EDGES}) AS e(x0, y0, x1, y1)) GROUP BY s_suppkey""")
def winding_inside(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", raster.winding(F.col("s_acctbal"), (F.col("s_suppkey") % 100).cast("double"), POLYGON).alias("winding"))


_RULES = [("price", "o_totalprice < 50000"), ("status", "o_orderstatus = 'F'"), ("priority", "o_orderpriority LIKE '1%'")]


@_query("SELECT o_orderkey, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _RULES) + " ELSE 'OK' END AS rule, CAST(CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (n, c) in enumerate(_RULES)) + " END AS INTEGER) AS rule_no FROM orders")
def first_failure(spark, sf_dir):
    failed = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(i).alias("rule_no"), F.lit(n).alias("rule"))) for i, (n, c) in enumerate(_RULES)]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(failed, F.lit(0)).alias("f")).select("o_orderkey", F.coalesce("f.rule", F.lit("OK")).alias("rule"), "f.rule_no")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def dangling_refs(spark, sf_dir):
    return graph.dangling(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


@_query("SELECT p_partkey, mode, 10 + (80 - w) / 2 AS x, 20 + (60 - h) / 2 AS y, w AS width, h AS height FROM (SELECT p_partkey, mode, CASE mode WHEN 'stretch' THEN 80.0::DOUBLE WHEN 'contain' THEN iw * least(80 / iw, 60 / ih) ELSE iw * greatest(80 / iw, 60 / ih) END AS w, CASE mode WHEN 'stretch' THEN 60.0::DOUBLE WHEN 'contain' THEN ih * least(80 / iw, 60 / ih) ELSE ih * greatest(80 / iw, 60 / ih) END AS h FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS iw, CAST(p_size % 7 + 1 AS DOUBLE) AS ih FROM part), (VALUES ('stretch'), ('contain'), ('cover')) AS m(mode))")
def image_fit(spark, sf_dir):
    box, size = geometry.rect(10.0, 20.0, 90.0, 80.0), F.col("p_size")
    fits = F.array(*[F.struct(F.lit(m).alias("mode"), geometry.image_fit(size.cast("double"), (size % 7 + 1).cast("double"), box, m).alias("r")) for m in ("stretch", "contain", "cover")])
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(fits)).select("p_partkey", "mode", "r.*")


@_query("""SELECT vec_id, CAST(i AS INTEGER) AS cell, CAST(e[1 + CASE vec_id % 4 WHEN 1 THEN (3 - i % 4) * 16 + i // 4 WHEN 2 THEN 63 - i WHEN 3 THEN i % 4 * 16 + 15 - i // 4 ELSE i END] AS DOUBLE) AS value
    FROM (SELECT vec_id, embedding AS e FROM embeddings), LATERAL unnest(range(0, 64)) AS t(i)""")
def rotate_bitmap(spark, sf_dir):
    turned = raster.rotated(F.col("embedding"), 16, 4, F.col("vec_id") % 4 * 90)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(turned).alias("cell", "value")).withColumn("value", F.col("value").cast("double"))


_KIND = "CASE WHEN event_type IN ('view', 'signup', 'error') THEN 'move' WHEN event_type = 'click' THEN 'line' ELSE 'close' END"


@_query(f"""SELECT user_id, CASE WHEN first(kind ORDER BY ts, event_id) = 'move' AND bool_or(kind = 'line') AND bool_and(kind = 'close' OR coalesce(isfinite(value), false)) THEN 'OK' ELSE 'FORMAT' END AS status
    FROM (SELECT *, {_KIND} AS kind FROM events) GROUP BY user_id""")
def path_validity(spark, sf_dir):
    return documents.path_status(table(spark, sf_dir, "events").withColumn("kind", F.expr(_KIND)), "user_id", ["ts", "event_id"], "kind", "value")


@_query(f"""WITH t AS (SELECT p_partkey, 'P-' || p_partkey || '$/+%. ' || p_size AS body FROM part),
    c AS (SELECT p_partkey, body, i, substring('*' || body || '*', i, 1) AS x FROM t, LATERAL unnest(range(1, length(body) + 3)) AS u(i)),
    g AS (SELECT *, instr('1234567890ABCDEFGHIJKLMNOPQRSTUVWXYZ-. *', x) - 1 AS place, instr('$/+%', x) - 1 AS sign FROM c),
    w AS (SELECT *, CASE WHEN sign >= 0 THEN '00000' ELSE substring('10001010011100000101101000110000011100100101000110', place % 10 * 5 + 1, 5) END AS bars,
        CASE WHEN sign >= 0 THEN substring('1110110110110111', sign * 4 + 1, 4) ELSE substring('0100001000011000', place // 10 * 4 + 1, 4) END AS spaces FROM g),
    m AS (SELECT *, array_to_string(list_transform(range(0, 9), lambda k: repeat(CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END, CASE WHEN substring(CASE WHEN k % 2 = 0 THEN bars ELSE spaces END, k // 2 + 1, 1) = '1' THEN 3 ELSE 1 END)), '') AS modules FROM w)
    SELECT p_partkey, body, repeat('0', 10) || string_agg(modules, '0' ORDER BY i) || repeat('0', 10) AS modules FROM m GROUP BY p_partkey, body""")
def code39_modules(spark, sf_dir):
    body = F.concat(F.lit("P-"), "p_partkey", F.lit("$/+%. "), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"), barcode.code39_modules(body).alias("modules"))
