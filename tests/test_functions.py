"""Golden values and small cases of the functions and operators."""

import pytest
from pyspark.sql import functions as F

from quiresmith.functions import barcode, geometry, scan, text
from quiresmith.operators import audit, documents, graph, pages, raster


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("code", "length", "valid"), [("9780143127741", 13, True), ("9780143127742", 13, False), ("725272730706", 12, True), ("725272730707", 12, False), ("73513537", 8, True), ("73513538", 8, False), ("x", 8, False), ("", 8, False)])
def test_gtin(spark, code, length, valid):
    assert one(spark, barcode.gtin_valid(F.lit(code), length)) is valid


def test_upce(spark):
    assert one(spark, barcode.upce_expand(F.lit("04252614"))) == "042100005264"
    assert one(spark, barcode.upce_expand(F.lit("04252610"))) is None
    assert one(spark, barcode.upce_expand(F.lit("24252614"))) is None


def test_ean_and_upc_modules(spark):
    whole = one(spark, barcode.ean13_modules(F.lit("9780143127741")))
    # first digit 9: odd, even, even, odd, even, odd
    left = ["0111011", "0001001", "0100111", "0011001", "0011101", "0111101"]
    right = ["1100110", "1101100", "1000100", "1000100", "1011100", "1100110"]
    assert whole == "0" * 11 + "101" + "".join(left) + "01010" + "".join(right) + "101" + "0" * 7
    assert one(spark, barcode.ean13_modules(F.lit("9780143127742"))) is None
    assert one(spark, barcode.upca_modules(F.lit("725272730706"))).strip("0").startswith("101" + "0111011" + "0010011" + "0110001")
    assert len(one(spark, barcode.upca_modules(F.lit("725272730706")))) == 95 + 18
    assert one(spark, barcode.ean8_modules(F.lit("73513537"))) == "0" * 7 + "101" + "0111011" + "0111101" + "0110001" + "0011001" + "01010" + "1000010" + "1001110" + "1000010" + "1000100" + "101" + "0" * 7
    assert one(spark, barcode.ean8_modules(F.lit(""))) is None and one(spark, barcode.upca_modules(F.lit(None).cast("string"))) is None


def test_upce_modules(spark):
    # check digit 4 in number system 0: even, odd, even, even, odd, odd
    digits = ["0011101", "0010011", "0111001", "0011011", "0101111", "0011001"]
    assert one(spark, barcode.upce_modules(F.lit("04252614"))) == "0" * 9 + "101" + "".join(digits) + "010101" + "0" * 7
    assert one(spark, barcode.upce_modules(F.lit("04252610"))) is None


def test_code128_modules(spark):
    assert {(len(w), sum(map(int, w)), sum(map(int, w[::2])) % 2) for w in barcode.CODE128} == {(6, 11, 0)} and len(set(barcode.CODE128)) == 103
    parts = ["11010010000", "10100011000", "10001011000", "1100011101011"]  # start B, A, its check symbol, stop
    assert one(spark, barcode.code128b_modules(F.lit("A"))) == "0" * 10 + "".join(parts) + "0" * 10
    assert one(spark, barcode.code128b_modules(F.lit(""))) is None and one(spark, barcode.code128b_modules(F.lit("é"))) is None


def test_code39_published_symbols(spark):
    """Bars and spaces of single characters as the symbology prints them, three modules a wide element."""
    body = lambda c: one(spark, barcode.code39_modules(F.lit(c)))[10 + 15 + 1 : -(10 + 15 + 1)]
    assert (body("A"), body("0"), body("-"), body("%")) == ("111010100010111", "101000111011101", "100010101110111", "101000100010001")
    whole = one(spark, barcode.code39_modules(F.lit("Z")))
    assert whole[:26] == "0" * 10 + "100010111011101" + "0" and whole[-26:] == "0" + "100010111011101" + "0" * 10
    assert one(spark, barcode.code39_modules(F.lit("a"))) is None and one(spark, barcode.code39_modules(F.lit(""))) is None


@pytest.mark.parametrize(("line", "needle", "found"), [("aaaa", "aa", [0, 1, 2]), ("grüne Wiese", "ne Wi", [3]), ("x", "missing", []), ("", "a", []), ("a.b.", ".", [1, 3]), ("éaéa", "aé", [1])])
def test_match_offsets(spark, line, needle, found):
    assert one(spark, text.match_offsets(F.lit(line), needle)) == found
    assert one(spark, text.match_count(F.lit(line), needle)) == len(found)


def test_empty_needle():
    with pytest.raises(ValueError):
        text.match_offsets(F.lit("x"), "")


@pytest.mark.parametrize(("source", "columns", "lines"), [("", 5, [""]), ("\r", 5, []), ("a\n", 5, ["a", ""]), ("aa bb cc", 5, ["aa bb", "cc"]), ("abcdefgh", 3, ["abc", "def", "gh"]), ("a\tb", 9, ["a b"]), ("ab   ", 9, ["ab"])])
def test_wrap(source, columns, lines):
    assert text.wrap(source, columns) == lines


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_display_inverse(spark, rotation):
    box, rot, unit = geometry.rect(10.0, 20.0, 110.0, 320.0), F.lit(rotation), F.lit(2.0)
    shown = geometry.to_display(F.lit(30.0), F.lit(50.0), box, rot, unit)
    back = one(spark, geometry.to_source(shown["x"], shown["y"], box, rot, unit))
    assert (back.x, back.y) == (30.0, 50.0)


def test_ordinal_and_islands(spark):
    df = spark.createDataFrame([(k, i, float(v)) for k in ("a", "b", None) for i, v in enumerate([0, 1, 20, 21, 50])], "k string, i int, v double")
    found = scan.with_ordinal(df, "n", "k", "i").collect()
    assert [r.n for r in sorted(found, key=lambda r: (r.k is not None, r.k or "", r.i))] == list(range(15))
    lines = documents.break_islands(df, "k", ["i"], "v", 5.0).collect()
    assert sorted({(r.k or "", r.i, r.line) for r in lines}) == [(k, i, n) for k in ("", "a", "b") for i, n in enumerate([0, 0, 1, 1, 2])]
    assert documents.break_islands(df.limit(0), "k", ["i"], "v", 5.0).collect() == []


def test_outline(spark):
    tree = spark.createDataFrame([(0, 0, None, 0), (0, 1, 0, 0), (0, 2, 1, 0), (0, 3, 1, 1), (0, 4, None, 1), (0, 5, 4, 0)], "tree int, node int, parent int, ordinal int")
    got = {r.node: (r.parent_index, r.first_child, r.next_sibling) for r in graph.preorder(tree).collect()}
    assert got == {0: (None, 1, 4), 1: (0, 2, None), 2: (1, None, 3), 3: (1, None, None), 4: (None, 5, None), 5: (4, None, None)}


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert sorted(r.node for r in graph.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]


def test_export(spark):
    df = spark.range(5).withColumnRenamed("id", "page_index")
    assert [r.page_index for r in pages.export_pages(df, [4, 0, 4]).orderBy("out_page").collect()] == [4, 0, 4]
    assert pages.export_pages(df, [4, 9]).collect() == []
    assert pages.export_range(df, 3, 5).collect() == []


def test_sanitize_then_audit(spark):
    df = spark.createDataFrame([("<p>a<script>x()</script><!-- c --></p>",), (None,)], "html string")
    got = audit.sanitized(df, ["script", "comment"]).collect()
    assert [(r.clean, r.status) for r in got] == [("<p>a</p>", "OK"), (None, "OK")]


def test_thumbnail_keeps_flat_pictures(spark):
    assert one(spark, raster.thumbnail(F.array(*[F.lit(7)] * 64), 8, 8, 3, 3)) == [7] * 9
