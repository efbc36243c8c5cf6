"""Budgeted walks, pruning and aliases, search quads and graphics states, against hand-made documents and brute force."""

import math
import random

from pyspark.sql import functions as F
from test_pdf import parsed

from quiresmith.operators import graphics_state, pdf, pdf_edit, pdf_text, traversal


def doubling(depth):
    """A page tree of which each level lists the next one twice: 2^depth paths."""
    return [b"<< /Pages 2 0 R >>", *[b"<< /Type /Pages /Kids [%d 0 R %d 0 R] >>" % (i + 3, i + 3) for i in range(depth)], b"<< /Type /Page >>"]


def test_budget(spark):
    form = lambda *fields: [b"<< /Pages 2 0 R /AcroForm << /Fields [3 0 R] >> >>", b"<< /Type /Pages /Kids [] >>", *fields]
    wide = [b"<< /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % i for i in range(3, 23)), *[b"<< /Type /Page >>"] * 20]
    files = {"doubling": doubling(10), "wide": wide, "self": form(b"<< /T (a) /Kids [3 0 R 3 0 R 4 0 R] >>", b"<< /T (b) >>"), "plain": form(b"<< /T (a) /Kids [4 0 R] >>", b"<< /T (b) >>"), "direct": [b"<< /Pages << /Type /Pages /Kids [] >> >>"]}
    made = parsed(spark, files)
    tree = pdf.page_tree(made)
    got = {r.doc_id: (r.n_visits, r.walk_status) for r in traversal.walk_status(tree).collect()}
    assert got == {"doubling": (21, "FORMAT"), "wide": (21, "OK"), "self": (1, "OK"), "plain": (1, "OK"), "direct": (1, "FORMAT")}
    assert {r.doc_id: r.n for r in pdf.pages(made, tree).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {"doubling": 1, "wide": 20}
    few = traversal.budgets(made).withColumn("budget", F.lit(9).cast("long"))
    assert {r.doc_id: r.tree_status for r in pdf.page_tree_status(made, pdf.page_tree(made, few)).collect()} == {"doubling": "FORMAT", "wide": "UNSUPPORTED", "self": "OK", "plain": "OK", "direct": "FORMAT"}
    fields = pdf.form_fields(made).collect()
    assert sorted((r.doc_id, r.full_name, r.form_status) for r in fields) == [("plain", "a", "OK"), ("plain", "a.b", "OK"), ("self", "a", "FORMAT"), ("self", "a.b", "FORMAT")]
    assert min(r.budget for r in traversal.budgets(made).collect()) >= traversal.LEAST_BUDGET


def test_sanitize_guard_pruning_and_aliases(spark):
    launch, keep = b"<< /S /Launch >>", b"<< /S /GoTo >>"
    page = lambda more: [b"<< /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page " + more + b" >>"]
    files = {
        "emptied": page(b"/AA << /O %s /C %s >>" % (launch, launch)), "left": page(b"/AA << /O %s /C %s >>" % (launch, keep)), "empty before": page(b"/AA << >>"),
        "next": page(b"/AA << /O << /S /GoTo /Next [%s << /S /Launch /Next %s >>] >> >>" % (launch, launch)), "alias": [*page(b"/AA 4 0 R /Own 4 0 R"), b"<< /O %s >>" % launch],
        "shared": [b"<< /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 5 0 R] >>", b"<< /Type /Page /AA 4 0 R >>", b"<< /O %s >>" % launch, b"<< /Type /Page /AA 4 0 R >>"],
        "signed": [b"<< /Pages 2 0 R /AcroForm << /Fields [3 0 R] >> /OpenAction %s >>" % launch, b"<< /Type /Pages /Kids [] >>", b"<< /FT /Sig /V << >> >>"],
        "named": [b"<< /Pages 2 0 R /Names << /JavaScript << /Names [(a) %s (b) << /S /JavaScript >>] >> >> >>" % launch, b"<< /Type /Pages /Kids [] >>"],
    }
    made = parsed(spark, files)
    status, (nodes, edges) = pdf_edit.sanitize(made, ["launch"])
    assert {r.doc_id: r.status for r in status.collect()} == {k: "UNSUPPORTED" if k in ("alias", "signed") else "OK" for k in files}
    left = {k: set() for k in files}
    for r in edges.where("key IS NOT NULL").collect():
        left[r.doc_id].add(r.key)
    assert {k for k, keys in left.items() if "AA" in keys} == {"left", "empty before", "next"}
    assert "Next" not in left["next"] and "C" in left["left"] and not left["signed"] and "JavaScript" in left["named"]
    pairs = edges.where("doc_id = 'named' AND key IS NULL").count()
    assert pairs == 2  # the other pair
    both, (_, edges) = pdf_edit.sanitize(made, ["launch", "javascript"])
    assert edges.where("doc_id = 'named' AND key = 'Names'").count() == 0 and both.where("doc_id = 'named' AND status = 'OK'").count() == 1


def test_search_quads_of_turned_text(spark):
    rows = [("d", 0, i, 0, c, 10.0, 20.0 + 6 * i, 10.0, 26.0 + 6 * i, 10.0, 12.0 if c == "b" else 10.0, 0) for i, c in enumerate("aaba")]
    chars = spark.createDataFrame(rows, "doc_id string, page_index int, ord int, line int, ch string, x0 double, y0 double, x1 double, y1 double, height double, size double, argb long")
    page = spark.createDataFrame([("d", 0, (0.0, 0.0, 100.0, 200.0), 0, 1.0)], "doc_id string, page_index int, crop struct<x0:double,y0:double,x1:double,y1:double>, rotate int, unit double")
    cells = pdf_text.char_cells(chars, page)
    got = {r.offset: [tuple(round(v, 6) for v in p) for p in r.quad] for r in pdf_text.search_quads(cells, "ab").collect()}
    # upwards on the page: along is -y as shown, the top of the letters is on the left
    assert got == {1: [(0.4, 174.0), (0.4, 162.0), (12.4, 174.0), (12.4, 162.0)]}
    assert sorted(r.offset for r in pdf_text.search_quads(cells, "a").collect()) == [0, 1, 3] and pdf_text.search_quads(cells, "aaa").collect() == []


def test_graphics_states(spark):
    rng = random.Random(4)
    pages = {}
    for p in range(12):
        ops, depth = [], 0
        for _ in range(rng.randrange(1, 60)):
            op = rng.choice(["q", "Q", "cm", "cm", "W", "n", "f", "re", "S"])
            if op == "Q" and depth == 0 and p % 4:
                continue
            depth += (op == "q") - (op == "Q")
            ops.append((op, [round(rng.uniform(-2, 2), 1) for _ in range(6)] if op == "cm" else []))
        pages[p] = ops + [("Q", [])] * (depth if p % 5 else 0)
    pages[20] = [("cm", [1.0])]
    pages[21] = [("cm", [2.0, 0.0, 0.0, 2.0, 1.0, 1.0])] * 9 + [("f", [])]
    rows = [("d", p, 3 * i, op, args, 7) for p, ops in pages.items() for i, (op, args) in enumerate(ops)]
    status, states = graphics_state.graphics_states(spark.createDataFrame(rows, "doc_id string, page_index int, ord int, op string, args array<double>, depth int"))
    got = {(r.page_index, r.ord): (r.depth, tuple(r.ctm), r.clips) for r in states.collect()}
    fine = {r.page_index: r.state_status for r in status.collect()}
    for p, ops in pages.items():
        stack, ctm, clips, pending, want, good = [], (1, 0, 0, 1, 0, 0), 0, False, {}, True
        for i, (op, args) in enumerate(ops):
            want[p, 3 * i] = (len(stack), ctm, clips)
            if op == "q":
                stack.append((ctm, clips))
            elif op == "Q":
                if not stack:
                    good = False
                    break
                ctm, clips = stack.pop()
            elif op == "cm":
                if len(args) != 6:
                    good = False
                    break
                (a, b, c, d, e, f), (g, h, k, m, n, o) = args, ctm
                ctm = (a * g + b * k, a * h + b * m, c * g + d * k, c * h + d * m, e * g + f * k + n, e * h + f * m + o)
            elif op == "W":
                pending = True
            elif op in ("n", "f", "S") and pending:
                pending, clips = False, clips + 1
        good = good and not stack
        assert fine[p] == ("OK" if good else "FORMAT"), p
        mine = {k: v for k, v in got.items() if k[0] == p}
        assert set(mine) == (set(want) if good else set())
        for k, (depth, m, n) in mine.items():
            assert (depth, n) == (want[k][0], want[k][2]) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(m, want[k][1], strict=True)), (k, ops)
    empty = graphics_state.graphics_states(spark.createDataFrame([], "doc_id string, page_index int, ord int, op string, args array<double>"))
    assert [x.collect() for x in empty] == [[], []]
