"""The training-data operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiresmith.llm import bytebpe, chat, components, decontam, htmltree, jaccard, langid, quality, queries, sampling, tokenfile, topk, warc
from quiresmith.session import ship

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]


def documents(spark, rows):
    """Rows of (doc_id, text), with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, node long, k string, score double")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (4, "A b"), (None, "c d e"), (5, "é " * 30000), (6, "x" * 70000)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_quality(spark):
    good, bad = " ".join(WORDS), "!!! BUY NOW !!! " * 10
    docs = documents(spark, [(i, good if i % 2 else bad) for i in range(60)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("score")).unionByName(spark.createDataFrame([(None, 1, 0), (7, None, 0)], "doc_id long, quality int, score int"))
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs.unionByName(documents(spark, ODD)), model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got[:60])
    assert len(got) == 60 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(docs.limit(0), model).collect() == []
    assert quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0))).first().score == pytest.approx(0.5)


def test_held_out_quality(spark):
    """On rows that taught nothing."""
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
    p = lambda kind, text=None, uri=None, w=None, h=None, s=None, n=None: (kind, text, uri, w, h, s, n)
    rows = [
        (1, 0, "user", [p("text", "see <|image:0.1|> and </s>"), p("image", uri="a.png", w=56, h=57), p("text", "!")]),
        (1, 1, "assistant", [p("text", r"<\\/s> [INST]"), p("audio", uri="b", s=2.0)]),
        (2, None, None, None), (2, 0, "assistant", []), (2, 0, "assistant", []), (None, 0, "tool", [p(None, "t"), p("document", uri="d", n=3)]),
    ]
    out = chat.format_conversations(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{part}>"))
    out = out.withColumn("read", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].read] == [("user", "see <|image:0.1|> and </s><|image:0.1|>!".replace("<|image:0.1|>!", "<|image:0.1|>!")), ("assistant", r"<\\/s> [INST]<|audio:1.1|>")]
    assert got[1].loss == r"<\\/s> [INST]<|audio:1.1|>"
    assert [(a.turn, a.part, a.kind, a.uri, a.tokens) for a in got[1].attachments] == [(0, 1, "image", "a.png", 2 * 3 + 2), (1, 1, "audio", "b", 50)]
    assert got[1].expanded_tokens == 58 and got[1].formatted.count("<|image:0.1|>") == 1
    assert [tuple(t) for t in got[2].read] == [("", ""), ("assistant", ""), ("assistant", "")] and got[2].n_turns == 3
    assert got[None].expanded_tokens == 1536


def test_chat_uses_no_python(spark):
    plan = queries.QUERIES["op2_chat_format"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("text", ["", "</s>", "<\\/s>", "<\\\\/s>[INST]", "[/ROLE", "<|image:", "a<\\|image:b", "<<s>", "[[INST]]"])
def test_escape(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert row.u == text
    assert not any(c in row.e for c in ("</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<|image:"))


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, group, strict=True)), key=repr)


@pytest.mark.parametrize("tuning", [jaccard.Tuning(), jaccard.Tuning(2, 20, 7, 900, 6)])
def test_near_duplicates(spark, tuning):
    rng = np.random.default_rng(4)
    rows = list(ODD[:7])
    for i in range(12):
        base = [WORDS[k] for k in rng.integers(0, 60, int(rng.integers(3, 120)))]
        for c in range(int(rng.integers(1, 9))):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[k] = f"new{i}{c}{k}"
            rows.append((100 + len(rows), " ".join(copy)))
    common = " ".join(WORDS[:40])
    rows += [(500 + i, common + " " + " ".join(f"own{i}w{k}" for k in range(8 + i % 5))) for i in range(45)]
    got = jaccard.near_duplicates(documents(spark, rows).repartition(3), tuning=tuning).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(rows)


def test_near_duplicates_large_group(spark):
    """Copies of one text of 0 to 5 edits, whose text itself is missing: some link, some only with few others."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(260):
        copy = list(base)
        for k in rng.integers(0, 120, 1 + i % 5):
            copy[k] = f"new{int(rng.integers(0, 4))}k{k}"
        rows.append((i, " ".join(copy[: 120 - int(rng.integers(0, 12))])))
    want = brute_components(rows)
    assert len({r[2] for r in want}) > 20
    for tuning in (jaccard.Tuning(), jaccard.Tuning(salt_rows=60, block_rows=50)):
        got = jaccard.near_duplicates(documents(spark, rows).repartition(3), tuning=tuning).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_one_of_each(spark):
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[30:])
    docs = documents(spark, [(3, a), (2, a), (2, a), (9, b), (None, None), (4, a + " z")])
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(2, a), (9, b), (None, None)], key=repr)
    assert jaccard.near_duplicates(docs.limit(0)).collect() == []


def test_one_of_each_repeated_keys(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b + " z"), (None, ""), (None, ""), (1, a + " z"), (2, c), (2, d), (2, c), (3, c), (3, d + " z"), (3, "own")]
    got = sorted(((r.doc_id, r.text, r.k) for r in jaccard.one_of_each(documents(spark, rows).repartition(3)).collect()), key=repr)
    either = next(t for _, t, _ in got if t in (b, b + " z"))
    assert got == sorted([(i, t, "x") for i, t in [(None, either), (None, ""), (None, ""), (1, a + " z"), (2, c), (2, d), (3, "own")]], key=repr)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}
    assert components.connected_components(edges.limit(0)).collect() == []


def test_warc(spark):
    rows = [(1, "u", "same"), (5, "u", "same"), (3, None, "same"), (2, "v", None), (4, "v", ""), (None, "w", "same"), (6, "w", "é" * 50000), (7, "x", "é"), (7, "x", "é")]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, file string")
    index = warc.archive(pages)
    got = warc.read_warc(index).collect()
    assert len(got) == len(rows)
    hot = warc.read_warc(warc.archive(pages, hot=1)).collect()
    assert sorted(map(repr, hot)) == sorted(map(repr, got))
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].record_type, by_id[1].refers_to, by_id[3].refers_to, by_id[5].record_type) == ("revisit", 5, 5, "response")
    assert (by_id[2].refers_to, by_id[4].record_type, by_id[7].record_type) == (4, "response", "response")
    assert bytes(by_id[6].payload).decode() == "é" * 50000 and by_id[1].payload is None and by_id[1].payload_bytes == 4
    assert [r.page_id for r in warc.read_warc(index.where("page_id = 6")).collect()] == [6]
    assert warc.read_warc(warc.archive(pages.limit(0))).collect() == []
    assert {r.record_type for r in warc.read_warc(warc.archive(pages, min_revisit_bytes=100)).collect()} == {"response"}


def test_language(spark):
    texts = {"en": "the thing that was with them and the other", "fr": "être le même où ça déjà été très", "de": "über für schön große Straße und nicht"}
    rows = [(i, texts[lang] * (1 + i % 3), lang) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "en"), (902, "the", None)], "doc_id long, text string, lang string")
    model = langid.fit_language(docs)
    got = langid.identify(documents(spark, [(r[0], r[1]) for r in docs.collect()]), model).collect()
    assert np.mean([r.lang_pred == lang for r, (_, _, lang) in zip(got, rows, strict=False)]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (900, 901)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    none = langid.fit_language(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    docs = documents(spark, ODD).repartition(3)
    tokenizer = Tokenizer.from_file(path)
    got = tokenfile.token_file_round_trip(docs, path, 2).collect()
    want, start = [], 0
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        raw = np.asarray(ids, "<u4").tobytes()
        want.append((i, start, len(ids), zlib.crc32(raw), raw))
        start += len(ids)
    assert sorted((tuple(r[:4]) + (bytes(r.ids),) for r in got), key=lambda r: r[1]) == want
    assert tokenfile.token_file_round_trip(docs.limit(0), path, 2).collect() == []


def test_contamination(spark):
    item = " ".join(WORDS[:20])
    bench = spark.createDataFrame([("b", item, 1), ("a", "q r", 1), ("a", "q r", 1), (None, "x", 1), ("z", None, 1), ("y", "", 1)], "item_id string, text string, spans int")
    docs = documents(spark, [*ODD[:7], (10, "go " + " ".join(WORDS[2:18]) + " end q R"), (11, "q x r"), (12, "Q, r! " + "n " * 60)])
    for block in (1 << 20, 1):
        found = decontam.judged(decontam.find_contamination(docs, bench, block_bytes=block, keep=["k", "score"]))
        got = {r.doc_id: r for r in found.collect() if r.doc_id in (1, 10, 11, 12)}
        assert (got[10].n_hit, [tuple(s) for s in got[10].spans], got[10].items, got[10].contaminated) == (18, [(1, 16), (18, 2)], ["a", "b"], True)
        assert (got[11].n_hit, got[12].n_hit, got[12].contaminated, got[1].n_words, got[1].contaminated, got[1].k) == (1, 2, False, 0, False, "x")
        assert (list(got[11].spans), got[11].items, got[11].contaminated) == ([(1, 1)], [], True)  # an item without an id hits and isn't listed
        assert found.count() == docs.count()
    assert decontam.find_contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.find_contamination(docs.limit(0), bench).collect() == []


def test_main_text(spark):
    rows = [(i, f"http://h/{i}", f"<div class='top'><p>Sign up today</p></div><div><p>Story {i}</p></div>") for i in range(20)]
    rows += [(50, None, None), (51, "x", ""), (52, "http://h/52", "<main><p>Sign up today</p></main>"), (52, "http://h/52", "<main><p>Sign up today</p></main>"), (None, "http://one/", "<p>only</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, blocks int")
    got = htmltree.extract_main_text(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(text[i] == f"Story {i}" for i in range(20))
    assert (text[50], text[51], text[52], text[None]) == ("", "", "Sign up today", "only")
    assert htmltree.extract_main_text(pages.limit(0)).collect() == []


def test_main_text_copies(spark):
    page = lambda x: f"<p>Same foot</p><div><p>Story {x}</p></div>"
    rows = [(i, f"http://h/{i}", page(min(i, 200))) for i in range(300)]  # a third are copies of one page
    rows += [(1000 + i, "http://two/", "<title>t</title><p>only</p><p>twice</p><p>twice</p>") for i in range(2)]
    text = {r.page_id: r.text for r in htmltree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [text[i] for i in range(300)] == [f"Story {min(i, 200)}" for i in range(300)]
    assert text[1000] == text[1001] == "only\n\ntwice\n\ntwice"


def test_main_text_outside_landmarks(spark):
    page = lambda x: f"<ul><li><a href='/{x}'>Link {x}</a></li></ul><div class='content no-sidebar'><p>Story {x}, <a href='/'>a link</a></p></div><article class='card related'><header class='article-header'>Card {x}</header></article><div class='cookie-banner'>Cookie {x}</div><p>Same foot</p>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(20)] + [(50, "http://alone/", page(50))]
    text = {r.page_id: r.text for r in htmltree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [text[i] for i in range(20)] == [f"Story {i}, a link\n\nCard {i}" for i in range(20)]
    assert text[50] == "Card 50"  # no other page tells the story from a notice


def site(host, x, kind="div"):
    """A page whose parts have no telling names, but for the article."""
    return (x, f"http://{host}/{x}", f"<form><{kind}><p>Home</p><p>Topics</p></{kind}><article><div class='post-header'><h1>Title {x}</h1></div><p>Story {x} of {host}</p><p class='social policy'>Policy {x}</p><p>Tell your friends</p></article><{kind}><p>Hint {x % 3}</p></{kind}></form>")


def brute_main_text(rows):
    """Texts by a style tree of plain loops: every block's path, pages and texts counted one by one."""
    pages = []
    for i, url, html in rows:
        page = htmltree.Page(html or "")
        blocks, layouts = page.weighted(), page.layouts
        host = re.match(r"(?:\w+://([^/]*))?", url or "")[1] or ""
        article = tuple((b["path"], b["feature"]) for b in blocks if b["inside"])
        whole = (tuple((b["path"], b["feature"], b["inside"]) for b in blocks), repr(layouts))
        pages.append((i, host, blocks, layouts, {True: article, False: whole}))
    entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts), sum(counts)) for c in counts) if sum(counts) > 1 else 1.0
    out = {}
    for i, host, blocks, _, _ in pages:
        gone = set()
        for at, b in enumerate(blocks):
            side = b["inside"]
            others = {p[4][side]: p for p in pages if p[1] == host}.values()
            having = [{x["feature"] for x in p[2] if x["inside"] == side and x["path"] == b["path"]} for p in others]
            having = [h for h in having if h]
            k, m = sum(b["feature"] in h for h in having), len(having)
            content = 1 - math.log(k) / math.log(m) if k > 1 else 1.0
            if side:
                if m >= htmltree.LEAST_PAGES and content <= htmltree.LOW_INSIDE:
                    gone.add(at)
                continue
            styles = Counter(repr(s) for p in others for (path, inside), s in p[3].items() if path == b["parent"] and not inside)
            importance = 0.1 * (entropy(styles.values()) if styles else 1.0) + 0.9 * content
            w = b["weight"]
            value = importance if w == 1 else 0.0 if not w or m < (htmltree.LEAST_PAGES if w == htmltree.WEAK else 2) else w * importance if w == htmltree.WEAK else importance ** (1 / w)
            if value < htmltree.LOW_IMPORTANCE:
                gone.add(at)
        if 2 * sum(len(blocks[at]["text"]) for at in gone if blocks[at]["inside"]) > sum(len(b["text"]) for b in blocks if b["inside"]):
            gone -= {at for at in gone if blocks[at]["inside"]}
        out[i] = "\n\n".join(b["text"] for at, b in enumerate(blocks) if b["text"] is not None and at not in gone)
    return out


def test_main_text_by_the_tree(spark):
    rows = [site("h", x) for x in range(12)] + [site("alone", 100)] + [site("g", x, "section") for x in range(200, 206)]
    rows += [(300 + i, "http://copies/", f"<article><p>One story</p><p>twice</p><p>Part {i // 2}</p></article>") for i in range(10)]
    rows += [(400 + i, "http://weak/", f"<div class='share'>{'Send it' if i % 2 else f'Talk {i}'}</div><p>News {i}</p>") for i in range(12)]
    got = {r.page_id: r.text for r in htmltree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == brute_main_text(rows)
    story = lambda x, host: f"Title {x}\n\nStory {x} of {host}\n\nPolicy {x}"
    assert all(got[x] == story(x, "h") for x in range(12)) and all(got[x] == story(x, "g") for x in range(200, 206))
    assert got[100] == story(100, "alone") + "\n\nTell your friends"  # no other page tells
    assert got[304] == "One story\n\ntwice\n\nPart 2"  # most of it is repeated: a reprint
    assert (got[402], got[403]) == ("Talk 2\n\nNews 2", "News 3")
    alone = {i: "\n\n".join(b["text"] for b in htmltree.Page(h).weighted() if b["text"] is not None and b["weight"] >= htmltree.LOW_IMPORTANCE) for i, _, h in rows}
    assert sum(got[i] != alone[i] for i in got) > len(rows) / 2


def test_main_text_of_deep_and_long_pages(spark):
    deep = "<div>" * 100_000 + "deep" + "</div>" * 100_000
    inline = "<b>" * 50_000 + "".join(f"<p>{i}</p></u>" for i in range(50_000))
    rows = [(1, "http://a/", deep), (2, "http://b/", inline), (3, "http://c/", "<article><p>" + "long text " * 300_000 + "</p></article>")]
    got = {r.page_id: r for r in htmltree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].text, got[2].text.count("\n\n"), got[3].n_chars) == ("deep", 49_999, 2_999_999)


def test_bpe(spark):
    got = bytebpe.encode_decode(documents(spark, ODD), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    for r, (i, t) in zip(got, ODD, strict=True):
        assert (r.doc_id, r.decoded, r.decoded_sha256) == (i, t or "", hashlib.sha256((t or "").encode()).hexdigest())
        assert hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens
    assert bytebpe.encode_decode(documents(spark, ODD).limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


@pytest.mark.parametrize("block", [1000, 2])
def test_top_k(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("inf")] * 4), (104, [1.0]), (105, []), (None, [1.0] * 4), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 5, block_queries=block).collect())
    whole = [(i, np.floor(256 * np.asarray(v, float)).astype(int)) for i, v in rows if i is not None and i not in (100, 101, 102, 103)]
    want = []
    for q, v in whole:
        if q % 10 == 0:
            ranked = sorted((-int(v @ w), i) for i, w in whole if i != q and len(w) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert got == sorted(want)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_long_texts_are_scored_in_runs():
    rng = np.random.default_rng(5)
    texts = pa.array(["", None, "abc", *(" ".join(WORDS[k] for k in rng.integers(0, 60, n)) for n in (3, 300, 5000)), "", "é" * 700])
    model = quality.AttentionModel()
    model.c[:], model.a[:] = rng.standard_normal(len(model.c)), 3 * rng.standard_normal(len(model.a))
    want = quality._sigmoid(model.forward(*quality.passages(texts))["logit"].astype(np.float64))
    for most in (1, 7, 64):
        assert np.allclose(model.score(texts, most), want, atol=1e-5)
    tagger = langid.ByteTagger(["a", "b"])
    whole = tagger.pooled(texts)
    alone = np.concatenate([tagger.pooled(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(whole, alone, atol=1e-5)
    assert [len(t) for t in texts.to_pylist() if t] and langid.cut(texts)[0].shape[0] == sum(-(-len(t.encode()) // langid.WINDOW_BYTES) for t in texts.to_pylist() if t)


def test_quality_forward_by_hand(spark):
    """The score of the query against a pass through the layers in plain Python."""
    text = " ".join(WORDS) * 3
    docs = spark.createDataFrame([(i, WORDS[i % 60] * 20 if i % 2 else text[i:], "k", 7.0) for i in range(40)], "doc_id long, text string, predicted string, score double")
    model = quality.fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"), per_class=30)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def by_hand(value):
        raw = value.encode()
        bags, pull = [], []
        for at in range(0, max(1, len(raw)), quality.PASSAGE_BYTES):
            part = raw[at : at + quality.PASSAGE_BYTES]
            counts = [0] * quality.FEATURES
            for k in range(at, at + len(part)):
                counts[quality._PAIR_BUCKET[(raw[k - 1] << 8 if k else 0) | raw[k]]] += 1
            counts = [min(255, c) for c in counts]
            norm = max(1.0, math.sqrt(sum(counts)))
            size, distinct = sum(counts) / quality.PASSAGE_BYTES, sum(c > 0 for c in counts) / quality.PASSAGE_BYTES
            x = [4 * math.sqrt(c) / norm for c in counts] + [4 * distinct, 4 * distinct / max(size, 0.05), size]
            h = [math.tanh(sum(x[i] * float(model.w[i, j]) for i in range(len(x)) if x[i]) + float(model.b[j])) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * float(model.v[i, j]) for i in range(len(h)))) * sigmoid(sum(h[i] * float(model.u[i, j]) for i in range(len(h)))) for j in range(len(h))]
            bags.append(h)
            pull.append(math.exp(sum(g * float(a) for g, a in zip(gate, model.a, strict=True))))
        z = [sum(p * h[j] for p, h in zip(pull, bags, strict=True)) / sum(pull) for j in range(quality.HIDDEN)]
        return sigmoid(sum(a * float(c) for a, c in zip(z, model.c, strict=True)) + float(model.d[0]) + model.prior)

    got = quality.score_quality(docs, model).collect()
    rows = {r.doc_id: r for r in docs.collect()}
    assert all(abs(r.score - by_hand(rows[r.doc_id].text)) < 1e-3 and r.predicted == (r.score >= 0.3) for r in got)


def test_samples_are_the_same_every_time(spark):
    rows = [(i % 7, "long " * (20_000 if i == 5 else 5) + str(i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    counts = sampling.class_counts(df, "y")
    take = lambda d, most: [tuple(r) for r in sampling.within_bytes(sampling.bounded_sample(d, "y", "doc_id", 10, counts), "text", 40, most)]
    some = take(df, 1 << 20)
    assert some == take(df.repartition(5), 1 << 20) and 0 < len(some) <= 40
    less = take(df.repartition(2), 2000)
    assert less == take(df, 2000) and len(less) == len(some) and sum(len(r[1]) for r in less) <= 2000
    assert all(a == b for a, b in zip(less, some, strict=True) if len(b[1]) < 40)  # short texts stay whole wherever the long one is
    assert sampling.level_of([5, 100, 7], 40) == 28 and sampling.level_of([5, 7], 12) is None and sampling.level_of([9, 9], 9) == 4
    text = "".join(f"{i:06d}" for i in range(50_000))
    cut = spark.createDataFrame([(text,), ("é" * 3000,), (None,)], "t string").select(sampling.spread_windows(F.col("t"), 9000).alias("t"))
    long, exact, none = (r.t for r in cut.collect())
    assert 1024 < len(long) <= 9000 and exact == "é" * 3000 and none is None
    assert 0 < text.index(long[:1024]) < 200_000 and long[-500:] == text[-500:]  # from everywhere, no prefix
    assert sampling.within_bytes(df.limit(0), "text", 10, 10) == []


def test_batches_of_texts_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    texts = ship(spark).range(0, 9000, 1, 1).selectExpr("id", "repeat('abcdefgh', 300) AS text")
    got = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 9000 and max(r.size for r in got) < 9 << 20


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    counts = sampling.class_counts(df, "y")
    got = sampling.bounded_sample(df, "y", "doc_id", 50, counts).groupBy("y").count().collect()
    assert all(20 <= r["count"] <= 90 for r in got)
    assert df.select(sampling.remainder(F.col("doc_id"), 5).alias("r")).first().r == zlib.crc32(b"0") % 5


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and 50 < got.count() < 200
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_pipeline_clashing_columns_nulls_and_repeats(spark):
    """Every stage against the operator's own judgement of each row; documents keep their own values under any name."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    own = {"score": F.lit(-5.0), "predicted": F.lit(77), "lang_pred": F.lit("mine"), "n_hit": F.lit(-1), "items": F.lit("mine"), "n_words": F.lit("w"), "spans": F.lit(1), "node": F.lit("n"), "n": F.lit(0), "row": F.lit(True), "a.b": F.lit("dot"), "contaminated": F.lit(None).cast("string")}
    docs = base.select("*", *(c.alias(n) for n, c in own.items()))
    rows = [tuple(r) for r in docs.collect()]
    odd = [(None, "no id at all, but words enough"), (9_000_001, None), (9_000_002, ""), (9_000_003, "é " * 50_000)]
    docs = spark.createDataFrame([*rows, *rows[:5], *((i, t, *rows[0][2:]) for i, t in odd)], docs.schema).repartition(3)
    whole = Counter(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        kept = Counter(map(repr, got.collect()))
        assert kept and not kept - whole, name
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(sampling.remainder(F.col("doc_id"), 5) != 0)
    good = quality.score_quality(docs.select("doc_id", "text"), quality.fit_quality(docs, labels)).where("predicted = 1")
    assert sorted(r.text or "" for r in good.collect()) == sorted(r.text or "" for r in corpus_pipeline.quality(spark, docs, SF).collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    one = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    groups = {c for _, n, c in brute_components([r for r, x in zip(rows, sets, strict=True) if x])}
    assert len([1 for _, t in one if shingles(t)]) == len(groups) and sum(not shingles(t) for _, t in one) == sum(not x for x in sets)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] if w for i in range(max(1, len(w) - 12))}

    def clean(text):
        w, hit = words(text), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
        return not hit or 20 * len(hit) < len(w)

    assert sorted(map(repr, ((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()))) == sorted(map(repr, (r for r in rows if clean(r[1]))))
    named = langid.identify(docs.select("doc_id", "text"), langid.fit_language(docs.where(sampling.remainder(F.col("doc_id"), 4) != 2)))
    some = named.where((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.LEAST_LANGUAGE_SCORE)).collect()
    assert sorted(r.text for r in some) == sorted(r.text for r in corpus_pipeline.language(spark, docs, SF).collect())
