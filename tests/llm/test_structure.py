"""Repair, tries and divergence against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quiresmith.llm import divergence, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, label string, cost long"
INK = re.compile(r"[^\x20\x09-\x0D]+")


def turns(spark, rows):
    """Rows of (conv_id, turn, role, text), with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def cheapest(rows):
    """Cost, audit and lines of the cheapest edits, by search over (place, state); rows of (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        blank = not INK.search(text)
        again = (role, text) in seen
        seen.add((role, text))
        faults.append((blank or again, 0 if blank or again else int(text.rstrip(" \t\n\v\f\r")[-1] not in ".!?")))
    queue = [(0, "", 0, 0, ())]
    done = set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        reply = state == 2
        heapq.heappush(queue, (cost + 2, audit + "I", i, 3 if reply else 2, (*lines, "assistant:" if reply else "user:")))
        if i < len(rows):
            (role, text), (must, cut) = rows[i], faults[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, lines))
            if not must:
                heapq.heappush(queue, (cost + 2 + cut, audit + "R", i + 1, 3 if reply else 2, (*lines, ("assistant:" if reply else "user:") + text)))
                if role[:1] == ("a" if reply else "u"):
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, 3 if reply else 2, (*lines, f"{role}:{text}")))
                if role[:1] == "s" and state == 0:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, 1, (*lines, f"{role}:{text}")))


@pytest.mark.parametrize("segment", [256, 3])
def test_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(5)
    texts = ["Yes.", "no", " ", "", "Why? ", "Go!\n", "a. ", "b ", "long " * 2000 + "."]
    rows = [(c, rng.choice([None, 1, 2, 3, 4, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", "ua"]), rng.choice(texts)) for c in range(40) for _ in range(rng.randrange(1, 12))]
    rows += [(None, 0, "assistant", "x."), (77, 1, "user", "one."), (77, 1, "user", "one."), (-3, 2**40, "user", "q?"), (-3, 5, "assistant", "b.")]
    report, repaired = repair.repair(turns(spark, [*rows, (78, None, None, None)]))
    got = {r.conv: r for r in report.join(repair.repaired_hashes(repaired), "conv", "left").collect()}
    rows.append((78, None, " ", " "))
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert len(got) == len(groups)
    for conv, mine in groups.items():
        mine = by_turn(mine)
        r = got["" if conv is None else f":{conv}"]
        cost, audit, lines = cheapest([x[2:] for x in mine])
        assert (r.cost, r.audit) == (cost, audit), mine
        assert r.sha256 == (hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)
        known = [x[1] for x in mine if x[1] is not None]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        blank = sum(not INK.search(x[3]) for x in mine)
        assert r.blank == blank and r.duplicate == sum(not not INK.search(x[3]) and x[2:] in [y[2:] for y in mine[:k]] for k, x in enumerate(mine))
        assert r.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
    report, repaired = repair.repair(turns(spark, []))
    assert report.collect() == [] and repaired.collect() == []


def brute_trie(groups):
    nodes = defaultdict(list)
    for conv, seq in groups.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(conv)
    out = set()
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = lambda k: sum(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)
        saved = sum((len(nodes[k]) - 1) * len(INK.findall(k[-1][1])) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in members if tuple(groups[c]) == key)))
        out.add((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children(key), sum(not children(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("limit", "chunk"), [(10**6, 8192), (6, 2), (1, 1)])
def test_trie(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "d\te  f"])) for c in range(30) for t in range(rng.randrange(1, 5))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(5)] + [(c, t, "user", f"same {t}" if t < 4 else "x") for c in (131, 132) for t in range(3, 9)]
    rows += [(-5, None, None, None), (-5, None, "user", "z"), (-5, None, "user", "z"), (8, 9, "r", "long " * 5000)]
    table = turns(spark, [*rows, (None, 0, "user", "gone")])
    groups = defaultdict(list)
    for conv, turn, role, text in by_turn([(c, t, r or "", x or "") for c, t, r, x in rows]):
        groups[conv].append((role, text))
    groups[999] = []
    convs = table.where("conv_id IS NOT NULL").select("conv_id").distinct().union(spark.createDataFrame([(999,)], "conv_id long"))
    got = [tuple(r) for r in trie.prefix_trie(trie.label_turns(table), convs, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(groups)
    assert trie.prefix_trie(trie.label_turns(table.limit(0)), convs.limit(0), limit).collect() == []


def test_trie_bits():
    import numpy as np

    bits = trie.louds(np.array([2, 2, 0, 0, 1, 0]))  # two roots, the first with two leaves, then a grandchild
    assert "".join(map(str, bits.astype(int))) == "11011000100"[:11]
    assert trie.louds_parents(bits).tolist() == [-1, -1, 0, 0, 3]
    assert trie.louds_children(bits).tolist() == [2, 0, 0, 1, 0]


def js(p, q):
    one = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0, sum(one(a, b) + one(b, a) for a, b in zip(p, q, strict=True)) / 2))


def test_divergence(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choice(["the", "of", "and", "der", "Haus", "x1", "ä,"]) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    texts = [*lines, None, "", " \n", "a b c d e " * 4, "w " * 30, "\n".join(["same line", "other", "same line", " ", " "]), "$$$ ### |", "é" * 70000, lines[0], lines[0] + "\n" + lines[0], "!? " * 80, "9 " * 20000]
    langs = [("en", "de", None)[i % 3] for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, x, 1.0, 7) for (i, t), x in zip(enumerate(texts), langs, strict=True)], "doc_id long, text string, lang string, kept double, n_words int")
    rules = divergence.Rules(word_share=0.05, least_words=20, least_chars=60)
    refs = divergence.fit_references(docs, rules)
    split = lambda t: INK.findall(t or "")
    counts = {x: Counter(w for t, y in zip(texts, langs, strict=True) if y == x for w in split(t)) for x in ("de", "en")}
    totals = {x: sum(c.values()) for x, c in counts.items()}
    common = sorted({w for x, c in counts.items() for w in c if c[w] / totals[x] >= 0.05})
    assert refs.languages == ["de", "en"] and len(refs.words) == len(common)
    shares = {x: [counts[x][w] / totals[x] for w in common] for x in counts}
    for row in divergence.judge(docs, refs, rules).collect():
        t, words = texts[row.doc_id] or "", split(texts[row.doc_id])
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        worded = [x for x in t.split("\n") if INK.search(x)]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(worded) - len(set(worded)), len(again))
        assert row.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words))
        if words:
            p = [words.count(w) / len(words) for w in common]
            far = {x: js([*p, 1 - sum(p)], [*shares[x], 1 - sum(shares[x])]) for x in shares}
            assert row.word_distance == pytest.approx(far[row.language], abs=1e-6)
        if row.base_failed:
            assert not row.kept
    none = divergence.judge(docs, divergence.fit_references(docs.limit(0)))
    assert all(r.kept == (not r.base_failed) for r in none.collect())
    assert divergence.judge(docs.limit(0), refs).collect() == []


def test_divergence_uses_no_python(spark):
    docs = spark.createDataFrame([("a b",)], "text string").withColumn("lang", F.lit("en"))
    plan = divergence.judge(docs, divergence.fit_references(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
