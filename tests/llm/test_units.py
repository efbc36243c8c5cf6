"""Parts of the training-data operators that need no Spark."""

import base64
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiresmith.llm import bytebpe, decontam, htmltree, jaccard, langid, quality, textvec, tokenfile, warc

TEXTS = st.lists(st.text(alphabet=st.sampled_from("abcAB 1'.,\n\té日ñ!<|\x1c\xa0"), max_size=60), max_size=6)


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.pairs.tokens)}, special_tokens={})


def test_bpe_equals_library(codec, library):
    rng = random.Random(5)
    pieces = ["a", "e", "th", "ing", "ein", "é", "ñ", " ", "\n", "12", "'s", "!!", "日本", "и", "😀", "\x00", "\x1c", "\x85"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + ["a" * 5000, " " * 3000, "é" * 999, ""]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_single_pieces_by_merging(codec):
    """Against merging by rank, without the shortcut for pieces that are tokens."""
    pairs = codec.pairs
    rng = random.Random(6)
    for _ in range(500):
        piece = bytes(rng.choice(b"aeiounrstlhe\xc3\xa9 ") for _ in range(rng.randint(2, 14)))
        if piece in pairs.ids:
            continue
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranks = [(pairs.ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in pairs.ids]
            if not ranks:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert pairs.encode(piece) == [pairs.ids[p] for p in parts]


def test_word_encoder_equals_library():
    encoder = tokenfile.WordEncoder(P.path("word_bpe_49k.json"), "<u4")
    rng = random.Random(3)
    parts = ["a", "I", "É", "'s", "'", "***", "-", "é", "́", "̇", "̸", "=", "ß", "Σ", "İ", "23", " ", "\n", "\x85", "\xa0", "\x1c", "日本", "😀", "K", "ﬁ", "<|endoftext|>", "_", "don't,", "µ", "ª", "×"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, ""]
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for start in (0, 1000):  # the second time from the pool
        got = encoder.encode(pa.array(texts[start:], pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want[start:]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(9, 16))
def test_huffman_round_trip(ids, limit):
    ids = np.asarray(ids, np.int64)
    lengths = tokenfile.code_lengths(np.bincount(ids, minlength=301), limit)
    assert lengths.max() <= limit
    code = tokenfile.Code(lengths)
    data = tokenfile.pack_shard(code, [None, 5], [0, len(ids)], ids)
    keys, nulls, sizes, back = tokenfile.unpack_shard(data)
    assert back.tolist() == ids.tolist() and nulls.tolist() == [1, 0] and sizes.tolist() == [0, len(ids)] and keys[1] == 5


def test_huffman_is_optimal():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert int((tokenfile.code_lengths(counts, 30).astype(np.int64) * counts).sum()) == cost


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    data, offsets = textvec.packed(pa.array(texts, pa.string()))
    starts, ends, firsts = textvec.word_spans(textvec.LOWER[data], offsets, jaccard.WORD_BYTES)
    found = [bytes(textvec.LOWER[data][a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    want = [re.findall("[^\x20\x09-\x0d]+", t) for t in lower]
    assert found == [w for x in want for w in x]
    assert np.diff(firsts).tolist() == [len(x) for x in want]
    by_word = {}
    for w, h in zip(found, textvec.word_hashes(textvec.LOWER[data], starts, ends).tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_signatures_lose_no_link():
    """Sets that link share a signature, whatever tokens are frequent."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        base = rng.choice(1 << 20, n, replace=False)
        other = base.copy()
        changed = int(rng.integers(0, n // 9 + 1))
        other[:changed] = rng.integers(1 << 20, 1 << 21, changed)
        if rng.random() < 0.3:
            other = other[: max(1, len(other) - int(rng.integers(0, n // 10 + 1)))]
        sets = [np.sort(textvec.mix(np.unique(x).astype(np.uint64))) for x in (base, other)]
        common = len(np.intersect1d(*sets))
        if common * 5 < (len(sets[0]) + len(sets[1]) - common) * 4 or (len(sets[0]) == len(sets[1]) == common):
            continue
        tokens, firsts = np.concatenate(sets), np.cumsum([0, len(sets[0]), len(sets[1])])
        for share in (0.0, 0.5, 1.0):
            frequent = textvec.mix(tokens ^ np.uint64(77)) % np.uint64(100) < np.uint64(int(share * 100))
            sig, of, _ = jaccard.signatures(tokens, firsts, frequent)
            assert set(sig[of == 0]) & set(sig[of == 1]), (n, share)


def test_keys_round_trip():
    keys = jaccard.Keys(1000)
    tokens = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    values = keys.of(tokens)
    for p, a, b in jaccard._by_part(keys.part(tokens)):
        assert keys.unpack(p, keys.pack(p, values[a:b])).tolist() == values[a:b].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=8))
def test_fm_index(runs, patterns):
    text = np.asarray([x for r in runs for x in [*r, 0]], np.int64)
    index = decontam.FMIndex(text, step=3)
    lengths = np.asarray([len(p) for p in patterns])
    table = np.zeros((len(patterns), 4), np.int64)
    for i, p in enumerate(patterns):
        table[i, 4 - len(p) :] = p
    low, high = index.search(table, lengths)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_contamination_by_brute_force():
    rng = random.Random(8)
    words = ["the", "a", "b", "C", "é", "x1"]
    bench = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 13, 20]))) for _ in range(12)]
    texts = [" ".join(rng.choice([*words, "other"]) for _ in range(rng.randint(0, 40))) for _ in range(100)] + [b + ", " + b for b in bench] + [None, ""]
    windows = decontam.Windows([str(i) for i in range(12)], bench, 13)
    spans, items, counts = decontam._scan_batch(windows, pa.array(texts, pa.string()))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for text, s, found, n in zip(texts, spans, items, counts, strict=True):
        w, hit, ids = split(text), set(), set()
        for i, b in enumerate(map(split, bench)):
            for k in range(max(1, len(b) - 12) if b else 0):
                part = b[k : k + 13]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        ids.add(str(i))
        assert (n, ids) == (len(w), found)
        assert sum(x for _, x in decontam.merged(s)) == len(hit)


def test_remove_spans():
    assert decontam.remove_spans("One two, three four.", [(1, 2)]) == "One  four."


def test_gru_gradients():
    model = langid.ByteTagger(["a", "b"], units=3)
    rng = np.random.default_rng(0)
    steps, labels, mask = rng.integers(97, 100, (5, 4)).astype(np.uint8), np.array([0, 1, 0, 1]), np.ones((5, 4), np.float32)
    grads, _ = model.gradients(steps, labels, mask)
    for (owner, name), g in zip(model.weights(), grads, strict=True):
        w = getattr(owner, name)
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[i] += 1e-2
        up = model.gradients(steps, labels, mask)[1]
        w[i] -= 2e-2
        down = model.gradients(steps, labels, mask)[1]
        w[i] += 1e-2
        assert abs(g[i] - (up - down) / 2e-2) < 2e-4


def test_attention_gradients():
    model = quality.AttentionModel()
    model.c[:] = np.random.default_rng(1).standard_normal(len(model.c))
    counts, firsts = quality.passages(pa.array(["ab " * 100, "", "x!y " * 90]))
    labels = np.array([1, 0, 1], np.float32)
    loss = lambda: float(-np.log(np.where(labels > 0, p := quality._sigmoid(model.forward(counts, firsts)["logit"].astype(float)), 1 - p)).mean())
    for name, g in zip(model.NAMES, model.gradients(counts, firsts, labels), strict=True):
        w = getattr(model, name)
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[i] += 1e-2
        up = loss()
        w[i] -= 2e-2
        down = loss()
        w[i] += 1e-2
        assert abs(g[i] - (up - down) / 2e-2) < 1e-3 + 0.05 * abs(g[i]), name


@pytest.mark.parametrize(("html", "blocks"), [
    ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b <b>c</b>d<br>e", ["a", "b cd e"]),
    ("<nav>n</nav><article><h1>T</h1><p>x\n y</p><aside>no</aside><div class='comments'>no</div></article><div>out</div>", ["T", "x y"]),
    ("<script>var t='</p>';</script><style>p{}</style><p>k", ["k"]), ("<p>a</p><p cla", ["a"]), ("<div hidden>h</div><form>f</form>z", ["z"]), ("a &lt;b&gt; c", ["a <b> c"]),
])
def test_html_blocks(html, blocks):
    assert [b["text"] for b in htmltree.Page(html).weighted() if b["weight"] >= htmltree.LOW_IMPORTANCE] == blocks


def test_warc_record():
    record, sha = warc.build_record(7, "http://a/\r\n%", b"x\r\n\r\ny", None, "2000-01-01T00:00:00Z")
    got = warc.parse_record(record)
    assert (got["page_id"], got["url"], got["payload"], got["payload_digest"]) == (7, "http://a/\r\n%", b"x\r\n\r\ny", sha)
    assert len(base64.b32decode(sha)) == 20
    assert list(warc.coalesced([(0, 10), (10, 5), (1000, 3)], gap=50, most=500)) == [(0, 15, [0, 1]), (1000, 3, [2])]


def test_fits_hold_little_more_than_their_texts():
    """The driver fits on bounded samples: features of the whole sample would take several times the memory of its texts."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]
    texts = pa.array([" ".join(rng.choices(words, k=1000)) for _ in range(3000)], pa.large_string())
    peaks = []
    for fit in (lambda: quality.train(texts, [i % 2 for i in range(len(texts))], 0.0, epochs=1), lambda: langid.cut(texts)):
        tracemalloc.start()
        fit()
        peaks.append(tracemalloc.get_traced_memory()[1] / texts.nbytes)
        tracemalloc.stop()
    assert max(peaks) < 3


def test_scoring_holds_runs_of_bounded_size():
    """A slice of 2 MiB of text is scored in runs that take some tens of MB."""
    texts = pa.array(["abcdefghij klmnop " * 116] * 1000, pa.large_string())
    tracemalloc.start()
    quality.AttentionModel().score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
