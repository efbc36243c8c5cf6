r"""Prefix tries of conversations (operator 13): succinct level-order tries per prefix shard.

Conversations become sequences of 128-bit turn labels; equal ones are one row with a weight. A prefix is heavy if more than
``limit`` turns lie below it. Sequences are dealt out by their first prefix that isn't heavy, so that no shard holds much more than ``limit``
turns, however many conversations start alike. Each shard is a forest that numpy builds level by level: a LOUDS
bit vector (the children of every node in unary, in level order), labels and weights; parents and children are read from
the bits, and rollups run from the last level up. Heavy prefixes and the root are the upper levels: sums of the shards' roots by prefix,
finished by the same reverse pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresmith.session import written

SPACE = r"[\x20\x09-\x0D]+"
#: Turns below a prefix from which on it is heavy, and turns a shard is made for.
LIMIT = 1_000_000
#: Conversation ids that one row of an end list holds.
CHUNK = 8192
#: Rows up to which the upper levels are broadcast; beyond it the join is by shuffle.
SMALL = 200_000

ABOVE = "array<struct<prefix:string,words:long>>"
ABOVE_TYPE = pa.list_(pa.struct([("prefix", pa.string()), ("words", pa.int64())]))
NODES = f"conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, cut string, up string, above {ABOVE}"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _digest(labels: Column) -> Column:
    """128 bits, as hex, of a sequence of labels."""
    return F.substring(F.sha2(F.array_join(labels, ""), 256), 1, 32)


ROOT = EMPTY_SHA[:32]


def label_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, label, words``: turns by number from 0, with what tells (role, text) apart and the words of the text.

    Turns sort by turn (nulls first), ties by role and text; repeated rows are turns of their own; null roles and texts count as
    empty. Rows without a conversation id are left out. Rows are range-partitioned by conversation and turn, so one long
    conversation spreads over many tasks; only a count per partition reaches the driver.
    """
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    base = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spread = base.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    label = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(spread.select("conv_id", label.alias("label"), F.size(F.array_remove(F.split("text", SPACE), "")).cast("long").alias("words"), F.spark_partition_id().alias("part"), at.alias("at")), "labels")
    bases, total = [], 0
    for part, n in placed.groupBy("part").count().orderBy("part").collect():
        bases.append((part, total))
        total += n
    numbered = placed.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select("conv_id", "label", "words", (F.col("base") + F.col("at")).alias("n"))
    starts = numbered.groupBy("conv_id").agg(F.min("n").alias("start"))
    return numbered.join(starts, "conv_id").select("conv_id", (F.col("n") - F.col("start")).alias("pos"), "label", "words")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, labels) -> (seq, prefix, depth, rest): every prefix with the turns from its last on."""
    for batch in batches:
        out: list[tuple[str, str, int, int]] = []
        for seq, labels in zip(batch["seq"].to_pylist(), batch["labels"].to_pylist(), strict=True):
            h = hashlib.sha256()
            for d, label in enumerate(labels, 1):
                h.update(label.encode())
                out.append((seq, h.hexdigest()[:32], d, len(labels) - d + 1))
            if len(out) > 50_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    seq, prefix, depth, rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(seq), pa.array(prefix), pa.array(depth, pa.int64()), pa.array(rest, pa.int64())], ["seq", "prefix", "depth", "rest"])


def louds(children: np.ndarray) -> np.ndarray:
    """The bit vector of a forest: for a root above all, then every node in level order, a one for each child and a zero."""
    bits = np.ones(int(children.sum()) + len(children), dtype=bool)
    bits[np.cumsum(children + 1) - 1] = False
    return bits


def louds_parents(bits: np.ndarray) -> np.ndarray:
    """Of every node, in level order, its parent's place; -1 at the roots: the zeros before its one."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones)) - 1


def louds_children(bits: np.ndarray) -> np.ndarray:
    """Of every node, in level order, how many children it has: the ones between two zeros."""
    return np.diff(np.flatnonzero(~bits)) - 1


def roll_up(values: np.ndarray, parents: np.ndarray, levels: list[int]) -> np.ndarray:
    """Sums over subtrees, from the last level up; ``levels`` are the places where levels begin, and the end."""
    for a, b in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
        np.add.at(values, parents[a:b], values[a:b])
    return values


def _above(labels: list[str], words: list[int], cut: int) -> list[dict]:
    """The prefixes shorter than ``cut``, from the root on, with the words of their last turn."""
    h, out = hashlib.sha256(), [{"prefix": ROOT, "words": 0}]
    for label, n in zip(labels[: cut - 1], words, strict=False):
        h.update(label.encode())
        out.append({"prefix": h.hexdigest()[:32], "words": n})
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences that end in the upper levels, with all their prefixes in place of labels and words."""
    for b in batches:
        above = [_above(*x) for x in zip(b["labels"].to_pylist(), b["words"].to_pylist(), b["cut"].to_pylist(), strict=True)]
        kept = ["conv_id", "n_convs", "seq", "ends_sha256"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(above, ABOVE_TYPE)], [*kept, "above"])


def _shard(rows: pa.Table) -> pa.Table:
    """All nodes of the sequences of one shard, from their cut on."""
    cuts = rows["cut"].to_numpy().astype(np.int64)
    weight, first = rows["n"].to_numpy().astype(np.int64), rows["first"].to_numpy().astype(np.int64)
    lists = rows["labels"].combine_chunks()
    offsets, sizes = lists.offsets.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy().astype(np.int64))
    hexes = b"".join(x.encode() for x in lists.values.to_pylist())
    pairs = np.frombuffer(bytes.fromhex(hexes.decode()), dtype=[("a", ">u8"), ("b", ">u8")]).astype([("a", "u8"), ("b", "u8")])
    kinds, label = np.unique(pairs, return_inverse=True)
    word = rows["words"].combine_chunks().values.to_numpy().astype(np.int64)
    prefixes = np.array(rows["cut_prefix"].to_pylist())
    _, some, node = np.unique(prefixes, return_index=True, return_inverse=True)
    n_roots = len(some)
    levels, counts = [0, n_roots], [np.array([n_roots])]
    members: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(cuts)), node.copy())]
    depths, words = [cuts[some]], [word[offsets[some] + cuts[some] - 1]]
    active, at = np.arange(len(cuts)), node
    for step in range(1, int((sizes - cuts).max(initial=0)) + 1):
        going = sizes[active] >= cuts[active] + step
        active, at = active[going], at[going]
        place = offsets[active] + cuts[active] - 1 + step
        keys, some, inverse = np.unique(at * len(kinds) + label[place], return_index=True, return_inverse=True)
        parent = keys // len(kinds)
        counts.append(np.bincount(parent - levels[-2], minlength=levels[-1] - levels[-2]))
        words.append(word[place[some]])
        depths.append(cuts[active[some]] + step)
        at = levels[-1] + inverse
        members.append((active, at))
        levels.append(levels[-1] + len(keys))
    n = levels[-1]
    counts.append(np.zeros(n - levels[-2], dtype=np.int64))
    bits = louds(np.concatenate(counts))
    parents, children = louds_parents(bits), louds_children(bits)
    n_convs, conv = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    ends = np.full(n, EMPTY_SHA, dtype=object)
    shas = rows["ends_sha256"].to_pylist()
    for step, (which, nodes) in enumerate(members):
        np.add.at(n_convs, nodes, weight[which])
        np.minimum.at(conv, nodes, first[which])
        last = sizes[which] == cuts[which] + step
        for i, k in zip(which[last].tolist(), nodes[last].tolist(), strict=True):
            ends[k] = shas[i]
    leaves = roll_up((children == 0).astype(np.int64), parents, levels)
    saved = roll_up((n_convs - 1) * np.concatenate(words), parents, levels)
    inner = parents >= 0
    _, some = np.unique(prefixes, return_index=True)
    labels, all_words = rows["labels"], rows["words"]
    above = [_above(labels[int(i)].as_py(), all_words[int(i)].as_py(), int(cuts[i])) for i in some]
    none = [None] * (n - n_roots)
    return pa.table({
        "conv_id": conv, "depth": np.concatenate(depths), "parent_conv_id": pa.array(conv[np.where(inner, parents, 0)], mask=~inner), "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(ends.tolist(), pa.string()),
        "cut": pa.array([*prefixes[some].tolist(), *none], pa.string()), "up": pa.array([*(x[-1]["prefix"] for x in above), *none], pa.string()), "above": pa.array([*above, *none], ABOVE_TYPE),
    })


def _upper(rows: pa.Table) -> pa.Table:
    """The upper levels: own savings are added up from the last level to the root, and every node gets its parent's first member."""
    rows = rows.sort_by([("depth", "ascending"), ("prefix", "ascending")])
    depth, n, conv = (rows[c].to_numpy() for c in ("depth", "n_convs", "conv_id"))
    prefix, up = np.array(rows["prefix"].to_pylist()), np.array([x or "" for x in rows["up"].to_pylist()])
    order = np.argsort(prefix)
    parents = np.where(depth > 0, order[np.searchsorted(prefix, up, sorter=order).clip(max=len(prefix) - 1)], -1)
    levels = [*np.searchsorted(depth, np.arange(int(depth.max(initial=0)) + 1)).tolist(), len(depth)]
    own = roll_up((n - 1) * rows["words"].to_numpy(), parents, levels)
    children = rows["n_children"].to_numpy().copy()
    np.add.at(children, parents[parents >= 0], 1)
    leaves = rows["n_leaves"].to_numpy() + (children == 0)
    out = {"conv_id": conv, "depth": depth, "parent_conv_id": pa.array(conv[np.where(parents < 0, 0, parents)], mask=parents < 0), "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": rows["saved_tokens"].to_numpy() + own, "ends_sha256": rows["ends_sha256"]}
    return pa.table(out | {"cut": rows["prefix"], "up": rows["up"], "above": pa.nulls(len(depth), ABOVE_TYPE)})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) -> (seq, first, ids): ids of equal seq that follow each other, as text."""
    seq, ids, out = None, [], []
    for batch in batches:
        for s, c in zip(batch["seq"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if s != seq or len(ids) == CHUNK:
                if ids:
                    out.append((seq, ids[0], ",".join(map(str, ids))))
                seq, ids = s, []
            ids.append(c)
        if len(out) > 1000:
            yield _columns(out, ["seq", "first", "ids"])
            out = []
    if ids:
        out.append((seq, ids[0], ",".join(map(str, ids))))
    if out:
        yield _columns(out, ["seq", "first", "ids"])


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, first, ids) -> (seq, ends_sha256), one chunk in memory at a time."""
    seq, h = None, hashlib.sha256()
    for batch in batches:
        out = []
        for s, ids in zip(batch["seq"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if s == seq:
                h.update(b",")
            else:
                if seq is not None:
                    out.append((seq, h.hexdigest()))
                seq, h = s, hashlib.sha256()
            h.update(ids.encode())
        if out:
            yield _columns(out, ["seq", "ends_sha256"])
    if seq is not None:
        yield _columns([(seq, h.hexdigest())], ["seq", "ends_sha256"])


def _end_lists(seqs: DataFrame) -> DataFrame:
    """``seq, ends_sha256`` over the ids of equal sequences, in ascending order. Ids are packed where the ranges are; a hot list is then read in chunks by one task."""
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = seqs.select("seq", "conv_id").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_chunks, "seq string, first long, ids string")
    return packed.repartition(n, "seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "seq string, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of all conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node.

    ``turns``: conv_id, pos, label, words as label_turns() makes them; ``conversations``: the conv_id of every member, those without turns too.
    A node is a distinct sequence of first turns, from the empty one at depth 0; conv_id is its smallest member. Without
    conversations there is no node. A conversation is held by one task, as 40 bytes a turn. Other columns are ignored.
    """
    paths = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "words"))).alias("path"))
    paths = conversations.select("conv_id").join(paths, "conv_id", "left")
    labels = F.coalesce(F.transform("path", lambda x: x["label"]), F.array().cast("array<string>"))
    seqs = paths.select("conv_id", labels.alias("labels"), F.coalesce(F.transform("path", lambda x: x["words"]), F.array().cast("array<bigint>")).alias("words"))
    seqs = written(seqs.withColumn("seq", _digest(F.col("labels"))), "sequences")
    distinct = seqs.groupBy("seq").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("labels").alias("labels"), F.first("words").alias("words"))
    distinct = written(distinct.join(_end_lists(seqs), "seq"), "distinct-sequences")
    prefixes = distinct.select("seq", "labels").mapInArrow(_prefixes, "seq string, prefix string, depth long, rest long")
    heavy = written(prefixes.groupBy("prefix").agg(F.sum("rest").alias("turns")).where(F.col("turns") > limit).select("prefix"), "heavy-prefixes")
    few = heavy.limit(SMALL + 1).count()
    heavy = F.broadcast(heavy) if few <= SMALL else heavy
    if few:
        deep = prefixes.join(heavy, "prefix", "left_semi").groupBy("seq").agg((F.max("depth") + 1).alias("deep"))
        distinct = distinct.join(deep, "seq", "left").withColumn("cut", F.coalesce("deep", F.lit(1)).cast("int")).drop("deep")
    else:
        distinct = distinct.withColumn("cut", F.lit(1))
    shards = max(1, -(-(distinct.agg(F.sum(F.size("labels"))).first()[0] or 0) // limit))
    below = distinct.where(F.size("labels") >= F.col("cut")).withColumn("cut_prefix", _digest(F.slice("labels", F.lit(1), F.col("cut"))))
    below = below.withColumn("shard", F.pmod(F.xxhash64("cut_prefix"), F.lit(max(shards, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    nodes = written(below.groupBy("shard").applyInArrow(lambda t: _shard(t), NODES), "trie-nodes")
    # sequences that end in the upper levels, then all that lies below an upper node, summed by its prefix
    ended = distinct.where(F.size("labels") < F.col("cut")).select(F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), "seq", "ends_sha256", "labels", "words", "cut")
    ended = ended.mapInArrow(_chains, f"conv_id long, n_convs long, seq string, ends_sha256 string, above {ABOVE}")
    zero = F.lit(0).cast("long")
    parts = nodes.where("cut IS NOT NULL").select("conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("seq"), F.lit(None).cast("string").alias("ends_sha256"), "above")
    parts = parts.unionByName(ended.select("conv_id", "n_convs", zero.alias("n_leaves"), zero.alias("saved_tokens"), "seq", "ends_sha256", "above"))
    steps = F.transform("above", lambda x, i: F.struct(x["prefix"].alias("prefix"), x["words"].alias("words"), i.cast("long").alias("depth"), F.when(i > 0, F.get(F.col("above"), i - 1)["prefix"]).alias("up"), (F.col("seq").isNull() & (i + 1 == F.size("above"))).cast("long").alias("cuts")))
    each = parts.withColumn("x", F.explode(steps)).select("*", "x.*")
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")], F.max("words").alias("words"), F.max("depth").alias("depth"), F.max("up").alias("up"), F.sum("cuts").alias("n_children")]
    upper = each.groupBy("prefix").agg(*sums, F.max(F.when(F.col("seq") == F.col("prefix"), F.col("ends_sha256"))).alias("ends_sha256")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
    upper = written(upper.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: _upper(t), NODES), "trie-upper")
    above = upper.select(F.col("cut").alias("up"), F.col("conv_id").alias("up_conv"))
    above = F.broadcast(above) if few <= SMALL else above
    lower = nodes.join(above, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return lower.select(*shown).unionByName(upper.select(*shown))

