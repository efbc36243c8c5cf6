r"""Repair of conversation structure (operator 11): a DuckDB recursion inside hash-partitioned batches.

The rows of a conversation become steps (initial of the role, whether it has to go, whether it breaks off). Four grammar states -
nothing yet, after the system turn, after a user turn, after an assistant turn - hold the cheapest cost and audit so far; each
recursion advances every conversation of a batch by one step. Steps are cut into segments of ``SEGMENT``; segments of longer conversations are
run from all four states, side by side, and a second recursion joins them, one segment at a time. So no batch and no recursion
grows with the longest conversation, but for its audit.

Two audits of one cost are never one the start of the other: they have as many letters for rows, and each insertion costs. So
the least of both at a state stays the least whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quiresmith.session import written

SEGMENT = 256
#: Steps that a batch is made for.
BATCH = 200_000
INK = r"[^\x20\x09-\x0D]"

_STATES = [f"s{i}" for i in range(4)]
_MACROS = """
    CREATE MACRO went(x, cost, letter) AS {'c': x.c + cost, 'a': x.a || letter};
    CREATE MACRO far() AS {'c': 1000000000000::BIGINT, 'a': ''};
    CREATE MACRO at_user(s0, s1, s2, s3) AS list_min([s2, went(s0, 2, 'I'), went(s1, 2, 'I'), went(s3, 2, 'I')]);
    CREATE MACRO at_reply(s3, e2) AS list_min([s3, went(e2, 2, 'I')]);
    CREATE MACRO user_turn(x, i, cut) AS CASE WHEN i = 'u' THEN went(x, cut, 'K') ELSE went(x, 2 + cut, 'R') END;
    CREATE MACRO reply_turn(x, i, cut) AS CASE WHEN i = 'a' THEN went(x, cut, 'K') ELSE went(x, 2 + cut, 'R') END;
"""
_STEPS = """
    WITH RECURSIVE dp(id, start, k, s0, s1, s2, s3) USING KEY (id, start) AS (
        SELECT id, start, 0, CASE WHEN start = 0 THEN zero ELSE far() END, CASE WHEN start = 1 THEN zero ELSE far() END, CASE WHEN start = 2 THEN zero ELSE far() END, CASE WHEN start = 3 THEN zero ELSE far() END
        FROM (SELECT DISTINCT id, unnest(CASE WHEN long THEN [0, 1, 2, 3] ELSE [0] END) AS start, {'c': 0::BIGINT, 'a': ''} AS zero FROM steps)
        UNION
        SELECT id, start, k + 1, went(s0, 3, 'D'),
               CASE WHEN must OR i <> 's' THEN went(s1, 3, 'D') ELSE list_min([went(s1, 3, 'D'), went(s0, cut, 'K')]) END,
               CASE WHEN must THEN went(e2, 3, 'D') ELSE list_min([went(e2, 3, 'D'), user_turn(s0, i, cut), user_turn(s1, i, cut), user_turn(e3, i, cut)]) END,
               CASE WHEN must THEN went(e3, 3, 'D') ELSE list_min([went(e3, 3, 'D'), reply_turn(e2, i, cut)]) END
        FROM (SELECT *, at_reply(s3, e2) AS e3 FROM (
            SELECT dp.*, t.i, t.must, t.cut, at_user(s0, s1, s2, s3) AS e2 FROM dp JOIN steps AS t ON t.id = dp.id AND t.k = dp.k))
    ) SELECT * FROM dp"""
_SEGMENTS = """
    WITH RECURSIVE dp(id, g, s0, s1, s2, s3) USING KEY (id) AS (
        SELECT DISTINCT id, 0::BIGINT, {'c': 0::BIGINT, 'a': ''}, far(), far(), far() FROM parts
        UNION
        SELECT dp.id, dp.g + 1, %s FROM dp JOIN (
            SELECT id, g, %s FROM parts GROUP BY id, g
        ) AS m ON m.id = dp.id AND m.g = dp.g
    ) SELECT * FROM dp""" % (
    ", ".join("list_min([" + ", ".join(f"{{'c': dp.s{p}.c + m{p}.s{q}.c, 'a': dp.s{p}.a || m{p}.s{q}.a}}" for p in range(4)) + "])" for q in range(4)),
    ", ".join(f"coalesce(any_value({{{', '.join(f's{q!r}: s{q}'.replace(chr(39), '') for q in range(4))}}}) FILTER (start = {p}), {{{', '.join(f's{q}: far()' for q in range(4))}}}) AS m{p}" for p in range(4)),
)
_DONE = "SELECT id, best.c AS cost, best.a AS audit FROM (SELECT id, list_min([s0, at_reply(s3, at_user(s0, s1, s2, s3))]) AS best FROM (%s)) ORDER BY id"


def _duck(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "768MB"})
    con.execute(_MACROS)
    for name, data in tables.items():
        con.register(name, data)
    return con


def _run_steps(batch: pa.Table) -> pa.Table:
    """States of every segment of a batch, from each state it may start in."""
    keys = batch.group_by(["conv", "segment"], use_threads=False).aggregate([])
    con = _duck(raw=batch, keys=keys.append_column("id", pa.array(range(keys.num_rows), pa.int64())))
    con.execute("CREATE TABLE steps AS SELECT id, k, i, must, cut, long FROM raw JOIN keys USING (conv, segment)")
    states = ", ".join(f"{s}.c AS {s}_c, {s}.a AS {s}_a" for s in _STATES)
    return con.sql(f"SELECT conv, segment, start, {states} FROM ({_STEPS}) JOIN keys USING (id)").to_arrow_table()


def _join_segments(batch: pa.Table) -> pa.Table:
    """Cost and audit of every conversation of a batch, from the states of its segments."""
    keys = batch.group_by(["conv"], use_threads=False).aggregate([])
    con = _duck(raw=batch, keys=keys.append_column("id", pa.array(range(keys.num_rows), pa.int64())))
    states = ", ".join(f"{{'c': {s}_c, 'a': {s}_a}} AS {s}" for s in _STATES)
    con.execute(f"CREATE TABLE parts AS SELECT id, segment AS g, start, {states} FROM raw JOIN keys USING (conv)")
    return con.sql(f"SELECT conv, cost, audit FROM ({_DONE % _SEGMENTS}) JOIN keys USING (id)").to_arrow_table()


def _batched(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    return rows.withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(n)))


def edits(steps: DataFrame, n_steps: int) -> DataFrame:
    """``conv, cost, audit``: the cheapest edits of conversations, given as ``conv, pos, i, must, cut, long``."""
    spark = steps.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = steps.select("conv", F.floor(F.col("pos") / SEGMENT).cast("long").alias("segment"), (F.col("pos") % SEGMENT).cast("int").alias("k"), "i", "must", "cut", "long")
    state = ", ".join(f"{s}_c long, {s}_a string" for s in _STATES)
    parts = _batched(cut, max(least, -(-n_steps // BATCH)), "conv", "segment").groupBy("batch").applyInArrow(lambda t: _run_steps(t.drop(["batch"])), f"conv string, segment long, start int, {state}")
    parts = written(parts, "segment-states")
    return _batched(parts, max(least, -(-n_steps // BATCH)), "conv").groupBy("batch").applyInArrow(lambda t: _join_segments(t.drop(["batch"])), "conv string, cost long, audit string")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit) -> (conv, pos, place, edit, new_role): what stays or is put in; insertions stand before the row at pos."""
    for batch in batches:
        out: list[tuple] = []
        for conv, audit in zip(batch["conv"].to_pylist(), batch["audit"].to_pylist(), strict=True):
            made = len(audit) - audit.count("D")
            turn, pos, place = -(made % 2), 0, 0  # an odd number of turns begins with the system's
            for letter in audit:
                if letter != "D":
                    out.append((conv, pos, place, letter, None if turn < 0 else ("user", "assistant")[turn % 2]))
                    turn += 1
                place += 1
                if letter != "I":
                    pos, place = pos + 1, 0
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv", "pos", "place", "edit", "new_role"])


def placed_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, pos``: rows by number from 0 in their conversation, over range partitions.

    ``conv`` is a key that a null id has too; null roles and texts are one space. Rows sort by turn (nulls first), ties by role and text.
    """
    spark = rows.sparkSession
    order = ["conv", "turn", "role", "text"]
    base = rows.select(conv_key(F.col(conv)).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    spread = base.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = written(spread.withColumns({"part": F.spark_partition_id(), "at": at}), "placed")
    bases, total = [], 0
    for part, n in spread.groupBy("part").count().orderBy("part").collect():
        bases.append((part, total))
        total += n
    numbered = spread.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").withColumn("n", F.col("base") + F.col("at")).drop("part", "at", "base")
    starts = numbered.groupBy("conv").agg(F.min("n").alias("start"))
    return numbered.join(starts, "conv").withColumn("pos", F.col("n") - F.col("start")).drop("n", "start")


def conv_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit(":"), conv.cast("string")), F.lit(""))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    r"""(report, repaired) of conversations whose role initials have to be ``(s?(ua)+)?``.

    ``report``: conv (conv_key()), gaps, blank, duplicate, truncated, illegal, cost, audit. ``repaired``: conv, pos, place, edit, role, text, in the order
    of pos and place. A row's first fault counts: blank (white space of ``[\x20\x09-\x0D]`` alone), duplicate (role and text as in an earlier
    row) or truncated (its last other character isn't one of ``.!?``). Keeping costs 0, changing the role to user or assistant 2, deleting 3 (blank and
    duplicate rows have to go), inserting an empty user or assistant turn 2; a truncated row that stays adds 1. The cheapest
    edits hold, ties by the least audit (K, R, D, I in order). Null roles and texts are one space, ties of turns go by role and text,
    repeated rows are rows of their own; an empty table gives empty results. Other columns are ignored.
    """
    placed = written(placed_rows(rows, conv, turn, role, text), "repair-rows")
    short = placed.select("conv", "pos", "turn", F.substring("role", 1, 1).alias("i"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"), (~F.col("text").rlike(INK)).alias("blank"), (~F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")).alias("open"))
    first = short.groupBy("conv", "same").agg(F.min("pos").alias("first"))
    faults = short.join(first, ["conv", "same"]).withColumn("duplicate", ~F.col("blank") & (F.col("pos") > F.col("first")))
    faults = faults.select("conv", "pos", "turn", "i", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("open")).alias("truncated"))
    faults = written(faults, "repair-faults")
    border = F.floor(F.col("pos") / SEGMENT)
    inside = faults.groupBy("conv", border.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("pos", "i"))).alias("x"))
    pairs = F.transform(F.slice("x", 2, SEGMENT), lambda y, k: F.concat(F.col("x")[k]["i"], y["i"]))
    wrong = lambda pair: ~pair.isin("su", "ua", "au")
    inside = inside.select("conv", "segment", F.size(F.filter(pairs, wrong)).alias("wrong"), F.col("x")[0]["i"].alias("first"), F.element_at("x", -1)["i"].alias("last"))
    before = F.lag("last").over(Window.partitionBy("conv").orderBy("segment"))
    illegal = inside.withColumn("before", before).groupBy("conv").agg(F.sum(F.col("wrong") + F.when(wrong(F.concat("before", "first")), 1).otherwise(0)).alias("illegal"))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    facts = faults.groupBy("conv").agg(gaps, count("blank"), count("duplicate"), count("truncated"), F.count(F.lit(1)).alias("n"))
    facts = written(facts, "repair-facts")
    steps = faults.select("conv", "pos", "i", (F.col("blank") | F.col("duplicate")).alias("must"), F.col("truncated").cast("int").alias("cut"))
    steps = steps.join(facts.select("conv", (F.col("n") > SEGMENT).alias("long")), "conv")
    found = written(edits(steps, facts.agg(F.sum("n")).first()[0] or 0), "edits")
    items = found.select("conv", "audit").mapInArrow(_items, "conv string, pos long, place int, edit string, new_role string")
    kept = items.where("edit <> 'I'").join(placed.select("conv", "pos", "role", "text"), ["conv", "pos"])
    kept = kept.select("conv", "pos", "place", "edit", F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role")).alias("role"), "text")
    added = items.where("edit = 'I'").select("conv", "pos", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    report = facts.join(illegal, "conv").join(found, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, kept.unionByName(added)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, segment, lines) -> (conv, sha256), one segment in memory at a time."""
    conv, h, out = None, hashlib.sha256(), []
    for batch in batches:
        for c, lines in zip(batch["conv"].to_pylist(), batch["lines"].to_pylist(), strict=True):
            if c == conv:
                h.update(b"\n")
            else:
                if conv is not None:
                    out.append((conv, h.hexdigest()))
                conv, h = c, hashlib.sha256()
            h.update(lines.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["conv", "sha256"])
            out = []
    if conv is not None:
        out.append((conv, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["conv", "sha256"])


def repaired_hashes(repaired: DataFrame) -> DataFrame:
    """``conv, sha256`` (hex) of the repaired ``role:text`` lines, joined by new lines; conversations without lines have no row."""
    n = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.struct("pos", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    parts = repaired.groupBy("conv", F.floor(F.col("pos") / SEGMENT).cast("long").alias("segment")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))
    return parts.repartition(n, "conv").sortWithinPartitions("conv", "segment").select("conv", "lines").mapInArrow(_hashed, "conv string, sha256 string")
