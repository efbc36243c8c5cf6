r"""Chat formatting with typed content parts (operator 2), in DataFrame functions only.

A conversation is a set of turns; a turn has a role and an array of typed
parts (text, image, audio, document). A visitor, one expression per kind,
flattens the parts in order: text is escaped, every attachment becomes a
placeholder ``<|kind:turn.part|>`` whose reference and expanded token count
are recorded. Turns are framed as ``<s>[ROLE]role[/ROLE]content</s>``.

Escaping: wherever a text holds the start of a control string, with any
number of backslashes after its first character, one more backslash is put
there; unescaping takes one away. Control strings begin with ``<`` or ``[``
and hold neither of them later, so no control string can appear in, or arise
at the border of, escaped text, and the mapping is one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("text", "image", "audio", "document")
TURN_OPEN, ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
#: What follows the first character of a control string; the chat marks of common templates are reserved too.
CONTROL_TAIL = r"(/?(?:s>|INST\]|ROLE\])|\|(?:image|audio|document):)"

PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
IMAGE_PATCH, IMAGE_EXTRA, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 2, 25, 512


def escape(text: Column) -> Column:
    """Escape control strings; null stays null."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL_TAIL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL_TAIL, "$1$2$3")


def text_parts(text: Column) -> Column:
    """One text part holding ``text``; null counts as empty."""
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text")]
    fields += [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def part_tokens(part: Column) -> Column:
    """Tokens that a model expands an attachment to; 0 for text and unknown sizes."""
    patches = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / IMAGE_PATCH)
    image = patches(part["width"]) * patches(part["height"])
    return (
        F.when(part["kind"] == "image", F.when(image > 0, image + IMAGE_EXTRA).otherwise(0))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * DOCUMENT_PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")).isin(*KINDS[1:])


def _visit(part: Column, turn: Column, index: Column) -> Column:
    """The flattened form of one part."""
    mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), turn.cast("string"), F.lit("."), index.cast("string"), F.lit("|>"))
    return F.when(_is_attachment(part), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv, formatted, n_turns, loss_spans, attachments, expanded_tokens``.

    ``loss_spans`` are (start, length) in code points of ``formatted``, from 0,
    over the content of each turn of ``loss_role``. ``attachments`` are in order,
    with turn and part position, kind, uri and expanded tokens.
    Turns sort by turn number; ties and repeated rows are kept, ordered by role
    and content; null turn numbers come first. Null roles, parts and texts count
    as empty; a null conversation id is a conversation of its own. Parts of an
    unknown kind count as text. An empty table gives an empty result. Other
    columns are ignored. One shuffle, by conversation.
    """
    base = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role), F.lit("")).alias("_r"), F.coalesce(F.col(parts), F.array().cast(PARTS)).cast(PARTS).alias("_p"))
    by_turn = Window.partitionBy("_c").orderBy("_t", "_r", "_p")
    rows = base.withColumn("_n", F.row_number().over(by_turn) - 1)
    rows = rows.select(
        "_c", "_n", "_r",
        F.concat(F.lit(TURN_OPEN + ROLE_OPEN), escape(F.col("_r")), F.lit(ROLE_CLOSE)).alias("_head"),
        F.array_join(F.transform("_p", lambda p, i: _visit(p, F.col("_n"), i)), "").alias("_body"),
        F.filter(
            F.transform("_p", lambda p, i: F.struct(F.col("_n").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p).alias("tokens"))),
            lambda a: F.coalesce(a["kind"], F.lit("text")).isin(*KINDS[1:]),
        ).alias("_a"),
    )
    size = (F.length("_head") + F.length("_body") + len(TURN_CLOSE)).cast("long")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("_c").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", before + F.length("_head"))
    turn_row = F.struct("_n", F.concat("_head", "_body", F.lit(TURN_CLOSE)).alias("s"), (F.col("_r") == loss_role).alias("loss"), F.col("_start").alias("start"), F.length("_body").cast("long").alias("length"), F.col("_a").alias("a"))
    grouped = rows.groupBy("_c").agg(F.array_sort(F.collect_list(turn_row)).alias("_turns"))
    return grouped.select(
        F.col("_c").alias(conv),
        F.array_join(F.transform("_turns", lambda t: t["s"]), "").alias("formatted"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.transform(F.filter("_turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("_turns", lambda t: t["a"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("_turns", lambda t: t["a"])), F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def parse_formatted(formatted: Column) -> Column:
    """Turns read back from a formatted conversation: array of (role, text), unescaped."""
    items = F.split(formatted, TURN_CLOSE)
    head = len(TURN_OPEN + ROLE_OPEN)

    def turn(item: Column) -> Column:
        cut = F.instr(item, ROLE_CLOSE)
        return F.struct(unescape(F.substring(item, F.lit(head + 1), cut - F.lit(head + 1))).alias("role"), unescape(F.substring(item, cut + F.lit(len(ROLE_CLOSE)), F.length(item))).alias("text"))

    return F.transform(F.slice(items, F.lit(1), F.size(items) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
