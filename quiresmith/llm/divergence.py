r"""Quality rules by distribution divergence (operator 12), in DataFrame functions only.

Two histograms of a document are compared with those of every language: classes of characters, and common words. The
references are counted over all documents with a language. Words are what the white space of ``[\x20\x09-\x0D]`` parts.
A document is kept if one language is near in both, by Jensen-Shannon distance; a histogram of a text too short for
it says nothing. Nothing is shuffled but counts of hash slots, of words in heavy slots and of classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresmith.session import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
#: Classes of characters, each taken from what those before have left; what is left at the end is a class too.
CLASSES = (r"\p{Ll}+", SPACE, r"\p{Lu}+", r"[.,;:!?'\"()-]+", r"[0-9]+", r"\p{L}+")
SLOTS = 1 << 12
# Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict, and what makes a reference."""

    #: share of a language's words from which on a word is common, and share of all words from which on a language has a reference
    word_share: float = 1 / 256
    language_share: float = 1 / 100
    #: words or characters below which a histogram is no evidence
    least_words: int = 50
    least_chars: int = 200
    most_word_distance: float = 0.27
    most_class_distance: float = 0.25
    #: what chance alone adds to the squared distance of words, times the number of common words by that of the document's words
    chance: float = 0.06


@dataclass(frozen=True)
class References:
    """Histograms by language: the word of hash ``words[i]`` has the share ``word_shares[l][i]`` in language ``l``."""

    languages: list[str]
    words: list[int]
    word_shares: list[list[float]]
    class_shares: list[list[float]]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_hashes(text: Column) -> Column:
    """Array of the words as 64-bit hashes, by which they are told apart from here on."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def class_counts(text: Column) -> Column:
    """Code points of each of CLASSES and of the rest, as an array of long."""

    def rest(left: Column, classes: tuple[str, ...], found: Column) -> Column:
        if not classes:
            return F.concat(found, F.array(F.length(left).cast("long")))
        cut = lambda less: rest(less, classes[1:], F.concat(found, F.array((F.length(left) - F.length(less)).cast("long"))))
        return _let(F.regexp_replace(left, classes[0], ""), cut)

    return _let(F.coalesce(text, F.lit("")), lambda t: rest(t, CLASSES, F.array().cast("array<bigint>")))


def repeated_words(words: Column) -> Column:
    """Words, of an array of hashes, inside windows of five that are in it twice or more, the first included."""
    windows = F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k if k else i) for k in range(WINDOW)])))

    def covered(all_windows: Column, span: Column) -> Column:
        # sorted by their upper bits, with the place in the lower ones: neighbours of equal upper bits are compared whole
        place = lambda x: F.pmod(x, span).cast("int")
        whole = lambda x: F.get(all_windows, place(x))
        keys = F.sort_array(F.transform(all_windows, lambda w, i: w - F.pmod(w, span) + i))
        same = lambda x, y: (y - F.pmod(y, span) == x - F.pmod(x, span)) & (whole(x) == whole(y))
        again = _let(keys, lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k - 1)), F.lit(False))))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(again, place)), zero, step, lambda a: a["n"])

    span = lambda w: F.pow(F.lit(2.0), F.ceil(F.log2(F.size(w).cast("double")))).cast("long")
    none = F.lit(0).cast("long")
    return F.coalesce(_let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _let(span(w), lambda x: covered(w, x))).otherwise(none)), none)


def _x_log_x(v: Column) -> Column:
    return F.when(v > 0, v * F.log2(v)).otherwise(0.0)


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _distance(found: Column, own: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance, in bits, of values ``found`` (k from 1, p) to the shares of all values; ``own`` is the sum of p log p."""
    log = lambda v: v * math.log2(v) if v > 0 else 0.0
    half = [log(q / 2) for q in shares]  # of the mean with a value that isn't found
    each, less = _doubles(shares), _doubles(half)
    mixed = F.aggregate(found, F.lit(sum(half)), lambda a, x: a + _x_log_x((x["p"] + F.element_at(each, x["k"])) / 2) - F.element_at(less, x["k"]))
    return F.sqrt(F.greatest((own + F.lit(sum(map(log, shares)))) / 2 - mixed, F.lit(0.0)))


def _distances(found: Column, all_shares: list[list[float]]) -> Column:
    own = F.aggregate(found, F.lit(0.0), lambda a, x: a + _x_log_x(x["p"]))
    return _let(own, lambda o: F.array(*[_distance(found, o, shares) for shares in all_shares]).cast("array<double>"))


def word_distances(words: Column, references: References) -> Column:
    """Distance of an array of hashes to the common words of every language, all other words being one value more; null without words."""
    rest = len(references.words) + 1
    known = F.array(*[F.lit(w).cast("long") for w in references.words]).cast("array<bigint>")
    places = F.sort_array(F.transform(F.filter(words, lambda w: w.isin(references.words)), lambda w: F.array_position(known, w)))
    total = F.size(words).cast("double")

    def counted(ids: Column) -> Column:
        starts = F.transform(F.array_distinct(ids), lambda k: F.struct(k.cast("int").alias("k"), F.array_position(ids, k).alias("at")))
        ends = lambda s, i: F.coalesce(F.get(s, i + 1)["at"], F.size(ids) + F.lit(1).cast("long"))
        return _let(starts, lambda s: F.transform(s, lambda x, i: F.struct(x["k"].alias("k"), ((ends(s, i) - x["at"]) / total).alias("p"))))

    with_rest = lambda ids: F.concat(counted(ids), F.array(F.struct(F.lit(rest).alias("k"), ((total - F.size(ids)) / total).alias("p"))))
    shares = [[*s, max(0.0, 1 - sum(s))] for s in references.word_shares]
    return F.when(F.size(words) > 0, _let(places, lambda ids: _let(with_rest(ids), lambda found: _distances(found, shares))))


def class_distances(counts: Column, references: References) -> Column:
    """Distance to the classes of characters of every language; null without characters."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)
    found = lambda n: F.transform(counts, lambda c, i: F.struct((i + 1).alias("k"), (c / n).alias("p")))
    return _let(total, lambda n: F.when(n > 0, _let(found(n), lambda x: _distances(x, references.class_shares))))


def fit_references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> References:
    """Shares of common words and of character classes in all documents with a language.

    A word is common if it has ``word_share`` of the words of some language. Words are first counted by hash slots; only those
    in slots that reach that share can be common, and they alone are counted one by one (by 64-bit hashes), so no table of all words is
    shuffled and the counts are exact. Languages with less than ``language_share`` of all words have no reference;
    so at most ``1 / language_share`` rows of classes and ``1 / (language_share * word_share)`` words reach the driver. Null
    texts and languages count nothing; without documents there is no reference.
    """
    spoken = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    hashes = word_hashes(F.col("text"))
    slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
    in_slots = spoken.select("lang", F.explode(F.transform(hashes, slot)).alias("slot"))
    slots = written(in_slots.groupBy("lang", "slot").agg(F.count(F.lit(1)).alias("n")), "word-slots")
    least = rules.language_share * (slots.agg(F.sum("n")).first()[0] or 0)
    totals = {r["lang"]: r["n"] for r in slots.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    languages = sorted(totals)
    if not languages:
        return References([], [], [], [])
    total = reduce(lambda case, x: case.when(F.col("lang") == x, totals[x]), languages[1:], F.when(F.col("lang") == languages[0], totals[languages[0]]))
    heavy = [r["slot"] for r in slots.where(F.col("n") >= rules.word_share * total).select("slot").distinct().collect()]
    words = spoken.where(F.col("lang").isin(languages)).select("lang", F.explode(F.filter(hashes, lambda h: slot(h).isin(heavy))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    shares = counted.withColumn("share", F.col("n") / total).groupBy("word").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("shares"))
    common = sorted(((r["word"], {x["lang"]: x["share"] for x in r["shares"]}) for r in shares.where(F.col("most") >= rules.word_share).collect()), key=lambda r: (-max(r[1].values()), r[0]))
    sums = [F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    classes = {r["lang"]: r[1:] for r in spoken.where(F.col("lang").isin(languages)).select("lang", class_counts(F.col("text")).alias("c")).groupBy("lang").agg(*sums).collect()}
    return References(languages, [w for w, _ in common], [[by.get(x, 0.0) for _, by in common] for x in languages], [[n / sum(classes[x]) for n in classes[x]] for x in languages])


def judge(docs: DataFrame, references: References, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, language, word_distance, class_distance, kept.

    Every row is judged alone, by its whole text: repeated rows get the same, an empty table stays empty. A null or empty
    text has no words, so its base fails and its distances are null. ``kept`` wants a sound base and one language that is near in both
    histograms; ``language`` and the distances are those of the nearest by words and classes together, ties to the first in the alphabet.
    A histogram below its least length is no evidence, nor are missing references. Columns of ``docs`` with those names give
    way. A row is held with all its windows, so a task needs some twenty times the memory of its longest text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "language", "word_distance", "class_distance", "kept"]
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"), word_distances(w, references).alias("far"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.drop(*names).withColumn("_words", _let(word_hashes(whole), of_words)).withColumn("_classes", class_counts(whole))
    rows = rows.withColumn("_far", class_distances(F.col("_classes"), references)).withColumn("_chars", F.aggregate("_classes", F.lit(0).cast("long"), lambda a, n: a + n))
    rows = rows.withColumns({
        "n_words": F.col("_words.n"), "word_chars": F.col("_chars") - F.col("_classes")[CLASSES.index(SPACE)], "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")), "n_repeat_words": F.col("_words.again"),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    at = lambda column, i: F.get(F.col(column), F.lit(i))
    allowed = F.lit(rules.most_word_distance**2) + F.lit(rules.chance * len(references.words)) / F.greatest(F.col("n_words"), F.lit(1))
    near = [
        F.struct(
            (F.coalesce(at("_words.far", i), F.lit(0.0)) + F.coalesce(at("_far", i), F.lit(0.0))).alias("sum"), F.lit(name).alias("language"), at("_words.far", i).alias("words"), at("_far", i).alias("classes"),
            ((F.col("n_words") < rules.least_words) | (at("_words.far", i) * at("_words.far", i) <= allowed)).alias("by_words"), ((F.col("_chars") < rules.least_chars) | (at("_far", i) <= rules.most_class_distance)).alias("by_classes"),
        )
        for i, name in enumerate(references.languages)
    ]
    if not near:
        none = F.lit(None).cast("double")
        return rows.withColumns({"language": F.lit(None).cast("string"), "word_distance": none, "class_distance": none, "kept": ~F.col("base_failed")}).drop("_words", "_classes", "_far", "_chars")
    rows = rows.withColumn("_near", F.array(*near)).withColumn("_best", F.array_min("_near"))
    kept = ~F.col("base_failed") & F.exists("_near", lambda x: x["by_words"] & x["by_classes"])
    shown = {"language": F.when(F.col("n_words") > 0, F.col("_best.language")), "word_distance": F.col("_best.words"), "class_distance": F.col("_best.classes"), "kept": kept}
    return rows.withColumns(shown).drop("_words", "_classes", "_far", "_chars", "_near", "_best")
