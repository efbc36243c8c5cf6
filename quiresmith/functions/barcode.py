"""Barcode checks and encodings as column expressions over digit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))


def gtin_check_digit(body: Column) -> Column:
    """Check digit over a body of digits: weights 3, 1, ... from the right, up to the next ten."""
    weighted = F.transform(F.reverse(_digits(body)), lambda d, i: d * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda s, x: s + x)
    return F.when(body.rlike("^[0-9]+$"), (10 - total % 10) % 10)


def gtin_valid(code: Column, length: int) -> Column:
    """Whether a code of exactly ``length`` digits ends with its check digit; null counts as not."""
    body = F.substring(code, 1, length - 1)
    return F.coalesce(code.rlike(f"^[0-9]{{{length}}}$") & (gtin_check_digit(body).cast("string") == F.substring(code, length, 1)), F.lit(False))


def upce_expand(code: Column) -> Column:
    """UPC-A of an eight-digit UPC-E of number system 0 or 1; null for others and for wrong check digits."""
    d = [F.substring(code, i, 1) for i in range(1, 9)]
    last = d[6]
    body = (
        F.when(last.isin("0", "1", "2"), F.concat(d[0], d[1], d[2], last, F.lit("0000"), d[3], d[4], d[5]))
        .when(last == "3", F.concat(d[0], d[1], d[2], d[3], F.lit("00000"), d[4], d[5]))
        .when(last == "4", F.concat(d[0], d[1], d[2], d[3], d[4], F.lit("00000"), d[5]))
        .otherwise(F.concat(d[0], d[1], d[2], d[3], d[4], d[5], F.lit("0000"), last))
    )
    full = F.concat(body, d[7])
    return F.when(code.rlike("^[01][0-9]{7}$") & gtin_valid(full, 12), full)


def code128b_values(text: Column) -> Column:
    """Code values of set B: ASCII 32 to 126; null if a character is outside."""
    return F.when(text.rlike("^[\\x20-\\x7E]+$"), F.transform(F.split(text, ""), lambda c: F.ascii(c) - 32))


def code128b_checksum(text: Column) -> Column:
    """(104 + sum of value times place) modulo 103."""
    products = F.transform(code128b_values(text), lambda v, i: (v * (i + 1)).cast("long"))
    return F.aggregate(products, F.lit(104).cast("long"), lambda s, x: s + x) % 103


# Code 39 characters and their nine elements, bars and spaces by turns, narrow or wide.
CODE39 = {
    "0": "nnnwwnwnn",
    "1": "wnnwnnnnw",
    "2": "nnwwnnnnw",
    "3": "wnwwnnnnn",
    "4": "nnnwwnnnw",
    "5": "wnnwwnnnn",
    "6": "nnwwwnnnn",
    "7": "nnnwnnwnw",
    "8": "wnnwnnwnn",
    "9": "nnwwnnwnn",
    "A": "wnnnnwnnw",
    "B": "nnwnnwnnw",
    "C": "wnwnnwnnn",
    "D": "nnnnwwnnw",
    "E": "wnnnwwnnn",
    "F": "nnwnwwnnn",
    "G": "nnnnnwwnw",
    "H": "wnnnnwwnn",
    "I": "nnwnnwwnn",
    "J": "nnnnwwwnn",
    "K": "wnnnnnnww",
    "L": "nnwnnnnww",
    "M": "wnwnnnnwn",
    "N": "nnnnwnnww",
    "O": "wnnnwnnwn",
    "P": "nnwnwnnwn",
    "Q": "nnnnnnwww",
    "R": "wnnnnnwwn",
    "S": "nnwnnnwwn",
    "T": "nnnnwnwwn",
    "U": "wwnnnnnnw",
    "V": "nwwnnnnnw",
    "W": "wwwnnnnnn",
    "X": "nwnnwnnnw",
    "Y": "wwnnwnnnn",
    "Z": "nwwnwnnnn",
    "-": "nwnnnnwnw",
    ".": "wwnnnnwnn",
    " ": "nwwnnnwnn",
    "$": "nwnwnwnnn",
    "/": "nwnwnnnwn",
    "+": "nwnnnwnwn",
    "%": "nnnwnwnwn",
    "*": "nwnnwnwnn",
}
WIDE = 3
QUIET = 10


def _code39_symbols() -> dict[str, str]:
    """Character -> its modules, 1 for bars."""
    return {c: "".join(str(1 - k % 2) * (WIDE if e == "w" else 1) for k, e in enumerate(elements)) for c, elements in CODE39.items()}


def code39_modules(text: Column) -> Column:
    """Modules of a Code 39 with quiet zones, start and stop, without a checksum; null if a character is outside or there is none."""
    symbols = _code39_symbols()
    known = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair])
    body = F.array_join(F.transform(F.split(text, ""), lambda c: known[c]), "0")
    quiet, star = "0" * QUIET, symbols["*"]
    return F.when(text.rlike(r"^[0-9A-Z\-. $/+%]+$"), F.concat(F.lit(f"{quiet}{star}0"), body, F.lit(f"0{star}{quiet}")))


# The left-hand (odd) patterns of the digits 0 to 9 of EAN and UPC, and which of the six left digits of EAN-13 are even.
EAN_LEFT = ("0001101", "0011001", "0010011", "0111101", "0100011", "0110001", "0101111", "0111011", "0110111", "0001011")
EAN13_SETS = ("LLLLLL", "LLGLGG", "LLGGLG", "LLGGGL", "LGLLGG", "LGGLLG", "LGGGLL", "LGLGLG", "LGLGGL", "LGGLGL")
# The widths of bars and spaces, by turns, of the values 0 to 102 of Code 128, and those of start B and stop.
CODE128 = """
    212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132
    221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313
    231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111
    314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111
    111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141
    114131 311141 411131
""".split()
CODE128_START_B = "211214"
CODE128_STOP = "2331112"


def _bars(widths: str) -> str:
    return "".join(str(1 - k % 2) * int(w) for k, w in enumerate(widths))


def _ean_digits(digits: Column, sets: Column) -> Column:
    """The patterns of digits, each of the set (L, G or R) that stands at its place in ``sets``."""
    other = str.maketrans("01", "10")
    symbols = {}
    for d, left in enumerate(EAN_LEFT):
        right = left.translate(other)
        symbols |= {f"L{d}": left, f"R{d}": right, f"G{d}": right[::-1]}
    known = F.create_map(*[F.lit(x) for pair in symbols.items() for x in pair])
    return F.array_join(F.transform(F.split(digits, ""), lambda d, i: known[F.concat(F.substring(sets, i + 1, F.lit(1)), d)]), "")


def _framed(before: int, left: Column, right: Column, after: int) -> Column:
    """Two halves between guards and quiet zones."""
    return F.concat(F.lit("0" * before + "101"), left, F.lit("01010"), right, F.lit("101" + "0" * after))


def ean13_modules(code: Column) -> Column:
    """Modules of an EAN-13, 1 for bars, with quiet zones of 11 and 7; null unless the code is thirteen digits with the right check digit."""
    sets = F.element_at(F.array(*map(F.lit, EAN13_SETS)), F.ascii(code) - 47)
    made = _framed(11, _ean_digits(F.substring(code, 2, 6), sets), _ean_digits(F.substring(code, 8, 6), F.lit("RRRRRR")), 7)
    return F.when(gtin_valid(code, 13), made)


def upca_modules(code: Column) -> Column:
    """Modules of a UPC-A with quiet zones of 9; null unless the code is twelve digits with the right check digit."""
    made = _framed(9, _ean_digits(F.substring(code, 1, 6), F.lit("LLLLLL")), _ean_digits(F.substring(code, 7, 6), F.lit("RRRRRR")), 9)
    return F.when(gtin_valid(code, 12), made)


def ean8_modules(code: Column) -> Column:
    """Modules of an EAN-8 with quiet zones of 7; null unless the code is eight digits with the right check digit."""
    made = _framed(7, _ean_digits(F.substring(code, 1, 4), F.lit("LLLL")), _ean_digits(F.substring(code, 5, 4), F.lit("RRRR")), 7)
    return F.when(gtin_valid(code, 8), made)


def upce_modules(code: Column) -> Column:
    """Modules of a UPC-E with quiet zones of 9 and 7; null where upce_expand() is. The sets tell the check digit and the number system."""
    one = ("LLLGGG", *EAN13_SETS[1:])
    sets = F.element_at(F.array(*map(F.lit, one)), F.ascii(F.substring(code, 8, 1)) - 47)
    sets = F.when(code.startswith("1"), sets).otherwise(F.translate(sets, "LG", "GL"))
    made = F.concat(F.lit("0" * 9 + "101"), _ean_digits(F.substring(code, 2, 6), sets), F.lit("010101" + "0" * 7))
    return F.when(upce_expand(code).isNotNull(), made)


def code128b_modules(text: Column) -> Column:
    """Modules of a Code 128 of set B with quiet zones of 10; null if the text is empty or a character is outside ASCII 32 to 126."""
    symbols = F.array(*[F.lit(_bars(w)) for w in CODE128])
    body = F.array_join(F.transform(code128b_values(text), lambda v: F.element_at(symbols, v + 1)), "")
    check = F.element_at(symbols, (code128b_checksum(text) + 1).cast("int"))
    return F.concat(F.lit("0" * 10 + _bars(CODE128_START_B)), body, check, F.lit(_bars(CODE128_STOP) + "0" * 10))
