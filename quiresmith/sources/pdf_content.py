"""Page content to shown glyphs: one pass over the operators of a page, with the text state."""

from __future__ import annotations

import re

from quiresmith.sources.pdf import Broken, Name, Reader, Real

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
DEFAULT_WIDTH = 500.0
# Operators that show nothing and leave the text state alone, and the colour operators by number of components.
NEUTRAL = frozenset(b"w J j M d ri i gs m l c v y h re S s f F f* B B* b b* n W W* BMC BDC EMC MP DP sh d0 d1 BX EX CS cs SC SCN sc scn G RG K".split())
FILL_COLORS = {b"g": 1, b"rg": 3, b"k": 4}
WINDOWS_LATIN_80 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"


def product(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def unicode_map(cmap: bytes) -> dict[int, str]:
    """Code -> text of a ToUnicode map: bfchar and bfrange with hexadecimal strings."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for body in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, value in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body):
            out[int(code, 16)] = text(value)
    for body in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for first, last, value, items in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", body, re.S):
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", items)
            for i in range(min(int(last, 16) - int(first, 16) + 1, 65536)):
                if value:
                    head = text(value)
                    out[int(first, 16) + i] = head[:-1] + chr(ord(head[-1]) + i)
                elif i < len(listed):
                    out[int(first, 16) + i] = text(listed[i])
    return out


class Font:
    """How codes become text and widths. ``wide``: two bytes a code."""

    def __init__(self, wide: bool, first: int, widths: list[float], cmap: bytes | None):
        self.wide, self.first, self.widths = wide, first, widths
        self.map = unicode_map(cmap) if cmap else {}

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)

    def text(self, code: int) -> str:
        """The text of a code; U+FFFD where nothing is known."""
        if code in self.map:
            return self.map[code]
        if self.wide or code < 32:
            return "�"
        return WINDOWS_LATIN_80[code - 128] if 128 <= code < 160 else chr(code)

    def width(self, code: int) -> float:
        i = code - self.first
        return self.widths[i] if 0 <= i < len(self.widths) else DEFAULT_WIDTH


def _channel(v: float) -> int:
    return round(max(0.0, min(1.0, v)) * 255)


def _argb(v: list[float]) -> int:
    if len(v) == 1:
        v = v * 3
    elif len(v) == 4:
        v = [(1 - x) * (1 - v[3]) for x in v[:3]]
    return 0xFF000000 | _channel(v[0]) << 16 | _channel(v[1]) << 8 | _channel(v[2])


def glyphs(content: bytes, fonts: dict[str, Font], forms: frozenset[str] = frozenset()) -> list[tuple]:
    """(text, x0, y0, x1, y1, height, size, argb) of every glyph shown, in order: base line in page space, ``height`` the scaled font size.

    Unknown operators and the drawing of one of ``forms`` raise UNSUPPORTED, broken syntax and unbalanced states FORMAT.
    """
    r, out, stack, operands = Reader(content), [], [], []
    ctm, state = IDENTITY, {"font": None, "size": 0.0, "c": 0.0, "w": 0.0, "z": 1.0, "l": 0.0, "rise": 0.0, "argb": 0xFF000000}
    tm = line = IDENTITY

    def show(raw: bytes) -> None:
        nonlocal tm
        font = state["font"]
        if font is None:
            raise Broken("FORMAT")
        for code in font.codes(raw):
            gap = state["w"] if not font.wide and code == 32 else 0.0
            advance = (font.width(code) * state["size"] / 1000 + state["c"] + gap) * state["z"]
            full = product(tm, ctm)
            x0, y0 = full[4] + full[2] * state["rise"], full[5] + full[3] * state["rise"]
            height = state["size"] * (full[2] ** 2 + full[3] ** 2) ** 0.5
            out.append((font.text(code), x0, y0, x0 + full[0] * advance, y0 + full[1] * advance, height, state["size"], state["argb"]))
            tm = product((1.0, 0.0, 0.0, 1.0, advance, 0.0), tm)

    def move(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = product((1.0, 0.0, 0.0, 1.0, x, y), line)

    def number(v) -> float:
        if isinstance(v, bool) or not isinstance(v, (int, Real)):
            raise Broken("FORMAT")
        return float(v)

    size = len(content.rstrip(b"\0\t\n\f\r "))
    while r.at < size:
        before = r.at
        token = r.token()
        if token[:1] in b"<[(/+-.0123456789" or token in (b"true", b"false", b"null"):
            r.at = before
            operands.append(r.value())
            continue
        op, args, operands = token, operands, []
        if op == b"q":
            stack.append((ctm, dict(state)))
        elif op == b"Q":
            if not stack:
                raise Broken("FORMAT")
            ctm, state = stack.pop()
        elif op == b"BI":
            raise Broken("UNSUPPORTED")
        elif op == b"Do":
            if len(args) != 1 or not isinstance(args[0], Name):
                raise Broken("FORMAT")
            if args[0].decode("latin-1") in forms:
                raise Broken("UNSUPPORTED")
        elif op == b"cm":
            ctm = product(tuple(map(number, args[:6])), ctm)
        elif op == b"BT":
            tm = line = IDENTITY
        elif op == b"ET":
            pass
        elif op == b"Tf":
            if len(args) != 2 or not isinstance(args[0], Name) or args[0].decode("latin-1") not in fonts:
                raise Broken("FORMAT")
            state["font"], state["size"] = fonts[args[0].decode("latin-1")], number(args[1])
        elif op in (b"Tc", b"Tw", b"TL", b"Ts", b"Tz"):
            state[{b"Tc": "c", b"Tw": "w", b"TL": "l", b"Ts": "rise", b"Tz": "z"}[op]] = number(args[0]) / (100 if op == b"Tz" else 1)
        elif op == b"Tr":
            pass
        elif op == b"Tm":
            tm = line = tuple(map(number, args[:6]))
        elif op in (b"Td", b"TD"):
            if op == b"TD":
                state["l"] = -number(args[1])
            move(number(args[0]), number(args[1]))
        elif op == b"T*":
            move(0.0, -state["l"])
        elif op in (b"Tj", b"'", b'"'):
            if op == b'"':
                state["w"], state["c"] = number(args[0]), number(args[1])
            if op != b"Tj":
                move(0.0, -state["l"])
            show(args[-1])
        elif op == b"TJ":
            for part in args[0]:
                if isinstance(part, bytes) and not isinstance(part, Real):
                    show(part)
                else:
                    tm = product((1.0, 0.0, 0.0, 1.0, -number(part) / 1000 * state["size"] * state["z"], 0.0), tm)
        elif op in FILL_COLORS:
            state["argb"] = _argb(list(map(number, args[-FILL_COLORS[op] :])))
        elif op not in NEUTRAL:
            raise Broken("UNSUPPORTED")
    if stack:
        raise Broken("FORMAT")
    return out
