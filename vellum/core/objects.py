"""Tokens and objects of PDF syntax.

Scanning is regular expressions over the bytes; positions are offsets into the whole file.  Values are Python's own: None,
bool, int, float, bytes (strings), list, dict; and Name, Keyword, Ref, Stream below.
"""

from __future__ import annotations

import re
from itertools import accumulate
from operator import mul
from typing import Any, NamedTuple


class Name(str):
    __slots__ = ()


class Keyword(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    __slots__ = ("dict", "data", "id", "pending")

    def __init__(self, d: dict, data: bytes, ident: Ref | None, pending: list[str] | None = None):
        self.dict, self.data, self.id, self.pending = d, data, ident, pending or []


class PdfError(Exception):
    """A failure by name, with its place in the file and what was being read."""

    def __init__(self, failure: str, start: int | None = None, end: int | None = None, intent: tuple | None = None):
        super().__init__(failure)
        self.failure, self.start, self.end, self.intent = failure, start, end, intent


_SPACE = rb"\x00\t\n\x0c\r "
_STOP = _SPACE + rb"%()\[\]{}/<>\\"
_BLANK = re.compile(rb"(?:[" + _SPACE + rb"]+|%[^\r\n\x0c]*)+")
_TOKEN = re.compile(
    rb"(?P<real>[+-]?\d*\.\d*)|(?P<int>[+-]\d*|\d+)|/(?P<name>[^" + _STOP + rb"]*)|(?P<open><<)|(?P<close>>>)|(?P<left>\[)|(?P<right>\])"
    rb"|<(?P<hex>[0-9A-Fa-f" + _SPACE + rb"]*)>|(?P<string>\()|(?P<word>[^" + _STOP + rb"][^" + _STOP + rb"]*|\\[^" + _STOP + rb"]*)"
)
_PAREN = re.compile(rb"[()\\]")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\s\S]))")
_HASH = re.compile(rb"#([0-9A-Fa-f]{2})")
#: Fixed by the format: what a backslash and a letter stand for in a string.
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}


#: A tenth, a tenth of that, and so on, as repeated multiplication has them.
_PLACES = list(accumulate([0.1] * 32, mul))


def real_value(text: bytes) -> float:
    """Digits after the point are added one by one, each a tenth of the place before; the sum is what readers expect to find."""
    sign = -1.0 if text[:1] == b"-" else 1.0
    whole, _, rest = text.lstrip(b"+-").partition(b".")
    value = float(int(whole or b"0"))
    if len(rest) <= len(_PLACES):
        for d, place in zip(rest, _PLACES, strict=False):
            value += place * (d - 48)
        return sign * value
    place = 0.1
    for d in rest:
        value += place * (d - 48)
        place *= 0.1
    return sign * value


def _unescape(m: re.Match) -> bytes:
    if m[1] is not None:
        return bytes([int(m[1], 8) & 255])
    return b"" if m[2] in (b"\r\n", b"\r", b"\n") else _LETTERS.get(m[2], m[2])


def text_of_name(raw: bytes) -> str:
    if b"#" in raw:
        raw = _HASH.sub(lambda m: bytes([int(m[1], 16)]), raw)
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class Lexer:
    """Tokens (kind, value, start, end) of data[pos:end]."""

    __slots__ = ("data", "pos", "end")

    def __init__(self, data: bytes, pos: int = 0, end: int | None = None):
        self.data, self.pos, self.end = data, pos, len(data) if end is None else min(end, len(data))

    def next(self) -> tuple[str, Any, int, int] | None:
        data, end = self.data, self.end
        if m := _BLANK.match(data, self.pos, end):
            self.pos = m.end()
        start = self.pos
        if start >= end:
            return None
        m = _TOKEN.match(data, start, end)
        if not m:
            c = data[start : start + 1]
            if c == b"<":
                bad = re.compile(rb"[^0-9A-Fa-f" + _SPACE + rb"]").search(data, start + 1, end)
                if not bad:
                    raise PdfError("objectEndedUnexpectedly", start, end)
                raise PdfError("invalidHexDigit", bad.start(), bad.end())
            if c == b">" and start + 1 >= end:
                raise PdfError("objectEndedUnexpectedly", start, end)
            raise PdfError("unexpectedToken", start, start + 1)
        kind, self.pos = m.lastgroup, m.end()
        raw = m[kind]
        if kind == "int":
            digits = raw.lstrip(b"+-")
            value = int(digits or b"0") * (-1 if raw[:1] == b"-" else 1)
            if not -(1 << 63) <= value < 1 << 63:
                raise PdfError("expectedNaturalNumber", start, m.end())
            return kind, value, start, m.end()
        if kind == "real":
            return kind, real_value(raw), start, m.end()
        if kind == "name":
            return kind, Name(text_of_name(raw)), start, m.end()
        if kind == "hex":
            digits = re.sub(rb"[" + _SPACE + rb"]", b"", raw)
            return "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), start, m.end()
        if kind == "string":
            return "string", self._literal(start), start, self.pos
        if kind == "word":
            return kind, raw, start, m.end()
        return kind, None, start, m.end()

    def _literal(self, start: int) -> bytes:
        depth, at, data = 1, start + 1, self.data
        while True:
            m = _PAREN.search(data, at, self.end)
            if not m:  # an open string at the end is a string
                self.pos = self.end
                raw = data[start + 1 : self.end]
                break
            at = m.end()
            if m[0] == b"\\":
                at += 1
            else:
                depth += 1 if m[0] == b"(" else -1
                if not depth:
                    self.pos = at
                    raw = data[start + 1 : at - 1]
                    break
        return _ESCAPE.sub(_unescape, raw) if b"\\" in raw else raw

    def natural(self) -> int:
        t = self.next()
        if t is None:
            raise PdfError("expectedToken", self.pos, self.end)
        if t[0] != "int" or t[1] < 0:
            raise PdfError("expectedNaturalNumber", t[2], t[3])
        return t[1]

    def keyword(self, word: bytes, failure: str) -> None:
        t = self.next()
        if t is None:
            raise PdfError("expectedToken", self.pos, self.end)
        if t[0] != "word" or t[1] != word:
            raise PdfError(failure, t[2], t[3])

    def end_of_line(self) -> None:
        """What follows the word stream: CR LF or LF (blanks before it are passed over)."""
        at = self.pos
        while at < self.end and self.data[at] in b" \t":
            at += 1
        if self.data[at : at + 2] == b"\r\n":
            self.pos = at + 2
        elif self.data[at : at + 1] in (b"\n", b"\r"):
            self.pos = at + 1
        else:
            raise PdfError("expectedCrLf", at, at + 1)


_OPEN_ARRAY, _OPEN_DICT = object(), object()
_WORDS = {b"true": True, b"false": False, b"null": None}


#: The plain tokens, blanks before them included: whole numbers, reals, names, strings without escapes or parentheses
#: inside, words. What else there is goes to the lexer.
PLAIN = re.compile(
    rb"[" + _SPACE + rb"]*(?:([+-]?\d{1,18}(?![\d.]))|([+-]?\d*\.\d*)|/([^" + _STOP + rb"]*)|\(([^()\\\r]*)\)|([A-Za-z'\"][^" + _STOP + rb"]*))"
)


#: The same and what holds them together, a whole reference among them.
_PART = re.compile(
    rb"[" + _SPACE + rb"]*(?:(\d{1,18})[" + _SPACE + rb"]+(\d{1,18})[" + _SPACE + rb"]+R(?![^" + _STOP + rb"])|([+-]?\d{1,18}(?![\d.]))|([+-]?\d*\.\d*)|/([^" + _STOP + rb"]*)"
    rb"|\(([^()\\\r]*)\)|(<<)|(>>)|(\[)|(\])|(true|false|null)(?![^" + _STOP + rb"]))"
)
_REF, _INT, _REAL, _NAME, _STRING, _WORD = 2, 3, 4, 5, 6, 11
_BRACKETS = {7: "open", 8: "close", 9: "left", 10: "right"}


#: A dictionary without strings and comments, up to three deep: its bytes alone say what it is, whatever file they stand in.
_SHARED = re.compile(rb"[" + _SPACE + rb"]*+(<<(?:[^<>()%]++|<<(?:[^<>()%]++|<<[^<>()%]*+>>)*+>>)*+>>)")
#: Such dictionaries as files of one kind repeat, by their bytes; no more of them, and no longer ones, than this.
_known: dict[bytes, dict] = {}
KNOWN, KNOWN_BYTES = 4096, 512


def parse_object(lex: Lexer, decrypt=None) -> tuple[bool, Any]:
    """(found, value) of the next object; found is False at the end. What is inside a value is not to be changed."""
    m = _SHARED.match(lex.data, lex.pos, lex.end)
    if m is None:
        return _parse(lex, decrypt)
    if (value := _known.get(m[1])) is None:
        _, value = _parse(lex, decrypt)
        if len(m[1]) > KNOWN_BYTES:
            return True, value
        if len(_known) >= KNOWN:
            _known.clear()
        _known[m[1]] = value
    lex.pos = m.end()
    return True, dict(value)


def _parse(lex: Lexer, decrypt) -> tuple[bool, Any]:
    stack: list[Any] = []
    part, data, stop = _PART.match, lex.data, lex.end
    while True:
        m = part(data, lex.pos, stop)
        n = m.lastindex if m else None
        if n in _BRACKETS:
            lex.pos = end = m.end()
            kind, start = _BRACKETS[n], m.start(n)
        elif n:
            lex.pos = m.end()
            if n == _INT:
                value = int(m[_INT])
            elif n == _NAME:
                value = Name(text_of_name(m[_NAME]))
            elif n == _REF and stack:
                value = Ref(int(m[1]), int(m[2]))
            elif n == _REF:  # by itself, the first number is an object
                value, lex.pos = int(m[1]), m.end(1)
            elif n == _REAL:
                value = real_value(m[_REAL])
            elif n == _STRING:
                value = decrypt(m[_STRING]) if decrypt else m[_STRING]
            else:
                value = _WORDS[m[_WORD]]
            if not stack:
                return True, value
            stack.append(value)
            continue
        else:
            t = lex.next()
            if t is None:
                if not stack:
                    return False, None
                raise PdfError("missingEndOfScope", lex.pos, lex.end)
            kind, value, start, end = t
        if kind == "left":
            stack.append(_OPEN_ARRAY)
            continue
        if kind == "open":
            stack.append(_OPEN_DICT)
            continue
        if kind == "right":
            items = []
            while stack and stack[-1] is not _OPEN_ARRAY:
                item = stack.pop()
                if item is _OPEN_DICT:
                    raise PdfError("unexpectedToken", start, end)
                items.append(item)
            if not stack:
                raise PdfError("unexpectedToken", start, end)
            stack.pop()
            value = items[::-1]
        elif kind == "close":
            items = []
            while stack and stack[-1] is not _OPEN_DICT:
                item = stack.pop()
                if item is _OPEN_ARRAY:
                    raise PdfError("unexpectedToken", start, end)
                items.append(item)
            if not stack or len(items) % 2:
                raise PdfError("unexpectedToken", start, end)
            stack.pop()
            value = {}
            for v, k in zip(items[::2], items[1::2], strict=True):  # from the end: the first of equal keys stays
                if not isinstance(k, Name):
                    raise PdfError("unexpectedToken", start, end)
                value[str(k)] = v
        elif kind == "word":
            if value == b"R":
                if len(stack) < 2 or not all(type(x) is int for x in stack[-2:]):
                    raise PdfError("unexpectedToken", start, end)
                gen, num = stack.pop(), stack.pop()
                value = Ref(num, gen)
            elif value in _WORDS:
                value = _WORDS[value]
            else:
                value = Keyword(value.decode("latin-1"))
        elif kind == "string" and decrypt:
            value = decrypt(value)
        if not stack:
            return True, value
        stack.append(value)


def require_object(lex: Lexer, decrypt=None) -> Any:
    found, value = parse_object(lex, decrypt)
    if not found:
        raise PdfError("expectedObject", lex.pos, lex.end)
    return value


def tokens(data: bytes) -> list[tuple[int, str, str, int, int]]:
    """(seq, kind, text, start, end) of every token, up to the first that fails."""
    lex, out = Lexer(data), []
    while True:
        try:
            t = lex.next()
        except PdfError as e:
            out.append((len(out), "error", e.failure, e.start or 0, e.end or 0))
            return out
        if t is None:
            return out
        kind, value, start, end = t
        out.append((len(out), kind, value.hex() if kind == "string" else value.decode("latin-1") if isinstance(value, bytes) else "" if value is None else str(value), start, end))
