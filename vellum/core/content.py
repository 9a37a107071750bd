"""Content streams: bytes to operators with their operands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import Any, NamedTuple

from .objects import PLAIN, Keyword, Lexer, Name, PdfError, parse_object, real_value, text_of_name

#: Fixed by the format: each operator's operands in the order of the stream. n number, i integer, N name, s string,
#: a array, p properties (dictionary or name), * every number before it.
OPERANDS: dict[str, str] = {
    "'": "s", '"': "nns", "B": "", "B*": "", "b": "", "b*": "", "BDC": "Np", "BI": "", "BMC": "N", "BT": "", "BX": "",
    "c": "nnnnnn", "cm": "nnnnnn", "CS": "N", "cs": "N", "d": "an", "d0": "", "d1": "", "Do": "N", "DP": "Np", "EI": "",
    "EMC": "", "ET": "", "EX": "", "F": "", "f": "", "f*": "", "G": "n", "g": "n", "gs": "N", "h": "", "i": "n", "ID": "",
    "J": "i", "j": "i", "K": "nnnn", "k": "nnnn", "l": "nn", "M": "n", "m": "nn", "MP": "N", "n": "", "q": "", "Q": "",
    "re": "nnnn", "RG": "nnn", "rg": "nnn", "ri": "N", "S": "", "s": "", "SC": "*", "sc": "*", "SCN": "*", "scn": "*",
    "sh": "N", "Tc": "n", "Td": "nn", "TD": "nn", "Tf": "Nn", "Tj": "s", "TJ": "a", "TL": "n", "Tm": "nnnnnn", "Tr": "i",
    "Ts": "n", "Tw": "n", "Tz": "n", "T*": "", "v": "nnnn", "w": "n", "W": "", "W*": "", "y": "nnnn",
}
#: Operators of numbers alone, by how many they take.
_NUMBERS = {op.encode(): (op, len(spec)) for op, spec in OPERANDS.items() if not spec.strip("n") and op != "BI"}
#: Contents without these bytes, and not longer than this, are numbers and words between blanks.
_HELD_TOGETHER = re.compile(rb"[\x00\x0b%()\[\]{}/<>\\]")
PLAIN_BYTES = 1 << 20
_A_NUMBER = re.compile(rb"[+-]?(?:\d{1,18}|\d*\.\d*)")
_END_OF_IMAGE = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)")


class Op(NamedTuple):
    op: str
    nums: list[float] = []
    name: str | None = None
    data: bytes | None = None
    tj: list[tuple[bytes | None, float | None]] | None = None
    props: Any = None


def _number(x) -> bool:
    return type(x) in (int, float)


def build(op: str, stack: list[Any]) -> Op:
    """The operands are the last of the stack; what lies before them is not looked at."""
    spec = OPERANDS[op]
    if not spec:
        return Op(op)
    if spec == "*":
        return Op(op, [float(x) for x in stack if _number(x)])
    n = len(spec)
    if len(stack) < n:
        raise PdfError("missingRequiredParameters")
    args = stack[-n:]
    if spec == "n" * n and all(type(x) is int or type(x) is float for x in args):
        return Op(op, [float(x) for x in args])
    nums, name, data, tj, props = [], None, None, None, None
    for kind, x in zip(spec, args, strict=True):
        if kind == "n" and _number(x):
            nums.append(float(x))
        elif kind == "i" and type(x) is int:
            nums.append(float(x))
        elif kind == "N" and isinstance(x, Name):
            name = str(x)
        elif kind == "s" and isinstance(x, bytes):
            data = x
        elif kind == "p" and isinstance(x, dict | Name):
            props = x
        elif kind == "a" and isinstance(x, list):
            if op == "TJ":
                tj = [(x_, None) if isinstance(x_, bytes) else (None, float(x_)) for x_ in x if isinstance(x_, bytes) or _number(x_)]
            else:
                nums += [float(v) for v in x if _number(v)]
        else:
            raise PdfError("missingRequiredParameters")
    if op == "d":
        nums = [nums[-1], *nums[:-1]]  # phase first
    elif op == '"':
        nums = nums[::-1]  # character spacing, then word spacing
    return Op(op, nums, name, data, tj, props)


_CONSTANTS = {b"true": True, b"false": False, b"null": None}


@lru_cache(65536)
def _operand(text: bytes) -> float | None:
    if not _A_NUMBER.fullmatch(text):
        return None
    return real_value(text) if b"." in text else float(int(text))


def operators(data: bytes) -> Iterator[Op]:
    """Operators one by one; a PdfError ends them, after those before it."""
    done = 0
    if len(data) <= PLAIN_BYTES and not _HELD_TOGETHER.search(data):
        stack: list[float] = []
        for word in data.split():
            if (known := _NUMBERS.get(word)) is None:
                if (x := _operand(word)) is None:
                    break
                stack.append(x)
                continue
            op, n = known
            if len(stack) < n:
                break
            yield Op(op, stack[-n:]) if n else Op(op)
            stack, done = [], done + 1
        else:
            if not stack:
                return
    # What is not so plain is read by tokens, which tell errors by their places, too.
    yield from islice(_operators(data), done, None)


def _operators(data: bytes) -> Iterator[Op]:
    lex, stack, plain = Lexer(data), [], PLAIN.match
    while True:
        at = lex.pos
        if m := plain(data, at):
            lex.pos, kind = m.end(), m.lastindex
            if kind == 1:
                stack.append(int(m[1]))
                continue
            if kind == 2:
                stack.append(real_value(m[2]))
                continue
            if kind == 3:
                stack.append(Name(text_of_name(m[3])))
                continue
            if kind == 4:
                stack.append(m[4])
                continue
            raw = m[5]
            if raw in _CONSTANTS:
                stack.append(_CONSTANTS[raw])
                continue
            if raw == b"R":  # part of an object: the lexer tells what is wrong with it here
                raise PdfError("unexpectedToken", m.start(5), m.end())
            word = raw.decode("latin-1")
        else:
            found, x = parse_object(lex)
            if not found:
                if stack:
                    raise PdfError("expectedOperator", at, len(data))
                return
            if not isinstance(x, Keyword):
                stack.append(x)
                continue
            word = str(x)
        if word == "BI":
            yield Op("BI")
            yield from _inline_image(lex)
            stack = []
            continue
        if word not in OPERANDS:
            raise PdfError("unknownOperator", at, lex.pos)
        try:
            yield build(word, stack)
        except PdfError as e:
            raise PdfError(e.failure, at, lex.pos) from e
        stack = []


def _inline_image(lex: Lexer) -> Iterator[Op]:
    d: dict[str, Any] = {}
    while True:
        at = lex.pos
        found, key = parse_object(lex)
        if not found:
            raise PdfError("expectedOperator", at, lex.end)
        if isinstance(key, Keyword) and key == "ID":
            break
        ok, value = parse_object(lex)
        if not isinstance(key, Name) or not ok:
            raise PdfError("unexpectedToken", at, lex.pos)
        d[str(key)] = value
    start = lex.pos + 1  # one white-space byte
    m = _END_OF_IMAGE.search(lex.data, max(start - 1, 0), lex.end)
    if not m:
        raise PdfError("objectEndedUnexpectedly", start, lex.end)
    lex.pos = m.end()
    yield Op("ID", data=lex.data[start : m.start()], props=d)
    yield Op("EI")
