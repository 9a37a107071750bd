"""Functions of documents: sampled, exponential, stitching, calculator. Parsing and evaluation of single values."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

MAX_OPERATIONS, MAX_STACK, MAX_NESTING, MAX_INSTRUCTIONS = 10_000, 1_024, 64, 10_000
_WORD = re.compile(r"%[^\r\n]*|[{}]|[^\s{}%]+")
_INT = 1 << 63


@dataclass(frozen=True)
class Function:
    kind: str  # sampled, exponential, stitching, calculator
    domain: tuple[float, ...]
    range: tuple[float, ...] | None = None
    c0: tuple[float, ...] = (0.0,)
    c1: tuple[float, ...] = (1.0,)
    exponent: float = 1.0
    parts: tuple["Function", ...] = ()
    bounds: tuple[float, ...] = ()
    encode: tuple[float, ...] | None = None
    decode: tuple[float, ...] | None = None
    size: int = 0
    samples: tuple[tuple[float, ...], ...] = ()  # per sample, each output in [0, 1]
    program: Any = None


class Failed(Exception):
    pass


def parse(doc, obj) -> Function | None:
    """A function object, or an array of them: their outputs in a row. None where a part is missing."""
    from .objects import Stream

    x = doc.resolve(obj)
    if isinstance(x, list):
        parts = [parse(doc, v) for v in x]
        if not parts or any(p is None for p in parts):
            return None
        return Function("array", parts[0].domain, parts=tuple(parts))
    d = x.dict if isinstance(x, Stream) else x
    if not isinstance(d, dict):
        return None

    def reals(key: str) -> tuple[float, ...] | None:
        a = doc.list_(d.get(key))
        v = doc.reals_(d.get(key))
        return None if a is None or len(v) != len(a) else tuple(v)

    domain, rng, kind = reals("Domain"), reals("Range"), doc.int_(d.get("FunctionType"))
    if not domain or len(domain) % 2:
        return None
    if kind == 2:
        n = doc.real_(d.get("N"))
        return None if n is None else Function("exponential", domain, rng, reals("C0") or (0.0,), reals("C1") or (1.0,), n)
    if kind == 3:
        parts = [parse(doc, v) for v in doc.list_(d.get("Functions")) or []]
        bounds, enc = reals("Bounds"), reals("Encode")
        if not parts or any(p is None for p in parts) or bounds is None or enc is None or len(enc) < 2 * len(parts):
            return None
        return Function("stitching", domain, rng, parts=tuple(parts), bounds=bounds, encode=enc)
    if not isinstance(x, Stream) or not rng or len(rng) % 2:
        return None
    if kind == 4:
        program = parse_program(x.data.decode("latin-1"))
        return None if program is None else Function("calculator", domain, rng, program=program)
    if kind == 0:
        size, bits = doc.reals_(d.get("Size")), doc.int_(d.get("BitsPerSample"))
        if not size or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or len(domain) != 2:
            return None
        n, outs = int(size[0]), len(rng) // 2
        return Function("sampled", domain, rng, encode=reals("Encode"), decode=reals("Decode"), size=n, samples=unpack_samples(x.data, n, outs, bits))
    return None


def unpack_samples(data: bytes, n: int, outs: int, bits: int) -> tuple[tuple[float, ...], ...]:
    """Samples follow each other without padding; what the data lack is 0."""
    whole, top = int.from_bytes(data, "big"), len(data) * 8
    full = (1 << bits) - 1

    def at(k: int) -> float:
        shift = top - (k + 1) * bits
        return (whole >> shift & full) / full if shift >= 0 else 0.0

    return tuple(tuple(at(i * outs + j) for j in range(outs)) for i in range(n))


def parse_program(text: str) -> tuple | None:
    words, stack, count = [w for w in _WORD.findall(text) if w[0] != "%"], [], 0
    done = None
    for w in words:
        if done is not None:
            return None
        count += 1
        if count > MAX_INSTRUCTIONS or len(stack) > MAX_NESTING:
            return None
        if w == "{":
            stack.append([])
        elif w == "}":
            if not stack:
                return None
            body = tuple(stack.pop())
            if stack:
                stack[-1].append(body)
            else:
                done = body
        elif not stack:
            return None
        elif w in ("true", "false"):
            stack[-1].append(w == "true")
        elif re.fullmatch(r"[+-]?\d+", w):
            v = int(w)
            stack[-1].append(v if -_INT <= v < _INT else float(v))
        elif re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", w):
            stack[-1].append(float(w))
        elif w in WORDS:
            stack[-1].append(w)
        else:
            return None
    return done


def _num(x):
    if type(x) not in (int, float):
        raise Failed
    return x


def _whole(x):
    if type(x) is not int:
        raise Failed
    return x


def _finite(x: float) -> float:
    if not math.isfinite(x):
        raise Failed
    return x


def _fit(v):
    return v if type(v) is not int or -_INT <= v < _INT else float(v)


def _arith(f):
    return lambda a, b: _fit(f(a, b)) if type(_num(a)) is int and type(_num(b)) is int else _finite(f(float(a), float(b)))


def _rounding(f):
    return lambda a: a if type(_num(a)) is int else float(f(a))


def _logic(ints, bools):
    def run(a, b):
        if type(a) is bool and type(b) is bool:
            return bools(a, b)
        return ints(_whole(a), _whole(b))

    return run


def _same(a, b) -> bool:
    if type(a) is bool or type(b) is bool:
        if type(a) is not type(b):
            raise Failed
        return a == b
    return _num(a) == _num(b)


def _wrap(v: int) -> int:
    return (v + _INT) % (2 * _INT) - _INT


def _div(a, b):
    if _num(b) == 0:
        raise Failed
    return _finite(_num(a) / b)


def _int_div(a, b):
    if _whole(b) == 0:
        raise Failed
    q = abs(_whole(a)) // abs(b)
    return _fit(q if (a < 0) == (b < 0) else -q)


def _mod(a, b):
    return a - b * int(_int_div(a, b))


def _power(a, b):
    try:
        return _finite(math.pow(_num(a), _num(b)))
    except (ValueError, OverflowError):
        raise Failed from None


def _atan(a, b):
    if _num(a) == 0 and _num(b) == 0:
        raise Failed
    return math.degrees(math.atan2(a, b)) % 360.0


def _shift(a, b):
    a, b = _whole(a), _whole(b)
    if abs(b) >= 64:
        return 0 if b > 0 or a >= 0 else -1
    return _wrap(a << b) if b >= 0 else a >> -b


def _guarded(f, ok):
    def run(a):
        if not ok(_num(a)):
            raise Failed
        return _finite(f(a))

    return run


def _cvi(a):
    v = math.trunc(_num(a))
    if not -_INT <= v < _INT:
        raise Failed
    return v


UNARY = {
    "abs": lambda a: _fit(abs(_num(a))), "neg": lambda a: _fit(-_num(a)), "ceiling": _rounding(math.ceil), "floor": _rounding(math.floor), "truncate": _rounding(math.trunc),
    "round": _rounding(lambda a: math.copysign(math.floor(abs(a) + 0.5), a)), "sqrt": _guarded(math.sqrt, lambda a: a >= 0), "ln": _guarded(math.log, lambda a: a > 0),
    "log": _guarded(math.log10, lambda a: a > 0), "sin": lambda a: math.sin(math.radians(_num(a))), "cos": lambda a: math.cos(math.radians(_num(a))), "cvi": _cvi,
    "cvr": lambda a: float(_num(a)), "not": lambda a: (not a) if type(a) is bool else ~_whole(a),
}
BINARY = {
    "add": _arith(lambda a, b: a + b), "sub": _arith(lambda a, b: a - b), "mul": _arith(lambda a, b: a * b), "div": _div, "idiv": _int_div, "mod": _mod, "exp": _power,
    "atan": _atan, "and": _logic(lambda a, b: a & b, lambda a, b: a and b), "or": _logic(lambda a, b: a | b, lambda a, b: a or b),
    "xor": _logic(lambda a, b: a ^ b, lambda a, b: a != b), "bitshift": _shift, "eq": _same, "ne": lambda a, b: not _same(a, b), "ge": lambda a, b: _num(a) >= _num(b),
    "gt": lambda a, b: _num(a) > _num(b), "le": lambda a, b: _num(a) <= _num(b), "lt": lambda a, b: _num(a) < _num(b),
}
WORDS = frozenset([*UNARY, *BINARY, "if", "ifelse", "pop", "dup", "exch", "copy", "index", "roll"])


def shuffle(word: str, stack: list) -> None:
    """The operators that only move what is on the stack; counts are whole numbers."""
    if word == "pop":
        stack.pop()
    elif word == "dup":
        stack.append(stack[-1])
    elif word == "exch":
        stack[-2:] = stack[:-3:-1]
    elif word == "copy":
        n = _whole(stack.pop())
        if not 0 <= n <= len(stack):
            raise Failed
        stack += stack[len(stack) - n :]
    elif word == "index":
        n = _whole(stack.pop())
        if not 0 <= n < len(stack):
            raise Failed
        stack.append(stack[-1 - n])
    else:
        j, n = _whole(stack.pop()), _whole(stack.pop())
        if not 0 <= n <= len(stack):
            raise Failed
        if n:
            part, j = stack[len(stack) - n :], j % n
            stack[len(stack) - n :] = part[n - j :] + part[: n - j]


def run_program(program: tuple, inputs: list[float]) -> list:
    stack, left = [float(v) for v in inputs], [MAX_OPERATIONS]

    def run(body: tuple) -> None:
        for w in body:
            left[0] -= 1
            if left[0] < 0 or len(stack) > MAX_STACK:
                raise Failed
            if not isinstance(w, str):
                stack.append(w)
            elif w in UNARY:
                stack.append(UNARY[w](stack.pop()))
            elif w in BINARY:
                b = stack.pop()
                stack.append(BINARY[w](stack.pop(), b))
            elif w in ("if", "ifelse"):
                other = stack.pop() if w == "ifelse" else ()
                body_, test = stack.pop(), stack.pop()
                if type(test) is not bool or not isinstance(body_, tuple) or not isinstance(other, tuple):
                    raise Failed
                run(body_ if test else other)
            else:
                shuffle(w, stack)

    run(program)
    return stack


def _clamp(v: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, v))


def evaluate(f: Function, inputs: list[float]) -> list[float] | None:
    if f.kind == "array":
        outs = [evaluate(p, inputs) for p in f.parts]
        return None if any(o is None for o in outs) else [v for o in outs for v in o]
    if f.kind == "calculator":
        if len(inputs) < len(f.domain) // 2:
            return None
        try:
            stack = run_program(f.program, [_clamp(x, f.domain[2 * i], f.domain[2 * i + 1]) for i, x in enumerate(inputs[: len(f.domain) // 2])])
            n = len(f.range) // 2
            if len(stack) < n:
                return None
            return [_clamp(float(_num(v)), f.range[2 * i], f.range[2 * i + 1]) for i, v in enumerate(stack[len(stack) - n :])]
        except (Failed, IndexError):
            return None
    if not inputs:
        return None
    x = _clamp(inputs[0], f.domain[0], f.domain[1])
    if f.kind == "exponential":
        try:
            out = [a + x**f.exponent * ((f.c1[i] if i < len(f.c1) else 1.0) - a) for i, a in enumerate(f.c0)]
        except (ZeroDivisionError, OverflowError):
            return None
    elif f.kind == "stitching":
        i = next((k for k, b in enumerate(f.bounds) if x < b), len(f.bounds))
        i = min(i, len(f.parts) - 1)
        lo, hi = f.bounds[i - 1] if i else f.domain[0], f.bounds[i] if i < len(f.bounds) else f.domain[1]
        a, b = f.encode[2 * i], f.encode[2 * i + 1]
        return evaluate(f.parts[i], [a + (x - lo) / (hi - lo) * (b - a) if hi > lo else a])
    else:
        a, b = f.encode[:2] if f.encode else (0.0, f.size - 1.0)
        wide = f.domain[1] - f.domain[0]
        at = _clamp(a + ((x - f.domain[0]) / wide if wide else 0.0) * (b - a), 0.0, f.size - 1.0)
        i = int(at)
        j = min(i + 1, f.size - 1)
        dec = f.decode or f.range
        out = [dec[2 * k] + (f.samples[i][k] + (at - i) * (f.samples[j][k] - f.samples[i][k])) * (dec[2 * k + 1] - dec[2 * k]) for k in range(len(f.range) // 2)]
    if f.range:
        out = [_clamp(v, f.range[2 * i], f.range[2 * i + 1]) if 2 * i + 1 < len(f.range) else v for i, v in enumerate(out)]
    return out
