"""Functions of documents as Columns: the function is known when the plan is built, its inputs are columns.

Everything stays in built-in expressions.  A calculator program runs once over symbols: numbers that are known are
computed, others become expressions; a condition on a column runs both branches and chooses value by value.  What fails
for a row is NULL for that row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.core import functions as core


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNull(), x).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def compile_function(f: core.Function, inputs: list[Column]) -> list[Column]:
    """One Column per output."""
    if f.kind == "array":
        return [c for p in f.parts for c in compile_function(p, inputs)]
    xs = [_clamp(c.cast("double"), f.domain[2 * i], f.domain[2 * i + 1]) for i, c in enumerate(inputs[: len(f.domain) // 2])]
    if f.kind == "calculator":
        out = _calculator(f.program, xs)[-(len(f.range) // 2) :]
        return [_clamp(_lit(v).cast("double"), f.range[2 * i], f.range[2 * i + 1]) for i, v in enumerate(out)]
    x = xs[0]
    if f.kind == "exponential":
        out = [F.lit(a) + F.pow(x, F.lit(f.exponent)) * F.lit((f.c1[i] if i < len(f.c1) else 1.0) - a) for i, a in enumerate(f.c0)]
    elif f.kind == "stitching":
        cases = []
        for i, p in enumerate(f.parts):
            lo, hi = f.bounds[i - 1] if i else f.domain[0], f.bounds[i] if i < len(f.bounds) else f.domain[1]
            a, b = f.encode[2 * i], f.encode[2 * i + 1]
            at = F.lit(a) + (x - lo) / F.lit(hi - lo) * (b - a) if hi > lo else F.lit(a)
            cases.append(compile_function(p, [at]))
        out = []
        for k in range(min(map(len, cases))):
            c = cases[-1][k]
            for b, own in reversed(list(zip(f.bounds[: len(f.parts) - 1], cases[:-1], strict=False))):
                c = F.when(x < b, own[k]).otherwise(c)
            out.append(c)
        return out
    else:
        a, b = f.encode[:2] if f.encode else (0.0, f.size - 1.0)
        at = _clamp(F.lit(a) + (x - f.domain[0]) / F.lit(f.domain[1] - f.domain[0]) * (b - a), 0.0, f.size - 1.0)
        i = F.floor(at).cast("int")
        dec, out = f.decode or f.range, []
        for k in range(len(f.range) // 2):
            table = F.array(*[F.lit(s[k]) for s in f.samples])
            u, v = F.get(table, i), F.get(table, F.least(i + 1, F.lit(f.size - 1)))
            out.append(F.lit(dec[2 * k]) + (u + (at - i) * (v - u)) * (dec[2 * k + 1] - dec[2 * k]))
    if f.range:
        out = [_clamp(c, f.range[2 * i], f.range[2 * i + 1]) if 2 * i + 1 < len(f.range) else c for i, c in enumerate(out)]
    return out


def _toward_zero(a: Column) -> Column:
    return F.signum(a) * F.floor(F.abs(a))


_UNARY = {
    "abs": F.abs, "neg": lambda a: -a, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "truncate": _toward_zero,
    "round": lambda a: F.signum(a) * F.floor(F.abs(a) + 0.5), "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)), "ln": lambda a: F.when(a > 0, F.log(a)),
    "log": lambda a: F.when(a > 0, F.log10(a)), "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)), "cvi": lambda a: a.cast("long"),
    "cvr": lambda a: a.cast("double"), "not": lambda a: ~a,
}
_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.when(b != 0, a / b), "exp": lambda a, b: F.pow(a, b),
    "idiv": lambda a, b: F.when(b != 0, _toward_zero(a.cast("double") / b.cast("double"))).cast("long"), "mod": lambda a, b: F.when(b != 0, a % b),
    "atan": lambda a, b: F.when((a != 0) | (b != 0), F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0))), "and": lambda a, b: a & b, "or": lambda a, b: a | b,
    "xor": lambda a, b: a != b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b,
    "lt": lambda a, b: a < b,
}
_ON_INTEGERS = {"and": "bitwiseAND", "or": "bitwiseOR", "xor": "bitwiseXOR"}
_TRUTH = {"eq", "ne", "ge", "gt", "le", "lt", "and", "or", "xor", "not"}


class _Whole:
    """A column that holds whole numbers, so that logic on it is bitwise."""

    def __init__(self, c: Column):
        self.c = c


def _plain(x) -> Column:
    return x.c if isinstance(x, _Whole) else _lit(x)


def _calculator(program: tuple, inputs: list[Column]) -> list:
    def run(body: tuple, stack: list) -> list:
        for w in body:
            if not isinstance(w, str):
                stack.append(w)
            elif w in ("if", "ifelse"):
                other = stack.pop() if w == "ifelse" else ()
                then, test = stack.pop(), stack.pop()
                if isinstance(test, bool):
                    stack = run(then if test else other, stack)
                    continue
                a, b = run(then, list(stack)), run(other, list(stack))
                if len(a) != len(b):
                    raise ValueError("branches leave different numbers of values: evaluate row by row instead")
                stack = [u if u is v else F.when(test, _plain(u).cast("double")).when(~test, _plain(v).cast("double")) for u, v in zip(a, b, strict=True)]
            elif w in core.UNARY or w in core.BINARY:
                args = [stack.pop() for _ in range(1 if w in core.UNARY else 2)][::-1]
                if not any(isinstance(x, Column | _Whole) for x in args):
                    stack.append((core.UNARY.get(w) or core.BINARY[w])(*args))
                    continue
                whole = [isinstance(x, _Whole) or type(x) is int for x in args]
                cols = [_plain(x) for x in args]
                if w == "bitshift":
                    stack.append(_Whole(F.shiftleft(cols[0].cast("long"), args[1]) if args[1] >= 0 else F.shiftright(cols[0].cast("long"), -args[1])))
                elif w in _ON_INTEGERS and all(whole):
                    stack.append(_Whole(getattr(cols[0].cast("long"), _ON_INTEGERS[w])(cols[1].cast("long"))))
                elif w == "cvi" or w == "idiv" or w in ("add", "sub", "mul", "mod", "abs", "neg") and all(whole):
                    stack.append(_Whole((_UNARY.get(w) or _BINARY[w])(*cols)))
                elif w == "not" and whole[0]:
                    stack.append(_Whole(F.bitwise_not(cols[0])))
                else:
                    stack.append((_UNARY.get(w) or _BINARY[w])(*cols))
            else:
                core.shuffle(w, stack)
        return stack

    return [_plain(x) for x in run(program, list(inputs))]
