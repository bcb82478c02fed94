"""A small typed expression language that is lowered to Spark columns.

Expressions stay trees until they meet a schema, since their meaning depends on operand
types: integer division truncates, comparisons with NaN are false, rounding is half to
even, a null condition gives null. Lowering yields built-in Spark expressions only, so that
pushdown, folding and code generation apply.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that every row carries and expressions may not touch.
RESERVED = ("__shard_id", "__source_row_id")
#: White space that ``strip`` takes off.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def _wrap(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Expr("lit", (value,))


@dataclass(frozen=True, eq=False)
class Expr:
    """An operation and its arguments."""

    op: str
    args: tuple = ()

    def _(self, op: str, *others: Any) -> Expr:
        return Expr(op, (self, *map(_wrap, others)))

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; combine expressions with &, | and ~")

    def __hash__(self) -> int:
        return hash((self.op, self.args))

    __add__ = lambda a, b: a._("add", b)
    __radd__ = lambda a, b: _wrap(b)._("add", a)
    __sub__ = lambda a, b: a._("sub", b)
    __rsub__ = lambda a, b: _wrap(b)._("sub", a)
    __mul__ = lambda a, b: a._("mul", b)
    __rmul__ = lambda a, b: _wrap(b)._("mul", a)
    __truediv__ = lambda a, b: a._("div", b)
    __rtruediv__ = lambda a, b: _wrap(b)._("div", a)
    __floordiv__ = lambda a, b: a._("floordiv", b)
    __rfloordiv__ = lambda a, b: _wrap(b)._("floordiv", a)
    __mod__ = lambda a, b: a._("mod", b)
    __rmod__ = lambda a, b: _wrap(b)._("mod", a)
    __eq__ = lambda a, b: a._("eq", b)
    __ne__ = lambda a, b: a._("ne", b)
    __lt__ = lambda a, b: a._("lt", b)
    __le__ = lambda a, b: a._("le", b)
    __gt__ = lambda a, b: a._("gt", b)
    __ge__ = lambda a, b: a._("ge", b)
    __and__ = lambda a, b: a._("and", b)
    __rand__ = lambda a, b: _wrap(b)._("and", a)
    __or__ = lambda a, b: a._("or", b)
    __ror__ = lambda a, b: _wrap(b)._("or", a)
    __invert__ = lambda a: a._("not")

    def is_null(self) -> Expr:
        return self._("is_null")

    def is_not_null(self) -> Expr:
        return self._("is_not_null")

    def is_in(self, values: Any) -> Expr:
        """Membership; on an array column whether any element is a member."""
        return Expr("is_in", (self, tuple(values)))

    def between(self, low: Any, high: Any) -> Expr:
        return (self >= low) & (self <= high)

    def fill_null(self, value: Any) -> Expr:
        return Expr("coalesce", (self, _wrap(value)))

    def null_if(self, value: Any) -> Expr:
        return self._("null_if", value)

    def abs(self) -> Expr:
        return self._("abs")

    def floor(self) -> Expr:
        return self._("floor")

    def ceil(self) -> Expr:
        return self._("ceil")

    def round(self, digits: int = 0) -> Expr:
        return Expr("round", (self, int(digits)))

    def clip(self, min: Any = None, max: Any = None) -> Expr:  # noqa: A002
        if min is None and max is None:
            raise ValueError("clip needs a lower or an upper bound")
        return Expr("clip", (self, None if min is None else _wrap(min), None if max is None else _wrap(max)))

    @property
    def str(self) -> _Strings:
        return _Strings(self)

    @property
    def datetime(self) -> _Dates:
        return _Dates(self)

    def columns(self) -> list[str]:
        """Names of the columns that the expression reads, in the order of first use."""
        if self.op == "col":
            return [self.args[0]]
        found: dict[str, None] = {}
        for a in self.args:
            if isinstance(a, Expr):
                found.update(dict.fromkeys(a.columns()))
        return list(found)

    def to_dict(self) -> dict:
        """A form that JSON can hold."""
        return {"op": self.op, "args": [a.to_dict() if isinstance(a, Expr) else list(a) if isinstance(a, tuple) else a for a in self.args]}

    def __repr__(self) -> str:
        if self.op == "col":
            return f"col({self.args[0]!r})"
        if self.op == "lit":
            return repr(self.args[0])
        return f"{self.op}({', '.join(map(repr, self.args))})"


class _Strings:
    def __init__(self, e: Expr):
        self._e = e

    def lower(self) -> Expr:
        return self._e._("lower")

    def upper(self) -> Expr:
        return self._e._("upper")

    def strip(self) -> Expr:
        return self._e._("strip")

    def len(self) -> Expr:
        return self._e._("len")

    def contains(self, text: str) -> Expr:
        return Expr("contains", (self._e, text))

    def startswith(self, text: str) -> Expr:
        return Expr("startswith", (self._e, text))

    def endswith(self, text: str) -> Expr:
        return Expr("endswith", (self._e, text))

    def regex_contains(self, pattern: str) -> Expr:
        return Expr("regex_contains", (self._e, pattern))

    def replace(self, old: str, new: str) -> Expr:
        return Expr("replace", (self._e, old, new))

    def regex_replace(self, pattern: str, new: str) -> Expr:
        """Back references are ``\\1``; ``$`` is an ordinary character."""
        return Expr("regex_replace", (self._e, pattern, new))


class _Dates:
    def __init__(self, e: Expr):
        self._e = e

    def year(self) -> Expr:
        return self._e._("year")

    def month(self) -> Expr:
        return self._e._("month")

    def day(self) -> Expr:
        return self._e._("day")

    def hour(self) -> Expr:
        return self._e._("hour")

    def to_date(self) -> Expr:
        return self._e._("to_date")


def col(name: str) -> Expr:
    if name in RESERVED:
        raise ValueError(f"{name} is reserved")
    return Expr("col", (name,))


def lit(value: Any) -> Expr:
    return Expr("lit", (value,))


def coalesce(*values: Any) -> Expr:
    if not values:
        raise ValueError("coalesce needs a value")
    return Expr("coalesce", tuple(map(_wrap, values)))


def if_else(condition: Any, then: Any, otherwise: Any) -> Expr:
    """A null condition gives null, not the other branch."""
    return Expr("if_else", (_wrap(condition), _wrap(then), _wrap(otherwise)))


# --- lowering -----------------------------------------------------------------------------


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    for k, ts in (("float", (T.FloatType, T.DoubleType)), ("decimal", T.DecimalType), ("bool", T.BooleanType), ("str", T.StringType), ("bytes", T.BinaryType), ("date", T.DateType), ("ts", (T.TimestampType, T.TimestampNTZType)), ("list", T.ArrayType), ("null", T.NullType)):
        if isinstance(t, ts):
            return k
    return "other"


def _literal(v: Any) -> tuple[Column, str]:
    if v is None:
        return F.lit(None), "null"
    if isinstance(v, bool):
        return F.lit(v), "bool"
    if isinstance(v, int):
        return F.lit(v).cast("bigint"), "int"
    if isinstance(v, float):
        return F.lit(v), "float"
    if isinstance(v, str):
        return F.lit(v), "str"
    if isinstance(v, (bytes, bytearray)):
        return F.lit(bytes(v)), "bytes"
    if isinstance(v, dt.datetime):
        return F.lit(v), "ts"
    if isinstance(v, dt.date):
        return F.lit(v), "date"
    if isinstance(v, (list, tuple)):
        return F.array(*(_literal(x)[0] for x in v)), "list"
    raise TypeError(f"no literal of {type(v).__name__}")


_NUMBER = ("int", "float", "decimal")
_JOINED = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}
_COMPARED = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
_FLAT = 2.0**52  # doubles from here on have no fraction


def _whole(c: Column, f) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) >= _FLAT), c).otherwise(f(c).cast("double"))


def _quotient(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def _int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _same_kind(op: str, ka: str, kb: str) -> None:
    if "null" in (ka, kb) or ka == kb or ka in _NUMBER and kb in _NUMBER or {ka, kb} <= {"date", "ts"}:
        return
    raise TypeError(f"{op} of {ka} and {kb}")


def _compare(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    _same_kind(op, ka, kb)
    plain = _COMPARED[op](a, b)
    odd = [F.isnan(c) for c, k in ((a, ka), (b, kb)) if k == "float"]
    if not odd:
        return plain
    nan = odd[0] if len(odd) == 1 else odd[0] | odd[1]
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(nan, F.lit(op == "ne")).otherwise(plain)


def _need(op: str, kind: str, *kinds: str) -> None:
    if kind not in (*kinds, "null"):
        raise TypeError(f"{op} of {kind}")


def _java_replacement(text: str) -> str:
    out = text.replace("\\\\", "\0").replace("$", "\\$")
    return re.sub(r"\\(\d)", r"$\1", out).replace("\0", "\\\\\\\\")


def lower(e: Any, schema: T.StructType) -> Column:
    """The Spark column of an expression over ``schema``."""
    return _lower(_wrap(e), schema)[0]


def _lower(e: Expr, schema: T.StructType) -> tuple[Column, str]:
    op, args = e.op, e.args
    if op == "col":
        if args[0] not in schema.names:
            raise KeyError(args[0])
        name = args[0].replace("`", "``")
        return F.col(f"`{name}`"), kind_of(schema[args[0]].dataType)
    if op == "lit":
        return _literal(args[0])
    subs = [_lower(a, schema) if isinstance(a, Expr) else a for a in args]
    if op == "coalesce":
        kinds = [k for _, k in subs if k != "null"]
        kind = "float" if "float" in kinds and set(kinds) <= set(_NUMBER) else kinds[0] if kinds else "null"
        for k in kinds:
            _same_kind(op, kinds[0], k)
        return F.coalesce(*(c for c, _ in subs)), kind
    if op == "if_else":
        (c, kc), (t, kt), (f, kf) = subs
        _need(op, kc, "bool")
        _same_kind(op, kt, kf)
        return F.when(c.isNull(), F.lit(None)).when(c, t).otherwise(f), kt if kt != "null" else kf
    a, ka = subs[0]
    if op in _JOINED or op in ("div", "floordiv", "mod"):
        b, kb = subs[1]
        for k in (ka, kb):
            _need(op, k, *_NUMBER)
        whole = ka == kb == "int"
        if op in _JOINED:
            return _JOINED[op](a, b), "int" if whole else "float"
        if whole:
            return (_int_div(a, b), "int") if op == "div" else ((_int_div(a, b) if op == "floordiv" else a % b).cast("double"), "float")
        a, b = a.cast("double"), b.cast("double")
        if op == "div":
            return _quotient(a, b), "float"
        floor = _whole(_quotient(a, b), F.floor)
        return (floor if op == "floordiv" else a - floor * b), "float"
    if op in _COMPARED:
        return _compare(op, a, ka, *subs[1]), "bool"
    if op in ("and", "or"):
        b, kb = subs[1]
        _need(op, ka, "bool")
        _need(op, kb, "bool")
        return (a & b if op == "and" else a | b), "bool"
    if op == "not":
        _need(op, ka, "bool")
        return ~a, "bool"
    if op in ("is_null", "is_not_null"):
        return (a.isNull() if op == "is_null" else a.isNotNull()), "bool"
    if op == "is_in":
        values = args[1]
        some = [_literal(v) for v in values if v is not None]
        if ka == "list":
            hit = F.coalesce(F.arrays_overlap(a, F.array(*(c for c, _ in some))), F.lit(False)) if some else F.lit(False)
            return (hit | F.coalesce(F.exists(a, lambda x: x.isNull()), F.lit(False)) if None in values else hit), "bool"
        for _, k in some:
            _same_kind(op, ka, k)
        hit = F.coalesce(a.isin(*(c for c, _ in some)), F.lit(False)) if some else F.lit(False)
        return (a.isNull() | hit if None in values else hit), "bool"
    if op == "null_if":
        b, kb = subs[1]
        same = _compare("eq", a, ka, b, kb)
        return F.when(same.isNull() | same, F.lit(None)).otherwise(a), ka
    if op == "abs":
        _need(op, ka, *_NUMBER)
        return F.abs(a), ka
    if op in ("floor", "ceil"):
        _need(op, ka, *_NUMBER)
        return _whole(a.cast("double"), F.floor if op == "floor" else F.ceil), "float"
    if op == "round":
        _need(op, ka, *_NUMBER)
        return F.bround(a, args[1]), ka
    if op == "clip":
        low, high = args[1], args[2]
        (lo, _), (hi, _) = (_lower(x, schema) if x is not None else (None, "") for x in (low, high))
        out = a if lo is None else F.greatest(a, lo)
        out = out if hi is None else F.least(out, hi)
        out = F.when(F.isnan(a), lo if lo is not None else hi).otherwise(out) if ka == "float" else out
        return F.when(a.isNull(), F.lit(None)).otherwise(out), ka
    if op in ("year", "month", "day", "hour", "to_date"):
        _need(op, ka, "ts", *(("date",) if op != "hour" else ()))
        if op == "to_date":
            return F.to_date(a), "date"
        f = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[op]
        return f(a).cast("bigint"), "int"
    _need(op, ka, "str")
    if op == "lower":
        return F.lower(a), "str"
    if op == "upper":
        return F.upper(F.replace(a, F.lit("ß"), F.lit("ẞ"))), "str"
    if op == "strip":
        return F.regexp_replace(a, f"^[{SPACE}]+|[{SPACE}]+$", ""), "str"
    if op == "len":
        return F.length(a), "int"
    if op in ("contains", "startswith", "endswith"):
        return getattr(a, op)(args[1]), "bool"
    if op == "regex_contains":
        return a.rlike(args[1]), "bool"
    if op == "replace":
        return F.replace(a, F.lit(args[1]), F.lit(args[2])), "str"
    if op == "regex_replace":
        return F.regexp_replace(a, args[1], _java_replacement(args[2])), "str"
    raise ValueError(f"unknown operation {op}")
