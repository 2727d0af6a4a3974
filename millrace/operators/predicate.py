"""Row filters: terms joined by AND, compiled to one Column.

``parse`` reads the short notation ``column OP literal AND ...`` that transfer files
use; the terms can as well be given as they are.  ``~`` and ``!~`` test for a substring.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "IN", "NOT IN", "~", "!~")
_NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_REAL = (T.FloatType, T.DoubleType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
_TERM = re.compile(r"""\s*([\w.]+)\s*(!=|<=|>=|!~|=|<|>|~|NOT\s+IN\b|IN\b)\s*(\((?:[^()"']|"[^"]*"|'[^']*')*\)|"[^"]*"|'[^']*'|[^\s()]+)\s*(AND\b|$)""", re.I)


class Unsuitable(ValueError):
    """The filter does not fit the table: a column is missing or of another type."""


@dataclass(frozen=True)
class Term:
    column: str
    op: str
    value: object


def _literal(text: str) -> object:
    if text[0] == "(":
        return [_literal(x) for x in re.findall(r""""[^"]*"|'[^']*'|[^\s,()]+""", text)]
    if text[0] in "\"'":
        return text[1:-1]
    if (low := text.lower()) in ("true", "false"):
        return low == "true"
    if low in ("null", "nil"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))


def parse(text: str) -> list[Term]:
    terms, at = [], 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"cannot read a filter at {text[at:at + 30]!r}")
        terms.append(Term(m[1], re.sub(r"\s+", " ", m[2].upper()), _literal(m[3])))
        at = m.end()
        if not m[4] and at < len(text) or m[4] and at == len(text):
            raise ValueError(f"a filter ends at AND, or goes on without one: {text!r}")
    return terms


def _compare(c: Column, op: str, v: Column) -> Column:
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def _fits(kind: T.DataType, value: object) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, (*_NUMBER, *_REAL))
    if isinstance(value, datetime.datetime):
        return isinstance(kind, (*_TIME, T.StringType))
    return isinstance(value, str) and isinstance(kind, (T.StringType, T.BinaryType))


def _value(kind: T.DataType, value: object) -> Column:
    if isinstance(value, datetime.datetime):
        return F.lit(value).cast("timestamp")
    if isinstance(value, str) and isinstance(kind, T.BinaryType):
        return F.encode(F.lit(value), "UTF-8")
    return F.lit(value)


def compile_term(term: Term, schema: T.StructType) -> tuple[Column, Column]:
    """(whether the row passes, whether the term can't be applied to the row's value).

    A null counts as 0 beside a number; beside text, a time or a boolean it can't be compared.
    """
    if term.column not in schema.names:
        raise Unsuitable(f"no column {term.column}")
    kind, c, never = schema[term.column].dataType, F.col(term.column), F.lit(False)
    if term.value is None:
        if term.op not in ("=", "!="):
            raise Unsuitable(f"NULL with {term.op}")
        return (c.isNull() if term.op == "=" else c.isNotNull()), never
    if term.op in ("IN", "NOT IN"):
        values = term.value if isinstance(term.value, list) else [term.value]
        if not all(_fits(kind, v) for v in values):
            raise Unsuitable(f"{term.column}: a list of another type")
        number = isinstance(kind, (*_NUMBER, *_REAL))
        found = (F.coalesce(c, F.lit(0)) if number else c).isin(*[_value(kind, v) for v in values])
        return F.coalesce(found if term.op == "IN" else ~found, F.lit(False)), never if number else c.isNull()
    if not _fits(kind, term.value):
        raise Unsuitable(f"{term.column} is {kind.simpleString()}, the filter's value {term.value!r}")
    if term.op in ("~", "!~"):
        if not isinstance(term.value, str):
            raise Unsuitable(f"{term.op} needs text")
        found = F.contains(c, _value(kind, term.value))
        return F.coalesce(found if term.op == "~" else ~found, F.lit(False)), c.isNull()
    if isinstance(kind, (*_NUMBER, *_REAL)):
        too_large = c > F.lit(2**63 - 1) if isinstance(kind, T.DecimalType) else never
        c = F.coalesce(c, F.lit(0).cast(kind))
        if isinstance(term.value, float) or isinstance(kind, _REAL):
            c, v = c.cast("double"), F.lit(float(term.value))
        else:
            v = F.lit(term.value)
        return _compare(c, term.op, v), F.coalesce(too_large, never)
    if isinstance(term.value, datetime.datetime) and isinstance(kind, T.StringType):
        t = F.try_to_timestamp(c)
        return F.coalesce(_compare(t, term.op, _value(kind, term.value)), never), t.isNull()
    return F.coalesce(_compare(c, term.op, _value(kind, term.value)), never), c.isNull()


def compile_filters(filters: list[str | list[Term]], schema: T.StructType) -> tuple[Column, Column]:
    """(passes, can't be told): any of the filters, all terms of each; terms are tried in order and the first that is false ends a filter."""
    passes, failed = F.lit(False), F.lit(False)
    for f in filters:
        all_true, bad = F.lit(True), F.lit(False)
        for term in parse(f) if isinstance(f, str) else f:
            ok, wrong = compile_term(term, schema)
            bad = bad | (all_true & wrong)
            all_true = all_true & ok
        failed = failed | (~passes & bad)
        passes = passes | (all_true & ~bad)
    return passes, failed
