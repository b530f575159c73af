"""Scalar functions with the dialect's semantics, as Column expressions: in the JVM, and but for lambdas over arrays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corviq.errors import EngineError


def _fail(code: str, what: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {what}"))


# -- text ------------------------------------------------------------------------------------------------------------


def length(s: Column) -> Column:
    return F.char_length(s).cast("double")


def substr(s: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """Positions before 1 use up length; a negative length is an error."""
    start = start if isinstance(start, Column) else F.lit(start)
    size = F.char_length(s)
    first = F.greatest(start, F.lit(1))
    if count is None:
        return F.substring(s, first, F.greatest(size - first + 1, F.lit(0)))
    count = count if isinstance(count, Column) else F.lit(count)
    cut = F.substring(s, first, F.greatest(F.least(start + count, size + 1) - first, F.lit(0)))
    return F.when(count < 0, _fail("22000", "negative substring length")).otherwise(cut)


def concat(*parts: Column) -> Column:
    """Nulls count as empty texts; never null."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def trim(s: Column) -> Column:
    """Blanks (U+0020) only."""
    return F.trim(s)


def replace(s: Column, old: str, new: str) -> Column:
    return s if old == "" else F.replace(s, F.lit(old), F.lit(new))


def position(needle: str, s: Column) -> Column:
    return F.locate(needle, s).cast("double")


def like(s: Column, pattern: str) -> Column:
    """``%`` and ``_``; a backslash takes the next character literally; one at the end is an error."""
    if len(pattern.encode()) > 4096:
        raise EngineError("54000", "pattern is longer than 4096 bytes")
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            if at == len(pattern):
                raise EngineError("22000", "pattern ends in an escape")
            c = pattern[at]
            out.append(f"\\{c}" if c in "%_\\" else c)
        else:
            out.append(c)
        at += 1
    plain = pattern[:-1]
    if pattern.endswith("%") and not set(plain) & set("%_\\"):
        return s.startswith(plain)  # pushed to the scan
    return s.like("".join(out))


# -- numbers ---------------------------------------------------------------------------------------------------------


def round_half_away(x: Column, n: int = 0) -> Column:
    return F.round(x, n)


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def mod(x: Column, y: Column) -> Column:
    return x % y  # zero raises 22012 in ANSI mode


def power(x: Column, y: Column) -> Column:
    bad = ((x == 0) & (y < 0)) | ((x < 0) & (y != F.floor(y)))
    made = F.pow(x, y)
    return F.when(bad, _fail("22000", "power is undefined")).when(F.abs(made) == float("inf"), _fail("22003", "out of range")).otherwise(made)


def sqrt(x: Column) -> Column:
    return F.when(x < 0, _fail("22000", "square root of a negative number")).otherwise(F.sqrt(x))


# -- dates -----------------------------------------------------------------------------------------------------------

_SECONDS = {"second": 1, "milliseconds": 1_000, "microseconds": 1_000_000}
UNITS = ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")


def date_part(field: str, src: Column) -> Column:
    """Eighteen fields as double; seconds and their parts lie within the minute and include the fraction."""
    ts = src.cast("timestamp_ntz")
    year = F.year(ts)
    if field in _SECONDS:
        value = F.expr("0") + F.date_part(F.lit("second"), ts).cast("decimal(12,6)") * _SECONDS[field]
    elif field == "epoch":
        # without the session's time zone, which a cast to timestamp would bring in
        day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("decimal(12,0)") * 86400
        clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("second"), ts).cast("decimal(12,6)")
        value = day + clock
    elif field == "dow":
        value = F.dayofweek(ts) - 1
    elif field == "isodow":
        value = (F.dayofweek(ts) + 5) % 7 + 1
    elif field == "isoyear":
        value = F.date_part(F.lit("yearofweek"), ts)
    elif field in ("century", "millennium"):
        n = 100 if field == "century" else 1000
        value = F.floor((year + (n - 1)) / n)
    elif field == "decade":
        value = F.floor(year / 10)
    elif field in ("minute", "hour", "day", "doy", "week", "month", "quarter", "year"):
        value = F.date_part(F.lit(field), ts)
    else:
        raise EngineError("22000", f"no field {field}")
    return value.cast("double")


def date_trunc(unit: str, src: Column) -> Column:
    ts = src.cast("timestamp_ntz")
    if unit not in UNITS:
        raise EngineError("22000", f"no unit {unit}")
    if unit in ("decade", "century", "millennium"):
        year = F.year(ts)
        first = {"decade": F.floor(year / 10) * 10, "century": F.floor((year - 1) / 100) * 100 + 1, "millennium": F.floor((year - 1) / 1000) * 1000 + 1}[unit]
        first = F.when(first < 1, _fail("22008", "out of range")).otherwise(first)
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    names = {"microseconds": "microsecond", "milliseconds": "millisecond"}
    return F.date_trunc(names.get(unit, unit), ts).cast("timestamp_ntz")


def date_add(day: Column, n: int) -> Column:
    return F.date_add(day, n)


def date_diff(a: Column, b: Column) -> Column:
    return F.datediff(a, b).cast("double")


# -- vectors ---------------------------------------------------------------------------------------------------------


def vec(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vec_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def vec_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vec_div(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / by)  # zero raises 22012


def vec_add(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + sign * y.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    norms = vec_norm(a) * vec_norm(b)
    return F.when(norms > 0, dot(a, b) / norms)


# -- JSON ------------------------------------------------------------------------------------------------------------


def json_text(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def jsonb(doc: Column) -> Column:
    """Canonical text: sorted keys, no blanks; text that isn't JSON raises."""
    return F.to_json(F.parse_json(doc))


def check_json(text: str, depth: int = 16) -> str:
    """The text, if it is strict JSON of at most ``depth`` levels without a key that repeats in an object."""
    import json

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key repeats")
        return dict(items)

    def constant(name: str):
        raise ValueError(f"{name} isn't JSON")

    def deep(value, left: int) -> None:
        if isinstance(value, (dict, list)):
            if left == 0:
                raise ValueError("nested too deeply")
            for v in value.values() if isinstance(value, dict) else value:
                deep(v, left - 1)

    deep(json.loads(text, object_pairs_hook=pairs, parse_constant=constant), depth)
    return text


class _Number(str):
    """A number's own text."""


def canonical_json(text: str) -> str:
    """:func:`check_json`, then with sorted keys and without blanks; numbers keep their text."""
    import json

    def write(value) -> str:
        if isinstance(value, _Number):
            return value
        if isinstance(value, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(v)}" for k, v in sorted(value.items())) + "}"
        if isinstance(value, list):
            return "[" + ",".join(map(write, value)) + "]"
        return json.dumps(value, ensure_ascii=False)

    return write(json.loads(check_json(text), parse_int=_Number, parse_float=_Number))
