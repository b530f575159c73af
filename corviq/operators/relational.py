"""Scans, filters, aggregates, windows, joins, set operations and subqueries over policy-filtered DataFrames."""

from __future__ import annotations

import decimal
import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corviq.errors import EngineError
from corviq.functions import scalar

MAX_ROWS = MAX_OFFSET = 10_000
MAX_KEYS = 8
MAX_IN = 256


def ordering(keys: Sequence[tuple[Column | str, str]], tie: Sequence[str] = ("id",)) -> list[Column]:
    """Nulls last ascending, first descending; ties by ``tie`` ascending whatever the direction."""
    if len(keys) > MAX_KEYS:
        raise EngineError("54000", f"more than {MAX_KEYS} sort keys")
    out = []
    for key, way in keys:
        c = F.col(key) if isinstance(key, str) else key
        out.append(c.desc_nulls_first() if way == "desc" else c.asc_nulls_last())
    return out + [F.col(t).asc_nulls_last() for t in tie]


def page(df: DataFrame, limit: int | None = None, offset: int = 0, order: Sequence[tuple[Column | str, str]] = (), tie: Sequence[str] = ("id",)) -> DataFrame:
    """ORDER BY, OFFSET, LIMIT as one top-k operator; without a limit all rows after the offset.

    Without keys and offset any ``limit`` rows will do: reading stops as soon as enough are there, nothing is sorted. With
    an offset the rows are numbered by ``tie``, so that pages fit together.
    """
    if limit is not None and not 1 <= limit <= MAX_ROWS or not 0 <= offset <= MAX_OFFSET:
        raise EngineError("22000", "LIMIT is 1 to 10000, OFFSET 0 to 10000")
    if order or offset:
        df = df.orderBy(*ordering(order, tie))
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def in_scan_order(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of a join by the ids of its relations, first to last, rows that outer joins pad after the others."""
    return df.orderBy(*[F.col(i).asc_nulls_last() for i in ids])


_COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "lte": "__le__", "le": "__le__", "gt": "__gt__", "gte": "__ge__", "ge": "__ge__"}


def kinds(df: DataFrame) -> dict[str, str]:
    """Columns whose declared type compares by another form than its text: json, jsonb, uuid."""
    return {f.name: f.metadata["type"] for f in df.schema.fields if f.metadata and f.metadata.get("type") in ("json", "jsonb", "uuid")}


def canonical(kind: str | None, c: Column) -> Column:
    """JSON by its value (keys sorted, no blanks), uuids in lower case, everything else as it is."""
    return scalar.jsonb(c) if kind in ("json", "jsonb") else F.lower(c) if kind == "uuid" else c


def predicate(spec: Mapping | Sequence, columns: Sequence[str], kinds: Mapping[str, str] | None = None) -> Column:
    """A dict filter: leaves ``{column: {op: value}}``, groups ``not`` and ``or``, everything else joined by AND.

    Three-valued as in SQL. Unknown columns are 42703, unknown operators 42601. ``kinds`` names the columns that
    compare by a canonical form.
    """
    kinds = kinds or {}
    if isinstance(spec, (list, tuple)):
        return reduce(lambda a, b: a & b, [predicate(s, columns, kinds) for s in spec], F.lit(True))
    out = []
    for name, body in spec.items():
        if name == "or":
            out.append(reduce(lambda a, b: a | b, [predicate(s, columns, kinds) for s in body]))
        elif name == "and":
            out.append(predicate(list(body), columns, kinds))
        elif name == "not":
            out.append(~predicate(body, columns, kinds))
        elif name not in columns:
            raise EngineError("42703", f"no column {name}")
        else:
            out += [_leaf(F.col(name), op, value, kinds.get(name)) for op, value in (body if isinstance(body, Mapping) else {"eq": body}).items()]
    return reduce(lambda a, b: a & b, out, F.lit(True))


def _leaf(c: Column, op: str, value, kind: str | None = None) -> Column:
    if kind and op in ("eq", "ne", "in"):
        c = canonical(kind, c)
        if op != "in":
            return getattr(c, _COMPARE[op])(canonical(kind, F.lit(value)))
    elif kind in ("json", "jsonb") and op not in ("is_null", "not_null"):
        raise EngineError("42804", f"json has no {op}")
    if op in _COMPARE:
        return getattr(c, _COMPARE[op])(F.lit(value))
    if op == "prefix":
        return c.startswith(value)
    if op == "like":
        return scalar.like(c, value)
    if op == "between":
        low, high = value
        return c.between(F.lit(low), F.lit(high))
    if op == "is_null":
        return c.isNull() if value else c.isNotNull()
    if op == "not_null":
        return c.isNotNull() if value else c.isNull()
    if op == "in":
        if len(value) > MAX_IN:
            raise EngineError("54000", f"more than {MAX_IN} values")
        return c.isin(*[canonical(kind, F.lit(v)) for v in value])
    raise EngineError("42601", f"no operator {op}")


# -- aggregates ------------------------------------------------------------------------------------------------------


def sum_exact(c: Column) -> Column:
    """Integer sums that only the final value can overflow (22003)."""
    return F.sum(c.cast("decimal(38,0)")).cast("bigint")


def finite(c: Column) -> Column:
    """A double aggregate that must not leave the finite range."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("22003: out of range"))).otherwise(c)


def avg_numeric(c: Column, precision: int, scale: int, over=lambda c: c) -> Column:
    """AVG of NUMERIC(p, s): scale max(s, min(16, 38 - (p - s))), half away from zero. ``over`` puts it over a window.

    Spark divides decimals to six digits where precision runs short, so the one division a group is done in Python.
    """
    digits = max(scale, min(16, 38 - (precision - scale)))
    step = decimal.Decimal(1).scaleb(-digits)

    @F.pandas_udf(f"decimal(38,{digits})")
    def divide(total: pd.Series, n: pd.Series) -> pd.Series:
        with decimal.localcontext(prec=80):
            return pd.Series([None if t is None else (t / int(k)).quantize(step, rounding=decimal.ROUND_HALF_UP) for t, k in zip(total, n, strict=True)], dtype=object)

    return divide(over(F.sum(c.cast(f"decimal(38,{scale})"))), over(F.count(c)))


def grouped(df: DataFrame, keys: Sequence[str], items: Mapping[str, Column], having: Column | None = None) -> DataFrame:
    """GROUP BY up to eight keys; :func:`page` orders by keys where that is asked for."""
    if len(keys) > MAX_KEYS or not 1 <= len(items) <= 32:
        raise EngineError("54000", "at most 8 keys and 32 items")
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in items.items()])
    return out if having is None else out.where(having)


# -- windows ---------------------------------------------------------------------------------------------------------


def over(partition: Sequence[str], order: Sequence[tuple[str, str]] = (), tie: bool = False):
    """A window: the whole partition without keys, else from its start to the end of the current peers."""
    w = Window.partitionBy(*partition)
    return w.orderBy(*ordering(order, ("id",) if tie else ())) if order else w


# -- joins and sets --------------------------------------------------------------------------------------------------

#: Join keys by their class; integers include ids, and only keys of one class are compared.
_CLASS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "string": "text", "boolean": "bool", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamp", "binary": "bytes"}


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equality joins; key types must be of one class, and floats, decimals, JSON, arrays can't be keys (42804)."""
    types, declared = (dict(left.dtypes), dict(right.dtypes)), (kinds(left), kinds(right))
    for a, b in on:
        x, y = (declared[k].get(c) or _CLASS.get(types[k][c]) for k, c in enumerate((a, b)))
        if x is None or x != y or x in ("json", "jsonb"):
            raise EngineError("42804", f"{a} and {b} can't be compared as join keys")
    if how == "full" and reproducible(left) and reproducible(right):
        return _full(left, right, on)
    return left.join(right, reduce(lambda p, q: p & q, [left[a] == right[b] for a, b in on]), how)


#: Left rows of a key that one task of a full join takes.
DEALT = 4_096


def reproducible(df: DataFrame) -> bool:
    """Whether reading ``df`` twice gives the same rows: nothing random, no LIMIT, which may take any rows."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.deterministic() and not re.search(r"^\W*(Global|Local)Limit |^\W*(Offset|Sample|Tail) ", plan.toString(), re.MULTILINE)


def _full(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], ids: Sequence[str] = (), first: int | None = None) -> DataFrame:
    """A full join as a left join and the right rows without a match.

    Spark's own holds all pairs of a key in memory at once; a left join holds the matches of a row. The left rows of a
    key that has more than ``DEALT`` are dealt to several tasks by hash, and its right rows go to each of them. What is
    broadcast is a row for each such key, a ``DEALT``-th of the left rows at most. ``ids``, ``first``: see
    :func:`first_of_join`.
    """
    names = [*left.columns, *right.columns]
    a = left.toDF(*[f"_l{n}" for n in range(len(left.columns))])
    c = right.toDF(*[f"_r{n}" for n in range(len(right.columns))])
    la, rc = ([side[columns.index(k)] for k in keys] for side, columns, keys in ((a.columns, left.columns, [x for x, _ in on]), (c.columns, right.columns, [y for _, y in on])))
    some = a if first is None else _leading(a, [a.columns[left.columns.index(i)] for i in ids], first)
    keys = [f"_k{n}" for n in range(len(on))]
    known = reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in la])
    parts = some.where(known).groupBy(*[F.col(x).alias(k) for x, k in zip(la, keys, strict=True)]).agg(F.ceil(F.count("*") / DEALT).cast("int").alias("_parts")).where("_parts > 1")
    on_keys = lambda side: reduce(lambda p, q: p & q, [F.col(x) == F.col(k) for x, k in zip(side, keys, strict=True)])
    row = F.xxhash64(*[x for x, t in a.dtypes if "map<" not in t and t not in ("variant", "void")] or [F.lit(0)])
    dealt = some.join(F.broadcast(parts), on_keys(la), "left").withColumn("_part", F.pmod(row, F.when(known, F.coalesce("_parts", F.lit(1))).otherwise(DEALT)).cast("int"))
    copied = c.join(F.broadcast(parts), on_keys(rc), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    equal = lambda: reduce(lambda p, q: p & q, [F.col(x) == F.col(y) for x, y in zip(la, rc, strict=True)])
    pairs = dealt.select(*a.columns, "_part").join(copied.select(*c.columns, "_copy").hint("merge"), equal() & (F.col("_part") == F.col("_copy")), "left").select(*a.columns, *c.columns)
    alone = c.join(a.select(*la).distinct(), equal(), "left_anti").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in a.schema.fields], *c.columns)
    return pairs.union(alone).toDF(*names)


def _leading(df: DataFrame, ids: Sequence[str], first: int) -> DataFrame:
    """The rows up to the ``first``-th by ``ids``, nulls last, with all that tie with it."""
    place = F.struct(*[F.struct(F.col(i).isNull().alias("null"), F.col(i).alias("id")) for i in ids])
    edge = df.select(place.alias("_at")).orderBy("_at").limit(first).agg(F.max("_at").alias("_edge"))
    return df.join(F.broadcast(edge), place <= F.col("_edge")).drop("_edge")


def first_of_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str, ids: Sequence[str], first: int) -> DataFrame:
    """A join of which only the ``first`` rows by the left side's ``ids`` and then the right side's are asked for.

    In a left or full join every left row has a row, so that the first left rows are enough; other joins are made whole.
    """
    if how in ("left", "full") and reproducible(left) and reproducible(right):
        if how == "left":
            return join(_leading(left, ids, first), right, on, how)
        join(left, right, on)  # refuses what can't be compared
        return _full(left, right, on, ids, first)
    return join(left, right, on, how)


def in_subquery(df: DataFrame, column: str, inner: DataFrame, negate: bool = False) -> DataFrame:
    """``IN`` as a semi join. ``NOT IN``: all rows if the inner query is empty, none if it holds a null.

    The null rule is one aggregated row, and the rest an anti join on equality, which shuffles; a null-aware anti join
    would have to broadcast the inner query whatever its size.
    """
    (name,) = inner.columns
    inner = inner.select(F.col(name).alias("_inner"))
    if not negate:
        return df.join(inner, df[column] == F.col("_inner"), "left_semi")
    facts = inner.agg(F.count("*").alias("_n"), F.count("_inner").alias("_known"))
    kept = df.join(inner, df[column] == F.col("_inner"), "left_anti")
    return kept.join(F.broadcast(facts)).where((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(column).isNotNull())).drop("_n", "_known")


def exists(df: DataFrame, inner: DataFrame, negate: bool = False) -> DataFrame:
    """Uncorrelated EXISTS: one row of the inner query decides."""
    fact = inner.limit(1).agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(fact)).where(F.col("_n") == (0 if negate else 1)).drop("_n")


def scalar_subquery(df: DataFrame, inner: DataFrame, name: str) -> DataFrame:
    """``df`` with the inner query's single value; null for no row, 21000 for more, only if ``df`` has rows."""
    (column,) = inner.columns
    few = inner.limit(2).agg(F.count("*").alias("_n"), F.first(column).alias("_v"))
    value = F.when(F.col("_n") > 1, F.raise_error(F.lit("21000: more than one row")).cast(inner.schema[0].dataType)).otherwise(F.col("_v"))
    return df.join(F.broadcast(few)).withColumn(name, value).drop("_n", "_v")


def set_op(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """union_all, union, intersect, except by position; types must be the same (42804)."""
    if [t for _, t in left.dtypes] != [t for _, t in right.dtypes]:
        raise EngineError("42804", "branches differ in types")
    if kind == "union_all":
        return left.union(right)
    if kind == "union":
        return left.union(right).distinct()
    if kind == "intersect":
        return left.intersect(right)
    if kind == "except":
        return left.subtract(right)
    raise EngineError("42601", f"no set operation {kind}")
