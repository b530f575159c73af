"""Statements that change something: rows, definitions, the session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corviq.errors import EngineError
from corviq.functions import scalar as S
from corviq.policy import TENANT, VISIBILITY
from corviq.sources import ingest
from corviq.sql.compiler import Compiler, Env, _names, explain
from corviq.sql.parser import Statement

_TYPES = {
    "text": T.StringType(), "integer": T.IntegerType(), "int": T.IntegerType(), "bigint": T.LongType(), "real": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "bytea": T.BinaryType(), "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(),
}


def field(engine, name: str, kind: str) -> T.StructField:
    """A column of a declared type; vectors carry their dimension, enumerations their labels as metadata."""
    base, many = (kind[:-2], True) if kind.endswith("[]") else (kind, False)
    word, _, rest = base.partition("(")
    args = [int(x) for x in rest.rstrip(")").split(",")] if rest else []
    meta: dict = {}
    if word == "vector" and len(args) == 1 and not many:
        return T.StructField(name, T.ArrayType(T.FloatType()), True, {"dim": args[0]})
    if word in ("numeric", "decimal"):
        precision, scale = (*args, 0)[:2] if args else (38, 0)
        if not 1 <= precision <= 38 or not 0 <= scale <= precision:
            raise EngineError("22023", f"no type {kind}")
        made: T.DataType = T.DecimalType(precision, scale)
    elif word in engine.enums:
        made, meta = T.StringType(), {"enum": engine.enums[word]}
    elif word in _TYPES and not args:
        made = _TYPES[word]
        meta = {"type": word} if word in ("json", "jsonb", "uuid") else meta
    else:
        raise EngineError("42704", f"no type {kind}")
    return T.StructField(name, T.ArrayType(made) if many else made, True, meta)


def value(v, f: T.StructField):
    """A literal in the form of its column; what doesn't fit is refused."""
    if v is None:
        return None
    try:
        if "dim" in f.metadata:
            from corviq.sql.compiler import vector

            out = vector(v)
            if len(out) != f.metadata["dim"]:
                raise EngineError("22000", f"{f.name} has {f.metadata['dim']} dimensions")
            return out
        if "enum" in f.metadata and v not in f.metadata["enum"]:
            raise EngineError("22P02", f"{v} isn't a label")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out = float(v) + 0.0
            if out != out or abs(out) == float("inf"):
                raise EngineError("22003", "numbers are finite")
            return out
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            bits = 31 if isinstance(f.dataType, T.IntegerType) else 63
            if isinstance(v, (bool, float)) or not -(1 << bits) <= int(v) < 1 << bits:
                raise EngineError("22003", f"{v} doesn't fit {f.name}")
            return int(v)
        if isinstance(f.dataType, T.DecimalType):
            import decimal

            step = decimal.Decimal(1).scaleb(-f.dataType.scale)
            return decimal.Decimal(repr(v) if isinstance(v, float) else str(v)).quantize(step, rounding=decimal.ROUND_HALF_UP)
        if isinstance(f.dataType, T.BinaryType):
            if not v.startswith("\\x"):
                raise EngineError("22P02", "bytes are written as \\x and hexadecimal digits")
            return bytearray.fromhex(v[2:])
        if isinstance(f.dataType, T.DateType) and isinstance(v, str):
            import datetime

            return datetime.date.fromisoformat(v)
        if isinstance(f.dataType, T.TimestampNTZType) and isinstance(v, str):
            import datetime

            return datetime.datetime.fromisoformat(v)
        if "type" in f.metadata and isinstance(v, str):
            if f.metadata["type"] == "uuid":
                if not re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v):
                    raise EngineError("22P02", f"{v} is no uuid")
                return v.lower()
            return S.check_json(v) if f.metadata["type"] == "json" else S.canonical_json(v)
        if isinstance(f.dataType, T.StringType) and not isinstance(v, str) or isinstance(f.dataType, T.BooleanType) and not isinstance(v, bool):
            raise EngineError("42804", f"{f.name} has another type")
    except (TypeError, ValueError, ArithmeticError) as e:
        raise EngineError("22P02", f"{f.name}: {e}") from None
    return v


def _store(engine):
    if engine.store is None:
        raise EngineError("0A000", "this session has no store to write to")
    return engine.store


def _returned(engine, rows: DataFrame, returning) -> DataFrame | int:
    if returning is None:
        return rows.count()
    rows = rows.drop(TENANT, VISIBILITY)
    if returning == "*":
        return rows
    env, c = Env(rows, [("", {x: x for x in rows.columns})]), Compiler(engine)
    return rows.select(*[c.expr(e, env).alias(n) for (e, _), n in zip(returning, _names(returning), strict=True)])


def _condition(engine, table: str, node):
    raw = _store(engine).raw(table)
    env = Env(raw, [(table, {c: c for c in raw.columns if c not in (TENANT, VISIBILITY)})])
    return Compiler(engine).expr(node, env), env


def execute(engine, s: Statement, data: str | None = None):
    return _DO[s.kind](engine, **({"data": data} if s.kind == "copy_in" else {}), **s.parts)


def _insert(engine, table, columns, rows, conflict, target, sets, returning, operation, partitioned, chunk):
    if partitioned:
        raise EngineError("42601", "PARTITIONED belongs to UPDATE and DELETE")
    store = _store(engine)
    fields = {f.name: f for f in store.raw(table).schema.fields}
    if unknown := [c for c in columns if c not in fields or c in (TENANT, VISIBILITY)]:
        raise EngineError("42703", f"no column {unknown[0]}")
    made = [{c: value(v, fields[c]) for c, v in zip(columns, row, strict=True)} for row in rows]
    if sets:
        sets = {c: (how, v if how == "excluded" else value(v, fields[c])) for c, (how, v) in sets.items()}
    written = store.insert(table, engine.policy, made, operation, engine.visibility, conflict, tuple(target or ("id",)), sets)
    return _returned(engine, written, returning)


def _update(engine, table, sets, where, returning, operation, partitioned, chunk):
    condition, env = _condition(engine, table, where)
    c = Compiler(engine)
    values = {}
    for name, e in sets.items():
        if name in ("id", TENANT, VISIBILITY) or name not in env.df.columns:
            raise EngineError("42703", f"no column {name} to set")
        f = env.df.schema[name]
        values[name] = F.array(*[F.lit(x) for x in value(e[1], f)]) if e[0] == "lit" and "dim" in f.metadata and e[1] is not None else c.expr(e, env)
    if partitioned:
        if returning:
            raise EngineError("42601", "PARTITIONED has no RETURNING")
        return engine.partitioned(operation, lambda stop: _store(engine).partitioned_update(table, engine.policy, condition, values, operation, chunk, stop))
    return _returned(engine, _store(engine).update(table, engine.policy, condition, values, operation), returning)


def _delete(engine, table, where, returning, operation, partitioned, chunk):
    condition, _ = _condition(engine, table, where)
    if partitioned:
        if returning:
            raise EngineError("42601", "PARTITIONED has no RETURNING")
        return engine.partitioned(operation, lambda stop: _store(engine).partitioned_delete(table, engine.policy, condition, operation, chunk, stop))
    return _returned(engine, _store(engine).delete(table, engine.policy, condition, operation), returning)


def _truncate(engine, table, operation):
    return _store(engine).truncate(table, engine.policy)


def _rules(rules) -> dict:
    out: dict = {"key": ("id",), "unique": [], "not_null": [], "check": [], "foreign": []}
    for kind, rule in rules:
        if kind == "primary":
            out["key"] = tuple(rule)
            out["not_null"] += [c for c in rule if c != "id"]
        else:
            out[kind].append(rule)
    return out


def _create_table(engine, table, columns, rules):
    fields = [field(engine, n, k) for n, k, _ in columns]
    names = [f.name for f in fields if f.name != "id"]
    if len(set(names)) < len(names):
        raise EngineError("42701", "a column is named twice")
    defaults = {f.name: value(d, f) for f, (_, _, d) in zip(fields, columns, strict=True) if d is not None}
    _store(engine).create(table, T.StructType([f for f in fields if f.name != "id"]), **_rules(rules), defaults=defaults)


def _alter_table(engine, table, add=None, rules=(), drop=None, drop_rule=None, retype=None, nullable=None):
    store = _store(engine)
    if add:
        f = field(engine, add[0], add[1])
        store.add_column(table, f, value(add[2], f))
    for kind, rule in rules:
        store.add_rule(table, kind, rule)
    if drop:
        store.drop_column(table, drop)
    if drop_rule:
        store.drop_rule(table, drop_rule)
    if retype:
        store.retype(table, retype[0], field(engine, retype[0], retype[1]).dataType)
    if nullable:
        store.nullable(table, nullable)


def _create_view(engine, name, query):
    Compiler(engine).query(query)  # it must make sense now
    engine.create_view(name, lambda e: Compiler(e).query(query))


def _create_function(engine, name, args, body):
    if len(set(args)) < len(args):
        raise EngineError("42601", "an argument is named twice")

    def build(*given):
        if len(given) != len(args):
            raise TypeError
        return Compiler(engine).expr(body, Env(None, [], [(("col", None, a), c) for a, c in zip(args, given, strict=True)]))

    engine.create_function(name, build)


def _create_index(engine, name, table, method, columns):
    """A declared index steers the plan only: hnsw turns on the approximate search, results stay re-scored exactly."""
    if name in engine.indexes:
        raise EngineError("42P07", f"{name} exists")
    have = engine.table(table).columns
    if missing := [c for c in columns if c not in have]:
        raise EngineError("42703", f"no column {missing[0]}")
    if method not in ("scalar", "hnsw", "btree"):
        raise EngineError("42601", f"no index method {method}")
    engine.indexes[name] = (table, method, tuple(columns))


def _create_type(engine, name, labels):
    if name in engine.enums:
        raise EngineError("42710", f"{name} exists")
    engine.enums[name] = labels


def _gone(what: str):
    def drop(engine, name):
        if getattr(engine, what).pop(name, None) is None:
            raise EngineError("42704", f"no {name}")

    return drop


#: Statements about objects that a store keeps for later sessions.
OBJECTS = {f"{what}_{kind}" for what in ("create", "drop") for kind in ("view", "function", "index", "type")}


def remember(engine, s: Statement, text: str, params: tuple) -> None:
    """Views, functions, indexes and types are kept in the store as the statements that made them."""
    if engine.store is None or engine.restoring or params:
        return
    what, _, kind = s.kind.partition("_")
    engine.store.put_object(f"{kind} {s.parts['name']}", text if what == "create" else None)


def _set(engine, mode):
    if mode not in ("recall", "precision"):
        raise EngineError("22023", f"no mode {mode}")
    engine.mode = mode


def _copy_out(engine, query, format):
    df = Compiler(engine).query(query)
    return df.select(ingest.copy_line([F.col(f"`{c}`") for c in df.columns], format).alias("line"))


def _copy_in(engine, table, columns, format, operation, data):
    fields = {f.name: f for f in _store(engine).raw(table).schema.fields}
    rows = ingest.parse_copy(data or "", format)
    if any(len(r) != len(columns) for r in rows):
        raise EngineError("22P04", "a row has too many or too few fields")

    def read(text, f):
        if text is None or isinstance(f.dataType, (T.StringType, T.BinaryType, T.DateType, T.TimestampNTZType, T.DecimalType)) or "dim" in f.metadata:
            return text
        if isinstance(f.dataType, T.BooleanType):
            if text.lower() not in ("t", "true", "f", "false"):
                raise EngineError("22P02", f"{text} isn't a boolean")
            return text.lower()[0] == "t"
        return text

    made = [[read(t, fields[c]) for c, t in zip(columns, r, strict=True)] for r in rows]  # of a message; files go through ingest.read_copy and Store.load
    return _insert(engine, table, columns, made, "error", None, None, None, operation, None, None)


#: Statements that a message of several makes one transaction of.
CHANGES = {"insert", "update", "delete", "truncate", "create_table", "alter_table", "drop_table", "copy_in"}

_DO = {
    "insert": _insert, "update": _update, "delete": _delete, "truncate": _truncate, "create_table": _create_table, "alter_table": _alter_table,
    "drop_table": lambda e, name: _store(e).drop(name), "create_view": _create_view, "drop_view": _gone("views"), "create_function": _create_function, "drop_function": _gone("functions"),
    "create_index": _create_index, "drop_index": _gone("indexes"), "create_type": _create_type, "drop_type": _gone("enums"), "set": _set,
    "explain": lambda e, query: explain(e, query), "declare": lambda e, name, query: e.declare(name, Compiler(e).query(query)), "fetch": lambda e, name, n: e.fetch(name, n),
    "close": lambda e, name: e.close(name), "copy_out": _copy_out, "copy_in": _copy_in,
    "begin": lambda e: _store(e).begin(), "commit": lambda e: _store(e).commit(), "rollback": lambda e: _store(e).rollback(),
}
