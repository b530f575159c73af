"""From the parsed tree to DataFrames: every table comes through the engine's one door, everything else is Catalyst's work."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corviq.errors import EngineError
from corviq.functions import scalar as S
from corviq.operators import relational as R
from corviq.operators import retrieval as V
from corviq.plans.engine import KEY
from corviq.sql.lexer import split
from corviq.sql.parser import AGGREGATES, RANKS, Parser, Query, Select, SetOp, Statement

MAX_CTE_DEPTH = 4
_NUMBERS = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)


@dataclass
class Env:
    """Names in sight: relations with their columns, nodes that already have a column, and aliases of the select list."""

    df: DataFrame | None
    scope: list[tuple[str, dict[str, str]]] = field(default_factory=list)
    known: list[tuple[tuple, Column]] = field(default_factory=list)
    aliases: dict[str, Column] = field(default_factory=dict)

    def column(self, qualifier: str | None, name: str) -> str:
        found = [columns[name] for alias, columns in self.scope if qualifier in (None, alias) and name in columns]
        if not found:
            raise EngineError("42703", f"no column {name}")
        if len(found) > 1:
            raise EngineError("42702", f"{name} is ambiguous")
        return found[0]


def walk(node, seen: Callable[[tuple], bool]) -> None:
    """Calls ``seen`` on every node outside subqueries; where it returns true the walk doesn't go deeper."""
    if not isinstance(node, tuple):
        return
    if node and isinstance(node[0], str) and seen(node):
        return
    for part in node:
        if isinstance(part, tuple):
            walk(part, seen)


def vector(text) -> list[float]:
    try:
        out = [float(x) for x in (json.loads(text) if isinstance(text, str) else text)]
    except (TypeError, ValueError):
        raise EngineError("22000", "a vector literal is expected") from None
    if any(x != x or abs(x) == float("inf") for x in out):
        raise EngineError("22000", "vectors hold finite numbers")
    return out


class Compiler:
    def __init__(self, engine):
        self.engine, self.n, self.ctes = engine, 0, {}
        self.used: dict[str, str] = {}  # for EXPLAIN

    def fresh(self, prefix: str) -> str:
        self.n += 1
        return f"_{prefix}{self.n}"

    # -- expressions

    def kind(self, c: Column, env: Env) -> T.DataType:
        if env.df is None:
            return T.NullType()
        return env.df.select(c).schema[0].dataType

    def declared(self, node: tuple, env: Env) -> str | None:
        """json, jsonb or uuid, if the node is a column of that type."""
        if node[0] != "col" or env.df is None or node[1] is None and node[2] in env.aliases:
            return None
        try:
            return R.kinds(env.df.select(self.expr(node, env))).get(env.column(node[1], node[2]))
        except EngineError:
            return None

    def expr(self, node: tuple, env: Env) -> Column:
        for known, column in env.known:
            if known == node:
                return column
        how = getattr(self, f"_{node[0]}", None)
        if how is None:
            raise EngineError("42601", f"{node[0]} isn't allowed here")
        return how(node, env)

    def _lit(self, node, env):
        value = node[1]
        if isinstance(value, (list, tuple)):
            return F.array(*map(F.lit, value))
        return F.lit(value)

    def _raw(self, node, env):
        return F.col(node[1])

    def _col(self, node, env):
        _, qualifier, name = node
        if qualifier is None and name in env.aliases:
            return env.aliases[name]
        return F.col(f"`{env.column(qualifier, name)}`")

    def _array(self, node, env):
        return F.array(*[self.expr(x, env) for x in node[1]])

    def _and(self, node, env):
        return self.expr(node[1], env) & self.expr(node[2], env)

    def _or(self, node, env):
        return self.expr(node[1], env) | self.expr(node[2], env)

    def _not(self, node, env):
        return ~self.expr(node[1], env)

    def _is_null(self, node, env):
        c = self.expr(node[1], env)
        return c.isNotNull() if node[2] else c.isNull()

    def _in(self, node, env):
        kind = self.declared(node[1], env)
        values = [R.canonical(kind, self.expr(v, env)) for v in node[2]]
        out = R.canonical(kind, self.expr(node[1], env)).isin(*values)
        return ~out if node[3] else out

    def _between(self, node, env):
        out = self.expr(node[1], env).between(self.expr(node[2], env), self.expr(node[3], env))
        return ~out if node[4] else out

    def _like(self, node, env):
        out = S.like(self.expr(node[1], env), node[2])
        return ~out if node[3] else out

    def _op(self, node, env):
        _, sign, a, b = node
        x, y = self.expr(a, env), self.expr(b, env)
        if sign in ("=", "<>", "<", "<=", ">", ">="):
            kind = self.declared(a, env) or self.declared(b, env)
            if kind in ("json", "jsonb") and sign not in ("=", "<>"):
                raise EngineError("42804", f"json has no {sign}")
            x, y = R.canonical(kind, x), R.canonical(kind, y)
            return {"=": x.__eq__, "<>": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[sign](y)
        if sign == "<=>":
            raise EngineError("42601", "<=> belongs into ORDER BY")
        left, right = self.kind(x, env), self.kind(y, env)
        if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType) and sign in "+-":
            return S.vec_add(x, y, 1 if sign == "+" else -1)
        if isinstance(left, T.ArrayType) and sign in "*/":
            return S.vec_div(x, y) if sign == "/" else F.transform(x, lambda v: v.cast("double") * y)
        if isinstance(left, T.DateType) and isinstance(right, T.DateType) and sign == "-":
            return S.date_diff(x, y)
        if isinstance(left, T.DateType) and sign in "+-":
            return F.date_add(x, y.cast("int")) if sign == "+" else F.date_sub(x, y.cast("int"))
        if isinstance(right, T.DateType) and sign == "+":
            return F.date_add(y, x.cast("int"))
        if isinstance(left, T.StringType) or isinstance(right, T.StringType):
            raise EngineError("42804", f"{sign} needs numbers")
        x, y = x.cast("double"), y.cast("double")
        return x + y if sign == "+" else x - y if sign == "-" else x * y if sign == "*" else x / y

    def _case(self, node, env):
        _, branches, other = node
        values = [self.expr(v, env) for _, v in branches]
        last = self.expr(other, env)
        kinds = {_family(self.kind(v, env)) for v in [*values, last]} - {None}
        if len(kinds) > 1:
            raise EngineError("42804", "branches differ in types")
        out = F.when(self.expr(branches[0][0], env), values[0])
        for (condition, _), v in zip(branches[1:], values[1:], strict=True):
            out = out.when(self.expr(condition, env), v)
        return out.otherwise(last)

    def _scalar(self, node, env):
        raise EngineError("0A000", "a subquery isn't supported here")

    _in_query = _exists = _scalar

    def _star(self, node, env):
        raise EngineError("42601", "* isn't allowed here")

    def _call(self, node, env):
        _, name, args, distinct, over = node
        if over is not None:
            return self._window(name, args, over, env)
        if name in AGGREGATES:
            raise EngineError("42803", f"{name} isn't allowed here")
        if distinct or name in RANKS:
            raise EngineError("42601", f"{name} isn't allowed here")
        if name in self.engine.functions:
            try:
                return self.engine.functions[name](*[self.expr(a, env) for a in args])
            except TypeError:
                raise EngineError("42883", f"{name} doesn't take {len(args)} arguments") from None
        if name not in _FUNCTIONS:
            raise EngineError("42883", f"no function {name}")
        least, most, build = _FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise EngineError("42883", f"{name} doesn't take {len(args)} arguments")
        return build(*[a[1] if a[0] == "lit" and (name, k) in _PLAIN else self.expr(a, env) for k, a in enumerate(args)])

    def _window(self, name, args, over, env):
        partition, order = over
        from pyspark.sql import Window

        keys = [self.expr(p, env) for p in partition]
        w = Window.partitionBy(*keys)
        if order:
            tie = [i for _, columns in env.scope for c, i in columns.items() if c == "id"] if name == "row_number" else []
            w = w.orderBy(*R.ordering([(self.expr(k, env), way) for k, way in order], tie))
        elif name in RANKS:
            tie = [i for _, columns in env.scope for c, i in columns.items() if c == "id"]
            w = w.orderBy(*R.ordering([], tie)) if name == "row_number" else w.orderBy(F.lit(1))
        if name in RANKS:
            if args:
                raise EngineError("42883", f"{name} takes no arguments")
            return {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[name]().over(w)
        return self.aggregate(("call", name, args, False, None), env, w)

    def aggregate(self, node, env, window=None) -> Column:
        _, name, args, distinct, _ = node
        if len(args) != 1:
            raise EngineError("42883", f"{name} takes one argument")
        over = (lambda c: c) if window is None else (lambda c: c.over(window))
        if args[0][0] == "star":
            if name != "count":
                raise EngineError("42601", f"{name}(*) isn't allowed")
            return over(F.count("*"))
        c = self.expr(args[0], env)
        if name == "count":
            return over(F.count_distinct(c) if distinct else F.count(c))
        if distinct:
            raise EngineError("42601", "DISTINCT belongs to COUNT")
        kind = self.kind(c, env)
        if isinstance(kind, (T.ArrayType, T.BinaryType, T.BooleanType)) or name in ("sum", "avg") and not isinstance(kind, T.NumericType):
            raise EngineError("42804", f"{name} doesn't take this type")
        if name in ("min", "max"):
            return over((F.min if name == "min" else F.max)(c))
        if isinstance(kind, T.DecimalType):
            if name == "sum":
                return over(F.sum(c.cast(f"decimal(38,{kind.scale})"))).cast(f"decimal(38,{kind.scale})")
            return R.avg_numeric(c, kind.precision, kind.scale, over)
        if isinstance(kind, _NUMBERS):
            return over(F.sum(c.cast("decimal(38,0)"))).cast("bigint") if name == "sum" else over(F.avg(c))
        return R.finite(over((F.sum if name == "sum" else F.avg)(c.cast("double"))))

    # -- queries

    def query(self, q: Query) -> DataFrame:
        outer = self.ctes
        try:
            for name, inner in q.ctes:
                made = self.query(inner)
                self.ctes = {**self.ctes, name: made}
            return self.body(q.body)
        finally:
            self.ctes = outer

    def body(self, b) -> DataFrame:
        if isinstance(b, Select):
            return self.select(b)
        if b.kind == "limit":
            out = self.body(b.left)
        else:
            left, right = self.body(b.left), self.body(b.right)
            if len(left.columns) != len(right.columns):
                raise EngineError("42601", "branches differ in their number of columns")
            out = R.set_op(b.kind, left, right)
        if b.limit is not None or b.offset:
            out = out.orderBy(*R.ordering([], out.columns))
            out = out.offset(b.offset) if b.offset else out
            out = out if b.limit is None else out.limit(b.limit)
        return out

    def relation(self, name: str) -> DataFrame:
        return self.ctes[name] if name in self.ctes else self.engine.table(name)

    def source(self, s: Select, keyed: bool = False, asked: int | None = None) -> Env:
        """The relations of a query, joined; ``asked``: so many rows in scan order are all that it asks for."""
        aliases = [r.alias for r in s.relations]
        if len(set(aliases)) < len(aliases):
            raise EngineError("42712", "a relation name is used twice")
        first = s.relations[0]
        if keyed and first.name not in self.ctes:
            df = self.engine.table(first.name, keyed=True)
            return Env(df, [(first.alias, {c: c for c in df.columns if c != KEY})])
        df = self.relation(first.name)
        if len(s.relations) == 1:
            return Env(df, [(first.alias, {c: c for c in df.columns})])

        def named(r):
            t = self.relation(r.name)
            return t.select(*[F.col(f"`{c}`").alias(f"{r.alias}__{c}") for c in t.columns]), (r.alias, {c: f"{r.alias}__{c}" for c in t.columns})

        df, own = named(first)
        env = Env(df, [own])
        for n, r in enumerate(s.relations[1:], 2):
            right, new = named(r)
            keys = []
            for a, b in r.on:
                if a[0] != "col" or b[0] != "col":
                    raise EngineError("42601", "ON compares columns")
                there = Env(right, [new])
                if a[1] == r.alias or a[1] is None and a[2] in new[1] and not any(a[2] in c for _, c in env.scope):
                    a, b = b, a
                keys.append((env.column(a[1], a[2]), there.column(b[1], b[2])))
            ids = [i for _, cs in env.scope for c, i in cs.items() if c == "id"]
            if asked is not None and n == len(s.relations) and len(ids) == n - 1:
                env = Env(R.first_of_join(env.df, right, keys, r.how, ids, asked), [*env.scope, new])
            else:
                env = Env(R.join(env.df, right, keys, r.how), [*env.scope, new])
        return env

    def attach(self, node, env: Env):
        """``node`` with its scalar subqueries and EXISTS replaced by columns that one broadcast row brings."""
        if not isinstance(node, tuple) or not node:
            return node
        if node[0] == "scalar" and isinstance(node[1], Query):
            name = self.fresh("s")
            env.df = R.scalar_subquery(env.df, self.query(node[1]), name)
            return ("raw", name)
        if node[0] == "exists" and isinstance(node[1], Query):
            name = self.fresh("e")
            fact = self.query(node[1]).limit(1).agg((F.count("*") > 0).alias(name))
            env.df = env.df.join(F.broadcast(fact))
            return ("raw", name)
        if node[0] == "in_query" and isinstance(node[2], Query):
            return ("raw", self.marked(node, env))
        return tuple(self.attach(x, env) if isinstance(x, tuple) else x for x in node)

    def marked(self, node, env: Env) -> str:
        """IN of a subquery as a three-valued column: a left join with its distinct values and one row of facts."""
        _, left, query, negate = node
        key, seen, out = self.fresh("k"), self.fresh("m"), self.fresh("i")
        inner = self.query(query)
        if len(inner.columns) != 1:
            raise EngineError("42601", "the subquery has more than one column")
        df = env.df.withColumn(key, self.expr(self.attach(left, env), env))
        if _family(df.schema[key].dataType) != _family(inner.schema[0].dataType):
            raise EngineError("42804", "IN compares different types")
        value = inner.select(F.col(f"`{inner.columns[0]}`").alias("_v"))
        facts = value.agg(F.count("*").alias("_n"), F.count("_v").alias("_known"))
        known = value.where(F.col("_v").isNotNull()).distinct().withColumn(seen, F.lit(True))
        joined = df.join(known, F.col(key) == F.col("_v"), "left").join(F.broadcast(facts))
        found = F.when(F.col("_n") == 0, False).when(F.col(seen), True).when(F.col(key).isNull() | (F.col("_n") > F.col("_known")), None).otherwise(False)
        env.df = joined.withColumn(out, ~found if negate else found).drop("_v", "_n", "_known", key, seen)
        return out

    def where(self, condition: tuple | None, env: Env) -> None:
        for part in _conjuncts(condition):
            if part[0] == "in_query":
                _, left, query, negate = part
                name = self.fresh("k")
                df = env.df.withColumn(name, self.expr(left, env))
                inner = self.query(query)
                if len(inner.columns) != 1:
                    raise EngineError("42601", "the subquery has more than one column")
                if _family(df.schema[name].dataType) != _family(inner.schema[0].dataType):
                    raise EngineError("42804", "IN compares different types")
                env.df = R.in_subquery(df, name, inner, negate).drop(name)
            else:
                part = self.attach(part, env)
                env.df = env.df.where(self.expr(part, env))

    def select(self, s: Select) -> DataFrame:
        search = s.plan is not None or len(s.order) == 1 and (s.order[0][0][:2] == ("op", "<=>") or s.order[0][0][0] == "call" and s.order[0][0][1] in ("hybrid_rrf", "hybrid"))
        whole: list[tuple] = []  # what looks at all rows, though only some are asked for
        for e, _ in s.items:
            walk(e, lambda node: node[0] == "call" and node[1] in AGGREGATES | RANKS and not whole.append(node))
        plain = not (whole or s.where or s.group or s.having or s.order or s.offset or s.distinct)
        env = self.source(s, keyed=bool(search) and len(s.relations) == 1, asked=s.limit if plain else None)
        if search:
            return self.search(s, env)
        if s.mode or s.hint:
            raise EngineError("42601", "USING MODE and HINT ORDER belong to searches")
        self.where(s.where, env)
        items = self.items(s, env)
        aggregates: list[tuple] = []

        def note(node):
            if node[0] == "call" and node[1] in AGGREGATES and node[4] is None:
                if node not in aggregates:
                    aggregates.append(node)
                return True
            return False

        for e in (*[e for e, _ in items], s.having, *[k for k, _ in s.order]):
            walk(e, note)
        if s.group or aggregates:
            return self.grouped(s, env, items, aggregates)
        if s.having:
            raise EngineError("42601", "HAVING needs GROUP BY")
        names = _names(items)
        items = [(self.attach(e, env), a) for e, a in items]
        columns = [self.expr(e, env).alias(n) for (e, _), n in zip(items, names, strict=True)]
        if s.distinct:
            out = env.df.select(*columns).distinct()
            return self.paged(out, s, Env(out, [("", {c: c for c in out.columns})]), out.columns)
        tie = [i for _, cs in env.scope for c, i in cs.items() if c == "id"] or None
        if s.order or s.offset:
            env.aliases = dict(zip(names, [self.expr(e, env) for e, _ in items], strict=True))
            return self.paged(env.df, s, env, tie or [c for c in env.df.columns if not isinstance(env.df.schema[c].dataType, T.ArrayType)], columns)
        if len(s.relations) > 1 and s.limit is not None and tie:  # the first rows of a join, in scan order
            env.df = R.in_scan_order(env.df, tie)
        out = env.df.select(*columns)
        return out if s.limit is None else out.limit(s.limit)  # unordered: reading stops as soon as enough rows are there

    def items(self, s: Select, env: Env) -> list[tuple[tuple, str | None]]:
        out = []
        for e, alias in s.items:
            if e[0] != "star":
                out.append((e, alias))
                continue
            for name, columns in env.scope:
                if e[1] in (None, name):
                    out += [(("col", name, c), None) for c in columns]
        return out

    def paged(self, df: DataFrame, s: Select, env: Env, tie, columns=None) -> DataFrame:
        keys = []
        for k, way in s.order:
            if k[0] == "lit":
                raise EngineError("42601", "ORDER BY takes names and expressions")
            c = self.expr(self.attach(k, env), env)
            keys.append((self.ranked(c, env), way))
        df = env.df if columns is not None else df
        added = [(self.fresh("o"), k, way) for k, way in keys]
        out = df.withColumns({n: k for n, k, _ in added}) if added else df
        out = out.orderBy(*R.ordering([(n, way) for n, _, way in added], tie))
        out = out.offset(s.offset) if s.offset else out
        out = out if s.limit is None else out.limit(s.limit)
        return out.select(*columns) if columns is not None else out.drop(*[n for n, _, _ in added])

    def ranked(self, c: Column, env: Env) -> Column:
        """Labels of an enumeration are ordered as declared."""
        f = env.df.select(c).schema[0]
        if isinstance(f.dataType, T.ArrayType):
            raise EngineError("22000", "arrays have no order")
        labels = (f.metadata or {}).get("enum")
        return F.nullif(F.array_position(F.array(*map(F.lit, labels)), c), F.lit(0)) if labels else c

    def grouped(self, s: Select, env: Env, items, aggregates) -> DataFrame:
        if s.distinct:
            raise EngineError("42601", "DISTINCT with aggregates isn't supported")
        if len(aggregates) > 32:
            raise EngineError("54000", "more than 32 aggregates")
        by_alias = {a: e for e, a in items if a}
        keys = [by_alias.get(g[2], g) if g[0] == "col" and g[1] is None and not any(g[2] in c for _, c in env.scope) else g for g in s.group]
        key_columns = [self.expr(k, env).alias(f"_g{n}") for n, k in enumerate(keys)]
        values = [self.aggregate(a, env).alias(f"_a{n}") for n, a in enumerate(aggregates)] or [F.count("*").alias("_n")]
        out = env.df.groupBy(*key_columns).agg(*values)
        known = [(k, F.col(f"_g{n}")) for n, k in enumerate(keys)] + [(a, F.col(f"_a{n}")) for n, a in enumerate(aggregates)]
        known += [(("col", None, k[2]), F.col(f"_g{n}")) for n, k in enumerate(keys) if k[0] == "col"]
        known += [(("col", r.alias, k[2]), F.col(f"_g{n}")) for n, k in enumerate(keys) if k[0] == "col" and k[1] is None for r in s.relations]
        after = Env(out, [], known)
        names = _names(items)
        columns = [self.expr(e, after).alias(n) for (e, _), n in zip(items, names, strict=True)]
        after.aliases = {n: c for (_, a), n, c in zip(items, names, [self.expr(e, after) for e, _ in items], strict=True)}
        if s.having:
            after.df = after.df.where(self.expr(self.attach(s.having, after), after))
        if not keys:
            if s.offset:
                raise EngineError("42601", "a single row has no OFFSET")
            return after.df.select(*columns)
        if s.order or s.limit is not None or s.offset:
            return self.paged(after.df, s, after, [f"_g{n}" for n in range(len(keys))], columns)
        return after.df.select(*columns)

    def search(self, s: Select, env: Env) -> DataFrame:
        """k-NN, hybrid or planned search: RLS, then the filter, then the distance, unless a hint puts the filter last."""
        if len(s.relations) > 1 or s.group or s.having or s.distinct:
            raise EngineError("42601", "a search reads one table, without grouping")
        if s.offset:
            raise EngineError("42601", "a search has no OFFSET")
        if s.limit is None:
            raise EngineError("42601", "a search needs LIMIT")
        k, body, weights, planned, boosts = s.limit, "body", (1.0, 1.0), None, []
        columns = [c for c in env.df.columns if c != KEY]
        vec = next((c for c, t in env.df.dtypes if t == "array<float>"), None)
        if s.plan is not None:
            expansion = self.engine.expand(s.plan)
            planned = expansion.mode_hint
            self.used |= {"path_hint": expansion.path_hint or "none", "kind_hint": expansion.kind_hint or "none"}
            query, text = self.engine.embed(expansion.dense_text(), env.df, vec), expansion.sparse_text(s.plan)
            boosts = expansion.boosts(columns)
        else:
            node = s.order[0][0]
            args = node[2:4] if node[0] == "op" else node[2]
            if len(args) not in (2, 4) or args[0][0] != "col" or args[1][0] != "lit":
                raise EngineError("42601", "a vector column and a vector are expected")
            vec, query, text = env.column(args[0][1], args[0][2]), vector(args[1][1]), None
            if len(args) == 4:
                if args[2][0] != "col" or args[3][0] != "lit":
                    raise EngineError("42601", "a text column and a text are expected")
                body, text = env.column(args[2][1], args[2][2]), str(args[3][1])
        if vec is None or not str(dict(env.df.dtypes)[vec]).startswith("array<"):
            raise EngineError("22000", "there is no vector column")
        if text is not None and body not in columns:
            if s.plan is None:
                raise EngineError("42703", f"no column {body}")
            body, text = None, None  # dense only
        mode, source = self.engine.resolve_mode(s.mode, planned)
        late = s.hint is not None and s.hint.index("distance") < s.hint.index("scalar")
        self.used |= {"mode": mode, "mode_source": source, "order": "RLS,DISTANCE,SCALAR" if late else "RLS,SCALAR,DISTANCE"}
        if not late:
            self.where(s.where, env)
        hits = self.engine.hits(env.df, vec, query, k, body if text is not None else None, text, weights, s.relations[0].name, () if boosts or "score" in columns else (*(c for c in columns if c != "id"),), filtered=s.where is not None and not late)
        self.used["ann_plan"] = self.engine.ann_plan
        gate = {"least": 0.98, "margin": 0.005} if text is not None else {"least": 0.80, "margin": 0.05}
        key = KEY if KEY in env.df.columns else "id"
        if boosts:
            hits = hits.join(env.df.select(F.col(key).alias("id"), *{b[0] for b in boosts}), "id")
            hits = V.boost(hits, boosts).select("id", "score")
        if mode == "precision":
            confidence = V.rrf_confidence(F.col("score"), weights=weights) if text is not None else F.col("score")
            hits = V.gate(hits.withColumn("_raw", F.col("score")).withColumn("score", confidence), **gate).drop("score").withColumnRenamed("_raw", "score")
        if set(columns) <= set(hits.columns):  # exact k-NN: the winners came with their columns
            joined = hits.withColumnRenamed("score", "_score")
            if key == KEY:
                joined = joined.withColumn("id", F.col("id.id"))
        else:  # late: the payload of the winners only
            joined = env.df.join(hits.select(F.col("id").alias("_hit"), F.col("score").alias("_score")), F.col(key) == F.col("_hit"))
        after = Env(joined.select(*columns, "_score"), env.scope)
        if late:
            self.where(s.where, after)
        items = self.items(s, after)
        names = _names(items)
        made = [self.expr(e, after).alias(n) for (e, _), n in zip(items, names, strict=True)]
        out = after.df.orderBy(F.desc("_score"), F.asc("id"))
        return out.select(*made) if "score" in names else out.select(*made, F.col("_score").alias("score"))


def _conjuncts(node: tuple | None) -> list[tuple]:
    if node is None:
        return []
    return [*_conjuncts(node[1]), *_conjuncts(node[2])] if node[0] == "and" else [node]


def _names(items) -> list[str]:
    out = []
    for e, alias in items:
        name = alias or (e[2] if e[0] == "col" else e[1] if e[0] == "call" else "case" if e[0] == "case" else "?column?")
        while name in out:
            name += "_"
        out.append(name)
    return out


def _family(kind: T.DataType) -> str | None:
    if isinstance(kind, T.NullType):
        return None
    return "number" if isinstance(kind, T.NumericType) else "array" if isinstance(kind, T.ArrayType) else kind.typeName()


#: Arguments that the builders take as plain values.
_PLAIN = {("replace", 1), ("replace", 2), ("position", 0), ("date_part", 0), ("extract", 0), ("date_trunc", 0), ("round", 1), ("substr", 1), ("substr", 2)}


def _round(x, n=0):
    if not isinstance(n, int):
        raise EngineError("22000", "round takes a whole number of digits")
    return S.round_half_away(x, n)


_FUNCTIONS = {
    "lower": (1, 1, F.lower), "upper": (1, 1, F.upper), "length": (1, 1, S.length), "substr": (2, 3, S.substr), "concat": (1, 64, S.concat), "trim": (1, 1, S.trim),
    "replace": (3, 3, S.replace), "position": (2, 2, S.position), "abs": (1, 1, F.abs), "round": (1, 2, _round), "floor": (1, 1, S.floor), "ceil": (1, 1, S.ceil),
    "ceiling": (1, 1, S.ceil), "mod": (2, 2, S.mod), "power": (2, 2, S.power), "sqrt": (1, 1, S.sqrt), "date_part": (2, 2, S.date_part), "extract": (2, 2, S.date_part),
    "date_trunc": (2, 2, S.date_trunc), "vec_norm": (1, 1, S.vec_norm), "vec_sum": (1, 1, S.vec_sum), "vec_div": (2, 2, S.vec_div), "coalesce": (1, 64, F.coalesce),
    "nullif": (2, 2, F.nullif), "visible": (0, 0, lambda: F.lit(True)),
}


def predicate(text: str, df: DataFrame, engine) -> Column:
    """A condition of the dialect over the columns of ``df``."""
    p = Parser(text)
    node = p.expr()
    p.done()
    return Compiler(engine).expr(node, Env(df, [("", {c: c for c in df.columns})]))


def run(engine, sql: str, params: tuple = (), data: str | None = None):
    """One statement or several; the result of the last: a DataFrame, rows of FETCH, a count of changed rows, or None.

    Several statements are one transaction, unless they or the session handle transactions themselves.
    """
    from corviq.sql import statements as st

    texts = split(sql)
    if not texts:
        raise EngineError("42601", "no statement")
    nodes = [Parser(text, params).statement() for text in texts]
    kinds = {n.kind for n in nodes if isinstance(n, Statement)}
    whole = len(nodes) > 1 and engine.store is not None and engine.store.staged is None and kinds & st.CHANGES and not kinds & {"begin", "commit", "rollback"}
    if whole:
        engine.store.begin()
    try:
        out = None
        for text, node in zip(texts, nodes, strict=True):
            out = Compiler(engine).query(node) if isinstance(node, Query) else st.execute(engine, node, data)
            if isinstance(node, Statement) and node.kind in st.OBJECTS:
                st.remember(engine, node, text, params)
    except BaseException:
        if whole:
            engine.store.rollback()
        raise
    if whole:
        engine.store.commit()
    return out


def explain(engine, q: Query) -> DataFrame:
    from corviq.sql import statements as st

    c = Compiler(engine)
    if isinstance(q, Statement):  # the rows that an update or delete would touch
        condition, env = st._condition(engine, q.parts["table"], q.parts["where"])
        df = env.df.where(condition & engine.policy.owned() & engine.policy.visible())
    else:
        df = c.query(q)
    plan = df._jdf.queryExecution().executedPlan().toString()
    access = "pushed filters" if "PushedFilters: [" in plan and "PushedFilters: []" not in plan else "full scan"
    path = "probed lists" if c.used.get("ann_plan") == "probe" else "scan"
    lines = [f"{k}: {v}" for k, v in ({"engine": "spark"} | {"ann_plan": "none"} | c.used | {"scalar_plan": access, "access_path": path}).items()]
    return engine.spark.createDataFrame([(x,) for x in [*lines, *plan.split("\n")]], "`QUERY PLAN` string")


__all__ = ["Compiler", "Env", "SetOp", "Statement", "explain", "predicate", "run"]
