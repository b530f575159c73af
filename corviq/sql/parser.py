"""Recursive descent from tokens to a small tree. What isn't accepted here is refused with 42601.

Expressions are tuples that begin with their kind; queries and statements are dataclasses.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from corviq.errors import EngineError
from corviq.sql.lexer import Token, tokenize

MAX_DEPTH, MAX_RELATIONS, MAX_BRANCHES, MAX_CTES, MAX_PARAMS, MAX_CASE = 32, 8, 16, 16, 64, 64
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max"))
RANKS = frozenset(("row_number", "rank", "dense_rank"))
STOP = frozenset(
    "from where group having order limit offset using hint union intersect except on join inner left right full cross and or not as returning set when then else end is in like between asc desc nulls".split()
)


@dataclass
class Relation:
    name: str
    alias: str
    how: str = "from"
    on: list[tuple[tuple, tuple]] = field(default_factory=list)


@dataclass
class Select:
    items: list[tuple[tuple, str | None]]
    relations: list[Relation]
    distinct: bool = False
    where: tuple | None = None
    group: list[tuple] = field(default_factory=list)
    having: tuple | None = None
    order: list[tuple[tuple, str]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    plan: str | None = None
    mode: str | None = None
    hint: tuple[str, ...] | None = None


@dataclass
class SetOp:
    kind: str
    left: object
    right: object
    limit: int | None = None
    offset: int = 0


@dataclass
class Query:
    body: object
    ctes: list[tuple[str, Query]] = field(default_factory=list)


@dataclass
class Statement:
    kind: str
    parts: dict


class Parser:
    def __init__(self, sql: str, params: tuple = ()):
        self.sql, self.tokens, self.k, self.depth = sql, tokenize(sql), 0, 0
        if len(params) > MAX_PARAMS:
            raise EngineError("54000", f"more than {MAX_PARAMS} parameters")
        self.params = params

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def fail(self, what: str = "") -> EngineError:
        return EngineError("42601", f"syntax error at {self.now.at}: {what or self.now.text!r}")

    def peek(self, *words: str) -> bool:
        return all(t.kind in ("name", "sign") and t.text == w for t, w in zip(self.tokens[self.k : self.k + len(words)], words, strict=False)) and len(self.tokens) > self.k + len(words)

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.k += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(f"{' '.join(words)} expected")

    def next(self, kind: str) -> str:
        t = self.now
        if t.kind != kind:
            raise self.fail(f"{kind} expected")
        self.k += 1
        return t.text

    def name(self) -> str:
        if self.now.kind not in ("name", "quoted") or self.now.kind == "name" and self.now.text in STOP:
            raise self.fail("name expected")
        self.k += 1
        return self.tokens[self.k - 1].text

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def text(self) -> str:
        value = self.literal()
        if not isinstance(value, str):
            raise self.fail("text expected")
        return value

    def whole(self, low: int, high: int) -> int:
        value = self.literal()
        if not isinstance(value, int) or isinstance(value, bool):
            raise self.fail("whole number expected")
        if not low <= value <= high:
            raise EngineError("22000", f"{value} isn't within {low} and {high}")
        return value

    def literal(self):
        t = self.now
        if t.kind == "param":
            self.k += 1
            if int(t.text) > len(self.params):
                raise EngineError("42P02", f"no parameter ${t.text}")
            return self.params[int(t.text) - 1]
        if t.kind == "string":
            self.k += 1
            return t.text
        if t.kind == "number":
            self.k += 1
            return int(t.text) if t.text.isdigit() else float(t.text)
        if self.take("-"):
            value = self.literal()
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return -value
            raise self.fail("number expected")
        for word, value in (("null", None), ("true", True), ("false", False)):
            if self.take(word):
                return value
        for word, read in (("date", datetime.date.fromisoformat), ("timestamp", datetime.datetime.fromisoformat)):
            if self.peek(word) and self.tokens[self.k + 1].kind in ("string", "param"):
                self.k += 1
                try:
                    return read(self.text())
                except ValueError as e:
                    raise EngineError("22007", str(e)) from None
        raise self.fail("literal expected")

    def done(self) -> None:
        self.take(";")
        if self.now.kind != "end":
            raise self.fail()

    # -- expressions

    def expr(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise EngineError("54000", "nested too deeply")
        out = self._or()
        self.depth -= 1
        return out

    def _or(self) -> tuple:
        out = self._and()
        while self.take("or"):
            out = ("or", out, self._and())
        return out

    def _and(self) -> tuple:
        out = self._not()
        while self.take("and"):
            out = ("and", out, self._not())
        return out

    def _not(self) -> tuple:
        if self.take("not"):
            return ("not", self._not())
        return self._comparison()

    def _comparison(self) -> tuple:
        left = self._sum()
        for sign in ("<=>", "<=", ">=", "<>", "!=", "=", "<", ">"):
            if self.take(sign):
                return ("op", "<>" if sign == "!=" else sign, left, self._sum())
        if self.take("is"):
            negate = self.take("not")
            self.need("null")
            return ("is_null", left, negate)
        negate = self.take("not")
        if self.take("in"):
            self.need("(")
            if self.peek("select") or self.peek("with"):
                query = self.query()
                self.need(")")
                return ("in_query", left, query, negate)
            values = [self._sum()]
            while self.take(","):
                values.append(self._sum())
            self.need(")")
            if len(values) > 256:
                raise EngineError("54000", "more than 256 values")
            return ("in", left, tuple(values), negate)
        if self.take("between"):
            low = self._sum()
            self.need("and")
            return ("between", left, low, self._sum(), negate)
        if self.take("like"):
            return ("like", left, self.text(), negate)
        if negate:
            raise self.fail()
        return left

    def _sum(self) -> tuple:
        out = self._product()
        while self.peek("+") or self.peek("-"):
            sign = self.now.text
            self.k += 1
            out = ("op", sign, out, self._product())
        return out

    def _product(self) -> tuple:
        out = self._unary()
        while self.peek("*") or self.peek("/"):
            sign = self.now.text
            self.k += 1
            out = ("op", sign, out, self._unary())
        return out

    def _unary(self) -> tuple:
        if self.take("-"):
            inner = self._unary()
            return ("lit", -inner[1]) if inner[0] == "lit" and isinstance(inner[1], (int, float)) and not isinstance(inner[1], bool) else ("op", "-", ("lit", 0), inner)
        return self._primary()

    def _primary(self) -> tuple:
        t = self.now
        if self.take("("):
            if self.peek("select") or self.peek("with"):
                query = self.query()
                self.need(")")
                return ("scalar", query)
            out = self.expr()
            self.need(")")
            return out
        if t.kind in ("string", "number", "param") or t.kind == "name" and t.text in ("null", "true", "false") or t.kind == "name" and t.text in ("date", "timestamp") and self.tokens[self.k + 1].kind == "string":
            return ("lit", self.literal())
        if self.take("exists"):
            self.need("(")
            query = self.query()
            self.need(")")
            return ("exists", query)
        if self.take("case"):
            branches = []
            while self.take("when"):
                condition = self.expr()
                self.need("then")
                branches.append((condition, self.expr()))
            if not 1 <= len(branches) <= MAX_CASE:
                raise self.fail("WHEN expected, at most 64")
            other = self.expr() if self.take("else") else ("lit", None)
            self.need("end")
            return ("case", tuple(branches), other)
        if self.peek("extract", "("):
            self.k += 2
            part = self.text() if self.now.kind == "string" else self.name()
            self.need("from")
            src = self.expr()
            self.need(")")
            return ("call", "extract", (("lit", part), src), False, None)
        if self.peek("position", "("):
            self.k += 2
            needle = self._sum()
            self.need("in")
            out = ("call", "position", (needle, self._sum()), False, None)
            self.need(")")
            return out
        if self.peek("array", "["):
            self.k += 2
            values = [self.expr()]
            while self.take(","):
                values.append(self.expr())
            self.need("]")
            return ("array", tuple(values))
        name = self.name()
        if self.take("("):
            return self._call(name)
        if self.take("."):
            return ("col", name, self.name())
        return ("col", None, name)

    def _call(self, name: str) -> tuple:
        distinct = self.take("distinct")
        args: list[tuple] = []
        if self.take("*"):
            args.append(("star", None))
        elif not self.peek(")"):
            args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
        self.need(")")
        over = None
        if self.take("over"):
            self.need("(")
            partition: list[tuple] = []
            order: list[tuple[tuple, str]] = []
            if self.take("partition", "by"):
                partition.append(self.expr())
                while self.take(","):
                    partition.append(self.expr())
            if self.take("order", "by"):
                order = self.order()
            self.need(")")  # frames are refused
            if name not in AGGREGATES | RANKS or distinct:
                raise self.fail(f"no window function {name}")
            over = (tuple(partition), tuple(order))
        elif name in RANKS:
            raise self.fail("OVER expected")
        return ("call", name, tuple(args), distinct, over)

    def order(self) -> list[tuple[tuple, str]]:
        out = []
        while True:
            key = self.expr()
            down = self.take("desc")
            if not down:
                self.take("asc")
            out.append((key, "desc" if down else "asc"))
            if not self.take(","):
                return out

    # -- queries

    def query(self) -> Query:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise EngineError("54000", "nested too deeply")
        ctes = []
        if self.take("with"):
            while True:
                name = self.name()
                self.need("as")
                self.need("(")
                ctes.append((name, self.query()))
                self.need(")")
                if not self.take(","):
                    break
            if len(ctes) > MAX_CTES:
                raise EngineError("54000", f"more than {MAX_CTES} definitions")
        self.branches = 1
        body = self._set()
        self.depth -= 1
        return Query(body, ctes)

    def _set(self):
        left = self._intersect()
        while self.peek("union") or self.peek("except"):
            kind = self.now.text
            self.k += 1
            if self.take("all"):
                if kind != "union":
                    raise self.fail("EXCEPT ALL isn't supported")
                kind = "union_all"
            left = self._branch(kind, left, self._intersect())
        return left

    def _intersect(self):
        left = self._term()
        while self.take("intersect"):
            if self.peek("all"):
                raise self.fail("INTERSECT ALL isn't supported")
            left = self._branch("intersect", left, self._term())
        return left

    def _branch(self, kind: str, left, right) -> SetOp:
        self.branches += 1
        if self.branches > MAX_BRANCHES:
            raise EngineError("54000", f"more than {MAX_BRANCHES} branches")
        for side in (left, right):
            if isinstance(side, Select) and side.order and not getattr(side, "closed", False):
                raise self.fail("ORDER BY belongs into a parenthesised branch")
        out = SetOp(kind, left, right)
        if isinstance(right, Select) and right.limit is not None and not getattr(right, "closed", False):
            out.limit, out.offset, right.limit, right.offset = right.limit, right.offset, None, 0  # the whole set's
        return out

    def _term(self):
        if self.take("("):
            out = self._set()
            self.need(")")
            if isinstance(out, Select):
                out.closed = True
            if self.take("limit"):
                out = SetOp("limit", out, None, self.whole(1, 10_000), self.whole(0, 10_000) if self.take("offset") else 0)
            return out
        return self.select()

    def select(self) -> Select:
        self.need("select")
        distinct = self.take("distinct")
        items: list[tuple[tuple, str | None]] = []
        while True:
            if self.take("*"):
                items.append((("star", None), None))
            elif self.now.kind in ("name", "quoted") and self.tokens[self.k + 1].text == "." and self.tokens[self.k + 2].text == "*" and self.tokens[self.k + 1].kind == "sign":
                items.append((("star", self.name()), None))
                self.k += 2
            else:
                e = self.expr()
                alias = self.name() if self.take("as") else None
                items.append((e, alias))
            if not self.take(","):
                break
        self.need("from")
        relations = [self._relation("from")]
        while True:
            how = None
            for words, kind in ((("inner", "join"), "inner"), (("join",), "inner"), *[((w, *o, "join"), w) for w in ("left", "right", "full") for o in ((), ("outer",))]):
                if self.take(*words):
                    how = kind
                    break
            if how is None:
                break
            r = self._relation(how)
            self.need("on")
            while True:
                a = self._primary()
                self.need("=")
                r.on.append((a, self._primary()))
                if not self.take("and"):
                    break
            relations.append(r)
        if len(relations) > MAX_RELATIONS:
            raise EngineError("54000", f"more than {MAX_RELATIONS} relations")
        out = Select(items, relations, distinct)
        if self.take("where"):
            out.where = self.expr()
        if self.take("group", "by"):
            out.group.append(self.expr())
            while self.take(","):
                out.group.append(self.expr())
            if len(out.group) > 8:
                raise EngineError("54000", "more than 8 group keys")
        if self.take("having"):
            out.having = self.expr()
        if self.take("order", "by"):
            out.order = self.order()
        if self.take("using", "plan"):
            self.need("(")
            out.plan = self.text()
            self.need(")")
        if self.take("limit"):
            out.limit = self.whole(1, 10_000)
        if self.take("offset"):
            out.offset = self.whole(0, 10_000)
        while True:
            if self.peek("using", "mode"):
                self.k += 2
                out.mode = self.text()
                if out.mode not in ("recall", "precision"):
                    raise EngineError("22000", f"no mode {out.mode}")
            elif self.take("hint", "order"):
                names = tuple(self.names())
                if sorted(names) != ["distance", "rls", "scalar"]:
                    raise self.fail("a permutation of RLS, SCALAR, DISTANCE expected")
                out.hint = names
            else:
                return out

    def _relation(self, how: str) -> Relation:
        name = self.name()
        alias = self.name() if self.take("as") or self.now.kind in ("name", "quoted") and self.now.text not in STOP else name
        return Relation(name, alias, how)

    # -- statements

    def statement(self) -> Statement | Query:
        for words, read in _STATEMENTS:
            if self.peek(*words):
                self.k += len(words)
                out = read(self)
                self.done()
                return out
        if not (self.peek("select") or self.peek("with") or self.peek("(")):
            raise self.fail()
        out = self.query()
        self.done()
        return out

    def _operation(self) -> str | None:
        if self.take("using", "operation_id"):
            return self.text()
        return None

    def _returning(self):
        if not self.take("returning"):
            return None
        if self.take("*"):
            return "*"
        out = [(self.expr(), self.name() if self.take("as") else None)]
        while self.take(","):
            out.append((self.expr(), self.name() if self.take("as") else None))
        return out

    def _tail(self, **parts) -> dict:
        partitioned = chunk = None
        if self.take("partitioned"):
            partitioned, chunk = True, self.whole(1, 10_000) if self.take("chunk") else 1000
        returning = self._returning()
        operation = self._operation()
        if not partitioned and self.take("partitioned"):
            partitioned, chunk = True, self.whole(1, 10_000) if self.take("chunk") else 1000
        return parts | {"returning": returning, "operation": operation, "partitioned": partitioned, "chunk": chunk}

    def insert(self) -> Statement:
        table, columns = self.name(), self.names()
        self.need("values")
        rows = []
        while True:
            self.need("(")
            row = [self.literal_value()]
            while self.take(","):
                row.append(self.literal_value())
            self.need(")")
            if len(row) != len(columns):
                raise self.fail("as many values as columns expected")
            rows.append(row)
            if not self.take(","):
                break
        conflict, target, sets = "error", None, None
        if self.take("on", "conflict"):
            target = self.names()
            self.need("do")
            if self.take("nothing"):
                conflict = "nothing"
            else:
                self.need("update")
                self.need("set")
                conflict, sets = "update", {}
                while True:
                    c = self.name()
                    self.need("=")
                    sets[c] = ("excluded", self.name()) if self.take("excluded", ".") else ("lit", self.literal_value())
                    if not self.take(","):
                        break
        return Statement("insert", self._tail(table=table, columns=columns, rows=rows, conflict=conflict, target=target, sets=sets))

    def literal_value(self):
        if self.take("array", "["):
            out = [self.literal()]
            while self.take(","):
                out.append(self.literal())
            self.need("]")
            return out
        return self.literal()

    def update(self) -> Statement:
        table = self.name()
        self.need("set")
        sets = {}
        while True:
            c = self.name()
            self.need("=")
            sets[c] = self.expr()
            if not self.take(","):
                break
        self.need("where")
        return Statement("update", self._tail(table=table, sets=sets, where=self.expr()))

    def delete(self) -> Statement:
        table = self.name()
        self.need("where")
        return Statement("delete", self._tail(table=table, where=self.expr()))

    def truncate(self) -> Statement:
        self.take("table")
        table = self.name()
        return Statement("truncate", {"table": table, "operation": self._operation()})

    def type(self) -> str:
        name = self.name()
        if name == "double":
            self.need("precision")
        if self.take("("):
            name += "(" + str(self.whole(1, 65_536))
            if self.take(","):
                name += "," + str(self.whole(0, 38))
            self.need(")")
            name += ")"
        if self.take("["):
            if self.now.kind == "number":
                self.k += 1
            self.need("]")
            name += "[]"
        return name

    def slice(self) -> str:
        """The text of a parenthesised expression that follows."""
        self.need("(")
        begin = self.now.at
        self.expr()
        end = self.now.at
        self.need(")")
        return self.sql[begin:end].strip()

    def _action(self) -> str:
        action = "restrict"
        while self.take("on"):
            what = self.name() if not self.take("update") else "update"
            got = "no action" if self.take("no", "action") else "restrict" if self.take("restrict") else "cascade" if self.take("cascade") else None
            if got is None:
                self.need("set")
                got = "set_null" if self.take("null") else "set_default" if self.take("default") else None
                if got is None:
                    raise self.fail()
            if what == "delete":
                action = "restrict" if got == "no action" else got
        return action

    def constraint(self) -> tuple | None:
        self.take("constraint") and self.name()
        if self.take("primary", "key"):
            return ("primary", self.names())
        if self.take("unique"):
            return ("unique", self.names())
        if self.take("check"):
            return ("check", self.slice())
        if self.take("foreign", "key"):
            (column,) = self.names()
            self.need("references")
            parent = self.name()
            (target,) = self.names() if self.peek("(") else ["id"]
            return ("foreign", (column, parent, target, self._action()))
        return None

    def column(self) -> tuple[tuple[str, str, object], list[tuple]]:
        name, kind, default, rules = self.name(), self.type(), None, []
        while True:
            if self.take("not", "null"):
                rules.append(("not_null", name))
            elif self.take("null"):
                pass
            elif self.take("default"):
                default = self.literal_value()
            elif self.take("primary", "key"):
                rules.append(("primary", [name]))
            elif self.take("unique"):
                rules.append(("unique", [name]))
            elif self.take("check"):
                rules.append(("check", self.slice()))
            elif self.take("references"):
                parent = self.name()
                (target,) = self.names() if self.peek("(") else ["id"]
                rules.append(("foreign", (name, parent, target, self._action())))
            else:
                return (name, kind, default), rules

    def create_table(self) -> Statement:
        table, columns, rules = self.name(), [], []
        self.need("(")
        while True:
            rule = self.constraint() if any(self.peek(w) for w in ("constraint", "primary", "unique", "check", "foreign")) else None
            if rule:
                rules.append(rule)
            else:
                c, own = self.column()
                columns.append(c)
                rules += own
            if not self.take(","):
                break
        self.need(")")
        return Statement("create_table", {"table": table, "columns": columns, "rules": rules})

    def alter_table(self) -> Statement:
        table = self.name()
        if self.take("add", "column"):
            c, rules = self.column()
            return Statement("alter_table", {"table": table, "add": c, "rules": rules})
        if self.take("add"):
            rule = self.constraint()
            if rule is None:
                raise self.fail("constraint expected")
            return Statement("alter_table", {"table": table, "rules": [rule]})
        if self.take("drop", "column"):
            return Statement("alter_table", {"table": table, "drop": self.name()})
        if self.take("drop", "constraint"):
            return Statement("alter_table", {"table": table, "drop_rule": self.name()})
        if self.take("alter", "column") or self.take("alter"):
            column = self.name()
            if self.take("type") or self.take("set", "data", "type"):
                return Statement("alter_table", {"table": table, "retype": (column, self.type())})
            if self.take("set", "not", "null"):
                return Statement("alter_table", {"table": table, "rules": [("not_null", column)]})
            if self.take("drop", "not", "null"):
                return Statement("alter_table", {"table": table, "nullable": column})
        raise self.fail()

    def create_view(self) -> Statement:
        name = self.name()
        self.need("as")
        return Statement("create_view", {"name": name, "query": self.query()})

    def create_function(self) -> Statement:
        name, args = self.name(), self.names()
        self.need("as")
        return Statement("create_function", {"name": name, "args": args, "body": self.expr()})

    def create_index(self) -> Statement:
        name = self.name()
        self.need("on")
        table = self.name()
        method = self.name() if self.take("using") else "scalar"
        return Statement("create_index", {"name": name, "table": table, "method": method, "columns": self.names()})

    def create_type(self) -> Statement:
        name = self.name()
        self.need("as")
        self.need("enum")
        self.need("(")
        labels = [self.text()]
        while self.take(","):
            labels.append(self.text())
        self.need(")")
        return Statement("create_type", {"name": name, "labels": labels})

    def set(self) -> Statement:
        self.need("search_mode")
        self.need("=")
        return Statement("set", {"mode": self.text()})

    def explain(self) -> Statement:
        if self.peek("update") or self.peek("delete"):
            return Statement("explain", {"query": self.statement()})
        return Statement("explain", {"query": self.query()})

    def declare(self) -> Statement:
        name = self.name()
        self.take("insensitive")
        self.need("cursor")
        self.need("for")
        return Statement("declare", {"name": name, "query": self.query()})

    def fetch(self) -> Statement:
        self.take("forward")
        n = self.whole(1, 10_000) if self.now.kind in ("number", "param") else 1
        self.take("from") or self.take("in")
        return Statement("fetch", {"name": self.name(), "n": n})

    def copy(self) -> Statement:
        if self.take("("):
            query = self.query()
            self.need(")")
            self.need("to")
            self.need("stdout")
            return Statement("copy_out", {"query": query, "format": self._format()})
        table, columns = self.name(), self.names()
        self.need("from")
        self.need("stdin")
        return Statement("copy_in", {"table": table, "columns": columns, "format": self._format(), "operation": self._operation()})

    def _format(self) -> str:
        if not self.take("(", "format"):
            return "text"
        form = self.name()
        self.need(")")
        if form not in ("text", "csv"):
            raise self.fail(f"no format {form}")
        return form


def _named(kind: str):
    return lambda p: Statement(kind, {"name": p.name()})


_STATEMENTS = (
    (("insert", "into"), Parser.insert), (("update",), Parser.update), (("delete", "from"), Parser.delete), (("truncate",), Parser.truncate),
    (("create", "table"), Parser.create_table), (("alter", "table"), Parser.alter_table), (("drop", "table"), _named("drop_table")),
    (("create", "view"), Parser.create_view), (("drop", "view"), _named("drop_view")), (("create", "function"), Parser.create_function), (("drop", "function"), _named("drop_function")),
    (("create", "index"), Parser.create_index), (("drop", "index"), _named("drop_index")), (("create", "type"), Parser.create_type), (("drop", "type"), _named("drop_type")),
    (("set",), Parser.set), (("explain",), Parser.explain), (("declare",), Parser.declare), (("fetch",), Parser.fetch), (("close",), _named("close")), (("copy",), Parser.copy),
    (("begin",), lambda p: Statement("begin", {})), (("commit",), lambda p: Statement("commit", {})), (("rollback",), lambda p: Statement("rollback", {})),
)

