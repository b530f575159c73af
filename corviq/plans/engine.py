"""The session: one door for reads, views, modes, functions, and the dict form of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corviq.errors import EngineError
from corviq.operators import ann
from corviq.operators import relational as R
from corviq.operators import retrieval as V
from corviq.operators import sparse
from corviq.plans import planner
from corviq.policy import TENANT, VISIBILITY, Policy
from corviq.sources import shared

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey * 8 + l_linenumber", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
    "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id * 1000 + turn",
}

#: Fields that a changing operation needs, and those that it may have.
WRITES = {
    "insert": ({"table", "rows", "operation_id"}, {"on_conflict", "target", "returning"}),
    "update": ({"table", "set", "filter", "operation_id"}, {"returning", "partitioned", "chunk"}),
    "delete": ({"table", "filter", "operation_id"}, {"returning", "partitioned", "chunk"}),
    "create_table": ({"table", "columns"}, {"constraints"}),
    "alter_table": ({"table"}, {"add_column", "drop_column"}),
    "drop_table": ({"table"}, set()),
    "show_partitioned_dml": (set(), set()),
    "cancel_partitioned_dml": ({"operation_id"}, set()),
}

KEY = "_key"

_AGG = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}


_SCHEMAS: dict[str, StructType] = {}  # by what marks a table's files, so that they are opened once for their schema


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table without tenant columns: every tenth key is another tenant's private row."""
    path, key = f"{sf_dir}/{name}.parquet", F.expr(KEYS[name]).cast("long")
    mark = shared.mark(spark, path) or path
    if mark not in _SCHEMAS:
        _SCHEMAS[mark] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[mark]).parquet(path)
    other = key % 10 == 9
    return df.select(F.when(other, "tenant-b").otherwise("tenant-a").alias(TENANT), F.when(other, "private").otherwise("public").alias(VISIBILITY), key.alias("id"), "*")


def python_function(f: Callable) -> Callable[..., Column]:
    """A function of a vector (a numpy array) and a number to a number, as a Pandas UDF; a null in gives a null.

    It runs in Python workers, behind the visibility filter like every function. There is no sandbox: who may register
    functions may run code.
    """

    @F.pandas_udf("double")
    def udf(v: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or y != y else f(np.asarray(x, float), float(y)) for x, y in zip(v, s, strict=True)], dtype="float64")

    return udf


class Engine:
    """A session of a tenant over a resolver of raw tables. Everything it reads passes :meth:`table`."""

    def __init__(self, resolve: Callable[[str], DataFrame], policy: Policy, store=None, client: planner.Client | None = None, files: Callable[[str], str | None] | None = None):
        self.resolve, self.policy, self.store, self.client = resolve, policy, store, client
        self.files = files  # what tells a table's present files from all others
        self.visibility = "public"  # of the rows that this session writes
        self.enums: dict[str, list[str]] = {}
        self.indexes: dict[str, tuple] = {}
        self._ann: dict[tuple[str, str], tuple] = {}
        self.ann_plan = "exact"
        self.running: dict[str, str] = {}  # partitioned statements by operation id
        self.views: dict[str, Callable[[Engine], DataFrame]] = {}
        self.functions: dict[str, Callable[..., Column]] = {}
        self.mode: str | None = None
        self.restoring = False  # while the store's views, functions, indexes and types are made again
        self.strategy = "filter"  # or "prefilter": two ways to the same visible rows
        self._seen: dict[tuple[str, int], str] = {}
        self.cursors: dict[str, Iterator] = {}

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, tenant: str = "tenant-a") -> Engine:
        return cls(lambda n: derived(spark, sf_dir, n), Policy(tenant), files=lambda n: shared.mark(spark, f"{sf_dir}/{n}.parquet"))

    @classmethod
    def on(cls, store, policy: Policy, client: planner.Client | None = None) -> Engine:
        """A session that reads and writes the tables of a store."""
        e = cls(store.raw, policy, store, client)
        e.restoring = True
        for text in store.catalog.get("objects", {}).values():
            try:
                e.sql(text)
            except EngineError:
                continue  # what it is about was dropped: reading it says so
        e.restoring = False
        return e

    @property
    def spark(self) -> SparkSession:
        return SparkSession.getActiveSession()

    def sql(self, text: str, *params, data: str | None = None):
        """Runs statements of the dialect; a query gives a DataFrame, a change the rows of RETURNING or their number."""
        from corviq.sql.compiler import run

        return run(self, text, params, data)

    # -- searches

    def expand(self, question: str) -> planner.Expansion:
        if self.client is None:
            raise EngineError("0A000", "this session has no planner")
        return planner.parse_expansion(self.client(planner.prompt(question)))

    def embed(self, text: str, df: DataFrame, vector: str | None) -> list[float]:
        """The hashing embedding of a text, with the dimension of the table's vectors."""
        from corviq.sources.ingest import embed_text

        if vector is None:
            raise EngineError("22000", "there is no vector column")
        dim = (df.schema[vector].metadata or {}).get("dim")
        if dim is None:
            first = df.select(F.size(vector).alias("n")).where("n > 0").first()
            dim = first["n"] if first else 1
        return embed_text(text, dim)

    def hits(self, df: DataFrame, vector: str, query, k: int, body: str | None = None, text: str | None = None, weights: tuple[float, float] = (1.0, 1.0), table: str | None = None, keep: tuple[str, ...] = (), filtered: bool = True) -> DataFrame:
        """(id, score; the key for id, where ``df`` has one; exact k-NN also carries ``keep``): k-NN, or its fusion with BM25 where there is a text; exact unless ``table`` has an hnsw index.

        ``filtered``: ``df`` may be less than what the session sees of the table. Hits are checked against the policy
        once more after ranking.
        """
        wide = k if text is None else max(k, 200)
        near = self._approximate(table, df, vector, query, wide, filtered) if table else None
        self.ann_plan = "exact" if near is None else "probe"
        whole = df.withColumn("id", F.col(KEY)) if KEY in df.columns else df
        if near is not None and KEY in df.columns:
            near = near.join(df.select("id", KEY), "id").select(F.col(KEY).alias("id"), "score")
        if text is None:
            found = V.knn(whole, query, k, vector, keep=("id", *keep)) if near is None else near
        else:
            found = V.rrf(V.scored(whole, query, vector) if near is None else near, self.bm25(table, body, text, df if filtered else None, whole), k, weights=weights)
        return self.policy.recheck(found, "id")

    def bm25(self, table: str | None, body: str, text: str, ids: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """(id, score) of BM25 over a table's persistent postings, made when they are first needed; a view's texts are
        tokenized. ``ids``: the only rows that count, with their columns; ``rows``: what is searched, keyed or not."""
        index = self.text_index(table, body) if table else None
        if index is None:
            return V.bm25(rows if rows is not None else ids if ids is not None else self.table(table), text, body)
        keyed = rows is not None and dict(rows.dtypes)["id"].startswith("struct")
        return index.bm25(self.policy, text, ids, KEY if keyed else None)

    def text_index(self, table: str, body: str) -> sparse.TextIndex | None:
        """The postings of a table's text column: those of its parts, or of its files; None for views."""
        if table in self.views or self.strategy != "filter":
            return None
        if self.store is not None:
            parts = self.store._entry(table)["parts"]
            paths = [f"{self.store.root}/_text/{table}/{self.store.label(table, p)}/{body}-{sparse.FORMAT}" for p in parts]
            for part, path in zip(parts, paths, strict=True):
                if not shared.exists(self.spark, f"{path}/terms/_SUCCESS"):
                    shared.replace(self.spark, path, lambda at, p=part: sparse.build(self.store._read(table, [p]), body, at))
        elif self.files is not None and (mark := self.files(table)) is not None:
            path = f"{shared.folder(self.spark)}/corviq-text/{mark}-{body}-{sparse.FORMAT}"
            if not shared.exists(self.spark, f"{path}/terms/_SUCCESS"):
                shared.replace(self.spark, path, lambda at: sparse.build(self.resolve(table), body, at))
            paths = [path]
        else:
            return None
        return sparse.TextIndex(self.spark, tuple(paths)) if paths else None

    def _approximate(self, table: str, df: DataFrame, vector: str, query, k: int, filtered: bool = True) -> DataFrame | None:
        """(id, score) by probing a declared index, or None where there is none or a full scan is cheaper.

        The index covers all rows of a table with their tenant and visibility, is fitted once per table generation, and
        kept beside the store's tables, partitioned by list. Without a filter the policy prunes it, and how much of it a
        session sees is counted once. A ``df`` that is filtered counts by its ids; if they are too few of the indexed
        rows, probing would find too little.
        """
        if self.store is None or (table, "hnsw", (vector,)) not in self.indexes.values():
            return None
        generation = self.store._entry(table)["generation"]
        if (table, vector) not in self._ann or self._ann[table, vector][0] != generation:
            raw = self.store.raw(table)
            coarse = ann.fit(raw, vector=vector)
            path = f"{self.store.root}/_index/{table}-{vector}-{generation}-{uuid.uuid4().hex}"
            ann.assign(raw, coarse, vector, (TENANT, VISIBILITY)).write.partitionBy("list").parquet(path)
            stored = self.spark.read.schema(f"id long, embedding array<float>, {TENANT} string, {VISIBILITY} string, list int").parquet(path)
            mine = self.policy.read(stored)
            seen = mine.count()
            if mine.groupBy("id").count().where("count > 1").limit(1).count():
                mine, probes = None, 0  # ids of several tenants clash: exact search
            else:
                probes = ann.tune(mine, coarse, least=ann.RECALL) if seen else 1
            self._ann[table, vector] = (generation, coarse, mine, probes, stored.count(), seen)
        _, coarse, mine, probes, total, seen = self._ann[table, vector]
        if mine is None:
            return None
        ids = df.where(F.col(vector).isNotNull()).select("id") if filtered else None
        if not ann.worthwhile(seen if ids is None else ids.count(), total):
            return None
        return ann.search(mine if ids is None else mine.join(ids, "id", "left_semi"), coarse, {0: query}, k, probes).select("id", "score")

    # -- partitioned statements

    def partitioned(self, operation: str | None, action) -> int:
        if not operation:
            raise EngineError("23502", "an operation id is required")
        self.running[operation] = "running"
        try:
            done = action(lambda: self.running.get(operation) == "cancelled")
            self.running[operation] = "done"
            return done
        except EngineError:
            self.running[operation] = "stopped"
            raise

    def cancel(self, operation: str) -> None:
        if operation not in self.running:
            raise EngineError("42704", f"no operation {operation}")
        self.running[operation] = "cancelled"

    def table(self, name: str, keyed: bool = False) -> DataFrame:
        """A view (built with this session's rights) or a table behind the visibility filter.

        ``keyed`` adds ``_key`` to a table's rows: ids are unique within a tenant only, (id, tenant) always; the key also
        carries what the safety net after ranking looks at.
        """
        if name in self.views:
            return self.views[name](self)
        try:
            raw = self.resolve(name)
        except KeyError:
            raise EngineError("42P01", f"no table {name}") from None
        visible = self.policy.read(raw) if self.strategy == "filter" else self._prefiltered(name, raw)
        if keyed and "id" in visible.columns:
            visible = visible.withColumn(KEY, F.struct("id", TENANT, VISIBILITY))
        return visible.drop(TENANT, VISIBILITY)

    def _prefiltered(self, name: str, raw: DataFrame) -> DataFrame:
        """The other strategy: what this session sees is written once per table generation and read from then on."""
        if self.store is None:
            raise EngineError("0A000", "this session has no store to keep visible rows in")
        key = (name, self.store._entry(name)["generation"])
        if key not in self._seen:
            path = f"{self.store.root}/_visible/{name}-{key[1]}-{uuid.uuid4().hex}"
            self.policy.read(raw).write.parquet(path)
            self._seen[key] = path
        return self.spark.read.schema(raw.schema).parquet(self._seen[key])

    def create_view(self, name: str, build: Callable[[Engine], DataFrame]) -> None:
        if name in self.views:
            raise EngineError("42P07", f"{name} exists")
        self.views[name] = build

    def create_function(self, name: str, build: Callable[..., Column]) -> None:
        """A declarative function: a macro over columns, inlined where it is called."""
        self.functions[name] = build

    def resolve_mode(self, clause: str | None = None, planner: str | None = None) -> tuple[str, str]:
        """(mode, where it comes from): clause, session, planner, default."""
        for mode, source in ((clause, "clause"), (self.mode, "session"), (planner, "planner")):
            if mode is not None:
                if mode not in ("recall", "precision"):
                    raise EngineError("22023", f"no mode {mode}")
                return mode, source
        return "recall", "default"

    # -- cursors

    def declare(self, name: str, df: DataFrame) -> None:
        if len(self.cursors) >= 16:
            raise EngineError("54000", "more than 16 cursors")
        self.cursors[name] = df.toLocalIterator()

    def fetch(self, name: str, n: int) -> list:
        if name not in self.cursors:
            raise EngineError("34000", f"no cursor {name}")
        return [row for _, row in zip(range(n), self.cursors[name], strict=False)]

    def close(self, name: str) -> None:
        if self.cursors.pop(name, None) is None:
            raise EngineError("34000", f"no cursor {name}")

    # -- dict queries

    def query(self, op: Mapping) -> DataFrame:
        """``{"op": "scan" | "search" | "aggregate", "table": ..., "filter": {...}, ...}``; unknown fields are refused."""
        kind = op.get("op")
        if kind in WRITES:
            return self._write(kind, op)
        known = {
            "scan": {"op", "table", "filter", "columns", "order_by", "limit", "offset", "distinct"},
            "search": {"op", "table", "filter", "vector", "text", "plan", "k", "mode", "columns", "post_filter", "boosts", "weights"},
            "aggregate": {"op", "table", "filter", "group_by", "items", "having", "order_by", "limit", "offset"},
        }
        if kind not in known:
            raise EngineError("42601", f"no operation {kind}")
        if extra := set(op) - known[kind]:
            raise EngineError("42601", f"unknown fields {sorted(extra)}")
        df = self.table(op["table"], keyed=kind == "search")
        if op.get("filter"):
            df = df.where(R.predicate(op["filter"], df.columns, R.kinds(df)))
        return getattr(self, f"_{kind}")(df, op)

    def _scan(self, df: DataFrame, op: Mapping) -> DataFrame:
        order = [(o["column"], o.get("dir", "asc")) for o in op.get("order_by", ())]
        columns = list(op.get("columns") or df.columns)
        if missing := [c for c in columns if c not in df.columns]:
            raise EngineError("42703", f"no column {missing[0]}")
        if op.get("distinct"):
            return R.page(df.select(*columns).distinct(), op["limit"], op.get("offset", 0), order or [(c, "asc") for c in columns[: R.MAX_KEYS]], tie=columns)
        return R.page(df, op["limit"], op.get("offset", 0), order).select(*columns)

    def _aggregate(self, df: DataFrame, op: Mapping) -> DataFrame:
        items = {}
        for name, spec in op["items"].items():
            ((fn, column),) = spec.items()
            if fn not in _AGG:
                raise EngineError("42883", f"no aggregate {fn}")
            items[name] = F.count("*") if column == "*" else _AGG[fn](F.col(column))
        keys = list(op.get("group_by", ()))
        out = R.grouped(df, keys, items)
        if op.get("having"):
            out = out.where(R.predicate(op["having"], out.columns))
        if not keys:
            return out
        order = [(o["column"], o.get("dir", "asc")) for o in op.get("order_by", ())]
        if not order and "limit" not in op and not op.get("offset"):
            return out
        return R.page(out, op.get("limit"), op.get("offset", 0), order or [(k, "asc") for k in keys], tie=keys)

    def _search(self, df: DataFrame, op: Mapping) -> DataFrame:
        k, (mode, _) = op.get("k", 10), self.resolve_mode(op.get("mode"))
        if "plan" in op:
            if "vector" in op or "text" in op:
                raise EngineError("42601", "plan excludes vector and text")
            expansion = self.expand(op["plan"])
            vector = next((c for c, t in df.dtypes if t == "array<float>"), None)
            op = {**op, "vector": self.embed(expansion.dense_text(), df, vector), "text": expansion.sparse_text(op["plan"]), "boosts": expansion.boosts(df.columns)}
            mode, _ = self.resolve_mode(op.get("mode"), expansion.mode_hint)
        body = next((c for c in ("body", "text") if c in df.columns), None)
        if "text" in op and "vector" in op and body:
            hits = self.hits(df, "embedding", op["vector"], k, body, op["text"], tuple(op.get("weights", (1.0, 1.0))), op["table"], filtered=bool(op.get("filter")))
            gate = {"least": 0.98, "margin": 0.005}
            confidence = V.rrf_confidence(F.col("score"))
        elif "vector" in op:
            hits, gate, confidence = self.hits(df, "embedding", op["vector"], k, table=op["table"], filtered=bool(op.get("filter"))), {"least": 0.80, "margin": 0.05}, F.col("score")
        else:
            whole = df.withColumn("id", F.col(KEY)) if KEY in df.columns else df
            scores = self.bm25(op["table"], body or "text", op["text"], df if op.get("filter") else None, whole)
            hits = self.policy.recheck(scores.orderBy(F.desc("score"), "id").limit(k), "id")
            gate, confidence = {"least": 0.0, "margin": 0.0}, F.col("score")
        columns = [c for c in op.get("columns", ()) if c != "id"]
        if columns or op.get("post_filter") or op.get("boosts"):
            key = KEY if KEY in df.columns else "id"
            hits = hits.select(F.col("id").alias("_hit"), "score").join(df, F.col("_hit") == F.col(key)).drop("_hit", KEY)  # late: the payload of the winners only
        elif KEY in df.columns:
            hits = hits.select(F.col("id.id").alias("id"), "score")
        if op.get("post_filter"):
            hits = hits.where(R.predicate(op["post_filter"], df.columns, R.kinds(df)))
        if op.get("boosts"):
            hits = V.boost(hits, [tuple(b) for b in op["boosts"]])
        if mode == "precision":
            hits = V.gate(hits.withColumn("_raw", F.col("score")).withColumn("score", confidence), **gate).withColumn("score", F.col("_raw")).drop("_raw")
        return hits.select("id", *columns, "score").orderBy(F.desc("score"), "id")

    def _write(self, kind: str, op: Mapping):
        """insert, update, delete, create_table, alter_table, drop_table and the two that look after partitioned changes."""
        from corviq.sql import statements as st

        required, optional = WRITES[kind]
        if (missing := required - set(op)) or (extra := set(op) - required - optional - {"op"}):
            raise EngineError("42601", f"missing or unknown fields {sorted(missing or extra)}")
        if kind == "show_partitioned_dml":
            return self.spark.createDataFrame([(k, v) for k, v in self.running.items()], "operation_id string, state string")
        if kind == "cancel_partitioned_dml":
            return self.cancel(op["operation_id"])
        table, store = op["table"], st._store(self)
        if kind == "create_table":
            return st._create_table(self, table, [(c["name"], c["type"].lower(), c.get("default")) for c in op["columns"]], [tuple(r) for r in op.get("constraints", ())])
        if kind == "drop_table":
            return store.drop(table)
        if kind == "alter_table":
            add = op.get("add_column")
            return st._alter_table(self, table, (add["name"], add["type"].lower(), add.get("default")) if add else None, drop=op.get("drop_column"))
        raw = store.raw(table)
        returning = "*" if op.get("returning") else None
        if kind == "insert":
            columns = sorted({c for r in op["rows"] for c in r})
            rows = [[r.get(c) for c in columns] for r in op["rows"]]
            conflict = op.get("on_conflict", "error")
            return st._insert(self, table, columns, rows, conflict, op.get("target"), None, returning, op["operation_id"], None, None)
        where = R.predicate(op["filter"], raw.columns, R.kinds(raw))
        if kind == "delete":
            if op.get("partitioned"):
                return self.partitioned(op["operation_id"], lambda stop: store.partitioned_delete(table, self.policy, where, op["operation_id"], op.get("chunk", 1000), stop))
            return st._returned(self, store.delete(table, self.policy, where, op["operation_id"]), returning)
        fields = {f.name: f for f in raw.schema.fields}
        if unknown := set(op["set"]) - set(fields) | set(op["set"]) & {"id", TENANT, VISIBILITY}:
            raise EngineError("42703", f"no column {sorted(unknown)[0]} to set")
        values = {c: F.lit(st.value(v, fields[c])) for c, v in op["set"].items()}
        if op.get("partitioned"):
            return self.partitioned(op["operation_id"], lambda stop: store.partitioned_update(table, self.policy, where, values, op["operation_id"], op.get("chunk", 1000), stop))
        return st._returned(self, store.update(table, self.policy, where, values, op["operation_id"]), returning)

    def explain(self, op: Mapping) -> list[tuple[str, str]]:
        """(item, value) rows about how a dict query runs."""
        mode, source = self.resolve_mode(op.get("mode"))
        plan = self.query(op)._jdf.queryExecution().optimizedPlan().toString()
        return [("path_hint", "none"), ("kind_hint", "none"), ("mode", mode), ("mode_source", source), ("engine", "spark"), ("order", "RLS,SCALAR,DISTANCE"), ("ann_plan", self.ann_plan), ("plan", plan)]
