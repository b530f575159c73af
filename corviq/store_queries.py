"""Registered queries that write: each works on a store of its own in the shared folder and returns what is in it then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corviq.errors import EngineError
from corviq.operators import retrieval as V
from corviq.plans import planner
from corviq.plans.engine import KEYS, Engine
from corviq.policy import Policy
from corviq.queries import _POOLS, PROBE, QUERIES, SQL, TEXT, _dot, _sees
from corviq.sources import ingest, shared
from corviq.sources.store import Store

VEC = "[" + ",".join(map(repr, PROBE)) + "]"


def load(e: Engine, sf_dir: str, name: str, where: str | None = None, visibility: str = "public") -> None:
    """A Parquet table as a table of the store, by its key."""
    df = e.spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("id", F.expr(KEYS[name]).cast("long"))
    df = df if where is None else df.where(where)
    if name not in e.store.catalog["tables"]:
        fields = [T.StructField(f.name, f.dataType, True, {"dim": 64} if f.name == "embedding" else {}) for f in df.schema.fields if f.name != "id"]
        e.store.create(name, T.StructType(fields))
    e.store.load(name, e.policy, df, f"load-{uuid.uuid4().hex}", visibility)


def stored(name: str, sql: str | None, *tables: str):
    """Registers a query over a store with the given tables."""

    def put(f: Callable[[Engine, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            root = shared.until_the_end(spark, f"{shared.folder(spark)}/corviq-store-{uuid.uuid4().hex}")
            e = Engine.on(Store(spark, root), Policy("tenant-a"))
            for t in tables:
                load(e, sf_dir, t)
            return f(e, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = _sees(sql)
        return f

    return put


def code(action: Callable[[], object]) -> str:
    try:
        action()
    except EngineError as x:
        return x.code
    return "ok"


def _rows(e: Engine, rows: list[tuple], schema: str) -> DataFrame:
    return e.spark.createDataFrame(rows, schema)


def codes(name: str, cases: dict[str, str], *tables: str):
    """A query whose rows say which code each case ends with; ``cases`` has the codes that it must be."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in cases.items())

    def put(f: Callable[[Engine, str], dict[str, str]]):
        return stored(name, f"SELECT * FROM (VALUES {values}) AS t(\"case\", code)", *tables)(lambda e, d: _rows(e, list(f(e, d).items()), "`case` string, code string"))

    return put


# -- rows --------------------------------------------------------------------------------------------------------------


@stored("d1_insert", "SELECT n_nationkey AS id, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 2), (101, 'O''MU', NULL)", "nation")
def _(e, d):
    e.sql("INSERT INTO nation (id, n_nationkey, n_name, n_regionkey) VALUES (100, 100, 'ATLANTIS', 2), (101, 101, 'O''MU', NULL) USING OPERATION_ID 'i1'")
    return e.table("nation").select("id", "n_name", "n_regionkey")


@stored(
    "d2_upsert",
    "SELECT c_custkey AS id, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, 'new', 0.0 FROM customer WHERE c_custkey % 50 = 0",
    "customer",
)
def _(e, d):
    """A table of changes: rows that are there are updated, the others are added."""
    c = e.table("customer")
    new = c.where("c_custkey % 50 = 0").select((F.col("id") + 10000000).alias("id"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    e.store.load("customer", e.policy, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "u1", on_conflict="update")
    e.store.load("customer", e.policy, new.unionByName(c.select("id", "c_name", "c_acctbal")), "u2", on_conflict="nothing")
    return e.table("customer").select("id", "c_name", "c_acctbal")


@stored(
    "d2_upsert_sets",
    "SELECT n_nationkey AS id, n_name, CASE WHEN n_nationkey = 3 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (77, 'NEW', 5)",
    "nation",
)
def _(e, d):
    e.sql("INSERT INTO nation (id, n_name, n_regionkey) VALUES (3, 'OTHER', 9), (77, 'NEW', 5) ON CONFLICT (id) DO UPDATE SET n_regionkey = EXCLUDED.n_regionkey USING OPERATION_ID 'u1'")
    e.sql("INSERT INTO nation (id, n_name) VALUES (3, 'THIRD'), (77, 'x') ON CONFLICT (id) DO NOTHING USING OPERATION_ID 'u2'")
    return e.table("nation").select("id", "n_name", "n_regionkey")


@stored("d3_update", "SELECT o_orderkey AS id, o_orderstatus, round(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_totalprice * 2 + 1 ELSE o_totalprice END, 4) AS price FROM orders", "orders")
def _(e, d):
    e.sql("UPDATE orders SET o_totalprice = o_totalprice * 2 + 1 WHERE o_orderstatus = 'F' AND o_totalprice > 100000 USING OPERATION_ID 'u1'")
    return e.table("orders").select("id", "o_orderstatus", F.round("o_totalprice", 4).alias("price"))


@stored("d4_delete", "SELECT o_orderkey AS id FROM orders WHERE NOT (o_totalprice < 50000 OR o_orderpriority LIKE '5%')", "orders")
def _(e, d):
    e.sql("DELETE FROM orders WHERE o_totalprice < 50000 OR o_orderpriority LIKE '5%' USING OPERATION_ID 'd1'")
    return e.table("orders").select("id")


@stored("d5_truncate", "SELECT n_nationkey + 1000 AS id, n_name FROM nation", "nation")
def _(e, d):
    """Only the tenant's own rows go."""
    other = Engine.on(e.store, Policy("tenant-b"))
    rows = e.table("nation").withColumn("id", F.col("id") + 1000)
    e.store.load("nation", other.policy, rows, "b")
    e.sql("TRUNCATE TABLE nation")
    return e.table("nation").select("id", "n_name")


@stored("d6_returning", "SELECT s_suppkey AS id, upper(s_name) AS name, round(s_acctbal + 10, 4) AS bal FROM supplier WHERE s_acctbal > 0", "supplier")
def _(e, d):
    rows = e.sql("UPDATE supplier SET s_acctbal = s_acctbal + 10 WHERE s_acctbal > 0 RETURNING id, upper(s_name) AS name, s_acctbal USING OPERATION_ID 'r1'")
    return rows.select("id", "name", F.round("s_acctbal", 4).alias("bal"))


@stored("d7_partitioned", "SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN c_nationkey + 100 ELSE c_nationkey END AS nation, (SELECT count(*) FROM customer WHERE c_nationkey < 10) AS changed FROM customer WHERE c_acctbal >= 0 OR c_nationkey < 10", "customer")
def _(e, d):
    n = e.sql("UPDATE customer SET c_nationkey = c_nationkey + 100 WHERE c_nationkey < 10 USING OPERATION_ID 'p1' PARTITIONED CHUNK 400")
    e.sql("DELETE FROM customer WHERE c_acctbal < 0 AND c_nationkey < 100 USING OPERATION_ID 'p2' PARTITIONED CHUNK 50")
    return e.table("customer").select("id", F.col("c_nationkey").alias("nation"), F.lit(n).cast("long").alias("changed"))


@codes("d8_ledger", {"first": "ok", "same again": "23505", "other content": "22023", "other conflict rule": "22023", "without": "23502", "too long": "54000", "after reopening": "23505", "after rollback": "ok"}, "region")
def _(e, d):
    sql = "INSERT INTO region (id, r_name) VALUES (50, 'x')"
    out = {
        "first": code(lambda: e.sql(f"{sql} USING OPERATION_ID 'a'")), "same again": code(lambda: e.sql(f"{sql} USING OPERATION_ID 'a'")),
        "other content": code(lambda: e.sql("INSERT INTO region (id, r_name) VALUES (51, 'x') USING OPERATION_ID 'a'")),
        "other conflict rule": code(lambda: e.sql(f"{sql} ON CONFLICT (id) DO NOTHING USING OPERATION_ID 'a'")), "without": code(lambda: e.sql(sql)),
        "too long": code(lambda: e.sql(f"{sql} USING OPERATION_ID '{'a' * 257}'")),
    }
    again = Engine.on(Store(e.spark, e.store.root), e.policy)
    out["after reopening"] = code(lambda: again.sql(f"{sql} USING OPERATION_ID 'a'"))
    e.sql("BEGIN; DELETE FROM region WHERE id = 50 USING OPERATION_ID 'b'")
    e.sql("ROLLBACK")
    out["after rollback"] = code(lambda: e.sql("DELETE FROM region WHERE id = 50 USING OPERATION_ID 'b'"))
    return out


@stored("d9_transactions", "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 2 THEN 'kept' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4", "region")
def _(e, d):
    e.sql("BEGIN; DELETE FROM region WHERE id < 3 USING OPERATION_ID 'a'")
    e.sql("ROLLBACK")
    e.sql("BEGIN; UPDATE region SET r_name = 'kept' WHERE id = 2 USING OPERATION_ID 'b'; DELETE FROM region WHERE id = 4 USING OPERATION_ID 'c'")
    e.sql("COMMIT")
    e.sql("BEGIN; DELETE FROM region WHERE id = 0 USING OPERATION_ID 'd'")
    code(lambda: e.sql("DELETE FROM region WHERE nope = 1 USING OPERATION_ID 'e'"))
    e.sql("ROLLBACK")
    return e.table("region").select("id", "r_name")


@stored("d10_messages", "SELECT r_regionkey AS id, r_name, '23505' AS code FROM region UNION ALL VALUES (60, 'both', '23505'), (61, 'both', '23505')", "region")
def _(e, d):
    """A message is one transaction: the second statement's failure takes the first with it."""
    found = code(lambda: e.sql("DELETE FROM region WHERE id < 3 USING OPERATION_ID 'a'; INSERT INTO region (id, r_name) VALUES (3, 'x') USING OPERATION_ID 'b'"))
    e.sql("INSERT INTO region (id, r_name) VALUES (60, 'both') USING OPERATION_ID 'c'; INSERT INTO region (id, r_name) VALUES (61, 'both') USING OPERATION_ID 'd'")
    return e.table("region").select("id", "r_name", F.lit(found).alias("code"))


@codes("d11_create_drop", {"create": "ok", "again": "42P07", "twice the same column": "42701", "unknown type": "42704", "drop": "ok", "gone": "42P01", "lost race": "40001", "still there": "ok"})
def _(e, d):
    out = {
        "create": code(lambda: e.sql("CREATE TABLE t (a TEXT, v VECTOR(2))")), "again": code(lambda: e.sql("CREATE TABLE t (a TEXT)")),
        "twice the same column": code(lambda: e.sql("CREATE TABLE u (a TEXT, a TEXT)")), "unknown type": code(lambda: e.sql("CREATE TABLE u (a MONEY)")),
    }
    e.sql("CREATE TABLE kept (a TEXT)")
    late = Engine.on(Store(e.spark, e.store.root), e.policy)
    out["drop"] = code(lambda: e.sql("DROP TABLE t"))
    out["gone"] = code(lambda: e.sql("SELECT a FROM t"))
    out["lost race"] = code(lambda: late.sql("DROP TABLE kept"))
    out["still there"] = code(lambda: late.sql("SELECT a FROM kept"))
    return out


@stored(
    "d12_alter",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'none' END AS note, p_size::BIGINT AS p_size, NULL::DOUBLE AS rate FROM part UNION ALL VALUES (90000001, NULL, NULL, 1.5)",
    "part",
)
def _(e, d):
    e.sql("ALTER TABLE part ADD COLUMN note TEXT DEFAULT 'none'; ALTER TABLE part ADD COLUMN rate DOUBLE PRECISION; ALTER TABLE part ALTER COLUMN p_size TYPE BIGINT; ALTER TABLE part DROP COLUMN p_name")
    e.sql("UPDATE part SET note = 'x' WHERE mod(id, 2) = 0 USING OPERATION_ID 'a'")
    e.store.add_rule("part", "not_null", "p_size")
    refused = code(lambda: e.sql("INSERT INTO part (id, rate, note) VALUES (90000001, 1.5, NULL) USING OPERATION_ID 'b'"))
    e.sql("ALTER TABLE part ALTER COLUMN p_size DROP NOT NULL")
    again = Engine.on(Store(e.spark, e.store.root), e.policy)  # the change was saved
    if refused == "23502":
        again.sql("INSERT INTO part (id, rate, note) VALUES (90000001, 1.5, NULL) USING OPERATION_ID 'c'")
    return again.table("part").select("id", "note", "p_size", "rate")


@codes("d13_constraints", {"not null": "23502", "unique": "23505", "check": "23514", "foreign key": "23503", "restrict": "23503", "fits": "ok", "key twice": "21000", "add unique": "23505", "add check": "23514"})
def _(e, d):
    e.sql("CREATE TABLE p (name TEXT NOT NULL UNIQUE, n INTEGER CHECK (n > 0)); CREATE TABLE c (p_id BIGINT REFERENCES p (id))")
    e.sql("INSERT INTO p (id, name, n) VALUES (1, 'a', 1), (2, 'b', 1), (3, 'c', 9) USING OPERATION_ID '0'; INSERT INTO c (id, p_id) VALUES (1, 2), (2, NULL) USING OPERATION_ID '1'")
    tried = {
        "not null": "INSERT INTO p (id, n) VALUES (4, 1)", "unique": "INSERT INTO p (id, name) VALUES (4, 'a')", "check": "INSERT INTO p (id, name, n) VALUES (4, 'd', 0)",
        "foreign key": "INSERT INTO c (id, p_id) VALUES (3, 7)", "restrict": "DELETE FROM p WHERE id = 2", "fits": "INSERT INTO p (id, name, n) VALUES (4, 'd', NULL)",
        "key twice": "INSERT INTO p (id, name) VALUES (8, 'x'), (8, 'y')",
    }
    out = {k: code(lambda s=s, k=k: e.sql(f"{s} USING OPERATION_ID '{k}'")) for k, s in tried.items()}
    out["add unique"] = code(lambda: e.sql("ALTER TABLE p ADD UNIQUE (n)"))
    out["add check"] = code(lambda: e.sql("ALTER TABLE p ADD CHECK (n < 5)"))
    return out


@stored(
    "d13_cascade",
    "SELECT o_orderkey AS id, CASE WHEN c_nationkey IN (3, 4) THEN NULL ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN (1, 2)",
    "customer",
)
def _(e, d):
    """Rows that point at what a delete takes go too, or lose the reference."""
    for name, action in (("gone", "CASCADE"), ("cleared", "SET NULL")):
        e.sql(f"CREATE TABLE {name} (o_custkey BIGINT REFERENCES customer (id) ON DELETE {action})")
        orders = e.spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_custkey")
        keys = e.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").isin(1, 2).alias("first"))
        e.store.load(name, e.policy, orders.join(keys, "o_custkey").where("first" if name == "gone" else "not first").select("id", "o_custkey"), f"load-{name}")
    e.sql("DELETE FROM customer WHERE c_nationkey IN (1, 2, 3, 4) USING OPERATION_ID 'x'")
    return e.table("gone").unionByName(e.table("cleared"))


@stored("d14_objects", "SELECT c_custkey AS id, c_nationkey, CASE WHEN c_acctbal < 0 THEN 'sad' WHEN c_acctbal < 5000 THEN 'ok' ELSE 'happy' END AS mood FROM customer ORDER BY CASE mood WHEN 'happy' THEN 0 WHEN 'ok' THEN 1 ELSE 2 END, c_nationkey, c_custkey LIMIT 300", "customer")
def _(e, d):
    """Labels of an enumeration order as they were declared; views and indexes read and steer."""
    e.sql("CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy'); CREATE TABLE m (c_nationkey INTEGER, mood mood)")
    c = e.table("customer").select("id", "c_nationkey", F.when(F.col("c_acctbal") < 0, "sad").when(F.col("c_acctbal") < 5000, "ok").otherwise("happy").alias("mood"))
    e.store.load("m", e.policy, c, "load")
    e.sql("CREATE INDEX by_nation ON m USING scalar (c_nationkey); CREATE VIEW moods AS SELECT id, c_nationkey, mood FROM m WHERE c_nationkey >= 0")
    return e.sql("SELECT id, c_nationkey, mood FROM moods ORDER BY mood DESC, c_nationkey LIMIT 300")


_GATED = f"SELECT id, round(s, 6) AS score FROM (SELECT vec_id AS id, {_dot(PROBE)} AS s, row_number() OVER (ORDER BY {_dot(PROBE)} DESC, vec_id) AS r FROM embeddings) WHERE s >= 0.80 AND r = 1 AND (SELECT count(*) FROM embeddings) > 0 AND s - (SELECT s2 FROM (SELECT {_dot(PROBE)} AS s2, row_number() OVER (ORDER BY {_dot(PROBE)} DESC, vec_id) AS r2 FROM embeddings) WHERE r2 = 2) >= 0.05"


@stored("d15_set_mode", _GATED, "embeddings")
def _(e, d):
    """A session in precision mode gets one confident hit or none."""
    e.sql("SET search_mode = 'precision'")
    return e.sql(f"SELECT id FROM embeddings ORDER BY embedding <=> '{VEC}' LIMIT 10").select("id", F.round("score", 6).alias("score"))


@stored("d16_explain", "SELECT * FROM (VALUES ('scan', 'access_path,ann_plan,engine,scalar_plan'), ('search', 'access_path,ann_plan,engine,mode,mode_source,order,scalar_plan'), ('aggregate', 'access_path,ann_plan,engine,scalar_plan'), ('delete', 'access_path,ann_plan,engine,scalar_plan')) AS t(kind, items)", "embeddings")
def _(e, d):
    texts = {
        "scan": "SELECT id FROM embeddings WHERE label = 3", "search": f"SELECT id FROM embeddings ORDER BY embedding <=> '{VEC}' LIMIT 3", "aggregate": "SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label",
        "delete": "DELETE FROM embeddings WHERE label = 3 USING OPERATION_ID 'x'",
    }
    rows = []
    for kind, text in texts.items():
        lines = [r[0] for r in e.sql(f"EXPLAIN {text}").collect()]
        rows.append((kind, ",".join(sorted(x.split(":")[0] for x in lines if x.split(":")[0] in ("engine", "mode", "mode_source", "order", "ann_plan", "scalar_plan", "access_path", "path_hint", "kind_hint")))))
    return _rows(e, rows, "kind string, items string")


# -- sources -----------------------------------------------------------------------------------------------------------

_COPIED = "SELECT doc_id AS id, md5(text) AS digest, lang, n_chars FROM documents"


@stored("s6_copy_text", _COPIED)
def _(e, d):
    """Out to files in COPY's text form, and back from them on the executors, line feeds and all."""
    return _copied(e, d, "text")


@stored("s6_copy_csv", _COPIED)
def _(e, d):
    return _copied(e, d, "csv")


def _copied(e: Engine, d: str, form: str) -> DataFrame:
    docs = e.spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang", "n_chars")
    path = f"{e.store.root}/_copy"
    docs.select(ingest.copy_line([F.col(c) for c in docs.columns], form)).write.text(path, lineSep="\n")
    e.sql("CREATE TABLE docs (text TEXT, lang TEXT, n_chars BIGINT)")
    e.store.load("docs", e.policy, ingest.read_copy(e.spark, path, docs.schema, form), "copy")
    return e.table("docs").select("id", F.md5("text").alias("digest"), "lang", "n_chars")


@stored("s6_copy_message", "SELECT * FROM (VALUES (1, 'a' || chr(9) || 'b' || chr(10) || chr(92), 1.5), (2, NULL, NULL), (3, 'form' || chr(12) || 'feed', 2.0), (4, '', 0.0), (5, 'x,\"y\"', NULL)) AS t(id, a, n)")
def _(e, d):
    e.sql("CREATE TABLE t (a TEXT, n DOUBLE PRECISION)")
    e.sql("COPY t (id, a, n) FROM STDIN (FORMAT text) USING OPERATION_ID '1'", data="1\ta\\tb\\n\\\\\t1.5\n2\t\\N\t\\N\n3\tform\x0cfeed\t2\n")
    e.sql("COPY t (id, a, n) FROM STDIN (FORMAT csv) USING OPERATION_ID '2'", data='4,"",0\n5,"x,""y""",\n')
    return e.table("t").select("id", "a", "n")


_CHUNKED = r"""WITH l AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN 'changed' || chr(10) || text ELSE text END, chr(10)) AS l FROM documents WHERE doc_id % 7 <> 0), c AS (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 60 + 1)) AS chunk FROM l)
    SELECT 'f' || doc_id || '.txt' AS path, chunk::INTEGER AS chunk, (chunk * 60 + 1)::INTEGER AS start_line, least((chunk + 1) * 60, len(l))::INTEGER AS end_line, md5(body) AS digest
    FROM (SELECT *, regexp_replace(array_to_string(l[chunk * 60 + 1:chunk * 60 + 60], chr(10)), '^\s+|\s+$', '', 'g') AS body FROM c) WHERE body <> ''"""


@stored("s8_file_ingest", _CHUNKED)
def _(e, d):
    """Files are chunked and embedded; ingested again, a file's rows are replaced, and an empty one's go."""
    docs = e.spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("path"), "text")
    none = e.spark.createDataFrame([], "path string, chunk int, start_line int, end_line int, body string, embedding array<float>")
    path = f"{e.store.root}/_chunks"
    ingest.replace_files(none, docs.select("path", "text"), 8).write.parquet(path)
    first = e.spark.read.parquet(path)
    again = docs.where("doc_id % 3 = 0 or doc_id % 7 = 0").select("path", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("changed\n"), "text")).alias("text"))
    return ingest.replace_files(first, again, 8).select("path", "chunk", "start_line", "end_line", F.md5("body").alias("digest"))


@codes("s9_batch_limits", {"sixty-four": "ok", "one more": "54000", "a path twice": "21000", "too large": "54000"})
def _(e, d):
    files = e.spark.range(64).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("x").alias("text"))
    large = e.spark.createDataFrame([("a", "x")], "path string, text string").withColumn("text", F.repeat("text", ingest.MAX_INPUT + 1))
    return {
        "sixty-four": code(lambda: ingest.check_files(files)), "one more": code(lambda: ingest.check_files(files.union(e.spark.createDataFrame([("g", "x")], "path string, text string")))),
        "a path twice": code(lambda: ingest.check_files(files.limit(3).union(files.limit(3)))), "too large": code(lambda: ingest.check_files(large)),
    }


@stored("s11_row_store", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS now, o_orderstatus AS before FROM orders WHERE o_custkey % 11 <> 0", "orders")
def _(e, d):
    """A reader keeps what it planned on while others write; a compacted and reopened store has the last state."""
    before = e.table("orders").select("id", F.col("o_orderstatus").alias("before"))
    e.sql("UPDATE orders SET o_orderstatus = 'X' WHERE mod(o_custkey, 5) = 0 USING OPERATION_ID 'a'; DELETE FROM orders WHERE mod(o_custkey, 11) = 0 USING OPERATION_ID 'b'")
    e.store.compact("orders")
    again = Engine.on(Store(e.spark, e.store.root), e.policy)
    return again.table("orders").select("id", F.col("o_orderstatus").alias("now")).join(before, "id")


@stored("s14_cursor", "SELECT n_nationkey AS id, n_name, CASE WHEN r <= 7 THEN 1 WHEN r <= 10 THEN 2 ELSE 3 END AS fetch FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS r FROM nation)", "nation")
def _(e, d):
    e.sql("DECLARE c CURSOR FOR SELECT id, n_name FROM nation ORDER BY n_name")
    rows = [(r["id"], r["n_name"], n) for n, size in ((1, 7), (2, 3), (3, 100)) for r in e.sql(f"FETCH {size} FROM c")]
    e.sql("CLOSE c")
    return _rows(e, rows, "id long, n_name string, fetch int")


# -- retrieval over a store --------------------------------------------------------------------------------------------

_DOCS = f"SELECT e.vec_id AS id, e.embedding, d.text FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id"


def _docs(e: Engine, d: str) -> None:
    """Vectors with the texts of the same key, as one table."""
    e.sql("CREATE TABLE docs (embedding VECTOR(64), body TEXT)")
    v, t = (e.spark.read.parquet(f"{d}/{n}.parquet") for n in ("embeddings", "documents"))
    e.store.load("docs", e.policy, v.join(t, v.vec_id == t.doc_id).select(F.col("vec_id").alias("id"), "embedding", F.col("text").alias("body")), "load")


def _pooled(sql: str) -> str:
    """The oracle of a fused search, over the table of vectors with texts."""
    return sql.replace("{documents}", f"({_DOCS})").replace("{embeddings}", f"({_DOCS})")


@stored("h2_hybrid_function", _pooled(f"WITH {_POOLS} SELECT id, round(score, 9) AS score FROM fused"))
def _(e, d):
    _docs(e, d)
    return e.sql(f"SELECT id FROM docs ORDER BY hybrid(embedding, '{VEC}', body, '{TEXT}') LIMIT 20").select("id", F.round("score", 9).alias("score"))


@stored("h3_dense_only", f"SELECT vec_id AS id, round({_dot(PROBE)}, 6) AS score FROM embeddings ORDER BY {_dot(PROBE)} DESC, vec_id LIMIT 15", "embeddings")
def _(e, d):
    """A planned search of a table without texts falls back to its vectors."""
    e.client = lambda prompt: '{"search_terms": ["onrein"], "path_hint": null, "kind_hint": null, "mode": null}'
    e.embed = lambda text, df, vector: PROBE
    return e.sql("SELECT id FROM embeddings USING PLAN('where is it') LIMIT 15").select("id", F.round("score", 6).alias("score"))


@stored("h4_hybrid_ann", "SELECT true AS enough, 20 AS n, 'probe' AS plan")
def _(e, d):
    """With a declared index the vectors' side is approximate: nine tenths of the exact hits at least."""
    _docs(e, d)
    sql = f"SELECT id FROM docs ORDER BY hybrid_rrf(embedding, '{VEC}', body, '{TEXT}') LIMIT 20"
    exact = {r["id"] for r in e.sql(sql).collect()}
    e.sql("CREATE INDEX near ON docs USING hnsw (embedding)")
    found = {r["id"] for r in e.sql(sql).collect()}
    return _rows(e, [(len(found & exact) >= 18, len(found), e.ann_plan)], "enough boolean, n int, plan string")


_PLANNED = ingest.embed_text(planner.DENSE_PREFIX + "onrein edston", 64)


@stored("i8_using_plan", _pooled(f"WITH {_POOLS.replace(_dot(PROBE), _dot(_PLANNED)).replace(repr(V.query_terms(TEXT)), repr(V.query_terms('where is the onrein? onrein edston')))} SELECT id, round(score, 9) AS score FROM fused"))
def _(e, d):
    _docs(e, d)
    e.client = lambda prompt: 'Sure: {"search_terms": ["onrein", "edston"], "path_hint": null, "kind_hint": "fn", "mode": "recall"}'
    return e.sql("SELECT id FROM docs USING PLAN('where is the onrein?') LIMIT 20").select("id", F.round("score", 9).alias("score"))


# -- policy ------------------------------------------------------------------------------------------------------------


@stored("l3_two_strategies", "SELECT kind, n_nationkey AS id FROM nation, (VALUES ('filter'), ('prefilter')) AS t(kind) WHERE n_nationkey < 10 OR n_nationkey >= 20")
def _(e, d):
    """Filtering while reading, and reading what was filtered once, see the same rows."""
    load(e, d, "nation", "n_nationkey < 10")
    other = Engine.on(e.store, Policy("tenant-b"))
    load(other, d, "nation", "n_nationkey between 10 and 19", "private")
    load(other, d, "nation", "n_nationkey >= 20")
    out = None
    for kind in ("filter", "prefilter"):
        e.strategy = kind
        rows = e.table("nation").select(F.lit(kind).alias("kind"), "id")
        out = rows if out is None else out.union(rows)
    return out


@stored("l4_ownership", "SELECT n_nationkey AS id, n_name, 0::BIGINT AS touched FROM nation", "nation")
def _(e, d):
    """Another tenant's public rows are seen and not written."""
    other = Engine.on(e.store, Policy("tenant-b"))
    n = other.sql("UPDATE nation SET n_name = 'mine' WHERE id >= 0 USING OPERATION_ID 'a'") + other.sql("DELETE FROM nation WHERE id >= 0 USING OPERATION_ID 'b'")
    other.sql("TRUNCATE TABLE nation")
    return other.table("nation").select("id", "n_name", F.lit(n).cast("long").alias("touched"))


@stored("p14_json", "SELECT event_id AS id, 'eq' AS how FROM events WHERE json_extract_string(props, '$.k') = '3' UNION ALL SELECT event_id, 'in' FROM events WHERE json_extract_string(props, '$.k') IN ('3', '5')")
def _(e, d):
    """JSON compares by value: the order of keys and blanks don't matter."""
    e.sql("CREATE TABLE ev (props JSON, own JSONB)")
    events = e.spark.read.parquet(f"{d}/events.parquet")
    page = F.get_json_object("props", "$.k")
    e.store.load("ev", e.policy, events.select(F.col("event_id").alias("id"), F.concat(F.lit('{"z": 1, "page" :'), page, F.lit("}")).alias("props"), F.concat(F.lit('{"page":'), page, F.lit(',"z":1}')).alias("own")), "load")
    one = e.sql("""SELECT id FROM ev WHERE props = '{ "page":3,"z":1 }' AND own = '{"z":1, "page": 3}'""")
    two = e.table("ev").where(_predicate(e, {"own": {"in": ['{"z":1,"page":3}', '{"page":5, "z":1}']}})).select("id")
    return one.withColumn("how", F.lit("eq")).union(two.withColumn("how", F.lit("in")))


def _predicate(e: Engine, spec: dict):
    from corviq.operators import relational as R

    df = e.table("ev")
    return R.predicate(spec, df.columns, R.kinds(df))


@stored(
    "p4_types",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderdate::DATE >= DATE '1995-01-01' AND o_orderpriority > '2' AND o_totalprice::DECIMAL(12,2) < 200000.50 AND md5(o_orderkey::VARCHAR) >= '4' AND substr(md5(o_orderkey::VARCHAR), 1, 4) < 'f000'",
)
def _(e, d):
    """Ranges over dates, texts, exact numbers, uuids and bytes."""
    e.sql("CREATE TABLE t (day DATE, prio TEXT, price NUMERIC(12,2), u UUID, b BYTEA)")
    o, h = e.spark.read.parquet(f"{d}/orders.parquet"), F.md5(F.col("o_orderkey").cast("string"))
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    e.store.load("t", e.policy, o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("prio"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), u.alias("u"), F.unhex(F.substring(h, 1, 4)).alias("b")), "load")
    return e.table("t").where("day >= DATE '1995-01-01' and prio > '2' and price < 200000.50 and u >= '4' and b < X'f000'").select("id")


@codes("p14_types", {"json": "ok", "no json": "22P02", "a key twice": "22P02", "too deep": "22P02", "json range": "42804", "uuid": "ok", "no uuid": "22P02", "json join": "42804", "uuid join": "ok"})
def _(e, d):
    e.sql("CREATE TABLE t (j JSON, u UUID); CREATE TABLE s (j JSON, u UUID)")
    put = lambda k, v: code(lambda: e.sql(f"INSERT INTO t (id, {v[0]}) VALUES ({k}, '{v[1]}') USING OPERATION_ID '{k}'"))
    return {
        "json": put(1, ("j", '{"a": [1, {"b": null}]}')), "no json": put(2, ("j", "{a: 1}")), "a key twice": put(3, ("j", '{"a": 1, "a": 2}')), "too deep": put(4, ("j", "[" * 17 + "]" * 17)),
        "json range": code(lambda: e.sql("SELECT id FROM t WHERE j > '1'")), "uuid": put(5, ("u", "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11")), "no uuid": put(6, ("u", "a0eebc99")),
        "json join": code(lambda: e.sql("SELECT t.id FROM t JOIN s ON t.j = s.j")), "uuid join": code(lambda: e.sql("SELECT t.id FROM t JOIN s ON t.u = s.u")),
    }
