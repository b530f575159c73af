"""The registered queries of the engine's own operators, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corviq.functions import scalar as S
from corviq.operators import relational as R
from corviq.operators import retrieval as V
from corviq.plans.engine import Engine, python_function
from corviq.plans.planner import Expansion
from corviq.policy import ANONYMOUS, Policy
from corviq.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM = 64
PROBE = [((k * 37) % 19 - 9) / 10 for k in range(DIM)]
PROBES = {q: [((k * (37 + q)) % 19 - 9) / 10 for k in range(DIM)] for q in range(1, 17)}
TEXT = "the worthless onrein of edston and reresh"
SEEN = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "(l_orderkey * 8 + l_linenumber)", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "labels": "doc_id", "conversations": "(conv_id * 1000 + turn)", "benchmark": "item_id", "pages": "page_id"}


def _sees(sql: str) -> str:
    """``{orders}`` in SQL is the visible part of the table, with its id."""
    for name, key in SEEN.items():
        sql = sql.replace("{" + name + "}", f"(SELECT {key} AS id, * FROM {name} WHERE {key} % 10 <> 9)")
    return sql


def query(name: str, sql: str | None = None):
    def put(f: Callable[[Engine], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Engine.over(spark, sf_dir))
        if sql:
            SQL[name] = _sees(sql)
        return f

    return put


def _list(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def _dot(values: list[float]) -> str:
    return f"list_dot_product(embedding::DOUBLE[], {_list(values)})"


# -- scans -----------------------------------------------------------------------------------------------------------


@query("s1_wide_scan", "SELECT id, o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 150000 ORDER BY id LIMIT 500")
def _(e):
    return R.page(e.table("orders").where("o_totalprice > 150000"), 500, order=[("id", "asc")]).select("id", "o_custkey", "o_totalprice")


@query("s2_offset", "SELECT id, o_orderdate FROM {orders} ORDER BY o_orderdate, id LIMIT 100 OFFSET 250")
def _(e):
    return e.query({"op": "scan", "table": "orders", "columns": ["id", "o_orderdate"], "order_by": [{"column": "o_orderdate"}], "limit": 100, "offset": 250})


@query("s3_order_by", "SELECT id, p_brand, p_size FROM {part} ORDER BY p_brand DESC NULLS FIRST, p_size ASC NULLS LAST, id LIMIT 200")
def _(e):
    return R.page(e.table("part"), 200, order=[("p_brand", "desc"), ("p_size", "asc")]).select("id", "p_brand", "p_size")


@query("s4_order_by_expr", "SELECT id, p_name FROM {part} ORDER BY length(p_name) DESC, CASE WHEN p_size > 25 THEN 1 ELSE 0 END, id LIMIT 50")
def _(e):
    return R.page(e.table("part"), 50, order=[(S.length(F.col("p_name")), "desc"), (F.when(F.col("p_size") > 25, 1).otherwise(0), "asc")]).select("id", "p_name")


@query("s5_point_read", "SELECT id, c_name FROM {customer} WHERE id = 42")
def _(e):
    return e.table("customer").where("id = 42").select("id", "c_name")


@query("s7_copy_out", "SELECT id, concat_ws(chr(9), c_custkey::VARCHAR, c_name, c_mktsegment) AS line FROM {customer}")
def _(e):
    return e.table("customer").select("id", ingest.copy_line([F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")]).alias("line"))


@query("s7_copy_out_csv", "SELECT id, concat_ws(',', n_nationkey::VARCHAR, n_name) AS line FROM {nation}")
def _(e):
    return e.table("nation").select("id", ingest.copy_line([F.col("n_nationkey"), F.col("n_name")], "csv").alias("line"))


@query("s10_json_rows", """SELECT id, '{"id":' || id || ',"r_name":"' || r_name || '"}' AS line FROM {region}""")
def _(e):
    return e.table("region").select("id", F.to_json(F.struct("id", "r_name")).alias("line"))


def _rich(e):
    return e.table("customer").where("c_acctbal > 5000").select("id", "c_name", "c_nationkey", "c_acctbal")


@query("s12_view", "SELECT id, c_name FROM {customer} WHERE c_acctbal > 5000 AND c_nationkey = 7")
def _(e):
    e.create_view("rich", _rich)
    e.create_view("rich_seven", lambda s: s.table("rich").where("c_nationkey = 7"))
    return e.table("rich_seven").select("id", "c_name")


@query("s13_buffered_view", "SELECT c_nationkey, count(*) AS n FROM (SELECT * FROM {customer} ORDER BY c_acctbal DESC NULLS FIRST, id LIMIT 50) GROUP BY c_nationkey")
def _(e):
    e.create_view("top50", lambda s: R.page(s.table("customer"), 50, order=[("c_acctbal", "desc")]))
    return R.grouped(e.table("top50"), ["c_nationkey"], {"n": F.count("*")})


# -- predicates ------------------------------------------------------------------------------------------------------

_WHERE = {
    "p3_equals": ("orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "p4_range": ("lineitem", {"l_quantity": {"gt": 45}, "l_discount": {"lte": 0.02}}, "l_quantity > 45 AND l_discount <= 0.02"),
    "p5_in": ("customer", {"c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "p5_not_in": ("customer", {"not": {"c_nationkey": {"in": [1, 2, 3]}}}, "c_nationkey NOT IN (1, 2, 3)"),
    "p6_between": ("part", {"p_size": {"between": [10, 20]}}, "p_size BETWEEN 10 AND 20"),
    "p6_between_empty": ("part", {"p_size": {"between": [20, 10]}}, "p_size BETWEEN 20 AND 10"),
    "p8_not": ("part", {"not": {"or": [{"p_size": {"lt": 30}}, {"p_brand": {"prefix": "Brand#1"}}]}}, "NOT (p_size < 30 OR p_brand LIKE 'Brand#1%')"),
    "p9_tree": ("orders", {"or": [{"o_orderstatus": "O", "o_totalprice": {"lt": 50000}}, {"o_orderpriority": {"prefix": "1"}}]}, "(o_orderstatus = 'O' AND o_totalprice < 50000) OR o_orderpriority LIKE '1%'"),
    "p10_or_same": ("orders", {"or": [{"o_orderstatus": "O"}, {"o_orderstatus": "P"}]}, "o_orderstatus = 'O' OR o_orderstatus = 'P'"),
    "p11_prefix": ("part", {"p_type": {"prefix": "PROMO"}}, "p_type LIKE 'PROMO%'"),
    "p12_like": ("part", {"p_name": {"like": "%a_e%"}}, "p_name LIKE '%a_e%'"),
}
for _name, (_t, _spec, _sql) in _WHERE.items():
    query(_name, f"SELECT id FROM {{{_t}}} WHERE {_sql}")(lambda e, t=_t, s=_spec: (lambda df: df.where(R.predicate(s, df.columns)).select("id"))(e.table(t)))


@query("p7_is_null", "SELECT id, g IS NULL AS none FROM (SELECT id, nullif(p_size % 3, 0) AS g, nullif(p_brand, 'Brand#11') AS b FROM {part}) WHERE g IS NULL OR b IS NULL AND g IS NOT NULL")
def _(e):
    t = e.table("part").withColumn("g", F.nullif(F.col("p_size") % 3, F.lit(0))).withColumn("b", F.nullif("p_brand", F.lit("Brand#11")))
    spec = {"or": [{"g": {"is_null": True}}, {"b": {"is_null": True}, "g": {"not_null": True}}]}
    return t.where(R.predicate(spec, t.columns)).select("id", F.col("g").isNull().alias("none"))


_SIGNS = "list_transform(embedding[1:3], lambda x: CASE WHEN x > 0 THEN 1 WHEN x < -0.5 THEN NULL ELSE -1 END::INTEGER)"


@query("p13_arrays", f"SELECT id, s IS NOT DISTINCT FROM [1, -1, 1] AS same, list_contains([[1, 1, 1], [-1, NULL, 1], [-1, -1, -1]], s) AS among FROM (SELECT id, {_SIGNS} AS s FROM {{embeddings}})")
def _(e):
    """Arrays are equal element by element, nulls included."""
    signs = F.transform(F.slice("embedding", 1, 3), lambda x: F.when(x > 0, 1).when(x < -0.5, None).otherwise(-1))
    array = lambda *v: F.array(*[F.lit(x).cast("int") for x in v])
    return e.table("embeddings").select("id", (signs == array(1, -1, 1)).alias("same"), signs.isin(array(1, 1, 1), array(-1, None, 1), array(-1, -1, -1)).alias("among"))


@query("p18_id", "SELECT o_orderkey + 9007199254740992 AS id FROM {orders} WHERE o_orderkey + 9007199254740992 IN (9007199254740993, 9007199254740995, 9007199254741000) OR o_orderkey + 9007199254740992 > 9007199254740992 + (SELECT max(o_orderkey) FROM {orders}) - 3")
def _(e):
    """Ids are compared as whole numbers, where doubles would take neighbours for one."""
    big = e.table("orders").withColumn("id", F.col("o_orderkey") + 9007199254740992).select("id")
    top = big.agg(F.max("id")).first()[0]
    return big.where(R.predicate({"or": [{"id": {"in": [9007199254740993, 9007199254740995, 9007199254741000]}}, {"id": {"gt": top - 3}}]}, big.columns))


@query("p15_boolean", "SELECT id FROM (SELECT *, p_size > 40 AS big FROM {part}) WHERE big")
def _(e):
    return e.table("part").withColumn("big", F.col("p_size") > 40).where("big").select("id")


@query("p16_expression", "SELECT id FROM {lineitem} WHERE l_extendedprice * (1 - l_discount) > 40000 AND length(l_returnflag) = 1")
def _(e):
    return e.table("lineitem").where((F.col("l_extendedprice") * (1 - F.col("l_discount")) > 40000) & (S.length(F.col("l_returnflag")) == 1)).select("id")


@query("p19_vector_arithmetic", f"SELECT id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], {_list(PROBE)}), lambda x: (x[1] - x[2]) / 2)), 6) AS s FROM {{embeddings}}")
def _(e):
    return e.table("embeddings").select("id", F.round(S.vec_sum(S.vec_div(S.vec_add(F.col("embedding"), S.vec(PROBE), -1), F.lit(2.0))), 6).alias("s"))


@query("p20_case", "SELECT id, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand FROM {part}")
def _(e):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return e.table("part").select("id", size.alias("size"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("none")).alias("brand"))


@query("p21_typed_literals", "SELECT id FROM {orders} WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AND o_orderdate < DATE '1995-09-01'")
def _(e):
    return e.table("orders").where((F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1995-06-01 00:00:00'")) & (F.col("o_orderdate") < F.lit("1995-09-01").cast("date").cast("timestamp_ntz"))).select("id")


# -- functions -------------------------------------------------------------------------------------------------------


@query(
    "f1_f7_strings",
    """SELECT id, lower(p_name) AS lo, upper(p_name) AS up, length(p_name)::DOUBLE AS n, substr(p_name, 2, 5) AS mid, substr(p_name, 1, 2) AS head,
    concat(p_brand, NULL, '-', p_size) AS both, trim('  ' || p_type || ' ') AS t, replace(p_name, 'e', '33') AS r, strpos(p_name, 'a')::DOUBLE AS at FROM {part}""",
)
def _(e):
    n = F.col("p_name")
    return e.table("part").select(
        "id", F.lower(n).alias("lo"), F.upper(n).alias("up"), S.length(n).alias("n"), S.substr(n, 2, 5).alias("mid"), S.substr(n, -1, 4).alias("head"),
        S.concat(F.col("p_brand"), F.lit(None), F.lit("-"), F.col("p_size")).alias("both"), S.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("t"),
        S.replace(n, "e", "33").alias("r"), S.position("a", n).alias("at"),
    )


@query(
    "f8_f13_numbers",
    """SELECT id, abs(c_acctbal) AS a, round(c_acctbal) AS r, floor(c_acctbal)::DOUBLE AS f, ceil(c_acctbal)::DOUBLE AS c,
    (c_custkey % 7)::BIGINT AS m, round(power(c_custkey, 0.5), 6) AS p, round(sqrt(abs(c_acctbal)), 6) AS q FROM {customer}""",
)
def _(e):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return e.table("customer").select(
        "id", F.abs(b).alias("a"), S.round_half_away(b).alias("r"), S.floor(b).alias("f"), S.ceil(b).alias("c"), S.mod(k, F.lit(7)).cast("long").alias("m"),
        F.round(S.power(k.cast("double"), F.lit(0.5)), 6).alias("p"), F.round(S.sqrt(F.abs(b)), 6).alias("q"),
    )


_FIELDS = ("year", "quarter", "month", "week", "day", "hour", "minute", "dow", "isodow", "doy", "isoyear", "decade", "century", "millennium")


@query(
    "f14_f15_date_part",
    "SELECT id, " + ", ".join(f"date_part('{f}', ts)::DOUBLE AS {f}" for f in _FIELDS) + ", round(epoch_us(ts) / 1e6, 6) AS epoch, round((epoch_us(ts) % 60000000) / 1e6, 6) AS second FROM {events}",
)
def _(e):
    ts = F.col("ts")
    return e.table("events").select("id", *[S.date_part(f, ts).alias(f) for f in _FIELDS], F.round(S.date_part("epoch", ts), 6).alias("epoch"), F.round(S.date_part("second", ts), 6).alias("second"))


_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade")


@query(
    "f16_date_trunc",
    "SELECT id, " + ", ".join(f"date_trunc('{u}', ts)::TIMESTAMP AS {u}" for u in _UNITS)
    + ", make_timestamp(((date_part('year', ts) - 1) // 100 * 100 + 1)::BIGINT, 1, 1, 0, 0, 0) AS century, make_timestamp(((date_part('year', ts) - 1) // 1000 * 1000 + 1)::BIGINT, 1, 1, 0, 0, 0) AS millennium FROM {events}",
)
def _(e):
    return e.table("events").select("id", *[S.date_trunc(u, F.col("ts")).alias(u) for u in (*_UNITS, "century", "millennium")])


@query("f17_f19_dates", "SELECT id, (o_orderdate::DATE + 30)::DATE AS later, (o_orderdate::DATE - 7)::DATE AS sooner, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS days, o_orderdate::DATE <= o_orderdate AS promoted FROM {orders}")
def _(e):
    day = F.to_date("o_orderdate")
    return e.table("orders").select("id", S.date_add(day, 30).alias("later"), S.date_add(day, -7).alias("sooner"), S.date_diff(day, F.lit("1995-01-01").cast("date")).alias("days"), (day.cast("timestamp_ntz") <= F.col("o_orderdate")).alias("promoted"))


@query("f20_f22_vectors", f"SELECT id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_sum(embedding::DOUBLE[]), 6) AS total, round({_dot(PROBE)}, 6) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], {_list(PROBE)}), 6) AS cosine FROM {{embeddings}}")
def _(e):
    v, p = F.col("embedding"), S.vec(PROBE)
    return e.table("embeddings").select("id", F.round(S.vec_norm(v), 6).alias("norm"), F.round(S.vec_sum(v), 6).alias("total"), F.round(S.dot(v, p), 6).alias("dot"), F.round(S.cosine(v, p), 6).alias("cosine"))


@query("f23_json_path", "SELECT id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.ref') AS ref, (json_extract(props, '$.k')::INTEGER + 1)::VARCHAR AS second FROM {events}")
def _(e):
    """An object's key, one that isn't there, and an array's element."""
    deep = F.concat(F.lit('{"a": [{"b": 1}, '), S.json_text(F.col("props"), "$.k").cast("int") + 1, F.lit("]}"))
    return e.table("events").select("id", S.json_text(F.col("props"), "$.k").alias("k"), S.json_text(F.col("props"), "$.ref").alias("ref"), S.json_text(deep, "$.a[1]").alias("second"))


# -- aggregates ------------------------------------------------------------------------------------------------------


@query("a1_aggregate", "SELECT count(*) AS n, count(c_name) AS named, sum(c_custkey)::BIGINT AS s, round(avg(c_acctbal), 4) AS a, min(c_name) AS lo, max(c_acctbal) AS hi FROM {customer}")
def _(e):
    return e.table("customer").agg(F.count("*").alias("n"), F.count("c_name").alias("named"), R.sum_exact(F.col("c_custkey")).alias("s"), F.round(R.finite(F.avg("c_acctbal")), 4).alias("a"), F.min("c_name").alias("lo"), F.max("c_acctbal").alias("hi"))


@query("a1_empty", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS s, max(c_name) AS hi FROM {customer} WHERE c_custkey < 0")
def _(e):
    return e.table("customer").where("c_custkey < 0").agg(F.count("*").alias("n"), R.sum_exact(F.col("c_custkey")).alias("s"), F.max("c_name").alias("hi"))


@query("a5_numeric", "SELECT p_brand, sum(p_retailprice::DECIMAL(10,2))::DECIMAL(38,2) AS s, count(*) AS n FROM {part} GROUP BY p_brand")
def _(e):
    price = F.col("p_retailprice").cast("decimal(10,2)")
    return R.grouped(e.table("part"), ["p_brand"], {"s": F.sum(price.cast("decimal(38,2)")).cast("decimal(38,2)"), "n": F.count("*")})


@query("a5_average", "SELECT p_brand, round(sum(p_retailprice::DECIMAL(10,2))::DOUBLE / count(*), 10) AS a FROM {part} GROUP BY p_brand")
def _(e):
    price = F.col("p_retailprice").cast("decimal(10,2)")
    return R.grouped(e.table("part"), ["p_brand"], {"a": F.round(R.avg_numeric(price, 10, 2).cast("double"), 10)})


@query("a7_many_groups", "SELECT o_custkey, o_orderdate, count(*) AS n FROM {orders} GROUP BY ALL")
def _(e):
    """Without a limit all groups come, however many."""
    return e.query({"op": "aggregate", "table": "orders", "group_by": ["o_custkey", "o_orderdate"], "items": {"n": {"count": "*"}}})


@query("s2_offset_only", "SELECT id FROM {orders} ORDER BY id OFFSET 100")
def _(e):
    return e.sql("SELECT id FROM orders ORDER BY id OFFSET 100")


@query("a6_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM {orders} GROUP BY o_orderpriority")
def _(e):
    return R.grouped(e.table("orders"), ["o_orderpriority"], {"n": F.count_distinct("o_custkey")})


@query(
    "a7_group_by",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc FROM {lineitem} GROUP BY ALL",
)
def _(e):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return R.grouped(e.table("lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "qty": F.round(F.sum("l_quantity"), 2), "revenue": F.round(F.sum(net), 2), "disc": F.round(F.avg("l_discount"), 6)})


@query("a8_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 12")
def _(e):
    return R.grouped(e.table("orders"), ["o_custkey"], {"n": F.count("*")}, F.col("n") >= 12)


@query("a9_order_limit", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 5")
def _(e):
    return e.query({"op": "aggregate", "table": "orders", "group_by": ["o_custkey"], "items": {"n": {"count": "*"}}, "order_by": [{"column": "n", "dir": "desc"}], "limit": 20, "offset": 5})


@query("a10_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}")
def _(e):
    return e.table("part").select("p_brand", "p_size").distinct()


@query("a11_expression", "SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS high, count(nullif(user_id % 2, 0)) AS odd FROM {events} GROUP BY event_type")
def _(e):
    return R.grouped(e.table("events"), ["event_type"], {"high": F.sum(F.when(F.col("value") > 50, 1).otherwise(0)), "odd": F.count(F.nullif(F.col("user_id") % 2, F.lit(0)))})


@query("a12_over_join", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c_mktsegment")
def _(e):
    return R.grouped(R.join(e.table("orders"), e.table("customer"), [("o_custkey", "c_custkey")]), ["c_mktsegment"], {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})


# -- windows ---------------------------------------------------------------------------------------------------------


@query("w1_row_number", "SELECT id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, id) AS r FROM {orders}")
def _(e):
    return e.table("orders").select("id", F.row_number().over(R.over(["o_custkey"], [("o_totalprice", "desc")], tie=True)).alias("r"))


@query("w2_rank", "SELECT id, rank() OVER w AS r, dense_rank() OVER w AS d FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def _(e):
    w = R.over(["p_brand"], [("p_size", "asc")])
    return e.table("part").select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("w3_whole_partition", "SELECT id, count(*) OVER w AS n, max(p_retailprice) OVER w AS top, round(avg(p_retailprice) OVER w, 4) AS a FROM {part} WINDOW w AS (PARTITION BY p_brand)")
def _(e):
    w = R.over(["p_brand"])
    return e.table("part").select("id", F.count("*").over(w).alias("n"), F.max("p_retailprice").over(w).alias("top"), F.round(F.avg("p_retailprice").over(w), 4).alias("a"))


@query("w4_cumulative", "SELECT id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS s FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_type)")
def _(e):
    w = R.over(["user_id"], [("event_type", "asc")])
    return e.table("events").select("id", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 2).alias("s"))


@query("w5_then_page", "SELECT id, r FROM (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS r FROM {events} WHERE value > 10) ORDER BY r DESC, id LIMIT 40 OFFSET 10")
def _(e):
    ranked = e.table("events").where("value > 10").withColumn("r", F.row_number().over(R.over(["user_id"], [("ts", "asc")], tie=True)))
    return R.page(ranked, 40, 10, [("r", "desc")]).select("id", "r")


@query("w6_nulls", "SELECT id, row_number() OVER (PARTITION BY nullif(p_size % 3, 0) ORDER BY nullif(p_brand, 'Brand#11') DESC NULLS FIRST, id) AS r FROM {part}")
def _(e):
    t = e.table("part").withColumn("g", F.nullif(F.col("p_size") % 3, F.lit(0))).withColumn("o", F.nullif("p_brand", F.lit("Brand#11")))
    return t.select("id", F.row_number().over(R.over(["g"], [("o", "desc")], tie=True)).alias("r"))


# -- joins -----------------------------------------------------------------------------------------------------------

for _name, _how in {"j1_inner": "inner", "j2_left": "left", "j3_right": "right", "j4_full": "full"}.items():
    query(_name, f"SELECT c.id AS cid, o.id AS oid, c_name, o_totalprice FROM (SELECT * FROM {{customer}} WHERE c_custkey % 3 <> 1) c {_how.upper()} JOIN (SELECT * FROM {{orders}} WHERE o_totalprice > 100000) o ON c.c_custkey = o.o_custkey")(
        lambda e, how=_how: R.join(
            e.table("customer").where("c_custkey % 3 <> 1").withColumnRenamed("id", "cid"), e.table("orders").where("o_totalprice > 100000").withColumnRenamed("id", "oid"), [("c_custkey", "o_custkey")], how
        ).select("cid", "oid", "c_name", "o_totalprice")
    )


@query(
    "j5_chain",
    "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey LEFT JOIN {region} r ON n_regionkey = r_regionkey GROUP BY ALL",
)
def _(e):
    j = R.join(e.table("orders").drop("id"), e.table("customer").drop("id"), [("o_custkey", "c_custkey")])
    j = R.join(j, e.table("nation").drop("id"), [("c_nationkey", "n_nationkey")])
    j = R.join(j, e.table("region").drop("id"), [("n_regionkey", "r_regionkey")], "left")
    return R.grouped(j, ["r_name", "n_name"], {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})


@query("j5_self", "SELECT a.id AS a, b.id AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey WHERE a.id < b.id")
def _(e):
    a, b = (e.table("supplier").select(F.col("id").alias(x), F.col("s_nationkey").alias(f"k{x}")) for x in "ab")
    return R.join(a, b, [("ka", "kb")]).where("a < b").select("a", "b")


@query("j6_residual", "SELECT l.id FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey WHERE (o_orderstatus IN ('F', 'P') OR o_orderpriority LIKE '%URGENT') AND l_shipdate > o_orderdate")
def _(e):
    j = R.join(e.table("lineitem"), e.table("orders").drop("id"), [("l_orderkey", "o_orderkey")])
    return j.where((F.col("o_orderstatus").isin("F", "P") | S.like(F.col("o_orderpriority"), "%URGENT")) & (F.col("l_shipdate") > F.col("o_orderdate"))).select("id")


@query("j7_order", "SELECT o.id, c_name FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey ORDER BY c_name DESC, o.id LIMIT 60 OFFSET 3")
def _(e):
    return R.page(R.join(e.table("orders"), e.table("customer").drop("id"), [("o_custkey", "c_custkey")]), 60, 3, [("c_name", "desc")]).select("id", "c_name")


@query("j11_semi", "SELECT id, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)")
def _(e):
    return R.in_subquery(e.table("customer"), "c_custkey", e.table("orders").where("o_totalprice > 200000").select("o_custkey")).select("id", "c_name")


@query("j12_anti", "SELECT id, c_name FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000)")
def _(e):
    return R.in_subquery(e.table("customer"), "c_custkey", e.table("orders").where("o_totalprice > 250000").select("o_custkey"), negate=True).select("id", "c_name")


@query("j9_key_classes", "SELECT n.id, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.id")
def _(e):
    """Integers of any width and ids are one class of keys."""
    return R.join(e.table("nation"), e.table("region").withColumnRenamed("id", "rid"), [("n_regionkey", "rid")]).select("id", "r_name")


@query("j10_output_order", "SELECT c.id AS cid, s.id AS sid FROM {customer} c FULL JOIN {supplier} s ON c.c_nationkey = s.s_nationkey ORDER BY c.id NULLS LAST, s.id NULLS LAST LIMIT 500")
def _(e):
    """The first rows of a join are those of its scan order, padded rows last."""
    return e.sql("SELECT c.id AS cid, s.id AS sid FROM customer c FULL OUTER JOIN supplier s ON c.c_nationkey = s.s_nationkey LIMIT 500")


# -- subqueries, sets ------------------------------------------------------------------------------------------------


@query("q2_not_in_null", "SELECT id FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {orders})")
def _(e):
    return R.in_subquery(e.table("customer"), "c_custkey", e.table("orders").select(F.nullif("o_custkey", F.lit(1)).alias("x")), negate=True).select("id")


@query("q3_exists", "SELECT id FROM {nation} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_totalprice > 1000) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_totalprice < 0)")
def _(e):
    return R.exists(R.exists(e.table("nation"), e.table("orders").where("o_totalprice > 1000")), e.table("orders").where("o_totalprice < 0"), negate=True).select("id")


@query("q4_scalar_where", "SELECT id FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
def _(e):
    o = e.table("orders")
    return R.scalar_subquery(o, o.agg((F.avg("o_totalprice") * 1.5).alias("m")), "m").where("o_totalprice > m").select("id")


@query("q5_scalar_select", "SELECT id, n_name, (SELECT max(c_acctbal) FROM {customer}) AS top FROM {nation}")
def _(e):
    return R.scalar_subquery(e.table("nation"), e.table("customer").agg(F.max("c_acctbal").alias("m")), "top").select("id", "n_name", "top")


@query("q6_cte", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
def _(e):
    e.create_view("big", lambda s: s.table("orders").where("o_totalprice > 150000"))
    e.create_view("per", lambda s: R.grouped(s.table("big"), ["o_custkey"], {"n": F.count("*")}))
    return R.grouped(e.table("per"), ["n"], {"customers": F.count("*")})


for _name, (_kind, _word) in {"q7_union_all": ("union_all", "UNION ALL"), "q8_union": ("union", "UNION"), "q9_intersect": ("intersect", "INTERSECT"), "q10_except": ("except", "EXCEPT")}.items():
    query(_name, f"SELECT c_nationkey AS k FROM {{customer}} WHERE c_acctbal > 3000 {_word} SELECT nullif(s_nationkey, 7) FROM {{supplier}} WHERE s_acctbal > 3000")(
        lambda e, kind=_kind: R.set_op(kind, e.table("customer").where("c_acctbal > 3000").select(F.col("c_nationkey").alias("k")), e.table("supplier").where("s_acctbal > 3000").select(F.nullif("s_nationkey", F.lit(7))))
    )


@query("q11_branches", "(SELECT id FROM {orders} ORDER BY o_totalprice DESC NULLS FIRST, id LIMIT 10) UNION ALL (SELECT id FROM {orders} ORDER BY o_totalprice, id LIMIT 10 OFFSET 2)")
def _(e):
    o = e.table("orders")
    return R.set_op("union_all", R.page(o, 10, 0, [("o_totalprice", "desc")]).select("id"), R.page(o, 10, 2, [("o_totalprice", "asc")]).select("id"))


# -- retrieval -------------------------------------------------------------------------------------------------------


@query("v1_knn", f"SELECT id, round({_dot(PROBE)}, 6) AS score FROM {{embeddings}} ORDER BY {_dot(PROBE)} DESC, id LIMIT 10")
def _(e):
    return V.knn(e.table("embeddings"), PROBE, 10).select("id", F.round("score", 6).alias("score"))


@query("v2_filtered_knn", f"SELECT id, label, round({_dot(PROBE)}, 6) AS score FROM {{embeddings}} WHERE label = 3 ORDER BY {_dot(PROBE)} DESC, id LIMIT 10")
def _(e):
    return V.knn(e.table("embeddings").where("label = 3"), PROBE, 10, keep=("id", "label")).select("id", "label", F.round("score", 6).alias("score"))


@query("v3_post_filter", f"SELECT id FROM (SELECT id, label FROM {{embeddings}} ORDER BY {_dot(PROBE)} DESC, id LIMIT 50) WHERE label = 3")
def _(e):
    return V.knn(e.table("embeddings"), PROBE, 50, keep=("id", "label")).where("label = 3").select("id")


@query("v4_subset", f"SELECT id FROM {{embeddings}} WHERE id IN (SELECT doc_id FROM {{labels}} WHERE quality = 1) ORDER BY {_dot(PROBE)} DESC, id LIMIT 10")
def _(e):
    ids = e.table("labels").where("quality = 1").select("doc_id")
    return V.knn(R.in_subquery(e.table("embeddings"), "id", ids), PROBE, 10).select("id")


@query(
    "v6_batch_knn",
    "SELECT qid, id, rank FROM (SELECT q.id AS qid, v.id, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.id) AS rank FROM {embeddings} v, {embeddings} q WHERE q.id % 20 = 0) WHERE rank <= 10",
)
def _(e):
    """Every twentieth vector against all."""
    v = e.table("embeddings")
    return V.knn_join(v, v.where("id % 20 = 0"), 10).select("qid", "id", F.col("rank").cast("long").alias("rank"))


_SCALES = (
    "spot AS (SELECT id, unnest(range(1, 65)) AS d, unnest(embedding::DOUBLE[]) AS x FROM {embeddings}), sc AS (SELECT d, (max(abs(x)) / 127)::FLOAT::DOUBLE AS s FROM spot GROUP BY d), "
    "code AS (SELECT id, d, s, CASE WHEN s = 0 THEN 0 ELSE greatest(-127, least(127, round(x / s))) END::TINYINT AS c FROM spot JOIN sc USING (d))"
)


@query("v10_sq8", f"WITH {_SCALES} SELECT id, list(c ORDER BY d) AS code FROM code GROUP BY id")
def _(e):
    v = e.table("embeddings")
    return v.select("id", V.quantize(F.col("embedding"), V.fit_scales(v)).alias("code"))


@query("v10_decode_dot", f"WITH {_SCALES}, q AS (SELECT unnest(range(1, 65)) AS d, unnest({_list(PROBE)}) AS y) SELECT id, round(sum(c * s * y), 6) AS score FROM code JOIN q USING (d) GROUP BY id")
def _(e):
    v = e.table("embeddings")
    scales = V.fit_scales(v)
    return v.select("id", F.round(V.decode_dot(V.quantize(F.col("embedding"), scales), scales, PROBE), 6).alias("score"))


_TERMS = V.query_terms(TEXT)
_BM25 = (
    "tok AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM {documents}), len AS (SELECT id, t, len(t) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len), "
    f"tf AS (SELECT id, dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM len, (SELECT unnest({_TERMS}) AS term)), "
    "df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term), "
    "bm AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY id)"
)


@query("t2_bm25", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0")
def _(e):
    return e.bm25("documents", "text", TEXT).select("id", F.round("score", 6).alias("score"))


@query("t3_bm25_within", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0".replace("{documents}", "(SELECT * FROM {documents} WHERE lang = 'de')"))
def _(e):
    return e.bm25("documents", "text", TEXT, e.table("documents").where("lang = 'de'")).select("id", F.round("score", 6).alias("score"))


@query("t1_tokens", "SELECT id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::INTEGER AS n, regexp_extract_all(lower(text), '[a-z0-9_]+')[1] AS first FROM {documents}")
def _(e):
    t = V.tokens(F.col("text"))
    return e.table("documents").select("id", F.size(t).alias("n"), F.try_element_at(t, F.lit(1)).alias("first"))


_POOLS = (
    f"{_BM25}, dense AS (SELECT id, {_dot(PROBE)} AS score FROM {{embeddings}}), "
    "dp AS (SELECT id, count(*) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, rank() OVER (ORDER BY score DESC) AS k FROM dense), "
    "sp AS (SELECT id, count(*) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, rank() OVER (ORDER BY score DESC) AS k FROM bm WHERE score > 0), "
    "fused AS (SELECT id, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score FROM (SELECT * FROM dp WHERE k <= 200) a FULL JOIN (SELECT * FROM sp WHERE k <= 200) b USING (id) ORDER BY score DESC, id LIMIT 20)"
)


def _fused(e):
    return V.rrf(V.scored(e.table("embeddings"), PROBE), e.bm25("documents", "text", TEXT), 20)


@query("h1_rrf", f"WITH {_POOLS} SELECT id, round(score, 9) AS score FROM fused")
def _(e):
    return _fused(e).select("id", F.round("score", 9).alias("score"))


@query(
    "t4_tie_pool",
    "SELECT id, r::BIGINT AS rank FROM (SELECT id, rank() OVER (ORDER BY p_size DESC) AS k, count(*) OVER (ORDER BY p_size DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM {part}) WHERE k <= 10",
)
def _(e):
    """A pool of ten takes all hits that tie with the tenth, and all of a tie have its last rank."""
    return V.pool(e.table("part").select("id", F.col("p_size").cast("double").alias("score")), 10).select("id", F.col("rank").cast("long").alias("rank"))


@query("r2_identity", f"WITH {_POOLS} SELECT id, round(score, 9) AS score FROM fused ORDER BY score DESC, id LIMIT 7")
def _(e):
    return V.rerank(_fused(e), None, 7).select("id", F.round("score", 9).alias("score"))


@query("r4_cross_encoder", f"WITH {_POOLS} SELECT f.id, length(text)::DOUBLE / 7 AS score FROM fused f JOIN {{documents}} d ON f.id = d.id ORDER BY score DESC, f.id LIMIT 5")
def _(e):
    """A model plugs in as a function of pairs, here one that prefers long texts."""
    hits = _fused(e).join(e.table("documents").select("id", "text"), "id")
    return V.rerank(hits, V.cross_encoder(lambda q, texts: [len(t) / 7 for t in texts], 4)(TEXT), 5).select("id", "score")


@query("b1_boost_ids", f"WITH {_POOLS} SELECT id, round(score + CASE WHEN id IN (SELECT doc_id FROM {{labels}} WHERE quality = 1) THEN 0.5 ELSE 0 END, 9) AS score FROM fused")
def _(e):
    ids = e.table("labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return V.boost_ids(_fused(e), ids, 0.5).select("id", F.round("score", 9).alias("score"))


@query("b3_hints", f"WITH {_POOLS} SELECT f.id, round(score + CASE WHEN contains(source, 'c1') THEN 0.01 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.01 ELSE 0 END, 9) AS score FROM fused f JOIN {{documents}} d ON f.id = d.id")
def _(e):
    """A planner's hints: the path holds a text, the kind is equal."""
    hits = _fused(e).join(e.table("documents").select("id", F.col("source").alias("path"), F.col("lang").alias("kind")), "id")
    return V.boost(hits, Expansion(("x",), "c1", "en").boosts(hits.columns)).select("id", F.round("score", 9).alias("score"))


@query("v7_batch_window", f"WITH q(qid, v) AS (VALUES " + ", ".join(f"({q}, {_list(v)})" for q, v in PROBES.items()) + ") SELECT qid::BIGINT AS qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(embedding::DOUBLE[], v) DESC, id) AS rank FROM {embeddings}, q) WHERE rank <= 3")
def _(e):
    """Queries that wait are answered together, here in windows of five."""
    window = V.BatchWindow(e.table("embeddings"), 3, 5)
    out = None
    for q, v in PROBES.items():
        for done in [window.add(q, v), window.flush() if q == max(PROBES) else None]:
            out = done if out is None else out if done is None else out.union(done)
    return out.select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query("b1_boost", f"WITH {_POOLS} SELECT f.id, round(score + CASE WHEN lang = 'fr' THEN 0.01 ELSE 0 END + CASE WHEN starts_with(source, 'src1') THEN 0.005 ELSE 0 END, 9) AS score FROM fused f JOIN {{documents}} d ON f.id = d.id")
def _(e):
    hits = _fused(e).join(e.table("documents").select("id", "lang", "source"), "id")
    return V.boost(hits, [("lang", "equals", "fr", 0.01), ("source", "starts_with", "src1", 0.005)]).select("id", F.round("score", 9).alias("score"))


@query("g2_gate", f"SELECT id, round(s, 6) AS score FROM (SELECT id, {_dot(PROBE)} AS s, row_number() OVER (ORDER BY {_dot(PROBE)} DESC, id) AS r, max({_dot(PROBE)}) OVER () AS top FROM {{embeddings}}) WHERE top >= 0.5 AND s >= 0.5 AND r <= 5")
def _(e):
    return V.gate(V.knn(e.table("embeddings"), PROBE, 10), least=0.5, margin=0.0, most=5).select("id", F.round("score", 6).alias("score"))


@query("g3_confidence", f"WITH {_POOLS} SELECT id, round(score / (2.0::DOUBLE / 61), 9) AS confidence FROM fused")
def _(e):
    return _fused(e).select("id", F.round(V.rrf_confidence(F.col("score")), 9).alias("confidence"))


@query(
    "r3_rerank",
    f"WITH {_POOLS}, h AS (SELECT f.id, score, len(list_filter({_TERMS}, lambda w: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), w))) AS o FROM fused f JOIN {{documents}} d ON f.id = d.id), "
    "k AS (SELECT id, count(*) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, count(*) OVER (ORDER BY o DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM h) SELECT id, round(3.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 9) AS score FROM k",
)
def _(e):
    hits = _fused(e).join(e.table("documents").select("id", "text"), "id")
    return V.rerank_lexical(hits, TEXT).select("id", F.round("score", 9).alias("score"))


# -- ingest ----------------------------------------------------------------------------------------------------------


@query(
    "i1_chunks",
    r"""WITH l AS (SELECT id, string_split(text, chr(10)) AS l FROM {documents}), c AS (SELECT id, l, unnest(range(0, (len(l) - 1) // 60 + 1)) AS chunk FROM l)
    SELECT id, chunk::INTEGER AS chunk, (chunk * 60 + 1)::INTEGER AS start_line, least((chunk + 1) * 60, len(l))::INTEGER AS end_line, md5(body) AS digest
    FROM (SELECT *, regexp_replace(array_to_string(l[chunk * 60 + 1:chunk * 60 + 60], chr(10)), '^\s+|\s+$', '', 'g') AS body FROM c) WHERE body <> ''""",
)
def _(e):
    return ingest.chunk_lines(e.table("documents").select("id", "text")).select("id", "chunk", "start_line", "end_line", F.md5("body").alias("digest"))


_FNV = "list_reduce(list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::INTEGER, 2))::UHUGEINT), lambda a, b: xor(a, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


@query(
    "i4_hash_embedding",
    f"""WITH t AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM {{benchmark}}), h AS (SELECT t, {_FNV} AS h FROM (SELECT DISTINCT t FROM t)),
    v AS (SELECT id, (h % 64)::INTEGER AS b, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1.0 ELSE 1.0 END::DOUBLE) AS x FROM t JOIN h USING (t) GROUP BY ALL), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM v GROUP BY id)
    SELECT id, list(round(coalesce(x / nullif(n, 0), 0), 5) ORDER BY d) AS embedding FROM (SELECT n.id, d, v.x, n.n FROM n, range(64) AS r(d) LEFT JOIN v ON v.id = n.id AND v.b = d) GROUP BY id""",
)
def _(e):
    made = ingest.embed(e.table("benchmark").select("id", F.col("text").alias("body")))
    return made.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query("i5_embedder", "SELECT id, [length(text)::DOUBLE, length(regexp_replace(lower(text), '[^aeiou]', '', 'g'))::DOUBLE] AS embedding FROM {benchmark}")
def _(e):
    """An embedder of one's own, in batches of five."""
    own = lambda texts: [(len(t), sum(c in "aeiou" for c in t.lower())) for t in texts]
    made = ingest.embed(e.table("benchmark").select("id", F.col("text").alias("body")), 2, embedder=own, batch=5)
    return made.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


@query("i3_chunk_file", """SELECT id, 0 AS chunk, CASE WHEN id % 2 = 0 THEN '# ' || n_name || chr(10) || 'md' ELSE n_name || chr(10) || '# no heading' END AS body FROM {nation}
    UNION ALL SELECT id, 1, '## Two' || chr(10) || 'more' FROM {nation} WHERE id % 2 = 0""")
def _(e):
    """Markdown by headings, everything else by lines, told by the path."""
    n = e.table("nation")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("# "), "n_name", F.lit("\nmd\n\n## Two\nmore\n"))).otherwise(F.concat("n_name", F.lit("\n# no heading")))
    files = n.select("id", F.concat("n_name", F.when(F.col("id") % 2 == 0, ".MD").otherwise(".txt")).alias("path"), text.alias("text"))
    return ingest.chunk_file(files).select("id", "chunk", "body")


@query("i6_symbols", "SELECT id, 'fn' AS kind, 'do_' || lower(n_name) AS name FROM (SELECT id, replace(n_name, ' ', '_') AS n_name FROM {nation}) UNION ALL SELECT id, 'struct', 'S' || id FROM {nation}")
def _(e):
    source = F.concat(F.lit("// fn not_this()\npub async fn do_"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("() {}\npub(crate) struct S"), "id", F.lit(";\n"))
    return ingest.symbols(e.table("nation").select("id", source.alias("text")), "id")


_STOPPED = ", ".join(f"'{w}'" for w in ingest.STOP_WORDS)


@query(
    "i6_term_index",
    f"SELECT term, count(*) AS n FROM (SELECT substr(lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))), 1, 64) AS term FROM {{documents}}) WHERE length(term) >= 3 AND term NOT IN ({_STOPPED}) GROUP BY term ORDER BY n DESC, term LIMIT 300",
)
def _(e):
    return ingest.term_index(e.table("documents"))


@query(
    "i6_file_tree",
    r"""WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS p FROM {pages}), f AS (SELECT p, regexp_extract(p, '([^/\\]*)$', 1) AS f FROM p),
    e AS (SELECT 'extension' AS kind, CASE WHEN regexp_matches(f, '^.+\.[^.]+$') THEN lower(regexp_extract(f, '\.([^.]+)$', 1)) ELSE '(none)' END AS name FROM f
    UNION ALL SELECT 'top_dir', CASE WHEN regexp_matches(p, '^[^/\\]+[/\\]') THEN regexp_extract(p, '^([^/\\]+)', 1) ELSE '(root)' END FROM f)
    SELECT kind, name, count(*) AS n FROM e GROUP BY ALL""",
)
def _(e):
    return ingest.file_tree(e.table("pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


# -- functions of users, policy ---------------------------------------------------------------------------------------


@query("u1_macro", "SELECT id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * label + 1, 6) AS y FROM {embeddings} WHERE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * label + 1 > 2")
def _(e):
    e.create_function("f", lambda v, s: S.vec_norm(v) * s + 1)
    y = e.functions["f"](F.col("embedding"), F.col("label"))
    return e.table("embeddings").where(y > 2).select("id", F.round(y, 6).alias("y"))


@query("u3_python_function", "SELECT id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + CASE WHEN label > 2 THEN label ELSE NULL END, 5) AS y FROM {embeddings}")
def _(e):
    """A function of a vector and a number in Python, over visible rows only; a null in gives a null."""
    e.create_function("norm_plus", python_function(lambda v, s: float((v * v).sum() ** 0.5) + s))
    big = F.when(F.col("label") > 2, F.col("label"))
    return e.table("embeddings").select("id", F.round(e.functions["norm_plus"](F.col("embedding"), big), 5).alias("y"))


@query("u2_in_aggregate", "SELECT label, round(sum(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * label + 1), 4) AS total FROM {embeddings} GROUP BY label HAVING sum(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * label + 1) > 10")
def _(e):
    return e.sql("CREATE FUNCTION f(v, s) AS vec_norm(v) * s + 1; SELECT label, round(SUM(f(embedding, label)), 4) AS total FROM embeddings GROUP BY label HAVING SUM(f(embedding, label)) > 10")


@query("l2_recheck", "SELECT id FROM {nation} WHERE id < 5")
def _(e):
    """The safety net after ranking takes out what shouldn't have come so far, and nothing else."""
    key = F.struct("id", F.when(F.col("id") < 5, "tenant-a").otherwise("tenant-b").alias("_tenant_id"), F.when(F.col("id") % 2 == 0, "private").when(F.col("id") < 5, "public").otherwise("private").alias("_visibility"))
    return e.policy.recheck(e.table("nation").select(key.alias("id")), "id").select("id.id")


@query("l1_visible", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM {orders}")
def _(e):
    return e.table("orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("l1_other_tenant", "SELECT count(*) AS n, sum((o_orderkey % 10 = 9)::INT)::BIGINT AS own FROM orders")
def _(e):
    other = Engine(e.resolve, Policy("tenant-b"))
    return other.table("orders").agg(F.count("*").alias("n"), F.sum((F.col("id") % 10 == 9).cast("int")).alias("own"))


@query("l1_anonymous", "SELECT count(*) AS n FROM {orders}")
def _(e):
    return Engine(e.resolve, ANONYMOUS).table("orders").agg(F.count("*").alias("n"))
