"""Registered queries written in the dialect: the text goes through the parser, the oracle says the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corviq.errors import EngineError
from corviq.functions import scalar as S
from corviq.operators import ann
from corviq.operators import retrieval as V
from corviq.plans import planner
from corviq.queries import _POOLS, DIM, PROBE, TEXT, _dot, query
from corviq.sources import ingest

VEC = "[" + ",".join(map(repr, PROBE)) + "]"

_TEXTS: dict[str, tuple[str, str]] = {
    "sql_scan": (
        "SELECT id, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 7",
        "SELECT id, o_totalprice / 2 AS half FROM {orders} WHERE o_totalprice > 150000 AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 200 OFFSET 7",
    ),
    "sql_order_by_expression": (
        "SELECT id, p_name FROM part ORDER BY CASE WHEN p_size > 25 THEN 1 ELSE 0 END DESC, length(p_name) LIMIT 40",
        "SELECT id, p_name FROM {part} ORDER BY CASE WHEN p_size > 25 THEN 1 ELSE 0 END DESC, length(p_name), id LIMIT 40",
    ),
    "sql_predicates": (
        "SELECT id FROM part WHERE (p_size BETWEEN 5 AND 25 OR p_brand IN ('Brand#11', 'Brand#22')) AND NOT p_type LIKE 'PROMO%' AND p_name IS NOT NULL AND p_retailprice * 2 > 1900",
        "SELECT id FROM {part} WHERE (p_size BETWEEN 5 AND 25 OR p_brand IN ('Brand#11', 'Brand#22')) AND NOT p_type LIKE 'PROMO%' AND p_name IS NOT NULL AND p_retailprice * 2 > 1900",
    ),
    "sql_functions": (
        "SELECT id, upper(n_name) AS up, substr(n_name, 2, 3) AS mid, position('A' IN n_name) AS at, concat(n_name, NULL, '-', n_regionkey) AS joined, coalesce(nullif(n_name, 'CHINA'), 'none') AS c, mod(n_nationkey, 7) AS m FROM nation",
        "SELECT id, upper(n_name) AS up, substr(n_name, 2, 3) AS mid, strpos(n_name, 'A')::DOUBLE AS at, concat(n_name, NULL, '-', n_regionkey) AS joined, coalesce(nullif(n_name, 'CHINA'), 'none') AS c, (n_nationkey % 7)::INTEGER AS m FROM {nation}",
    ),
    "sql_dates": (
        "SELECT id, EXTRACT(dow FROM ts) AS dow, date_part('isodow', ts) AS isodow, date_trunc('week', ts) AS week FROM events WHERE ts >= TIMESTAMP '2020-01-01 00:00:00'",
        "SELECT id, date_part('dow', ts)::DOUBLE AS dow, date_part('isodow', ts)::DOUBLE AS isodow, date_trunc('week', ts)::TIMESTAMP AS week FROM {events} WHERE ts >= TIMESTAMP '2020-01-01 00:00:00'",
    ),
    "sql_group_by": (
        "SELECT o_orderpriority, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers, round(AVG(o_totalprice), 2) AS a, SUM(o_orderkey) AS s FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority HAVING n > 5 AND MAX(o_totalprice) > 2000 ORDER BY n DESC LIMIT 3",
        "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS a, sum(o_orderkey)::BIGINT AS s FROM {orders} WHERE o_totalprice > 1000 GROUP BY o_orderpriority HAVING count(*) > 5 AND max(o_totalprice) > 2000 ORDER BY n DESC, o_orderpriority LIMIT 3",
    ),
    "sql_aggregate": (
        "SELECT COUNT(*) AS n, SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big, MIN(l_shipdate) AS first, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem",
        "SELECT count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS big, min(l_shipdate) AS first, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem}",
    ),
    "sql_distinct": ("SELECT DISTINCT p_brand, p_size FROM part ORDER BY p_size DESC LIMIT 30", "SELECT DISTINCT p_brand, p_size FROM {part} ORDER BY p_size DESC NULLS FIRST, p_brand, p_size LIMIT 30"),
    "sql_window": (
        "SELECT id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
        "SELECT id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, id) AS r, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}",
    ),
    "sql_join": (
        "SELECT c.c_name, o.o_orderkey, n.n_name AS nation FROM orders o JOIN customer AS c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 200000 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c.c_name DESC, o.o_orderkey LIMIT 100",
        "SELECT c.c_name, o.o_orderkey, n.n_name AS nation FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 200000 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c.c_name DESC NULLS FIRST, o.o_orderkey LIMIT 100",
    ),
    "sql_join_aggregate": (
        "SELECT r_name, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "sql_full_join": (
        "SELECT c.id AS cid, s.id AS sid FROM customer c FULL OUTER JOIN supplier s ON c.c_nationkey = s.s_nationkey",
        "SELECT c.id AS cid, s.id AS sid FROM {customer} c FULL JOIN {supplier} s ON c.c_nationkey = s.s_nationkey",
    ),
    "sql_subqueries": (
        "SELECT id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND EXISTS (SELECT id FROM region) AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
        "SELECT id, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000) AND c_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal < 0) AND EXISTS (SELECT id FROM {region}) AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer})",
    ),
    "sql_in_or": (
        "SELECT id FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) OR c_acctbal < -900",
        "SELECT id FROM {customer} WHERE c_nationkey IN (SELECT s_nationkey FROM {supplier}) OR c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 1000) OR c_acctbal < -900",
    ),
    "sql_scalar_projection": ("SELECT id, (SELECT MAX(c_acctbal) FROM customer) AS top FROM nation", "SELECT id, (SELECT max(c_acctbal) FROM {customer}) AS top FROM {nation}"),
    "sql_cte": (
        "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n",
        "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n",
    ),
    "sql_set_operations": (
        "(SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier)",
        "SELECT c_nationkey FROM ((SELECT c_nationkey FROM {customer} WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM {supplier}) UNION ALL (SELECT n_nationkey FROM {nation} INTERSECT SELECT s_nationkey FROM {supplier}))",
    ),
    "sql_knn": (f"SELECT id, label FROM embeddings WHERE label <> 3 ORDER BY embedding <=> '{VEC}' LIMIT 10", f"SELECT id, label, round({_dot(PROBE)}, 6) AS score FROM {{embeddings}} WHERE label <> 3 ORDER BY {_dot(PROBE)} DESC, id LIMIT 10"),
    "sql_knn_hint": (
        f"SELECT id, label FROM embeddings WHERE label = 3 ORDER BY embedding <=> '{VEC}' LIMIT 50 HINT ORDER(RLS, DISTANCE, SCALAR)",
        f"SELECT id, label, round(s, 6) AS score FROM (SELECT id, label, {_dot(PROBE)} AS s FROM {{embeddings}} ORDER BY s DESC, id LIMIT 50) WHERE label = 3",
    ),
}

for _name, (_text, _sql) in _TEXTS.items():
    if _name.startswith("sql_knn"):
        query(_name, _sql)(lambda e, t=_text: (lambda df: df.withColumn("score", F.round("score", 6)))(e.sql(t)))
    else:
        query(_name, _sql)(lambda e, t=_text: e.sql(t))


@query("sql_params", "SELECT id FROM {orders} WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def _(e):
    return e.sql("SELECT id FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2", 250000, "F")


@query("sql_function", "SELECT id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * label + 1, 6) AS y FROM {embeddings} ORDER BY sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * label + 1 DESC, id LIMIT 25")
def _(e):
    return e.sql("CREATE FUNCTION f(v, s) AS vec_norm(v) * s + 1; SELECT id, round(f(embedding, label), 6) AS y FROM embeddings ORDER BY f(embedding, label) DESC LIMIT 25")


@query("sql_view", "SELECT c_nationkey, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey")
def _(e):
    return e.sql("CREATE VIEW rich AS SELECT id, c_nationkey FROM customer WHERE c_acctbal > 5000; SELECT c_nationkey, COUNT(*) AS n FROM rich GROUP BY c_nationkey")


@query("sql_copy_out", "SELECT concat_ws(',', n_nationkey::VARCHAR, n_name) AS line FROM {nation}")
def _(e):
    return e.sql("COPY (SELECT n_nationkey, n_name FROM nation) TO STDOUT (FORMAT csv)")


@query("sql_hybrid", f"WITH {_POOLS} SELECT id, round(score, 9) AS score FROM fused")
def _(e):
    """The vectors and texts of one table: embeddings with the documents of the same id."""
    e.create_view("docs", lambda s: s.table("embeddings").select("id", "embedding").join(s.table("documents").select("id", "text"), "id", "full"))
    return e.sql(f"SELECT id FROM docs ORDER BY hybrid_rrf(embedding, '{VEC}', text, '{TEXT}') LIMIT 20").withColumn("score", F.round("score", 9))


@query("v9_inverted_file")
def _(e):
    """Approximate search of every twentieth vector among all: the fitted lists are probed, scores are exact; recall is
    measured in the tests."""
    vectors = e.table("embeddings")
    coarse = ann.fit(vectors)
    index = ann.assign(vectors, coarse)
    found = ann.search_join(index, coarse, vectors.where("id % 20 = 0"), 10, ann.tune(index, coarse))
    return found.select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query("i2_markdown_chunks")
def _(e):
    return ingest.chunk_markdown(e.table("documents").select("id", "text"), "id")


_CUES, _OTHER = "|".join(c for c in planner.CUES if c.isascii()), "|".join(c for c in planner.CUES if not c.isascii())


@query(
    "i9_tiers",
    f"""WITH q AS (SELECT item_id AS id, text, list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(regexp_replace(regexp_replace(w, '^[?!,;:''"`()\\[\\]{{}}<>]+', ''), '[?!,;:''"`()\\[\\]{{}}<>.]+$', ''), '(.)(n''t|''re|''ve|''ll|''s|''d|''m)$', '\\1')), lambda w: w <> '') AS w FROM {{benchmark}}),
    c AS (SELECT id, CASE WHEN len(w) = 0 OR length(text) > 2000 OR len(w) > 256 THEN 'intent' WHEN len(list_filter(w, lambda x: regexp_matches(x, '\\.({'|'.join(planner.EXTENSIONS)})$'))) > 0 THEN 'direct'
    WHEN len(list_filter(w, lambda x: regexp_full_match(x, '{_CUES}'))) > 0 OR regexp_matches(text, '{_OTHER}') THEN 'abstraction' WHEN list_contains(w, 'onrein') THEN 'direct' ELSE 'intent' END AS class FROM q)
    SELECT id, class, CASE WHEN class = 'direct' THEN 'dialogue' ELSE 'high_precision' END AS tier FROM c""",
)
def _(e):
    kind = planner.class_column(F.col("text"), symbols=["Onrein"])
    return e.table("benchmark").select("id", kind.alias("class"), planner.tier_column(kind).alias("tier"))


def codes(name: str, cases: dict[str, tuple[str, str]]):
    """A row per statement of the dialect with the code that it ends with."""
    values = ", ".join(f"('{k}', '{want}')" for k, (_, want) in cases.items())

    @query(name, f"SELECT * FROM (VALUES {values}) AS t(\"case\", code)")
    def _(e):
        out = []
        for k, (text, _) in cases.items():
            try:
                e.sql(text)
                out.append((k, "ok"))
            except EngineError as x:
                out.append((k, x.code))
        return e.spark.createDataFrame(out, "`case` string, code string")


codes(
    "a2_types",
    {
        "sum of text": ("SELECT SUM(n_name) FROM nation", "42804"), "avg of text": ("SELECT AVG(n_name) FROM nation", "42804"), "min of text": ("SELECT MIN(n_name) AS m FROM nation", "ok"),
        "sum of dates": ("SELECT SUM(ts) FROM events", "42804"), "max of dates": ("SELECT MAX(ts) AS m FROM events", "ok"), "max of vectors": ("SELECT MAX(embedding) FROM embeddings", "42804"),
        "count of vectors": ("SELECT COUNT(embedding) AS n FROM embeddings", "ok"), "sum of booleans": ("SELECT SUM(n_name = 'x') FROM nation", "42804"), "avg of integers": ("SELECT AVG(n_regionkey) AS a FROM nation", "ok"),
        "distinct sum": ("SELECT SUM(DISTINCT n_regionkey) FROM nation", "42601"), "star sum": ("SELECT SUM(*) FROM nation", "42601"), "two arguments": ("SELECT SUM(id, id) FROM nation", "42883"),
    },
)
codes(
    "q12_strict_types",
    {
        "number and text": ("SELECT n_regionkey FROM nation UNION SELECT r_name FROM region", "42804"), "int and bigint": ("SELECT n_regionkey FROM nation UNION SELECT id FROM region", "42804"),
        "number of columns": ("SELECT id, n_name FROM nation UNION SELECT id FROM region", "42601"), "text and text": ("SELECT n_name FROM nation INTERSECT SELECT r_name FROM region", "ok"),
        "date and text": ("SELECT ts FROM events EXCEPT SELECT n_name FROM nation", "42804"),
    },
)
codes(
    "j9_refused",
    {
        "double keys": ("SELECT a.id FROM customer a JOIN customer b ON a.c_acctbal = b.c_acctbal", "42804"), "int and text": ("SELECT a.id FROM nation a JOIN region b ON a.n_name = b.r_regionkey", "42804"),
        "vectors": ("SELECT a.id FROM embeddings a JOIN embeddings b ON a.embedding = b.embedding", "42804"), "timestamps": ("SELECT a.id FROM events a JOIN events b ON a.ts = b.ts", "ok"), "int and id": ("SELECT a.id FROM nation a JOIN region b ON a.n_regionkey = b.id", "ok"),
    },
)
codes(
    "f25_refused",
    {"now": ("SELECT now() FROM nation", "42883"), "random": ("SELECT random() FROM nation", "42883"), "current_date": ("SELECT current_date() FROM nation", "42883"), "a known one": ("SELECT abs(id) AS a FROM nation", "ok")},
)


@query("p17_visible", "SELECT id FROM {nation} WHERE n_regionkey = 1")
def _(e):
    return e.sql("SELECT id FROM nation WHERE visible() AND n_regionkey = 1")


@query("f24_jsonb", """SELECT id, '{"a":[1,' || coalesce(json_extract(props, '$.k')::VARCHAR, 'null') || '],"z":' || id || '}' AS doc FROM {events}""")
def _(e):
    """Canonical text: keys sorted, no blanks."""
    page = F.coalesce(S.json_text(F.col("props"), "$.k"), F.lit("null"))
    doc = F.concat(F.lit('{ "z" : '), "id", F.lit(' , "a": [ 1, '), page, F.lit(" ] }"))
    return e.table("events").select("id", S.jsonb(doc).alias("doc"))


@query(
    "g1_modes",
    "SELECT clause, session, planner, coalesce(clause, session, planner, 'recall') AS mode, CASE WHEN clause IS NOT NULL THEN 'clause' WHEN session IS NOT NULL THEN 'session' WHEN planner IS NOT NULL THEN 'planner' ELSE 'default' END AS source"
    " FROM (VALUES (NULL), ('recall'), ('precision')) a(clause), (VALUES (NULL), ('recall'), ('precision')) b(session), (VALUES (NULL), ('recall'), ('precision')) c(planner)",
)
def _(e):
    modes, rows = (None, "recall", "precision"), []
    for clause in modes:
        for e.mode in modes:
            rows += [(clause, e.mode, planned, *e.resolve_mode(clause, planned)) for planned in modes]
    e.mode = None
    return e.spark.createDataFrame(rows, "clause string, session string, planner string, mode string, source string")


_ANSWERS = {
    "plain": ('{"search_terms": ["a", "b"], "path_hint": "src/", "kind_hint": null, "mode": "precision"}', "a b|src/|-|precision"), "with talk": ('Sure! {"search_terms": [], "path_hint": null, "kind_hint": "fn"} Bye.', "|-|fn|-"),
    "odd mode": ('{"search_terms": ["x"], "path_hint": null, "kind_hint": null, "mode": 3}', "x|-|-|-"), "no object": ("none", "22000"), "no hints": ('{"search_terms": ["x"]}', "22000"), "terms no list": ('{"search_terms": "x", "path_hint": null, "kind_hint": null}', "22000"),
    "long term": ('{"search_terms": ["' + "t" * 129 + '"], "path_hint": null, "kind_hint": null}', "22000"), "too many": ('{"search_terms": [' + ", ".join(['"t"'] * 33) + '], "path_hint": null, "kind_hint": null}', "22000"),
    "control": ('{"search_terms": ["a\\u0000"], "path_hint": null, "kind_hint": null}', "22000"), "hint no text": ('{"search_terms": ["a"], "path_hint": 1, "kind_hint": null}', "22000"),
}


@query("i7_expansion", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{want}')" for k, (_, want) in _ANSWERS.items()) + ') AS t("case", found)')
def _(e):
    """What a model may answer, and what is refused."""
    rows = []
    for k, (answer, _) in _ANSWERS.items():
        try:
            x = planner.parse_expansion(answer)
            rows.append((k, "|".join([" ".join(x.search_terms), *(h or "-" for h in (x.path_hint, x.kind_hint, x.mode_hint))])))
        except EngineError as err:
            rows.append((k, err.code))
    return e.spark.createDataFrame(rows, "`case` string, found string")


@query("r1_contract", "SELECT * FROM (VALUES ('foreign id', '22000'), ('id twice', '22000'), ('not finite', '22000'), ('pool too large', '54000'), ('cut too large', '54000'), ('subset', 'ok')) AS t(\"case\", code)")
def _(e):
    """A reranker may reorder and leave out; everything else is refused as a whole."""
    hits = e.table("nation").select("id", F.col("id").cast("double").alias("score"))
    many = e.table("lineitem").select("id", F.lit(1.0).alias("score"))
    cases = {
        "foreign id": (hits, lambda h: h.withColumn("id", F.col("id") + 1), 5), "id twice": (hits, lambda h: h.union(h), 5), "not finite": (hits, lambda h: h.withColumn("score", F.lit(float("nan"))), 5),
        "pool too large": (many.union(many.withColumn("id", -F.col("id") - 1)), None, 5), "cut too large": (hits, None, V.MAX_K + 1), "subset": (hits, lambda h: h.where("id < 5"), 3),
    }
    rows = []
    for k, (pool, rank, limit) in cases.items():
        try:
            V.rerank(pool, rank, limit).count()
            rows.append((k, "ok"))
        except EngineError as err:
            rows.append((k, err.code))
    return e.spark.createDataFrame(rows, "`case` string, code string")


assert len(PROBE) == DIM
