"""Nearest neighbours, BM25, rank fusion, boosts, the precision gate and lexical reranking."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corviq.errors import EngineError
from corviq.functions import scalar
from corviq.operators.batches import CELLS, bound_batches, by_bytes, by_rows

MAX_K = 10_000
CODE, F16_MAX = 127, 65504.0
BROADCAST_QUERIES = 4_096  # of a batch


def scored(df: DataFrame, query: Sequence[float], vector: str = "embedding", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Inner products of all rows, finite ones only; vectors of another length than the query have none.

    A pass of matrix products over Arrow batches: on 500,000 vectors of 64 components it took half the time of array
    lambdas, which are interpreted, and a twentieth of sums that are written out, whose code is too long to be compiled.
    """
    q, fields = np.asarray(query, float), df.select(*keep).schema.fields
    names = [*(f.name for f in fields), "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            fits = pc.equal(pc.fill_null(pc.list_value_length(column), -1), len(q))
            batch = batch if pc.all(fits).as_py() else batch.filter(fits)
            score = products(matrix(batch.column(batch.num_columns - 1)), q) if batch.num_rows else np.empty(0)
            good = np.isfinite(score)
            if not good.all():
                batch, score = batch.filter(pa.array(good)), score[good]
            yield pa.record_batch([*batch.columns[:-1], pa.array(score)], names)

    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    return df.select(*keep, F.col(vector).alias("_scored")).mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors without nulls as rows of doubles; null components are not a number."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1).astype(float)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each row's product with ``q``, summed in the same order wherever a row stands: equal vectors have equal scores,
    which the blocked sums of a matrix product don't promise."""
    return np.einsum("ij,j->i", x, q)


def best_of(score: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best by score and id, out of scores of a matrix product: those near the edge are summed
    again before they are compared."""
    rows = np.flatnonzero(np.isfinite(score))
    if len(rows) > k:
        edge = np.partition(score[rows], len(rows) - k)[len(rows) - k]
        rows = rows[score[rows] >= edge - 1e-9 * max(1.0, abs(edge))]
    exact = products(x[rows], q)
    order = np.lexsort((ids[rows], -exact))[:k]
    return rows[order], exact[order]


def knn(df: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Exact k-NN by inner product, descending, ties by id. Filters go on ``df`` before; those after on the result.

    One pass: partitions keep their own top k, and the winners meet in one task. Non-finite scores are dropped.
    """
    if not 1 <= k <= MAX_K:
        raise EngineError("54000", f"k is 1 to {MAX_K}")
    return scored(df, query, vector, keep).orderBy(F.desc("score"), F.asc("id")).limit(k)


def batch_knn(df: DataFrame, queries: Mapping[int, Sequence[float]], k: int, vector: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the k best of every query of a batch. Only k rows per query and partition are shuffled."""
    if len(queries) > BROADCAST_QUERIES:
        raise EngineError("54000", f"more than {BROADCAST_QUERIES} queries in a batch")
    ids, asked = np.array(list(queries), np.int64), np.array(list(queries.values()), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partition-local winners of each query: those kept so far compete with a batch's."""
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        for batch in by_rows(batches, len(ids)):
            if batch.num_rows:
                who, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                for n, (q, score) in enumerate(zip(asked, asked @ x.T, strict=True)):
                    rows, exact = best_of(score, x, q, who, k)
                    w, s = np.concatenate((best[n][0], who[rows])), np.concatenate((best[n][1], exact))
                    order = np.lexsort((w, -s))[:k]
                    best[n] = w[order], s[order]
        count = [len(w) for w, _ in best]
        yield pa.record_batch([pa.array(np.repeat(ids, count)), pa.array(np.concatenate([w for w, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["qid", "id", "score"])

    local = df.where(F.col(vector).isNotNull()).select(F.col("id").cast("long"), F.col(vector)).mapInArrow(run, "qid long, id long, score double")
    return _best(local, k)


def fit_scales(df: DataFrame, vector: str = "embedding") -> list[float]:
    """The scale of each dimension for eight-bit codes: the largest absolute value over 127, as a float.

    A row per dimension and partition is aggregated; non-finite components are refused (22000), and so are scales that a float
    can't hold. A dimension that is zero throughout has scale 0.
    """
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = None
        for batch in batches:
            if batch.num_rows:
                own = np.abs(matrix(batch.column(0))).max(axis=0)  # not a number, if one isn't
                most = own if most is None else np.maximum(most, own)
        if most is not None:
            yield pa.record_batch([pa.array(np.arange(len(most), dtype=np.int32)), pa.array(most)], ["at", "top"])

    local = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(tops, "at int, top double")
    rows = local.groupBy("at").agg(F.max("top").alias("top")).orderBy("at").collect()
    out = []
    for r in rows:
        top = r["top"]
        if top is None or top != top or top == float("inf"):
            raise EngineError("22000", f"dimension {r['at']} has components that aren't finite")
        scale = float(np.float32(top / CODE))
        if top > 0 and scale == 0.0 or scale * CODE > float(np.finfo(np.float32).max):
            raise EngineError("22000", f"dimension {r['at']} is out of range")
        out.append(scale)
    return out


def quantize(v: Column, scales: Sequence[float]) -> Column:
    """Codes from -127 to 127 by the scale of each dimension, half away from zero."""
    listed = F.array(*[F.lit(s) for s in scales])
    code = lambda x, s: F.when(s == 0, 0.0).otherwise(F.least(F.lit(float(CODE)), F.greatest(F.lit(-float(CODE)), F.round(x.cast("double") / F.nullif(s, F.lit(0.0))))))
    return F.zip_with(v, listed, lambda x, s: code(x, s).cast("tinyint"))


def decode_dot(code: Column, scales: Sequence[float], query: Sequence[float]) -> Column:
    """The score of stored codes for a query that stays as it is: the sum of code times scale times query."""
    return scalar.dot(code, scalar.vec([s * q for s, q in zip(scales, query, strict=True)]))


def fits_f16(v: Column) -> Column:
    """Whether all components have a finite half-precision form."""
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) <= F16_MAX))


def to_f16(df: DataFrame, vector: str = "embedding", name: str = "f16") -> DataFrame:
    """``df`` with the vector's half-precision bits (two bytes a component, little-endian): nearest, ties to even."""

    @F.pandas_udf("binary")
    def bits(s: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return s.map(lambda v: None if v is None else np.asarray(v, "<f4").astype("<f2").tobytes())

    return df.withColumn(name, bits(F.col(vector)))


def from_f16(df: DataFrame, name: str = "f16", vector: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def floats(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float32))

    return df.withColumn(vector, floats(F.col(name)))


TILE = 65_536  # vectors that a task of a k-NN join holds at once


def _tile(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best of a tile of vectors (id, v) for each query (qid, q), a block of queries at a time."""
    out: list[list[np.ndarray]] = [[], [], []]
    if left.num_rows and right.num_rows:
        ids, x = left.column("id").to_numpy(), matrix(left.column("v"))
        qids, queries = right.column("qid").to_numpy(), matrix(right.column("q"))
        step = max(1, CELLS // len(ids))
        for at in range(0, len(qids), step):
            for qid, q, score in zip(qids[at : at + step], queries[at : at + step], queries[at : at + step] @ x.T, strict=True):
                rows, exact = best_of(score, x, q, ids, k)
                for column, value in zip(out, (np.full(len(rows), qid), ids[rows], exact), strict=True):
                    column.append(value)
    return pa.table([pa.array(np.concatenate(c) if c else np.empty(0), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "id", "score"])


def _best(local: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(df: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", rows: int = TILE, block: int = BROADCAST_QUERIES) -> DataFrame:
    """(qid, id, score, rank): the exact k best rows of ``df`` for each row (id, vector) of ``queries``, of any number.

    Both sides are dealt to tiles by hash, ``rows`` vectors against ``block`` queries, each a matrix product in one task;
    a vector travels once per block of queries, a query once per tile of vectors, and only k rows of a tile and query go
    on. Rows without a vector are left out.
    """
    if not 1 <= k <= MAX_K:
        raise EngineError("54000", f"k is 1 to {MAX_K}")
    left = df.where(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(vector).alias("v"))
    right = queries.where(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("qid"), F.col(vector).alias("q"))
    tiles, blocks = max(1, -(-left.count() // rows)), max(1, -(-right.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("t", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("b", every(blocks))
    right = right.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("t", every(tiles))
    local = left.groupBy("t", "b").cogroup(right.groupBy("t", "b")).applyInArrow(lambda a, c: _tile(a, c, k), "qid long, id long, score double")
    return _best(local, k)


class BatchWindow:
    """Collects queries until there are ``most`` of them, and answers them in one pass over the vectors."""

    def __init__(self, df: DataFrame, k: int, most: int = BROADCAST_QUERIES, vector: str = "embedding"):
        if not 1 <= most <= BROADCAST_QUERIES:
            raise EngineError("54000", f"a window has 1 to {BROADCAST_QUERIES} queries")
        self.df, self.k, self.most, self.vector = df, k, most, vector
        self.waiting: dict[int, Sequence[float]] = {}

    def add(self, qid: int, query: Sequence[float]) -> DataFrame | None:
        """The answers of the window that this query fills, as of :func:`batch_knn`; else None."""
        if qid in self.waiting:
            raise EngineError("21000", f"query {qid} is waiting already")
        self.waiting[qid] = query
        return self.flush() if len(self.waiting) == self.most else None

    def flush(self) -> DataFrame | None:
        waiting, self.waiting = self.waiting, {}
        return batch_knn(self.df, waiting, self.k, self.vector) if waiting else None


# -- text ------------------------------------------------------------------------------------------------------------

CJK = "぀-ヺー-ヿ㐀-䶿一-鿿가-힯"
CJK_STOP = tuple("のにはをがでとも")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words (``_`` belongs to them), and of CJK runs the single characters and pairs.

    Frequent particles are no single tokens. The middle dot parts runs, the long-vowel mark doesn't.
    """
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]+)"), F.lit(1))
    ones = F.filter(F.flatten(F.transform(runs, lambda r: F.split(r, ""))), lambda c: ~c.isin("", *CJK_STOP))
    twos = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.concat(words, ones, twos)


WORD, RUN = re.compile(r"[a-z0-9_]+"), re.compile(f"[{CJK}]+")


def token_list(text: str) -> list[str]:
    """The tokens of one text by the same rules, words first."""
    low = text.lower()
    out = WORD.findall(low)
    if not low.isascii():
        runs = RUN.findall(low)
        out += [c for run in runs for c in run if c not in CJK_STOP]
        out += [run[k : k + 2] for run in runs for k in range(len(run) - 1)]
    return out


def query_terms(text: str) -> list[str]:
    """The term set of a query, by the same rules, on the driver."""
    return sorted(set(token_list(text)))


def _term_counts(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    words = [(n, rf"\b{t}\b") for n, t in enumerate(terms) if WORD.fullmatch(t)]
    for batch in by_bytes(batches, 1):
        low = pc.utf8_lower(batch.column(1))
        size = pc.count_substring_regex(low, WORD.pattern).to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.zeros((len(terms), len(low)), np.int32)
        for n, pattern in words:  # word boundaries of the pattern are those of the tokens
            counts[n] = pc.count_substring_regex(low, pattern).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(pc.match_substring_regex(low, RUN.pattern).to_numpy(zero_copy_only=False)).tolist():
            found = token_list(low[k].as_py())
            size[k] = len(found)
            counts[:, k] = [found.count(t) for t in terms]
        yield pa.record_batch([batch.column(0), pa.array(size), *map(pa.array, counts)], ["id", "dl", *(f"tf{n}" for n in range(len(terms)))])


def term_counts(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(id, dl, tf0, tf1, ...): length and counts of the given terms, a narrow row per document.

    A batch-wise Arrow kernel: tokenizing with built-in regular expressions and filtering arrays by interpreted lambdas
    took about three times as long on the bench's documents.
    """
    kind = dict(docs.dtypes)["id"]
    kind = kind if kind.startswith("struct") else "bigint"  # rows of several tenants are keyed by id and tenant
    schema = ", ".join([f"id {kind}", "dl int", *(f"tf{n} int" for n in range(len(terms)))])
    known = docs.where(F.col(text).isNotNull()).select(F.col("id").cast(kind).alias("id"), text)  # rows without a text are no documents
    bound_batches(docs)
    return known.mapInArrow(lambda it: _term_counts(it, terms), schema)


def bm25(docs: DataFrame, query: str, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score > 0) of the documents that hold a term of the query; statistics are those of ``docs`` (the visible set).

    A pass tokenizes and keeps, per document, its length and the counts of query terms only: a narrow row.
    Statistics are one aggregated row; nothing is exploded or shuffled by term.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    tf = term_counts(docs, terms, text)
    df = [f"df{n}" for n in range(len(terms))]
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"tf{n}") > 0, 1)).alias(c) for n, c in enumerate(df)])
    score = bm25_score(F.col("n"), F.col("avgdl"), [F.col(c) for c in df], k1, b)
    return tf.join(F.broadcast(stats)).select("id", score.alias("score")).where("score > 0")


def bm25_score(n: Column, avgdl: Column, df: Sequence[Column], k1: float, b: float) -> Column:
    """Of a row (dl, tf0, tf1, ...), summed in the order of the terms."""
    score = F.lit(0.0)
    for k, d in enumerate(df):
        f, idf = F.col(f"tf{k}"), F.log((n - d + 0.5) / (d + 0.5) + 1)
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / avgdl))).otherwise(0.0)
    return score


# -- fusion, boosts, gate, rerank ------------------------------------------------------------------------------------


def pool(hits: DataFrame, size: int) -> DataFrame:
    """The best ``size`` hits with the tie group at the edge completed, and the group-end rank: all ties take its last place.

    Scores are counted first; of at most ``size`` distinct ones the ranks are summed up and broadcast. So however many
    hits share a score, they never meet in one task.
    """
    ranks = group_ends(hits, "score", size).where(F.col("rank") - F.col("_n") < size).select(F.col("_v").alias("_s"), "rank")
    return hits.join(F.broadcast(ranks), F.col("score") == F.col("_s")).drop("_s")


def group_ends(hits: DataFrame, column: str, most: int) -> DataFrame:
    """(_v, _n, rank): the ``most`` largest distinct values, how often each occurs, and how many values are not smaller."""
    top = hits.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")).orderBy(F.desc("_v")).limit(most)
    return top.withColumn("rank", F.sum("_n").over(Window.orderBy(F.desc("_v"))))


def rrf(dense: DataFrame, sparse: DataFrame, limit: int, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), size: int = 200) -> DataFrame:
    """(id, score): the sum of weight / (k + rank) over both pools, descending, ties by id."""
    size = max(limit, size)
    a = pool(dense, size).select("id", F.col("rank").alias("rd"))
    c = pool(sparse, size).select("id", F.col("rank").alias("rs"))
    score = F.coalesce(weights[0] / (k + F.col("rd")), F.lit(0.0)) + F.coalesce(weights[1] / (k + F.col("rs")), F.lit(0.0))
    return a.join(c, "id", "full").select("id", score.alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(limit)


def boost(hits: DataFrame, rules: Sequence[tuple[str, str, str, float]], most: float = 1.0) -> DataFrame:
    """Adds ``amount`` for each rule (column, equals/starts_with/contains, text, amount) that fits; nulls don't; never removes."""
    total = F.lit(0.0)
    for column, how, text, amount in rules:
        c = F.col(column)
        fits = {"equals": c == text, "starts_with": c.startswith(text), "contains": c.contains(text)}.get(how)
        if fits is None or not 0 <= amount <= most:
            raise EngineError("22000", f"bad boost {how} {amount}")
        total = total + F.when(fits, amount).otherwise(0.0)
    return hits.withColumn("score", F.col("score") + total).orderBy(F.desc("score"), F.asc("id"))


def gate(hits: DataFrame, least: float = 0.80, margin: float = 0.05, most: int = 1) -> DataFrame:
    """Precision mode: nothing unless the best score reaches ``least`` and leads by ``margin``; then the leading run, capped."""
    top = hits.orderBy(F.desc("score"), F.asc("id")).limit(max(most, 2))
    w = Window.orderBy(F.desc("score"), F.asc("id"))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = top.withColumn("_r", F.row_number().over(w)).withColumn("_s", F.collect_list("score").over(every))
    lead = (F.size("_s") == 1) | (F.element_at("_s", 1) - F.try_element_at("_s", F.lit(2)) >= margin)
    return seen.where((F.element_at("_s", 1) >= least) & lead & (F.col("score") >= least) & (F.col("_r") <= most)).drop("_r", "_s")


def rrf_confidence(score: Column, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    return score / (sum(weights) / (k + 1))


def rerank(hits: DataFrame, rank=None, limit: int = 10) -> DataFrame:
    """Runs a reranker (hits to hits with new scores; None: as they are) and cuts.

    ``hits`` is a pool of at most ``MAX_K`` rows (id, score, ...); more are refused (54000), and so is an id that stands
    twice or a score that isn't finite (22000). A model that scores pairs plugs in as ``rank``. What it gives must be
    finite scores of ids among the hits, each once: one foreign id refuses all, since leaving it out would tell that it
    is there.
    """
    if not 1 <= limit <= MAX_K:
        raise EngineError("54000", f"limit is 1 to {MAX_K}")
    pool = hits.limit(MAX_K + 1)
    _refuse(pool, "the pool", MAX_K)
    out = hits
    if rank is not None:
        out = rank(hits)
        _refuse(out.limit(MAX_K + 1), "the reranker", MAX_K)
        if out.join(hits.select("id"), "id", "left_anti").limit(1).count():
            raise EngineError("22000", "the reranker gave an id that isn't among the hits")
    return out.orderBy(F.desc("score"), F.asc("id")).limit(limit)


def _refuse(pool: DataFrame, who: str, most: int) -> None:
    odd = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    seen = pool.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count(F.when(odd, 1)).alias("odd")).first()
    if seen["n"] > most:
        raise EngineError("54000", f"{who} has more than {most} hits")
    if seen["ids"] < seen["n"] or seen["odd"]:
        raise EngineError("22000", f"{who} has an id twice or a score that isn't finite")


def cross_encoder(score, batch: int = 256, text: str = "text"):
    """A reranker out of a model that scores pairs: ``score(query, texts)`` gives a number for each text of a batch.

    It runs on the executors, up to 256 pairs at a time; pass ``cross_encoder(model)(query)`` to :func:`rerank`.
    """
    if not 1 <= batch <= 256:
        raise EngineError("54000", "a batch has 1 to 256 pairs")

    def of(query: str):
        @F.pandas_udf("double")
        def scores(s: pd.Series) -> pd.Series:
            texts = [t or "" for t in s]
            return pd.Series([float(x) for at in range(0, len(texts), batch) for x in score(query, texts[at : at + batch])], index=s.index)

        def rank(hits: DataFrame) -> DataFrame:
            bound_batches(hits)
            return hits.withColumn("score", scores(F.col(text)))

        return rank

    return of


def boost_ids(hits: DataFrame, ids: DataFrame, amount: float, most: float = 1.0) -> DataFrame:
    """Adds ``amount`` to the hits whose id is in ``ids`` (id); never removes one."""
    if not 0 <= amount <= most:
        raise EngineError("22000", f"bad boost {amount}")
    marked = hits.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    return marked.withColumn("score", F.col("score") + F.when(F.col("_in"), amount).otherwise(0.0)).drop("_in").orderBy(F.desc("score"), F.asc("id"))


def rerank_lexical(hits: DataFrame, query: str, text: str = "text", k: int = 60, fused: float = 3.0, lexical: float = 1.0) -> DataFrame:
    """``hits`` (id, score, text) by fused / (k + rank) + lexical / (k + rank of shared terms), group-end ranks.

    ``hits`` is a pool with at most ``MAX_K`` distinct scores. A hit without a text shares no terms. Their number is never
    null: else Spark infers a filter on it for the join below and tokenizes whatever the texts are joined from.
    """
    shared = F.size(F.array_intersect(F.array_distinct(tokens(F.col(text))), F.array(*[F.lit(t) for t in query_terms(query)]).cast("array<string>")))
    shared = F.coalesce(shared, F.lit(0))

    marked = hits.withColumn("_o", shared)
    by_score, by_words = (group_ends(marked, c, MAX_K) for c in ("score", "_o"))
    ranked = marked.join(F.broadcast(by_score.select(F.col("_v").alias("_fv"), F.col("rank").alias("_f"))), F.col("score") == F.col("_fv")).join(
        F.broadcast(by_words.select(F.col("_v").alias("_lv"), F.col("rank").alias("_l"))), F.col("_o") == F.col("_lv")
    )
    score = fused / (k + F.col("_f")) + lexical / (k + F.col("_l"))
    return ranked.withColumn("score", score).drop("_o", "_f", "_l", "_fv", "_lv").orderBy(F.desc("score"), F.asc("id"))
