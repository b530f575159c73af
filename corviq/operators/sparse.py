"""Persistent postings for BM25: a table of (term, row) sorted by term, of which a query reads its own terms only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corviq.operators.batches import bound_batches, by_bytes
from corviq.operators.retrieval import RUN, WORD, bm25_score, query_terms, token_list
from corviq.policy import TENANT, VISIBILITY, Policy
from corviq.sources import shared

MOST_KEPT = 100_000  # counts of terms in the driver's memory
_KEPT: dict[tuple, dict[str, tuple[int, int]]] = {}
FORMAT = 2  # of the tables, in their names: another one is built anew
KEYS = ("id", TENANT, VISIBILITY)
POSTINGS = f"term string, id long, {TENANT} string, {VISIBILITY} string, tf int, dl int"
TERMS = f"term string, {TENANT} string, {VISIBILITY} string, n long, words long"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with their counts, and for each row the empty term of count 0, which has its length."""
    for batch in by_bytes(batches, 3):
        low = pc.utf8_lower(batch.column(3))
        rows, terms = [], []
        odd = np.flatnonzero(pc.match_substring_regex(low, RUN.pattern).to_numpy(zero_copy_only=False))
        for k in odd.tolist():
            own = token_list(low[k].as_py())
            rows.append(np.full(len(own), k))
            terms.append(pa.array(own, pa.string()))
        if len(odd):
            blank = np.zeros(len(low), bool)
            blank[odd] = True
            low = pc.if_else(pa.array(blank), pa.scalar("", pa.string()), low)
        parts = pc.split_pattern_regex(low, f"[^{WORD.pattern[1:-2]}]+")
        rows.append(np.repeat(np.arange(len(low)), pc.list_value_length(parts).to_numpy(zero_copy_only=False)))
        terms.append(parts.flatten())
        row, coded = np.concatenate(rows).astype(np.int64), pa.chunked_array(terms).combine_chunks().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.empty(0, bool)
        row, code = row[real], code[real]
        size = np.bincount(row, minlength=len(low)).astype(np.int32)
        both, tf = np.unique(row * max(1, len(names)) + code, return_counts=True)
        at, code = both // max(1, len(names)), both % max(1, len(names))
        every = np.arange(len(low))
        term = pa.concat_arrays([names.take(pa.array(code)).cast(pa.string()), pa.array([""] * len(every), pa.string())])
        at, tf = np.concatenate((at, every)), np.concatenate((tf, np.zeros(len(every), np.int64)))
        yield pa.record_batch([term, *(batch.column(k).take(pa.array(at)) for k in range(3)), pa.array(tf.astype(np.int32)), pa.array(size[at])], [f.split()[0] for f in POSTINGS.split(", ")])


def build(rows: DataFrame, text: str, path: str) -> None:
    """Writes the postings of ``rows`` (id, tenant, visibility, text), and by tenant and visibility the documents of each
    term; the empty term stands for all of them, with their words.

    Postings are partitioned and sorted by term and id, so that a term's rows lie together and the Parquet statistics
    skip all others; a term of many rows has many partitions. Rows without a text are no documents.
    """
    known = rows.where(F.col(text).isNotNull()).select(F.col("id").cast("long"), TENANT, VISIBILITY, F.col(text).alias("text"))
    spark = rows.sparkSession
    bound_batches(rows)
    known.mapInArrow(_postings, POSTINGS).write.parquet(f"{path}/made")  # ranges are sampled first: texts are tokenized once
    made = spark.read.schema(POSTINGS).parquet(f"{path}/made")
    made.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    fs, where = shared.hadoop(spark, f"{path}/made")
    fs.delete(where, True)
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    counts = stored.groupBy("term", TENANT, VISIBILITY).agg(F.count("*").alias("n"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("words"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


@dataclass(frozen=True)
class TextIndex:
    """Postings in one or several folders (of the parts of a table)."""

    spark: SparkSession
    paths: tuple[str, ...]

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{p}/{what}" for p in self.paths])

    def _counts(self, policy: Policy, terms: Sequence[str]) -> dict[str, tuple[int, int]]:
        """(documents, words) of each term among what ``policy`` lets through. Postings never change, so counts are kept."""
        if sum(map(len, _KEPT.values())) > MOST_KEPT:
            _KEPT.clear()
        known = _KEPT.setdefault((self.paths, policy), {})
        if new := [t for t in terms if t not in known]:
            found = _collected(policy.read(self._read("terms", TERMS)).where(F.col("term").isin(*new)))
            known.update({t: found.get(t, (0, 0)) for t in new})
        return known

    def bm25(self, policy: Policy, query: str, ids: DataFrame | None = None, key: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score > 0), as ``retrieval.bm25`` gives them for the rows that ``policy`` lets through.

        ``ids`` (id, or the struct ``key`` of id, tenant and visibility): only these rows count, for the statistics too.
        ``key`` asks for such structs as ids.
        """
        terms = query_terms(query)
        every = policy.read(self._read("postings", POSTINGS))
        if not terms:
            found = F.struct(*KEYS).alias("id") if key else F.col("id")
            return every.select(found, F.lit(0.0).alias("score")).where(F.lit(False))
        if ids is None:
            seen = self._counts(policy, ("", *terms))
        else:
            on = ["id", TENANT, VISIBILITY] if key else ["id"]
            wanted = ids.select(f"{key}.*").distinct() if key else ids.select(F.col("id").cast("long").alias("id")).distinct()
            every = every.join(wanted, on, "left_semi")
            counted = every.where(F.col("term").isin("", *terms)).withColumn("n", F.lit(1)).withColumn("words", F.when(F.col("term") == "", F.col("dl")))
            seen = _collected(counted)
        n, words = seen.get("", (0, 0))
        wide = _wide(every.where(F.col("term").isin(*terms)).select(F.struct(*KEYS).alias("id") if key else F.col("id"), "term", "tf", "dl"), terms)
        score = bm25_score(F.lit(n), F.lit(words / n if n else 0.0), [F.lit(seen.get(t, (0, 0))[0]) for t in terms], k1, b)
        return wide.select("id", score.alias("score")).where("score > 0")


def _collected(counted: DataFrame) -> dict[str, tuple[int, int]]:
    """A row a term reaches the driver."""
    return {r["term"]: (r["n"], r["words"]) for r in counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()}


def _wide(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, dl, tf0, tf1, ...): a row per document, so that its score is summed in the order of the terms."""
    return postings.groupBy("id").agg(F.max("dl").alias("dl"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{n}") for n, t in enumerate(terms)])
