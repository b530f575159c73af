"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of their input, extra ones included. ``run`` writes every stage as Parquet in the shared folder and reads it again, so
that a lost executor never costs more than one stage. An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corviq.llm import langid, linechunks, mixing, packing, simhash
from corviq.llm.common import few_files, fresh, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no letters, null) go; profiles are learnt from the labelled ones."""
    verdict = fresh("_language", docs.columns)
    marked = langid.identify(docs, langid.train(docs), verdict=verdict)
    return marked.where(F.col(verdict) != langid.UNKNOWN).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; documents of which nothing but white space is left go with them."""
    gone = fresh("_gone", docs.columns)
    cut = linechunks.dedup_lines(docs, count=gone)
    kept = cut.where((F.col(gone) == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one document stays, of rows that repeat it one: the smallest id, null ids last."""
    kept = simhash.representatives(docs).select(F.col("id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash"), F.col("copies").alias("_copies"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep_id")) & (F.xxhash64("text") == F.col("_keep_hash"))
    single = docs.join(kept.where("_copies = 1").hint("merge"), same, "left_semi")
    if kept.where("_copies > 1").isEmpty():
        return few_files(single.select(*docs.columns), docs)
    several = docs.join(kept.where("_copies > 1").hint("merge"), same, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = several.groupBy("doc_id", F.xxhash64("text").alias("_hash")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row"))
    return few_files(single.select(*docs.columns).union(first.select("_row.*").select(*docs.columns)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated up to three times."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    copies = F.col(f"{prefix}copies")
    mixed = mixing.mix(docs, prefix=prefix).where(copies > 0)
    return mixed.withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the tokenizer nor XXH64; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:  # what the stages write for themselves goes with each of them
        for _, stage in STAGES[:-1]:
            with scratch(spark) as written:
                docs = written(stage(spark, docs, sf_dir))
        docs = keep(STAGES[-1][1](spark, docs, sf_dir))
    return docs
