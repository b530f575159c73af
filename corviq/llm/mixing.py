"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corviq.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP = 60, 12
MAX_SOURCES = 100_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def place(id_col: str, seed: str) -> Column:
    """A document's place in [0, 2^60): fixed by its id and the seed."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Water-filling: shares of the whole by weight, none above ``most`` times its source; the excess is reshared."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), [s for s in names]
    while free:
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if per * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: per * weight[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: str = "mix:",
    prefix: str = "mix_",
    size_col: str | None = None,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (0 to ``most``) added.

    The added names begin with ``prefix``. ``size_col`` names sizes that are known already; the text isn't read then.

    A source with target t and size z takes each document floor(t / z) times and those whose hash lies below the
    source's threshold once more. The threshold is found from sums by source and hash bucket; only the bucket in which
    the budget ends is refined, 12 bits at a time, and documents are then filtered, never sorted. Budgets are nested: a
    larger one takes all that a smaller one takes. The last document is taken if that brings the sum nearer.

    Null texts have size 0; a null source is a source of its own, the last. Rows with equal ids (or null ids) share
    their hash and are taken together. An empty table gives an empty result. Columns with the added names are replaced.
    Only sums by source reach the driver; more than ``MAX_SOURCES`` sources are refused.
    """
    size, hashed = words(text_col) if size_col is None else F.col(size_col), place(id_col, seed)
    slim = materialize(docs.select(F.col(source_col).alias("source"), hashed.alias("h"), size.alias("size")))
    sums = slim.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: int(r["size"]) for r in sums}
    goal = targets(sizes, weights, most)
    whole = {s: min(int(goal[s] // sizes[s]), int(most)) if sizes[s] else 0 for s in sizes}
    budget = {s: goal[s] - whole[s] * sizes[s] if whole[s] < most else 0.0 for s in sizes}
    limit = _thresholds(slim, budget)
    names = {n: f"{prefix}{n}" for n in ("size", "hash", "source", "source_size", "target", "base", "limit", "copies")}
    kinds = {"source": T.StringType(), "source_size": T.LongType(), "target": T.DoubleType(), "base": T.LongType(), "limit": T.LongType()}
    schema = T.StructType([T.StructField(names[n], t) for n, t in kinds.items()])
    known = docs.sparkSession.createDataFrame([(s, sizes[s], float(goal[s]), whole[s], limit[s]) for s in sizes], schema)
    marked = docs.select(*[c for c in docs.columns if c not in names.values()], size.alias(names["size"]), hashed.alias(names["hash"]))
    joined = marked.join(F.broadcast(known), F.col(source_col).eqNullSafe(F.col(names["source"])))  # at most MAX_SOURCES rows
    taken = F.col(names["base"]) + (F.col(names["hash"]) < F.col(names["limit"])).cast("long")
    return joined.withColumn(names["copies"], taken).drop(*(names[n] for n in ("source", "base", "limit", "hash")))


def _thresholds(slim: DataFrame, budget: dict[str | None, float]) -> dict[str | None, int]:
    """For each source the limit below which hashes are taken; the sum comes nearest to the budget (a tie takes less)."""
    spark = slim.sparkSession
    out = {s: 0 for s in budget}
    open_at = {s: (0, 0) for s, b in budget.items() if b > 0}  # the prefix of the boundary bucket, the sum before it
    shift = HASH_BITS
    while open_at and shift:
        shift -= STEP
        bound = spark.createDataFrame(
            [(s, p, before, float(budget[s])) for s, (p, before) in open_at.items()], "b_source string, prefix long, before long, budget double"
        )
        inside = slim.join(
            F.broadcast(bound),
            F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("h", shift + STEP) == F.col("prefix")),
        )
        bucket = inside.groupBy("b_source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.first("before").alias("before"), F.first("budget").alias("budget"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        # The bucket in which the running sum reaches the budget; at most 2^12 buckets a source meet in this window.
        run = F.sum("size").over(Window.partitionBy("b_source").orderBy("bucket"))
        at = bucket.withColumn("upto", F.col("before") + run).where("upto >= budget and upto - size < budget")
        rows = at.select("b_source", "bucket", "size", "upto", "budget", "lo", "hi").collect()
        found = {r["b_source"]: r for r in rows}
        for s in list(open_at):
            r = found.get(s)
            if r is None:  # the budget is above all that is left
                out[s] = (open_at[s][0] + 1) << (shift + STEP)
                del open_at[s]
            elif r["lo"] == r["hi"] or not shift:
                before = r["upto"] - r["size"]
                out[s] = r["hi"] + 1 if r["upto"] - budget[s] < budget[s] - before else r["lo"]
                del open_at[s]
            else:
                open_at[s] = (r["bucket"], r["upto"] - r["size"])
    return out
