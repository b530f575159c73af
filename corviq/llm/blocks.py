"""Pairs inside the buckets of an index, compared in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corviq.llm.common import materialize


def blocked(postings: DataFrame, key: str, item: str, block: int, *bases: DataFrame) -> DataFrame:
    """Deal the members of each bucket ``key`` to blocks (i, j) with i <= j, so that each two members meet in a block.

    A bucket of up to ``block`` members is the one block (0, 0). A larger one is cut by a hash of ``item`` into
    ceil(n / block) parts, and a block holds two of them (one, if i = j); ``part`` says to which the row belongs.
    No pair of rows is made here. The result is partitioned and sorted by (key, i, j). ``bases`` bound the size of
    ``postings``, as for ``materialize``.
    """
    hot = materialize(
        postings.groupBy(key).count().where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("parts")),
        *bases,
    )
    dealt = (
        postings.join(hot, key, "left")
        .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(item), F.col("parts"))).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .drop("parts", "other")
    )
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
