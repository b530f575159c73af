"""Helpers shared by the training-data operators: tables, durable intermediate results, batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corviq.operators.batches import bound_batches, by_bytes  # noqa: F401  the operators take the first from here
from corviq.sources import shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A written table gets a file per this many bytes of what it is made of (but one per core at least).
FILE_BYTES = 8 << 20
_WRITTEN: dict[str, None] = {}  # folders of this process that weren't released, in order


def few_files(df: DataFrame, *bases: DataFrame) -> DataFrame:
    """``df`` in at most a partition per ``FILE_BYTES`` of ``bases``, which bound what it can have (but one per core).

    Adaptive execution does that too where it may; each file that a local file system writes costs a process or two.
    Sizes are those of written tables, else Spark's estimates, which are the files' for a scan and large for joins.
    """
    spark, size = df.sparkSession, 0
    for base in bases:
        path = getattr(base, "_corviq_path", None)
        if path:
            fs, where = shared.hadoop(spark, path)
            size += fs.getContentSummary(where).getLength()
        else:
            size += int(str(base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)), 1 << 30))


def materialize(df: DataFrame, *bases: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage is cut, lost executors lose nothing.

    ``bases``: see :func:`few_files`. What isn't released goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared.folder(spark)}/corviq-{uuid.uuid4().hex}"
    if bases:
        df = few_files(df, *bases)
    df.write.parquet(path)
    fs, where = shared.hadoop(spark, path)
    fs.deleteOnExit(where)
    _WRITTEN[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out._corviq_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of :func:`materialize` results that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._corviq_path)


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = shared.hadoop(spark, path)
    fs.delete(where, True)
    fs.cancelDeleteOnExit(where)
    _WRITTEN.pop(path, None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within, the yielded function writes a result; at the end all other tables written meanwhile are released."""
    before, kept = set(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        kept.add(out._corviq_path)
        return out

    try:
        yield keep
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in kept]:
            _delete(spark, path)


def with_fields(schema: T.StructType, *added: tuple[str, str]) -> T.StructType:
    """A new schema; StructType.add would change the one that the DataFrame holds."""
    return T.StructType([*schema.fields, *(T.StructField(n, T.LongType() if t == "long" else T.DoubleType() if t == "double" else T.StringType()) for n, t in added)])


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column has it (names are compared without case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """:func:`by_bytes` of a column by its name."""
    for batch in batches:
        yield from by_bytes([batch], batch.schema.get_field_index(name), most)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``keys`` so that no run of equal keys is cut between two tables.

    Memory holds one batch and the run that is open at its end; callers bound the length of a run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        same = None
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k))
            eq = pc.equal(col, col[n - 1])
            same = eq if same is None else pc.and_(same, eq)
        tail = n
        flags = same.to_numpy(zero_copy_only=False)
        if not flags.all():
            tail = int((~flags).nonzero()[0][-1]) + 1  # where the last run begins
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = [batch.slice(tail)]
        else:
            if held and any(
                held[0].column(held[0].schema.get_field_index(k))[0] != batch.column(batch.schema.get_field_index(k))[0]
                for k in keys
            ):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
