"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

Filter directions are all combinations of one random unit codeword per block of the (rotated) coordinates. Their number
is a product, but a vector finds all directions beyond the threshold by list decoding: partial sums over the blocks are
kept while the best rest can still lift them over it. Vectors meet in the filters they share.

What travels to the filters is a vector's id and a sketch of 128 bits, not the vector: only members of a filter whose
sketch is near to another's are fetched, once a filter, and verified there. Filters are where most vectors meet others
that aren't near, so most vectors are never fetched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corviq.llm.blocks import blocked
from corviq.llm.common import bound_batches, key_runs, materialize, release
from corviq.llm.components import connected_components, spanning

LEAST = 3  # filters that any vector is in, of one table
TABLES = 4  # independent rotations and codes, up to 100,000 vectors: what one misses another finds
PER_TABLE = 4.0  # filters a vector is expected to be in, of one table
IN_FILTER = 8.0  # vectors expected in a filter
BLOCKS = 2  # of a product code
BLOCK = 1024
SLICE = 500  # vectors that are decoded at once
SKETCH = 128  # hyperplanes


@lru_cache(64)
def _code(dim: int, words: int, table: int) -> tuple[np.ndarray, list[tuple[slice, np.ndarray]]]:
    """A rotation and the codewords of each block, the same in every process."""
    rng = np.random.default_rng([dim, words, table, 77])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    blocks = min(BLOCKS, max(1, dim // 4))
    cuts = np.linspace(0, dim, blocks + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        c = rng.standard_normal((words, b - a))
        out.append((slice(a, b), c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks)))
    return rotation, out


def plan(n: int) -> tuple[int, float]:
    """(codewords a block, threshold in standard deviations) for ``n`` vectors: filters grow with the vectors."""
    words = max(16, int(np.ceil((n * PER_TABLE / IN_FILTER) ** (1 / BLOCKS))))
    return words, NormalDist().inv_cdf(1 - PER_TABLE / words**BLOCKS)


def tables(n: int) -> int:
    """Tables for ``n`` vectors. A table finds fewer of the links as its filters narrow, so larger inputs get more."""
    return TABLES + int(np.ceil(1.5 * max(0.0, np.log10(max(n, 1) / 1e5))))


def decode(unit: np.ndarray, words: int, z: float, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter direction of a table whose product with the row reaches the threshold."""
    dim = unit.shape[1]
    rotation, blocks = _code(dim, words, table)
    blocks_n = len(blocks)
    z = z if blocks_n == BLOCKS else NormalDist().inv_cdf(1 - min(0.5, PER_TABLE / words**blocks_n))
    turned, least = unit @ rotation, z / np.sqrt(dim)
    scores = [turned[:, s] @ c.T for s, c in blocks]
    rest = np.zeros((blocks_n + 1, len(unit)))
    for b in range(blocks_n - 1, -1, -1):
        rest[b] = rest[b + 1] + scores[b].max(axis=1)
    # a vector far from all directions still gets its LEAST nearest ones: they lie among the nearest words of each block
    best = np.zeros((len(unit), 1))
    for block in scores:
        few = min(LEAST, block.shape[1])
        top = -np.partition(-block, few - 1, axis=1)[:, :few]
        best = (best[:, :, None] + top[:, None, :]).reshape(len(unit), -1)
        few = min(LEAST, best.shape[1])
        best = -np.partition(-best, few - 1, axis=1)[:, :few]
    reach = np.minimum(least, best.min(axis=1) - 1e-12)
    row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for b in range(blocks_n):
        after = total[:, None] + scores[b][row]
        keep, word = np.nonzero(after + rest[b + 1][row][:, None] >= reach[row][:, None])
        row, code, total = row[keep], code[keep] * words + word, after[keep, word]
    return row, code + table * words**blocks_n


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(column.type.value_type)) if pa.types.is_list(column.type) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def narrow(words: int, count: int) -> bool:
    """Whether 32 bits number the filters of all tables."""
    return count * words**BLOCKS < 1 << 31


@lru_cache(16)
def _planes(dim: int) -> np.ndarray:
    """The normals of the hyperplanes whose sides are a sketch, the same in every process."""
    return np.random.default_rng([dim, 78]).standard_normal((dim, SKETCH))


def sketch(unit: np.ndarray) -> np.ndarray:
    """Two 64-bit words a row: on which side of each hyperplane it lies."""
    bits = np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)


def farthest(least: float) -> int:
    """How many bits of two sketches may differ. Vectors at cosine ``least`` differ in a bit with probability angle / pi;
    six standard deviations and two bits above the mean lose about one link in ten million."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p))) + 2)


def _lists(batches: Iterator[pa.RecordBatch], words: int, z: float, count: int) -> Iterator[pa.RecordBatch]:
    """Each vector with its sketch and its sorted filters."""
    number = np.int32 if narrow(words, count) else np.int64
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            values, offsets = _vectors(batch.column(batch.schema.get_field_index("v")))
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = values[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = [decode(x, words, z, t) for t in range(count)]
                row, key = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                order = np.lexsort((key, row))
                row, key = row[order], key[order].astype(number)
                ends = np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32)
                bits = sketch(x).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key))
                own = batch.take(pa.array(rows)).columns
                yield pa.record_batch([*own, pa.array(np.full(len(rows), dim, np.int32)), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), lists], [*batch.schema.names, "dim", "s0", "s1", "filters"])


def _runs(run: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, part or None) of the blocks of two rows or more in a table sorted by (key, i, j)."""
    key, i, j, part = (run.column(n).to_numpy() for n in ("key", "i", "j", "part"))
    cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
    several = ends - starts > 1
    for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        yield a, b, None if i[a] == j[a] else part[a:b]


def _candidates(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The members of each block that have another one whose sketch is near: only their vectors are fetched."""
    for run in key_runs(batches, ["key", "i", "j"]):
        bits = [run.column(n).to_numpy().view(np.uint64) for n in ("s0", "s1")]
        kept = []
        for a, b, part in _runs(run):
            away = sum(np.bitwise_count(s[a:b][:, None] ^ s[a:b][None, :]).astype(np.uint16) for s in bits)
            near = away <= most
            if part is None:
                np.fill_diagonal(near, False)
            else:
                near &= part[:, None] != part[None, :]
            kept.append(a + np.flatnonzero(near.any(axis=1)))
        if kept and sum(map(len, kept)):
            yield from run.take(pa.array(np.concatenate(kept))).combine_chunks().to_batches()


def _met_before(filters: list[np.ndarray], key: int) -> np.ndarray | None:
    """Which two of the rows share a filter before ``key`` (they are counted there); None if none do."""
    early = [f[f < key] for f in filters]
    flat = np.concatenate(early)
    if not len(flat):
        return None
    names, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(early)), [len(f) for f in early])
    shared = uses[column] > 1
    if not shared.any():
        return None
    place = np.cumsum(uses > 1) - 1
    table = np.zeros((len(early), int((uses > 1).sum())), np.float32)
    table[row[shared], place[column[shared]]] = 1
    return table @ table.T > 0


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for run in key_runs(batches, ["key", "i", "j"]):
        key, rep, m = (run.column(n).to_numpy() for n in ("key", "rep", "m"))
        values, at = _vectors(run.column("v"))
        filters, ft = _vectors(run.column("filters"))
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b, part in _runs(run):
            x = values[at[a] : at[b]].reshape(b - a, -1).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ x.T >= least
            if part is None:
                np.fill_diagonal(near, False)
            else:
                near &= part[:, None] != part[None, :]
            if not near.any():
                continue
            before = _met_before([filters[ft[r] : ft[r + 1]] for r in range(a, b)], int(key[a]) & (1 << 44) - 1)
            if before is not None:
                near &= ~before
            p, q = np.nonzero(near)
            if not len(p):
                continue
            label = spanning(p, q, b - a)
            own = np.unique(p)
            out[0].append(rep[a:b][own])
            out[1].append((near @ m[a:b].astype(np.float64)).astype(np.int64)[own])
            out[2].append(rep[a:b][label[own]])
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["rep", "links", "root"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors are collapsed first and counted. Every link has cosine >= ``least``, computed in
    double precision; a link is found if its ends share a filter, which isn't certain: of links at cosine 0.955 about
    two in a thousand were missed at 50,000 vectors of 64 components, fewer of nearer ones (README has the figures).
    Each link is counted in the first filter that both ends share, so no table of pairs is made: blocks emit one row per
    vector. Rows with a null id link with nothing. Rows that
    repeat an id are vectors of their own, but share links and component. Labels and other columns aren't looked at.
    Choose parameters by the number of vectors: filters grow with it, so that their occupancy stays the same.
    """
    bound_batches(vectors)
    v = F.col("v")
    exact = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # floats are widened where they are compared
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(exact).alias("v"))
    # infinity times zero is NaN: one sum tells whether all components are finite
    whole = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * 0.0)
    some = F.exists(v, lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & ~F.exists(v, lambda x: x.isNull()) & (whole == 0.0) & some, F.lit(False))
    n = max(1, base.where(usable).count())
    (words, z), count = plan(n), tables(n)
    digest = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]  # 128 bits stand for a vector where it needn't travel
    groups = base.where(usable).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("m")).select("rep", "m", *digest, "v")
    schema = f"rep long, m long, h long, g long, v {exact}, dim int, s0 long, s1 long, filters array<{'int' if narrow(words, count) else 'long'}>"
    held = materialize(groups.mapInArrow(lambda it: _lists(it, words, z, count), schema))
    # vectors of different lengths never meet
    keys = F.transform("filters", lambda f: f.cast("long") + F.shiftleft(F.col("dim").cast("long"), 44))
    postings = held.select("rep", "s0", "s1", F.explode(keys).alias("key"))
    dealt = blocked(postings, "key", "rep", block, held).select("key", "i", "j", "part", "rep", "s0", "s1")
    most = farthest(least)
    members = materialize(dealt.mapInArrow(lambda it: _candidates(it, most), "key long, i int, j int, part int, rep long, s0 long, s1 long"))
    whole = members.join(held.select("rep", "s0", "s1", "m", "v", "filters"), ["rep", "s0", "s1"]).select("key", "i", "j", "part", "rep", "m", "v", "filters")
    whole = whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(whole.mapInArrow(lambda it: _links(it, least), "rep long, links long, root long"))
    release(members)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        held.select("h", "g", "rep", "m")
        .join(links, "rep", "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select("h", "g", (F.coalesce("links", F.lit(0).cast("long")) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    component = F.col("component_id")
    found = base.where(usable).select("id", *digest).join(named, ["h", "g"]).select(F.col("id").alias(id_col), "n_links", component, (F.col("id") == component).alias("kept"))
    # vectors that link with nothing share no key and need no join
    alone = base.where(~usable).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    return found.unionByName(alone)
