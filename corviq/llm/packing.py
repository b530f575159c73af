"""Best-fit packing by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corviq.llm.common import bound_batches, few_files, materialize, slices

EOS = 2
_ENCODERS: dict[str, object] = {}
_TOKENIZERS: dict[tuple[str, bool], object] = {}
_ADDED: dict[str, list[str]] = {}


def encoder(vocabulary: str):
    """The byte-level BPE of a public vocabulary file, loaded once a worker.

    ``name.json`` is read through its rank file ``name.tiktoken``: the same ids for ordinary text, several times faster.
    """
    if vocabulary not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def tokenizer(vocabulary: str, added_tokens: bool):
    """The vocabulary file by the tokenizers library itself; without ``added_tokens`` their strings are ordinary text."""
    if (vocabulary, added_tokens) not in _TOKENIZERS:
        import public_tokenizers
        from tokenizers import Tokenizer

        made = _TOKENIZERS[vocabulary, added_tokens] = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        made.encode_special_tokens = not added_tokens
    return _TOKENIZERS[vocabulary, added_tokens]


def added(vocabulary: str) -> list[str]:
    """The strings of the added tokens of a vocabulary file."""
    if vocabulary not in _ADDED:
        import json

        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            _ADDED[vocabulary] = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return _ADDED[vocabulary]


def encode(text: str, vocabulary: str, added_tokens: bool = True) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit numbers.

    The tokenizers library encodes texts with added tokens, if these count, and texts at which tiktoken fails: it panics
    (no ``Exception``) or raises ValueError at about a million white-space characters in a row.
    """
    if not (added_tokens and any(t in text for t in added(vocabulary))):
        try:
            return np.asarray(encoder(vocabulary).encode_to_numpy(text, disallowed_special=()), np.uint32)
        except UnicodeEncodeError:
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        except BaseException as e:
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
    return np.asarray(tokenizer(vocabulary, added_tokens).encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first piece takes what is no full piece."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(at, most) for at in range(first, n, most)]


def _pieces(batches: Iterator[pa.RecordBatch], most: int, vocabulary: str, with_ids: bool, added_tokens: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out: list[list] = [[], [], [], [], [], []]
        names = batch.schema.names
        for doc, cell in zip(batch.column(names.index("id")).to_pylist(), batch.column(names.index("text")), strict=True):
            ids = np.append(encode(cell.as_py() or "", vocabulary, added_tokens), np.uint32(EOS)).astype("<u4")
            for k, (start, length) in enumerate(cuts(len(ids), most)):
                part = ids[start : start + length]
                for column, value in zip(out, (doc, k, start, length, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
        yield pa.record_batch(columns if with_ids else columns[:5], names if with_ids else names[:5])


def fullest(counts: dict[int, int], capacity: int, slack: int = 0) -> dict[int, int]:
    """The combination of available lengths, the longest among them, that leaves the least slack.

    With ``slack`` 0, the base of the method, that is the fullest combination there is.

    Bitset subset sums: bit s of an integer says that the sum s can be reached; counts are split into powers of two,
    and the bitsets before each item lead back to the combination. Long lengths are tried first, and the search ends
    as soon as the bin can be full but for ``slack``: that keeps short lengths for later bins.
    """
    first = max(counts)
    gap = capacity - first
    reach, mask, steps = 1, (1 << (gap + 1)) - 1, []
    for length in sorted((n for n in counts if n <= gap), reverse=True):
        left, k = min(counts[length] - (length == first), gap // length), 1
        while left > 0:
            take = min(k, left)
            left, k = left - take, k * 2
            new = (reach | reach << (take * length)) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
        if reach.bit_length() > gap - slack:
            break
    need, out = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> need & 1:
            out[length] = out.get(length, 0) + take
            need -= take * length
    return out


def _bins(counts: dict[int, int], capacity: int, slack: int) -> list[tuple[dict[int, int], int]]:
    counts = {n: c for n, c in counts.items() if c}
    out = []
    while counts:
        combination = fullest(counts, capacity, slack)
        times = min(counts[n] // k for n, k in combination.items())
        for n, k in combination.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((combination, times))
    return out


def bins(counts: dict[int, int], capacity: int, slacks: tuple[int, ...] = (0, 1, 2, 3, 5, 8, 12, 20)) -> list[tuple[dict[int, int], int]]:
    """[(combination, how many bins of it)]: the fullest combination is removed as often as the counts allow.

    ``slacks=(0,)`` is the method itself. A bin that may stay a few tokens short is found among the long lengths alone,
    which keeps short ones for later bins; so the plan is made for each of ``slacks``, 0 first, and the one with the
    fewest bins is taken (a tie: the least slack), never a worse one than the method's own. Each
    entry uses some length up to less than one more combination needs, so there are a few thousand entries for a
    capacity of 1024, whatever the number of pieces.
    """
    return min((_bins(counts, capacity, s) for s in slacks), key=lambda plan: sum(times for _, times in plan))


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, pieces a bin, first sequence and offset in it of each run of ranks."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for combination, times in plan:
        offset = 0
        for n in sorted(combination, reverse=True):
            k = combination[n]
            rows.setdefault(n, []).append((used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def _placed(batches: Iterator[pa.RecordBatch], slots: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            first, k, base, before = slots[n]
            run = np.searchsorted(first, rank[at], side="right") - 1
            nth = rank[at] - first[run]
            sequence[at] = base[run] + nth // k[run]
            offset[at] = before[run] + nth % k[run] * n
        keep = [f.name for f in batch.schema if f.name != "rank"]
        yield pa.record_batch(
            [*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"]
        )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False, added_tokens: bool = True
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    Ids are those of a Tokenizer with its default settings: strings of the vocabulary's added tokens give their own id
    (without ``added_tokens`` they are ordinary text). Null and empty texts are the one id 2. Equal rows give equal pieces, each with a place of its own. Null ids are kept.
    Only the histogram of lengths (at most ``capacity`` rows) and the plan made of it are on the driver. Pieces of one
    length get their rank without meeting in one task: by salted groups of about the square root of their number,
    and the groups' running sums.
    """
    bound_batches(docs)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = materialize(source.mapInArrow(lambda it: _pieces(it, capacity, vocabulary, with_ids, added_tokens), schema))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(bins(counts, capacity))
    salts = [1] + [-(-counts.get(n, 1) // max(512, math.isqrt(counts.get(n, 1)))) for n in range(1, capacity + 1)]
    salted = pieces.withColumn(
        "salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.element_at(F.array(*map(F.lit, salts)), (F.col("length") + 1).cast("int")))
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "salt"]).select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    return few_files(ranked, pieces).mapInArrow(lambda it: _placed(it, slots), schema + ", sequence_id long, offset long")
