"""SimHash near-duplicates over a positional byte index with count filtering.

Two 64-bit fingerprints that differ in at most three bits agree in at least five of their eight positional bytes. The
inverted index lists fingerprints under their positional bytes. Lists of one byte hold a 256th of all documents, and a
pair would be met in each byte it shares; so lists are kept under the first three bytes that a pair shares: of five
shared positions p1 < ... < p5 the first three are at most at 3, 4 and 5, which gives twenty lists a fingerprint, and a
long list is split by the next two (at most at 6 and 7), ever again before anything is compared. Inside a list the
shared positional bytes of each pair are tallied; the pairs that reach the guaranteed five, and only those, are
verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corviq.llm.blocks import blocked
from corviq.llm.common import bound_batches, key_runs, materialize, release, slices
from corviq.llm.components import connected_components, spanning

BYTES_MATCH = 5  # that any two fingerprints within three bits share
#: The first three, and all five, of five shared positions.
TRIPLES = [c for c in combinations(range(8), 3) if all(p <= k + 3 for k, p in enumerate(c))]
FIVES = list(combinations(range(8), 5))
BLOCK = 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text; null and texts without words give zero."""
    import xxhash

    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, as the contract asks
    if not parts:
        return 0
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    total = max(1, len(parts) - words + 1)
    for at in range(0, total, SHINGLES):  # very long texts in slices
        own = parts[at : at + SHINGLES + words - 1]
        if total == 1:
            digests = digest(b" ".join(own), 42)
        else:
            line = b" ".join(own)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            digests = b"".join([digest(line[a:b], 42) for a, b in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])
        votes += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


SHINGLES = 1 << 16  # of a text that are hashed at once


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        column = batch.column(batch.schema.get_field_index("text"))
        prints = np.array([fingerprint(cell.as_py(), words) for cell in column], np.uint64).view(np.int64)
        kept = [k for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
        yield pa.record_batch([*(batch.column(k) for k in kept), pa.array(prints)], [*(batch.schema.names[k] for k in kept), "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash, fp): XXH64 of the text, which tells rows of one id apart, and the signed view of the fingerprint."""
    bound_batches(docs)
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        lambda it: _fingerprints(it, words), "id long, text_hash long, fp long"
    )


def _key(spots: tuple[int, ...], n: int) -> Column:
    """A list's name: the number of its positions, then the bytes there (five bytes and the number fill 48 bits)."""
    out = F.lit(n).cast("long")
    for p in spots:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return out


def postings(prints: DataFrame, block: int = BLOCK, *bases: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its twenty lists; lists longer than ``block`` are split by two more bytes.

    Positions are numbered from the lowest byte. Fives that begin with a triple cover all pairs of that triple's list,
    so a split loses none. Names of fives come after those of triples.
    """
    prints = prints.select("fp").repartition("fp")  # few bytes each, but twenty rows: not as few tasks as they have files
    listed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), _key(t, n).alias("key")) for n, t in enumerate(TRIPLES)])).alias("p")).select("fp", "p.n", "p.key")
    hot = materialize(listed.groupBy("key").count().where(F.col("count") > block).select(F.col("key").alias("hot")), *bases)
    marked = listed.join(hot, F.col("key") == F.col("hot"), "left")
    after = F.array(
        *[F.array(*[_key(five, len(TRIPLES) + m) for m, five in enumerate(FIVES) if five[:3] == triple]).cast("array<bigint>") for triple in TRIPLES]
    )
    keys = F.when(F.col("hot").isNull(), F.array("key")).otherwise(F.element_at(after, F.col("n") + 1))
    return marked.select("fp", F.explode(keys).alias("key"))


def tally(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair of fingerprints shares."""
    out = np.zeros((len(left), len(right)), np.uint8)
    for p in range(8):
        shift = np.uint64(8 * p)
        one, two = (left >> shift).astype(np.uint8), (right >> shift).astype(np.uint8)
        out += one[:, None] == two[None, :]
    return out


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    for run in key_runs(batches, ["key", "i", "j"]):
        key, i, j, part, fp = (run.column(n).to_numpy() for n in ("key", "i", "j", "part", "fp"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        left, right = [], []
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            f = fp[a:b].view(np.uint64)
            one = np.arange(b - a) if i[a] == j[a] else np.flatnonzero(part[a:b] == i[a])
            two = one if i[a] == j[a] else np.flatnonzero(part[a:b] == j[a])
            p, q = np.nonzero(tally(f[one], f[two]) >= BYTES_MATCH)  # the count filter
            p, q = one[p], two[q]
            near = np.bitwise_count(f[p] ^ f[q]) <= max_bits  # verified
            label = spanning(p[near], q[near], b - a)
            own = np.flatnonzero(label != np.arange(b - a))
            left.append(fp[a:b][own])
            right.append(fp[a:b][label[own]])
        if left:
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _groups(prints: DataFrame, max_bits: int, block: int) -> DataFrame:
    """(fp, root): a fingerprint of each group for all of its fingerprints."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees links of at most three differing bits")
    distinct = materialize(prints.select("fp").distinct(), prints)
    dealt = blocked(postings(distinct, block, distinct), "key", "fp", block, distinct).select("key", "i", "j", "part", "fp")
    found = connected_components(dealt.mapInArrow(lambda it: _links(it, max_bits), "a long, b long"))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, block: int = BLOCK
) -> DataFrame:
    """One row per document: (doc_id, fp, component_id), the smallest id reachable over links of ``max_bits`` bits.

    Nulls and empty texts have fingerprint zero and link like any other. Documents with a null id get the group of
    their fingerprint but don't name it; a group all of whose ids are null has a null component_id. Repeated rows and
    ties fall together by their equal fingerprint; rows that share an id but not the text are documents of their own.
    Other columns of ``docs`` are not looked at. Equal fingerprints are collapsed by a map-side combined aggregate
    before anything is compared.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words))
    groups = _groups(prints, max_bits, block)
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    named = materialize(groups.join(least, "fp").select("fp", "root", "least"), prints)
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(component, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, text_hash, copies): of each group of :func:`simhash_groups` the text that stays, and how many equal rows it has.

    That is the row with the smallest id, nulls last, and among rows that repeat this id the smallest hash of the text.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words))
    rows = prints.groupBy("fp", "id", "text_hash").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("text_hash"))
    per = rows.groupBy("fp").agg(F.min_by(F.struct("id", "text_hash", "copies"), place).alias("row"), F.min(place).alias("place"))
    kept = _groups(prints, max_bits, block).join(per, "fp").groupBy("root").agg(F.min_by("row", "place").alias("row"))
    out = materialize(kept.select("row.*"), prints)
    release(prints)
    return out


