"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corviq.llm.common import bound_batches, fresh, materialize, release, slices, with_fields

PASSAGE, LEAST_WORDS = 48, 1  # words, defaults of the parameters
LEAST_LINES, MOST_LINES, DIVISOR, MOST_BLANK, DIGEST = 2, 16, 2, 8, 16
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _cut(lines: list[str], sizes: list[int], passage: int) -> list[tuple[int, int]]:
    """(first line, lines) of the content-defined chunks, which cover all lines.

    Lines are hashed, and a rolling hash over the last two line hashes ends a chunk of at least two lines where it is
    divisible by ``DIVISOR``; so a run of lines has the same inner boundaries wherever it stands. A line of
    ``passage`` words or more holds a whole passage by itself: it is a chunk of its own. No chunk has more than
    ``MOST_LINES`` lines.
    """
    import xxhash

    out, first, last = [], 0, 0
    for k, line in enumerate(lines):
        if sizes[k] >= passage:
            if k > first:
                out.append((first, k - first))
            out.append((k, 1))
            first, last = k + 1, 0
            continue
        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = (last * BASE + h) & MASK
        last = h
        if k + 1 - first >= MOST_LINES or k + 1 - first >= LEAST_LINES and (rolled >> 17) % DIVISOR == 0:
            out.append((first, k + 1 - first))
            first = k + 1
    if first < len(lines):
        out.append((first, len(lines) - first))
    return out


def _passages(sizes: list[int], passage: int) -> Iterator[tuple[int, int]]:
    """(first line, lines) of the least runs of ``passage`` words or more from each line on and up to each line.

    Where they begin and end depends on nothing outside of them, and they cover any run of that many words: a line that
    no run from a line before it reaches has enough words before it within the run. Runs begin with a line that has
    words; of blank lines in a row, runs end at the first ``MOST_BLANK``.
    """
    n, end, words, first, before, blank = len(sizes), 0, 0, 0, 0, 0
    for k, size in enumerate(sizes):
        while end < n and words < passage:
            words += sizes[end]
            end += 1
        if size and words >= passage:
            yield k, end - k
        words -= size
        before += size
        while before - sizes[first] >= passage:
            before -= sizes[first]
            first += 1
        blank = 0 if size else blank + 1
        if before >= passage and blank <= MOST_BLANK:
            yield first, k + 1 - first


def chunks(text: str | None, passage: int = PASSAGE) -> list[tuple[int, int, int]]:
    """(first line, lines, words) of what is compared of a text, in order: its content-defined chunks, and since those
    seldom lie whole inside a short passage, all least runs of lines that are as long as a passage; they overlap."""
    return _chunks_of(text.split("\n"), passage) if text else []


def _chunks_of(lines: list[str], passage: int) -> list[tuple[int, int, int]]:
    sizes = [len(line.split()) for line in lines]
    upto = [0, *accumulate(sizes)]
    spots = {*_cut(lines, sizes, passage), *_passages(sizes, passage)}
    if len(number := {line: k for k, line in enumerate(lines)}) < len(lines):
        spots = _apart([number[line] for line in lines], spots)
    return [(first, n, upto[first + n] - upto[first]) for first, n in sorted(spots)]


def _apart(lines: list[int], spots: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """A run that overlaps the first one equal to it in the text is joined with it: else the first would lose lines."""
    seen: dict[tuple[int, ...], int] = {}
    out = set()
    for first, n in sorted(spots):
        at = seen.setdefault(tuple(lines[first : first + n]), first)
        out.add((at, first + n - at) if at < first < at + n else (first, n))
    return out


def _spots(lines: list[str], least_words: int, passage: int) -> list[tuple[int, int]]:
    """(first line, lines) of the chunks and passages of a text that are compared."""
    return [(first, n) for first, n, words in _chunks_of(lines, passage) if counts(n, words, least_words, passage)]


def _digest(data: bytes, size: int) -> bytes:
    return blake2b(data, digest_size=size).digest().ljust(DIGEST, b"\0")


def counts(lines: int, words: int, least_words: int = LEAST_WORDS, passage: int = PASSAGE) -> bool:
    """Whether a chunk is compared: several lines with enough words between them, or one line as long as a passage."""
    return words >= (least_words if lines > 1 else passage)


def _chunks(batches: Iterator[pa.RecordBatch], least_words: int, passage: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out: list[list] = [[], [], [], [], []]
        names = batch.schema.names
        ids, rows = (batch.column(names.index(n)).to_pylist() for n in ("id", "row"))
        for doc, row, cell in zip(ids, rows, batch.column(names.index("text")), strict=True):
            text = cell.as_py()
            if not text:
                continue
            lines = text.split("\n")
            digests = b"".join(_digest(line.encode("utf-8", "surrogatepass"), size) for line in lines)
            for first, n in _spots(lines, least_words, passage):
                body = digests[first * DIGEST : (first + n) * DIGEST]
                for column, value in zip(out, (doc, row, first, n, _digest(body, size)), strict=True):
                    column.append(value)
            if len(out[0]) >= 16384:
                yield _batch(out)
                out = [[], [], [], [], []]
        yield _batch(out)


def _batch(columns: list[list]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(columns[4]), "<i8").reshape(-1, 2)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    arrays = [pa.array(c, t) for c, t in zip(columns[:4], types, strict=True)] + [pa.array(halves[:, k].copy()) for k in (0, 1)]
    return pa.record_batch(arrays, ["id", "row", "first", "lines", "h", "g"])


def _cover(spots: list[dict]) -> list[dict]:
    """Few of the spots that together hold the same lines: each line is in two of them at most."""
    out: list[dict] = []
    end = -1  # the first line that isn't covered yet
    spots = sorted(spots, key=lambda d: (d["first"], -d["lines"]))
    k = 0
    while k < len(spots):
        best, at = None, max(end, spots[k]["first"])
        while k < len(spots) and spots[k]["first"] <= at:
            if best is None or spots[k]["first"] + spots[k]["lines"] > best["first"] + best["lines"]:
                best = spots[k]
            k += 1
        if best["first"] + best["lines"] > end:
            out.append(best)
            end = best["first"] + best["lines"]
    return out


MOST_UNEQUAL = 100_000  # chunks whose digests collide; of 128 bits none do
SPOT = "struct<first int, lines int, h long, g long, keep boolean>"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        at = names.index("spots")
        out = [_cover(spots) for spots in batch.column(at).to_pylist()]
        columns = [batch.column(k) if k != at else pa.array(out, batch.schema.field(at).type) for k in range(len(names))]
        yield pa.record_batch(columns, names)


def _bodies(batches: Iterator[pa.RecordBatch], text_col: str, spots_col: str) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks that go and of those that stay for them."""
    for batch in slices(batches, text_col):
        names = batch.schema.names
        rows: list[tuple] = []
        for cell, spots in zip(batch.column(names.index(text_col)), batch.column(names.index(spots_col)).to_pylist(), strict=True):
            lines = cell.as_py().split("\n")
            rows += [(d["h"], d["g"], "\n".join(lines[d["first"] : d["first"] + d["lines"]]).encode("utf-8", "surrogatepass")) for d in spots]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h", "g", "body"])


def _removed(batches: Iterator[pa.RecordBatch], text_col: str, spots_col: str, keep: list[str], count: str, unequal: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col):
        names = batch.schema.names
        texts, counts = [], []
        for cell, spots in zip(batch.column(names.index(text_col)), batch.column(names.index(spots_col)).to_pylist(), strict=True):
            gone = {k for d in spots or () if not d["keep"] and (d["h"], d["g"]) not in unequal for k in range(d["first"], d["first"] + d["lines"])}
            text = cell.as_py()
            texts.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text)
            counts.append(len(gone))
        columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(names.index(n)) for n in keep]
        yield pa.record_batch([*columns, pa.array(counts, pa.int64())], [*keep, count])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, passage: int = PASSAGE, digest: int = DIGEST, count: str = "removed_lines") -> DataFrame:
    """``docs`` with the text without its repeated chunks, and ``count`` (long), the lines that went.

    Compared are all content-defined chunks of two lines or more with ``least_words`` words between them (one, so that
    blank lines alone are no chunk; a corpus of code may want more), and all least runs of lines with ``passage`` words (one line may be such a run). Of each that occurs more than once in the whole table (within a document or across) the occurrence with the smallest
    (id, text hash, line) stays, null ids last; the others are removed. So all of a run of lines of ``passage`` words or
    more that stands elsewhere before goes (of lines that repeat within themselves, fewer words than that may stay at
    the end), and each line that goes stands elsewhere.

    Occurrences are found by 128-bit BLAKE2b digests of their lines' digests. Before anything is removed, the bytes of
    what goes and of what stays for it are compared: a chunk goes only where all of them are equal. (Shorter digests, by
    ``digest`` in bytes, are for tests of this.)

    Nulls stay null; empty texts stay empty; a text of which nothing is left becomes empty. A document is a row's id and
    text: rows that repeat both are taken as copies of one and treated alike, so that the first occurrence is never
    lost; rows that repeat an id with another text are documents of their own. Other columns are kept, an existing
    column of the name ``count`` is replaced. An empty table gives an empty table.

    One shuffle carries text: documents to their removals; its result is written, and read for the comparison and for
    the removal. Chunks travel as digests; one that stands in a third of all documents is combined on the map side, and
    its occurrences meet only a join that adaptive execution splits. No side is broadcast.
    """
    bound_batches(docs)
    row = F.xxhash64(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    found = source.mapInArrow(lambda it: _chunks(it, least_words, passage, digest), "id long, row long, first int, lines int, h long, g long")
    # the least (id, text hash, line), null ids last; the chunks of one line differ in their lines
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "row", "first", "lines")
    groups = found.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("at")).where("n > 1")
    repeated = materialize(groups.select("h", "g", "at"))
    spots = (
        found.join(repeated.hint("merge"), ["h", "g"])
        .withColumn("keep", F.col("at.id").eqNullSafe(F.col("id")) & (F.col("at.row") == F.col("row")) & (F.col("at.first") == F.col("first")))
        .groupBy("id", "row", "keep")
        .agg(F.collect_set(F.struct("first", "lines", "h", "g", "keep")).alias("spots"))
    )
    going = materialize(spots.where("not keep").select("id", "row", "spots").mapInArrow(_covered, f"id long, row long, spots array<{SPOT}>"), repeated)
    wanted = going.select(F.explode("spots").alias("s")).select("s.h", "s.g").distinct()
    staying = repeated.join(wanted.hint("merge"), ["h", "g"]).select(
        "at.id", "at.row", F.struct("at.first", "at.lines", "h", "g", F.lit(True).alias("keep")).alias("s")
    )
    every = going.select("id", "row", F.explode("spots").alias("s")).unionByName(staying)
    every = every.groupBy("id", "row").agg(F.collect_list("s").alias("spots"))
    return _without(docs, every, id_col, text_col, count, (repeated, going))


def _without(docs: DataFrame, spots: DataFrame, id_col: str, text_col: str, count: str, done: tuple[DataFrame, ...]) -> DataFrame:
    keep = [c for c in docs.columns if c != count]
    by, row, mine = (fresh(n, docs.columns) for n in ("_spot_id", "_spot_row", "_spots"))
    spots = spots.select(F.col("id").alias(by), F.col("row").alias(row), F.col("spots").alias(mine)).hint("merge")
    own = F.col(id_col).cast("long").eqNullSafe(F.col(by)) & (F.xxhash64(text_col) == F.col(row))
    joined = materialize(docs.select(*keep).join(spots, own, "left").drop(by, row), docs)
    release(*done)
    bodies = joined.where(F.col(mine).isNotNull()).select(text_col, mine).mapInArrow(lambda it: _bodies(it, text_col, mine), "h long, g long, body binary")
    differ = bodies.groupBy("h", "g").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a != b").select("h", "g")
    unequal = {(r["h"], r["g"]) for r in differ.limit(MOST_UNEQUAL + 1).collect()}
    if len(unequal) > MOST_UNEQUAL:
        raise RuntimeError("the digests are too short")
    schema = with_fields(joined.select(*keep).schema, (count, "long"))
    return joined.mapInArrow(lambda it: _removed(it, text_col, mine, keep, count, unequal), schema)
