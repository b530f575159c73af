"""Language identification by rank-order profiles of n-grams (out-of-place distance)."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corviq.llm.common import bound_batches, rows_of, slices, with_fields

UNKNOWN = "und"
PROFILE = 400
TRAIN_DOCS = 4000
MAX_LANGUAGES = 5000  # labels that profiles are fitted for; languages have some 7000 codes, far fewer have texts
_CLASSES: list[np.ndarray] = []
WIDTH = 21  # bits of a code point
SLICE = 1 << 18  # characters that are counted at once
SPACE = re.compile(r"\s")


def _classes() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark (which belongs to the letter before it), else 0."""
    if not _CLASSES:
        kinds = (unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
        _CLASSES.append(np.fromiter((2 if k == "L" else 1 if k == "M" else 0 for k in kinds), np.uint8, sys.maxunicode + 1))
    return _CLASSES[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the letters, pairs and triples of a text; words are padded with one blank (code 0).

    A code packs up to three code points of 21 bits. Anything but letters and their marks parts words; a text without
    a letter has none. Very long texts are counted in slices that end between words.
    """
    text = text or ""
    if len(text) <= SLICE:
        return _counted(text)
    parts, at = [], 0
    while at < len(text):
        gap = SPACE.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        parts.append(_counted(text[at:end]))
        at = end
    codes, index = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(index, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[points]
    if not (kinds == 2).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.where(kinds > 0, points, 0).astype(np.int64)
    points = np.concatenate(([0], points, [0]))
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    a, b, c = points[:-2], points[1:-1], points[2:]
    inner = b != 0
    pairs = points[:-1] << WIDTH | points[1:] | 1 << (3 * WIDTH - 1)  # the highest bit tells pairs with a blank from letters
    triples = (a << 2 * WIDTH | b << WIDTH | c)[inner]
    codes = np.concatenate((points[points != 0], pairs, triples))
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def held_out(id_col: str = "doc_id", parts: int = 5) -> Column:
    """True for one in ``parts`` documents by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == 0, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n-gram counts by language; memory is bounded by the distinct n-grams of a slice of a megabyte."""
    for batch in slices(batches, "text", 1 << 20):
        by: dict[str, list] = {}
        for lang, text in zip(*rows_of(batch, "lang", "text"), strict=True):
            by.setdefault(lang, []).append(ngrams(text))
        for lang, found in by.items():
            codes, index = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            if len(codes):
                sums = np.bincount(index, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(codes)), pa.array(codes), pa.array(sums)], ["lang", "gram", "n"])


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS, profile: int = PROFILE
) -> dict[str, list[int]]:
    """A profile for each language: its ``profile`` most frequent n-grams in rank order.

    Learns from rows that :func:`held_out` doesn't hold out and whose label and text aren't null. Of each language about
    ``docs_per_lang`` labelled documents are taken, by a hash of the id (all, where there are no more): the documented
    bound of the sample. Counts are summed on the executors; only profiles reach the driver.
    """
    bound_batches(docs)
    pool = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        ~held_out("id") & F.col("lang").isNotNull()
    )
    per = pool.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not per:
        return {}
    span = 1 << 30
    rows = [(r["lang"], min(span, -(-span * docs_per_lang // r["count"]))) for r in per]
    share = F.broadcast(docs.sparkSession.createDataFrame(rows, "share_lang string, share long"))  # at most MAX_LANGUAGES rows
    chosen = pool.join(share, F.col("lang") == F.col("share_lang")).where(F.pmod(F.xxhash64("id"), F.lit(span)) < F.col("share"))
    sums = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = sums.withColumn("place", best).where(F.col("place") <= profile).collect()  # at most ``profile`` a language
    out: dict[str, list[int]] = {r["lang"]: [] for r in per}
    for r in sorted(rows, key=lambda r: r["place"]):
        out[r["lang"]].append(r["gram"])
    return {k: v for k, v in sorted(out.items()) if v}


class Profiles:
    """Profiles ready for prediction: the out-of-place distance of a document to each of them."""

    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.langs, self.most = list(profiles), most
        self.grams = np.unique(np.concatenate([np.array(v, np.int64) for v in profiles.values()])) if profiles else np.empty(0, np.int64)
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for k, grams in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(codes, counts, self.most)
        at = np.searchsorted(self.grams, top)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        rank = self.rank[at]
        away = np.where(rank < 0, self.most, np.minimum(np.abs(rank - np.arange(len(top))[:, None]), self.most)).sum(axis=0)
        best = int(np.argmin(away))  # a tie: the first by code point
        return self.langs[best], 1.0 - float(away[best]) / (self.most * len(top))


def _predict(batches: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], most: int, text_col: str, keep: list[str], added: list[str]) -> Iterator[pa.RecordBatch]:
    model = Profiles(profiles, most)
    for batch in slices(batches, text_col):
        names = batch.schema.names
        found = [model.predict(cell.as_py()) for cell in batch.column(names.index(text_col))]  # one text at a time
        yield pa.record_batch(
            [*(batch.column(names.index(k)) for k in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            [*keep, *added],
        )


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", keep: list[str] | None = None, most: int = PROFILE, verdict: str = "lang_pred") -> DataFrame:
    """The columns ``keep`` (all, if None) of ``docs`` with ``verdict`` and its score (0 to 1, 1 for equal rank orders).

    The score's column is named score, or after any other ``verdict``.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if there are no profiles. Columns
    of ``docs`` with the added names are replaced. The text travels to the workers once, whether it is kept or not.
    """
    bound_batches(docs)
    added = [verdict, "score" if verdict == "lang_pred" else f"{verdict}_score"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*columns, *([] if text_col in columns else [text_col]))
    schema = with_fields(docs.select(*columns).schema, (added[0], "string"), (added[1], "double"))
    return source.mapInArrow(lambda it: _predict(it, profiles, most, text_col, columns, added), schema)
