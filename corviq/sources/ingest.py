"""Files to chunks to vectors; COPY text; JSON lines."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corviq.errors import EngineError
from corviq.operators.batches import bound_batches, by_bytes

WINDOW, SECTION = 60, 600
MAX_INPUT = 16 << 20


def chunk_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Windows of 60 lines, trimmed, empty ones dropped: df's columns without the text, chunk, start_line, end_line, body.

    Built-in functions only; one row per window.
    """
    lines = F.split(F.col(text), "\n", -1)
    keep = [c for c in df.columns if c != text]
    starts = F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / WINDOW).cast("int"))
    cut = df.where(F.col(text).isNotNull()).select(*keep, lines.alias("_l")).select(*keep, "_l", F.explode(starts).alias("chunk"))
    body = F.trim(F.regexp_replace(F.array_join(F.slice("_l", F.col("chunk") * WINDOW + 1, F.lit(WINDOW)), "\n"), r"^\s+|\s+$", ""))
    return cut.select(
        *keep, "chunk", (F.col("chunk") * WINDOW + 1).alias("start_line"), F.least((F.col("chunk") + 1) * WINDOW, F.size("_l")).alias("end_line"), body.alias("body")
    ).where("body != ''")


def markdown_chunks(text: str) -> list[tuple[int, int, str]]:
    """(start line, end line, body) by heading; headings inside fences don't count; long sections repack by paragraph."""
    if len(text.encode()) > MAX_INPUT:
        raise EngineError("54000", "input is larger than 16 MiB")
    sections: list[tuple[int, list[str]]] = [(1, [])]
    fence = None
    for n, line in enumerate(text.split("\n"), 1):
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if mark and (fence is None or mark[1].startswith(fence)):
            fence = None if fence else mark[1][:3]
        if fence is None and re.match(r"#{1,6}(\s|$)", line) and not mark:
            sections.append((n, []))
        sections[-1][1].append(line)
    out = []
    for first, lines in sections:
        body = "\n".join(lines).strip()
        if not body:
            continue
        if len(body) <= SECTION:
            out.append((first, first + len(lines) - 1, body))
            continue
        start, held = first, []
        for n, line in enumerate([*lines, None], first):
            if line is None or not line.strip():
                if held and (line is None or len("\n".join(held)) >= SECTION):
                    out.append((start, n - 1, "\n".join(held).strip()))
                    start, held = n + 1, []
                elif held and line is not None:
                    held.append(line)
                elif not held:
                    start = n + 1
            else:
                held.append(line)
    return [c for c in out if c[2]]


def chunk_markdown(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            rows = [(i, k, *c) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, c in enumerate(markdown_chunks(t or ""))]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], [id_col, "chunk", "start_line", "end_line", "body"])

    bound_batches(df)
    return df.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"{id_col} long, chunk int, start_line int, end_line int, body string")


def chunk_file(df: DataFrame, path: str = "path", text: str = "text", id_col: str = "id") -> DataFrame:
    """By extension: .md and .markdown by heading, everything else by lines."""
    md = F.lower(F.col(path)).rlike(r"\.(md|markdown)$")
    return chunk_markdown(df.where(md), id_col, text).unionByName(
        chunk_lines(df.where(~F.coalesce(md, F.lit(False))).select(id_col, text), text).select(id_col, "chunk", "start_line", "end_line", "body")
    )


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def embed_text(text: str, dim: int) -> list[float]:
    """Tokens by white space, lower case; bucket hash mod dim, sign by the top bit; unit length."""
    v = np.zeros(dim)
    for t in text.split():
        h = fnv1a(t.lower().encode())
        v[h % dim] += -1.0 if h >> 63 else 1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


#: A pluggable embedder: a list of at most ``MAX_EMBED`` texts to a vector each, all of one length, finite.
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
MAX_EMBED = 8_192


def hashing(dim: int) -> Embedder:
    """:func:`embed_text` of many texts: each distinct token of a batch is hashed once, and their bytes column by column."""

    def run(texts: list[str]) -> np.ndarray:
        tokens = [t.lower().split() for t in texts]
        names = sorted({t for own in tokens for t in own})
        if not names:
            return np.zeros((len(texts), dim), np.float32)
        raw = [n.encode() for n in names]
        sizes = np.array([len(r) for r in raw])
        order = np.argsort(-sizes, kind="stable")
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        for k in range(int(sizes.max())):  # one step of FNV-1a for all tokens that have a k-th byte
            some = order[: int(np.searchsorted(-sizes[order], -k, side="left"))]
            h[some] = (h[some] ^ np.fromiter((raw[i][k] for i in some), np.uint64, len(some))) * np.uint64(0x100000001B3)
        bucket, sign = (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)
        place = {n: k for k, n in enumerate(names)}
        row = np.repeat(np.arange(len(texts)), [len(own) for own in tokens])
        at = np.array([place[t] for own in tokens for t in own], np.int64)
        out = np.zeros((len(texts), dim))
        np.add.at(out, (row, bucket[at]), sign[at])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)

    return run


def embed(df: DataFrame, dim: int = 64, text: str = "body", name: str = "embedding", embedder: Embedder | None = None, batch: int = MAX_EMBED) -> DataFrame:
    """``df`` with a vector of each text (null: empty), by the hashing embedder or another, ``batch`` texts at a time.

    A vector of another length than ``dim``, or one that isn't finite, fails the query (22000).
    """
    if not 1 <= batch <= MAX_EMBED:
        raise EngineError("54000", f"a batch has 1 to {MAX_EMBED} texts")
    run = embedder or hashing(dim)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def udf(s: pd.Series) -> pd.Series:
        texts, out = [t or "" for t in s], []
        for at in range(0, len(texts), batch):
            made = [np.asarray(v, np.float32) for v in run(texts[at : at + batch])]
            if len(made) != len(texts[at : at + batch]) or any(v.shape != (dim,) or not np.isfinite(v).all() for v in made):
                raise EngineError("22000", f"the embedder gives {dim} finite numbers for each text")
            out += made
        return pd.Series(out, index=s.index)

    return df.withColumn(name, udf(F.col(text)))


# -- dictionary ------------------------------------------------------------------------------------------------------

# Words that are no terms.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our",
    "out", "day", "get", "has", "him", "his", "how", "man", "new", "now", "old", "see", "two",
    "way", "who", "did", "its", "let", "put", "say", "she", "too", "use", "this", "that", "with",
    "from", "have", "will", "your", "they", "them", "then", "than", "when", "what", "where",
    "which", "while", "into", "over", "also", "such", "each", "some", "more", "most", "only",
    "other", "these", "those", "been", "being", "were", "does", "doing", "here", "there", "about",
    "would", "could", "should", "must", "may", "might", "shall",
)
TOP_TERMS, LEAST_TERM, MAX_TERM = 300, 3, 64


def term_index(df: DataFrame, text: str = "text", path: str | None = None, most: int = TOP_TERMS) -> DataFrame:
    """(term, n): the most frequent terms of a corpus, ties by term.

    Terms are runs of ASCII letters in lower case, three or more of them, without the stop words. With a ``path`` column
    only documentation counts: Markdown files as a whole, of Rust files the lines of documentation comments.
    """
    body = F.col(text)
    if path is not None:
        name = F.lower(F.col(path))
        comments = F.array_join(F.regexp_extract_all(body, F.lit(r"(?m)^\s*//[/!](.*)$"), F.lit(1)), "\n")
        body = F.when(name.rlike(r"\.(md|markdown)$"), body).when(name.endswith(".rs"), comments)
    words = F.explode(F.regexp_extract_all(body, F.lit("([A-Za-z]+)"), F.lit(1)))
    terms = df.select(words.alias("term")).select(F.substring(F.lower("term"), 1, MAX_TERM).alias("term")).where((F.length("term") >= LEAST_TERM) & ~F.col("term").isin(*STOP_WORDS))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def file_tree(df: DataFrame, path: str = "path") -> DataFrame:
    """(kind, name, n): files by extension (``(none)`` without) and by top folder (``(root)`` without); a path counts once."""
    paths = df.where(F.col(path).isNotNull()).select(F.col(path).alias("p")).distinct()
    file = F.regexp_extract("p", r"([^/\\]*)$", 1)
    ending = F.lower(F.regexp_extract(file, r"^.+\.([^.]+)$", 1))
    top = F.regexp_extract("p", r"^([^/\\]+)[/\\]", 1)
    both = F.explode(F.array(F.struct(F.lit("extension").alias("kind"), F.when(ending == "", "(none)").otherwise(ending).alias("name")), F.struct(F.lit("top_dir").alias("kind"), F.when(top == "", "(root)").otherwise(top).alias("name"))))
    return paths.select(both.alias("s")).groupBy("s.kind", "s.name").agg(F.count("*").alias("n"))


SYMBOL = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|impl|mod|const|type)\s+([A-Za-z_][A-Za-z0-9_]*)"


def symbols(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Declared symbols of source files: id, kind, name."""
    kinds = F.regexp_extract_all(F.col(text), F.lit(SYMBOL), F.lit(1))
    names = F.regexp_extract_all(F.col(text), F.lit(SYMBOL), F.lit(2))
    return df.select(id_col, F.explode(F.arrays_zip(kinds.alias("kind"), names.alias("name"))).alias("s")).select(id_col, "s.kind", "s.name")


ESCAPES = {"\\": "\\", "t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}


def _copy_field(raw: str) -> str | None:
    if raw == "\\N":
        return None

    def plain(m: re.Match) -> str:
        if m[1] not in ESCAPES:
            raise EngineError("22000", "unknown escape in COPY text")
        return ESCAPES[m[1]]

    return re.sub(r"\\(.?)", plain, raw, flags=re.DOTALL)


def parse_copy(text: str, form: str = "text") -> list[list[str | None]]:
    r"""Rows of COPY input. text: tabs, ``\N`` is null, backslash escapes. csv: an empty field is null, ``""`` is empty.

    Lines end with a line feed, with or without a carriage return before it; no other character ends one. A carriage
    return elsewhere, or another escape, is refused (22000).
    """
    if form == "text":
        rows = []
        lines = text.split("\n")
        for line in lines[:-1] if lines[-1] == "" else lines:
            line = line.removesuffix("\r")
            if line == "\\.":
                break
            if "\r" in line:
                raise EngineError("22000", "a carriage return inside a line")
            rows.append([_copy_field(f) for f in line.split("\t")])
        return rows
    if form != "csv":
        raise EngineError("42601", f"no format {form}")
    rows, quoted = [], csv.reader(io.StringIO(re.sub(r'(?:(?<=,)|(?<=\n)|^)""(?=,|\n|$)', '"\x00"', text, flags=re.MULTILINE)))
    for row in quoted:
        if row:
            rows.append([None if f == "" else "" if f == "\x00" else f for f in row])
    return rows


def copy_from(spark: SparkSession, text: str, schema: T.StructType, form: str = "text") -> DataFrame:
    """Rows of COPY input in the given types; a value that doesn't convert fails the whole input (22P02)."""
    rows = parse_copy(text, form)
    if any(len(r) != len(schema) for r in rows):
        raise EngineError("22P04", "a row has too many or too few fields")
    raw = spark.createDataFrame(rows, ", ".join(f"`{f.name}` string" for f in schema))
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_copy(spark: SparkSession, path: str, schema: T.StructType, form: str = "text") -> DataFrame:
    """COPY files of any size, read and parsed on the executors, in the given types; ``Store.load`` takes the result.

    A row with another number of fields fails (22P04), and so does a value that doesn't convert (22P02).
    """
    if form == "csv":
        raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path, multiLine=True, quote='"', escape='"', emptyValue="\x00", nullValue="", mode="FAILFAST", lineSep="\n")
        return raw.select(*[F.when(F.col(f"`{f.name}`") != "\x00", F.col(f"`{f.name}`")).when(F.col(f"`{f.name}`") == "\x00", "").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])
    if form != "text":
        raise EngineError("42601", f"no format {form}")
    width = len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[_copy_field(f) for f in line.removesuffix("\r").split("\t")] for line in batch.column(0).to_pylist() if line.removesuffix("\r") != "\\."]
            if any(len(r) != width for r in rows):
                raise EngineError("22P04", "a row has too many or too few fields")
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(width)], [f"c{k}" for k in range(width)])

    raw = spark.read.text(path, lineSep="\n").mapInArrow(run, ", ".join(f"c{k} string" for k in range(width)))
    return raw.select(*[F.col(f"c{k}").cast(f.dataType).alias(f.name, metadata=f.metadata) for k, f in enumerate(schema)])


def copy_line(columns: Sequence[Column], form: str = "text") -> Column:
    """One COPY output line per row."""
    if form == "csv":
        cells = [F.when(c.isNull(), "").when(c.cast("string").rlike('[",\n\r]') | (c.cast("string") == ""), F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c.cast("string")) for c in columns]
        return F.concat_ws(",", *cells)
    cells = []
    for c in columns:
        text = c.cast("string")
        for name, char in ESCAPES.items():  # the backslash first
            text = F.replace(text, F.lit(char), F.lit(f"\\{name}"))
        cells.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("\t", *cells)


MAX_FILES = 64


def check_files(files: DataFrame, path: str = "path", body: str = "text", most: int = MAX_FILES) -> None:
    """The limits of a batch of files: their number, their size, no path twice."""
    seen = files.agg(F.count("*").alias("n"), F.count_distinct(path).alias("paths"), F.max(F.octet_length(body)).alias("most")).first()
    if seen["n"] > most or (seen["most"] or 0) > MAX_INPUT:
        raise EngineError("54000", f"at most {most} files of 16 MiB")
    if seen["paths"] < seen["n"]:
        raise EngineError("21000", "a path stands twice in the batch")


def replace_files(table: DataFrame, files: DataFrame, dim: int = 64) -> DataFrame:
    """``table`` (path, chunk, start_line, end_line, body, embedding) after ``files`` (path, text) were ingested.

    The rows of each given path are replaced as a whole by its new chunks; a path whose text is null or empty loses its
    rows. An anti join on the path keeps the rest; only chunk rows of the batch are embedded.
    """
    numbered = files.withColumn("id", F.xxhash64("path"))
    chunks = chunk_file(numbered.where(F.col("text").isNotNull())).join(numbered.select("id", "path"), "id").drop("id")
    new = embed(chunks, dim).select("path", "chunk", "start_line", "end_line", "body", "embedding")
    kept = table.join(files.select("path").distinct(), "path", "left_anti")
    return kept.select(*new.columns).unionByName(new)
