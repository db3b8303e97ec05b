"""Cutting texts into chunks: line windows, headings, and refinement by size.

Windows and sections are array expressions over a file's lines: a file's chunks are made where its
row is, without a shuffle or a self-join, and numbered by posexplode. Refinement packs lines
greedily, each piece depending on the one before; it runs on Arrow batches in Python.

A files table has relative_path and content, and may have file_path and others that are dropped. A
chunk has chunk_id, content, file_path, relative_path, start_line, end_line (from 1, inclusive) and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.config import PIPELINE, SplitConfig
from lodestrand.functions import text as X
from lodestrand.shipping import ship

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
    ]
)
COLUMNS = CHUNK.names
#: What refinement turns into Python objects at once: bytes of chunks (or one chunk), and pieces.
REFINED_BYTES = 1 << 20
PIECES_AT_ONCE = 4096


def explode_lines(files: DataFrame) -> DataFrame:
    """(relative_path, line_no, line), line numbers from 1."""
    parts = files.select("relative_path", F.posexplode(X.lines(F.col("content"))).alias("k", "line"))
    return parts.select("relative_path", (F.col("k") + 1).alias("line_no"), "line")


def windows(parts: Column, size: int, overlap: int) -> Column:
    """Windows of an array of lines as (start, end, text): start from 0, end exclusive, none blank.

    The last window is the first that reaches the last line."""
    size = max(size, 1)
    step = max(size - overlap, 1)
    n = F.size(parts)
    last = F.ceil(F.greatest(n - F.lit(size), F.lit(0)) / F.lit(step)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda w: F.struct(
            (w * step).alias("start"), F.least(w * step + size, n).alias("end"), F.array_join(F.slice(parts, w * step + 1, F.lit(size)), "\n").alias("text")
        ),
    )
    return F.filter(F.when(n > 0, cut).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>")), lambda w: ~X.is_blank(w["text"]))


def _files(files: DataFrame) -> DataFrame:
    path = F.col("file_path") if "file_path" in files.columns else F.lit("")
    return files.select(path.alias("file_path"), "relative_path", "content", X.extension(F.col("relative_path")).alias("ext"))


def line_chunks(files: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Chunks of size lines, neighbours sharing overlap lines."""
    cut = _files(files).withColumn("parts", X.lines(F.col("content")))
    each = cut.select("*", F.posexplode(windows(F.col("parts"), size, overlap)).alias("k", "w"))
    return each.select(
        F.concat_ws(":", "relative_path", F.lit("lines"), F.col("k")).alias("chunk_id"),
        F.col("w.text").alias("content"),
        "file_path",
        "relative_path",
        (F.col("w.start") + 1).alias("start_line"),
        F.col("w.end").alias("end_line"),
        X.language_of(F.col("ext")).alias("language"),
    )


def sections(files: DataFrame) -> DataFrame:
    """(file_path, relative_path, ext, section, start_line, end_line, content): what lies between the headings of a text; blank
    sections have no number."""
    parts = F.col("parts")
    cut = _files(files).withColumn("parts", X.lines(F.col("content"))).where(F.size(parts) > 0)
    heads = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: (k == 0) | X.is_heading(F.get(parts, k)))
    cut = cut.withColumn("heads", heads)
    spans = F.transform(F.col("heads"), lambda k, i: F.struct(k.alias("start"), F.coalesce(F.get(F.col("heads"), i + 1), F.size(parts)).alias("end")))
    texts = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array_join(F.slice(parts, s["start"] + 1, s["end"] - s["start"]), "\n").alias("text")))
    each = cut.select("file_path", "relative_path", "ext", F.posexplode(F.filter(texts, lambda s: ~X.is_blank(s["text"]))).alias("section", "s"))
    return each.select("file_path", "relative_path", "ext", "section", (F.col("s.start") + 1).alias("start_line"), F.col("s.end").alias("end_line"), F.col("s.text").alias("content"))


def markdown_chunks(files: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """A chunk per section, or windows of the sections that have more than size lines."""
    size = max(size, 1)
    own = sections(files).withColumn("parts", X.lines(F.col("content")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size("parts").alias("end"), F.col("content").alias("text")))
    short = F.size("parts") <= size
    cut = F.when(short, whole).otherwise(windows(F.col("parts"), size, overlap))
    each = own.select("*", short.alias("short"), F.posexplode(cut).alias("k", "w"))
    start = F.col("start_line") + F.col("w.start")
    return each.select(
        F.concat_ws(":", "relative_path", F.lit("md"), F.col("section"), F.when(~F.col("short"), F.col("k"))).alias("chunk_id"),
        F.col("w.text").alias("content"),
        "file_path",
        "relative_path",
        start.alias("start_line"),
        F.when(F.col("short"), F.col("end_line")).otherwise(F.least(F.col("start_line") + F.col("w.end") - 1, F.col("end_line"))).alias("end_line"),
        X.language_of(F.col("ext")).alias("language"),
    )


def fallback_chunks(files: DataFrame, config: SplitConfig = PIPELINE) -> DataFrame:
    """Chunks of files that have no syntax splitter: by headings in Markdown, by lines elsewhere."""
    ext = X.extension(F.col("relative_path"))
    plain = files.where(X.has_line_splitter(ext) & ~X.is_markdown(ext))
    marked = files.where(X.is_markdown(ext))
    size, overlap = config.lines_per_chunk, config.overlap_lines
    return line_chunks(plain, size, overlap).unionByName(markdown_chunks(marked, size, overlap))


def split_lines(text: str) -> list[str]:
    parts = text.split("\n")
    ended = [x[:-1] if x.endswith("\r") else x for x in parts[:-1]]
    return [*ended, parts[-1]] if parts[-1] else ended


def pack_lines(content: str, most: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """Greedy pieces of at most `most` bytes as (first line, end, text); a longer line is a piece alone.

    Blank lines at a piece's begin belong to its range, not to its text."""
    parts = split_lines(content)
    sizes = [len(x.encode("utf-8", "surrogatepass")) for x in parts]
    first = 0
    while first < len(parts):
        end, begin, used = first, first, 0
        while end < len(parts):
            more = sizes[end] + (1 if used else 0)
            if used and used + more > most:
                break
            if not used:
                begin = end
            used += more
            end += 1
            if used >= most:
                break
        yield first, end, "\n".join(parts[begin:end]) if used else ""
        if end >= len(parts):
            return
        first = end - overlap if end - overlap > first else end


def _refined(batch: pa.RecordBatch, most: int, overlap: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch's chunks, of which no more than PIECES_AT_ONCE are held."""
    kinds = [batch.schema.field(k).type for k in range(len(names))]
    own: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*own, strict=True))
        own.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    for chunk_id, content, path, relative, start, _, language in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True):
        for k, (a, b, text) in enumerate(pack_lines(content, most, overlap)):
            last = a + 1 if not text else b
            own.append((f"{chunk_id}_{k}", text, path, relative, start + a, start + last - 1, language))
            if len(own) >= PIECES_AT_ONCE:
                yield made()
    if own:
        yield made()


def refine(chunks: DataFrame, most: int, overlap: int = 0) -> DataFrame:
    """Chunks of more than `most` bytes cut at line ends; the others as they are, without becoming Python objects."""
    ship(chunks.sparkSession)
    names = COLUMNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pc.less_equal(pc.fill_null(pc.binary_length(batch.column(1)), 0), most)
            yield pa.RecordBatch.from_arrays(batch.filter(small).columns, names=names)
            large = batch.filter(pc.invert(small))
            sizes = np.cumsum(pc.binary_length(large.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < large.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + REFINED_BYTES, "right")))
                yield from _refined(large.slice(at, end - at), most, overlap, names)
                at = end

    return chunks.select(COLUMNS).mapInArrow(run, CHUNK)


def split(files: DataFrame, config: SplitConfig = PIPELINE) -> DataFrame:
    """All chunks of a files table: by syntax where the language has a splitter, else by headings or
    lines, refined by size. Files without an extension, unsupported ones and empty ones have none."""
    from lodestrand.operators.syntax import syntax_chunks

    some = files.where(F.col("content") != "")
    raw = fallback_chunks(some, config).unionByName(syntax_chunks(some))
    return refine(raw, config.max_chunk_bytes, config.overlap_lines)
