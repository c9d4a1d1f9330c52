"""Cutting texts into chunks: windows of lines, windows of sentences, sections of marked-up text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markup

LINES, OVERLAP, MOST_BYTES = 150, 0.15, 12_288
SENTENCE_CHARS = 1500
# Characters that a long line is cut behind.
BREAKS = ";,})]"


def split_line(line: str, most: int) -> list[str]:
    """Pieces of at most `most` characters: cut behind the last break character in the last fifth, else behind the last white space, else anywhere."""
    out = []
    while len(line) > most:
        head = line[:most]
        late = int(0.8 * most)
        cut = max(head.rfind(c) for c in BREAKS) + 1
        if cut <= late + 1:
            cut = max(head.rfind(c, 1) for c in " \t") + 1 or most
        out.append(line[:cut])
        line = line[cut:]
    return [*out, line] if line or not out else out


def windows_of(text: str, lines: int, overlap: float, most: int | None, between: str | None = None) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of the windows of a text, lines from 1; long lines are cut into several before they count.

    Lines end at any line end, a last one makes no line of its own, and an empty text has no windows. With `between`, lines are
    what stands between these characters, empty ones too. Without `most`, lines and windows are whole however long they are.
    """
    rows = text.splitlines() if between is None else text.split(between)
    if most is not None:
        rows = [piece for line in rows for piece in (split_line(line, most) if len(line.encode()) > most else [line])]
        # Bytes up to each line's end, with line feeds.
        ends = list(accumulate(len(row.encode()) + 1 for row in rows))
    start = 0
    while rows:
        end = min(start + lines, len(rows))
        if most is None:
            yield start + 1, end, "\n".join(rows[start:end])
        else:
            before = ends[start - 1] if start else 0
            end = min(end, max(start + 1, bisect_right(ends, before + most + 1, start)))
            yield start + 1, end, "\n".join(rows[start:end]).encode()[:most].decode("utf-8", "ignore")
        if end == len(rows):
            return
        start += max(1, int((end - start) * (1 - overlap)))


def line_windows(docs: DataFrame, key: str, text: str, lines: int = LINES, overlap: float = OVERLAP, most: int | None = MOST_BYTES, between: str | None = None) -> DataFrame:
    """(key, chunk_index, line_start, line_end, text): windows of at most `lines` lines and `most` bytes, each beginning a little before
    the last one ended. A line of more bytes is cut first; a window of one line that is still too long loses its end.

    `most` None is no limit of bytes. With `between`, lines are what stands between these characters, and only a null text has no windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for at, cuts in enumerate(batched(windows_of(body, lines, overlap, most, between), 1000)):
                    first, last, parts = zip(*cuts, strict=True)
                    index = [at * 1000 + i for i in range(len(cuts))]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(cuts), name.type), *(pa.array(x, pa.int64()) for x in (index, first, last)), pa.array(parts, pa.string())], [key, "chunk_index", "line_start", "line_end", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index long, line_start long, line_end long, text string")


def byte_pieces(text: Column, most: int = MOST_BYTES) -> Column:
    """Pieces of at most `most` UTF-8 bytes: whole for short texts, else of `most` / 4 characters, which never hold more bytes."""
    width = most // 4
    n = F.ceil(F.char_length(text) / width)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: F.substr(text, i * width + 1, F.lit(width)))
    return F.when(F.octet_length(text) <= most, F.array(text)).otherwise(many)


def sentence_windows(docs: DataFrame, key: str, sentences: Column, most: int = SENTENCE_CHARS) -> DataFrame:
    """(key, chunk_index, text): sentences in order, a new chunk wherever the next one would make more than `most` characters."""
    packed = F.aggregate(
        sentences,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).when(F.char_length(F.element_at(acc, -1)) + 1 + F.char_length(s) > most, F.array_append(acc, s)).otherwise(F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat_ws(" ", F.element_at(acc, -1), s))),
    )
    return docs.select(key, F.posexplode(packed).alias("i", "text")).select(key, F.col("i").cast("long").alias("chunk_index"), "text")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, level, header, path, text): what stands below each header, with the headers above it, its own last; text
    before the first header has level 0, an empty header and no path. Lines inside code fences are no headers. Null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "section_index", "level", "header", "path", "text"]
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = list(markup.sections(body)) if body and body.strip() else []
                if found:
                    level, header, path, parts = zip(*found, strict=True)
                    columns = [pa.array(range(len(found)), pa.int64()), pa.array(level, pa.int32()), pa.array(header), pa.array(path, pa.list_(pa.string())), pa.array(parts)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), name.type), *columns], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, section_index long, level int, header string, path array<string>, text string")
